"""Real-table path: schema-checked scans and partition pruning on detected_date."""

import os

import pytest
from pyspark.sql import functions as F

from relyscope.operators import incidents as I
from relyscope.plans import rollup as RU
from relyscope.sources.fixtures import load_incidents, load_metrics
from relyscope.sources.tables import read_incidents, read_metrics, write_snapshot

from .conftest import SMALL


def test_partitioned_table_is_pruned(spark, tmp_out):
    path = os.path.join(tmp_out, "incidents")
    write_snapshot(load_incidents(spark, SMALL), path, partition_by=("detected_date",))
    inc = read_incidents(spark, path)
    plain = I.overview_kpis(inc, as_of="2024-01-31", days=7).first()
    pruned_df = I.overview_kpis(inc, as_of="2024-01-31", days=7, date_partitioned=True)
    assert pruned_df.first() == plain
    plan = pruned_df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(detected_date" in plan
    assert "(detected_date" in plan and ">= 2024-01-24" in plan


def test_schema_check_rejects_wrong_input(spark, tmp_out):
    path = os.path.join(tmp_out, "bad")
    load_incidents(spark, SMALL).drop("resolved_at").write.parquet(path)
    with pytest.raises(ValueError, match="resolved_at"):
        read_incidents(spark, path)
    path2 = os.path.join(tmp_out, "bad2")
    load_metrics(spark, SMALL).withColumn("metric_value", F.col("metric_name")).write.parquet(path2)
    with pytest.raises(TypeError, match="metric_value"):
        read_metrics(spark, path2)


def test_materialised_rollup_answers_match(spark, tmp_out):
    inc = load_incidents(spark, SMALL)
    path = RU.write_rollup(RU.incident_daily_rollup(inc), os.path.join(tmp_out, "rollup"))
    stored = spark.read.parquet(path)
    for direct, from_rollup in [(I.overview_kpis, RU.overview_kpis),
                                (I.workspace_rollup, RU.workspace_rollup)]:
        a = sorted(map(tuple, direct(inc, as_of="2024-01-31", days=7).collect()))
        b = sorted(map(tuple, from_rollup(stored, as_of="2024-01-31", days=7).collect()))
        assert a == b


def test_registered_tables_are_read_by_partition(spark):
    from relyscope import registry

    plan = registry.build()["overview_kpis_table"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(detected_date" in plan and ">= 2024-01-24" in plan


def test_swap_replaces_the_touched_partitions_only(spark, tmp_out):
    import glob

    from relyscope.operators import resolve as R

    table, staging = os.path.join(tmp_out, "table"), os.path.join(tmp_out, "staging")
    write_snapshot(load_incidents(spark, SMALL), table, ("detected_date",))
    inc = read_incidents(spark, table)
    before = {r.incident_id: r for r in inc.collect()}
    opened = sorted((r for r in before.values() if r.resolved_at is None), key=lambda r: r.incident_id)[0]
    files = {p: os.path.getmtime(p) for p in glob.glob(f"{table}/*/*.parquet")}
    asked = spark.createDataFrame([(opened.incident_id,), ("no such id",)], "incident_id string")
    R.swap_resolved_partitions(inc, asked, table, staging)
    after = {r.incident_id: r for r in read_incidents(spark, table).collect()}
    assert after.keys() == before.keys()
    assert {i for i in after if after[i] != before[i]} == {opened.incident_id}
    assert after[opened.incident_id].resolved_at is not None
    day = f"detected_date={opened.detected_date}"
    kept = {p: t for p, t in files.items() if day not in p}
    assert kept and all(os.path.getmtime(p) == t for p, t in kept.items())


def test_no_stand_in_for_the_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from relyscope.session import shared_folder

    context = N(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(N(conf=N(get=lambda k, d=None: d), sparkContext=context))
