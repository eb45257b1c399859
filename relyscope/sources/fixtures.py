"""Test inputs derived from the driver tables.

The library itself reads real ``incidents`` / ``metric_insights`` tables (see
``tables.py``). For tests, the oracle and the bench those two tables are
projections of ``events`` and ``lineitem`` (FIXTURES.md). Every column is one
SQL expression that parses identically in Spark and DuckDB, so the Spark side
runs them with ``selectExpr`` (one fused projection over the scan) and the
oracle side pastes the same text into a ``WITH`` clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The fixture definitions of FIXTURES.md, one expression per
# output column, in output order.
INCIDENT_EXPRS: tuple[str, ...] = (
    "concat('INC-', lpad(CAST(event_id AS STRING), 8, '0')) AS incident_id",
    "concat('ws-', CAST(user_id % 12 AS STRING)) AS workspace_id",
    "concat('team-', CAST(user_id % 7 AS STRING)) AS team_name",
    "concat('job_', event_type, '_', CAST(user_id % 25 AS STRING)) AS job_name",
    """CASE event_id % 4 WHEN 0 THEN '{"trace": 1} **Driver** ran   out of memory'
                    WHEN 1 THEN 'Upstream table late {"lag": 9}'
                    WHEN 2 THEN '' END AS root_cause""",
    """CASE WHEN event_id % 97 = 0 THEN NULL
       ELSE CASE (event_id * 7 + user_id) % 8 WHEN 0 THEN 'OOM' WHEN 1 THEN 'CLUSTER_FAILURE'
         WHEN 2 THEN 'TIMEOUT' WHEN 3 THEN 'PERMISSION' WHEN 4 THEN 'DEPENDENCY'
         WHEN 5 THEN 'DATA_QUALITY' WHEN 6 THEN 'NETWORK' ELSE 'UNKNOWN' END END AS cause_category""",
    "CASE WHEN event_id % 53 = 0 THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) / 100 END AS confidence",
    """CASE event_id % 3 WHEN 0 THEN 'Increase driver memory and repartition the input'
                    WHEN 1 THEN 'Retry' END AS suggested_fix""",
    """CASE event_id % 6
    WHEN 0 THEN CASE WHEN user_id % 12 >= 8 THEN 'high' ELSE 'medium' END
    WHEN 1 THEN 'medium' WHEN 2 THEN 'low'
    WHEN 3 THEN '{"SLA_AT_RISK": true, "SEVERITY": "HIGH", "MESSAGE": "Dashboard stale"}'
    WHEN 4 THEN '{not json' END AS business_impact""",
    """CASE WHEN event_id % 89 = 0 THEN NULL
       ELSE event_id % 3 = 1 AND user_id % 2 = 0 END AS auto_resolved""",
    "CASE WHEN user_id % 12 < 4 OR event_id % 3 <> 0 THEN CAST(event_id % 240 AS INT) END AS mttr_minutes",
    "ts AS detected_at",
    "CAST(ts AS DATE) AS detected_date",
    """CASE WHEN user_id % 12 < 4 OR event_id % 3 <> 0
       THEN ts + INTERVAL '1' MINUTE * CAST(event_id % 240 AS INT) END AS resolved_at""",
    "ts + INTERVAL '1' MINUTE * 2 AS created_at",
)

METRIC_EXPRS: tuple[str, ...] = (
    """concat('MI-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
         CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
         CAST(CAST(l_shipdate AS DATE) AS STRING)) AS insight_id""",
    "concat('ws-', CAST(l_suppkey % 20 AS STRING)) AS workspace_id",
    "concat('cluster-', CAST(l_partkey % 50 AS STRING)) AS cluster_name",
    """CASE WHEN l_partkey % 31 = 0 THEN NULL
       ELSE concat('cat_', CAST(l_partkey % 13 AS STRING)) END AS metric_category""",
    "concat('metric_', CAST(l_linenumber AS STRING)) AS metric_name",
    """CASE l_partkey % 11 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(0.0005 AS DOUBLE)
       WHEN 2 THEN CAST(12345678 AS DOUBLE) WHEN 3 THEN CAST(10000000000000000 AS DOUBLE)
       WHEN 4 THEN CAST(l_quantity AS DOUBLE) / 1000000 WHEN 5 THEN -CAST(l_quantity AS DOUBLE) / 8
       ELSE CAST(l_quantity AS DOUBLE) END AS metric_value""",
    "CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN '%' ELSE 'GB' END AS metric_unit",
    """CASE WHEN l_orderkey % 41 = 0 THEN NULL
       ELSE CASE l_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'MEDIUM'
         WHEN 3 THEN 'low' ELSE 'HIGH' END END AS severity""",
    "CASE l_returnflag WHEN 'A' THEN 'SPIKE' WHEN 'R' THEN 'DROP' ELSE 'DRIFT' END AS anomaly_type",
    "CASE l_orderkey % 3 WHEN 0 THEN '**Resize** the cluster to a larger node type' WHEN 1 THEN 'Restart' END AS suggested_fix",
    """CASE l_orderkey % 4 WHEN 0 THEN 'Reports delayed' WHEN 1 THEN '{"severity": "low", "team": "core"}'
                      WHEN 2 THEN '{x' END AS business_impact""",
    "CASE l_linestatus WHEN 'F' THEN 'OOM' ELSE 'UNKNOWN' END AS cause_category",
    "l_discount * 10 AS confidence",
    "l_shipdate AS timestamp",
)

# Raw texts over ``documents`` for the text rules: objects before, after and inside
# whole texts, interior objects over 200 characters, stars, Unicode spaces.
RAW_TEXT = """CASE doc_id % 7
    WHEN 0 THEN concat('{"trace": ', CAST(n_chars AS STRING), '} ', text)
    WHEN 1 THEN concat(text, ' {"lag": 9}')
    WHEN 2 THEN concat('**', text, '**  {x} tail ', CAST(doc_id AS STRING))
    WHEN 3 THEN concat('\u3000\u00a0', text, '\u2003', lang, '\u2028')
    WHEN 4 THEN concat('a {', text, '} z {short} ', CAST(doc_id AS STRING))
    ELSE text END"""
# Impact texts over ``documents``: every field in both spellings, true and false
# values, numbers with a fraction or exponent, lists, nested and broken objects, keys
# given twice.
RAW_IMPACT = """CASE doc_id % 15
    WHEN 0 THEN concat('{"SLA_AT_RISK": true, "SEVERITY": "HIGH", "MESSAGE": "Load ', CAST(doc_id AS STRING), ' late"}')
    WHEN 1 THEN concat('{"sla_at_risk": 1, "severity": "critical", "team": "', source, '"}')
    WHEN 2 THEN concat('{"REGION": ', CAST(n_chars AS STRING), '.50, "TEAM": 1.0, "affected_pipelines": 1e3}')
    WHEN 3 THEN concat('{"AFFECTED_PIPELINES": "p', CAST(doc_id AS STRING), '", "region": 0.0, "team": 0}')
    WHEN 4 THEN concat('{"message": "", "DESCRIPTION": "doc ', CAST(doc_id AS STRING), '", "SEVERITY": "low"}')
    WHEN 5 THEN concat('{"description": "d', CAST(doc_id AS STRING), '", "sla_at_risk": false, "REGION": 12345678.0}')
    WHEN 6 THEN concat('free text ', CAST(doc_id AS STRING), ' {"a": 1}')
    WHEN 7 THEN concat('{"SEVERITY": "medium", "x": [1, 2]} trailing ', CAST(doc_id AS STRING))
    WHEN 8 THEN concat('{broken ', CAST(doc_id AS STRING))
    WHEN 9 THEN '{"TEAM": [], "MESSAGE": {}, "severity": null, "REGION": ["eu"]}'
    WHEN 10 THEN concat('  {"MESSAGE": "m ', CAST(doc_id AS STRING), '", "x": {"y": 1}}  ')
    WHEN 11 THEN concat('{"TEAM": -0.25, "REGION": ', CAST(doc_id AS STRING), '}')
    WHEN 12 THEN concat('{"TEAM": "first", "SEVERITY": "low", "TEAM": "last ', CAST(doc_id AS STRING), '", "SEVERITY": "HIGH"}')
    WHEN 13 THEN concat('{"MESSAGE": "given", "REGION": 1, "MESSAGE": "", "REGION": ', CAST(doc_id AS STRING), '.0}') END"""

# Reporting dates the fixtures are built around (FIXTURES.md).
INCIDENTS_AS_OF = "2024-01-31"
METRICS_AS_OF = "2001-11-05"

# Resolution batch for ``incident_resolve``: every incident that is open in the
# whole table gets two resolution requests (a repeat, so the latest must win),
# one and two hours after it was detected. Ids are data-derived, so the batch
# grows with the table.
RESOLUTION_EXPRS: tuple[str, ...] = (
    "incident_id",
    "detected_at + INTERVAL '1' MINUTE * 60 * k AS resolved_at",
)

# Lookup batch for ``incident_lookup``: ids built from every events row with
# the event id doubled, so about half of them exist and half do not.
LOOKUP_EXPRS: tuple[str, ...] = (
    "concat('INC-', lpad(CAST(event_id * 2 AS STRING), 8, '0')) AS incident_id",
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def incidents_from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(*INCIDENT_EXPRS)


def metrics_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(*METRIC_EXPRS)


def load_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_from_events(_read(spark, sf_dir, "events"))


def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_from_lineitem(_read(spark, sf_dir, "lineitem"))


def resolutions_from_incidents(incidents: DataFrame) -> DataFrame:
    """Two resolution requests per open incident (k = 1, 2 hours)."""
    from pyspark.sql import functions as F

    reps = incidents.where(F.col("resolved_at").isNull()).select(
        "incident_id", "detected_at", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")
    )
    return reps.selectExpr(*RESOLUTION_EXPRS)


def lookup_ids_from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(*LOOKUP_EXPRS)


def load_lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_ids_from_events(_read(spark, sf_dir, "events"))


# ---- SQL text for the DuckDB oracle (same expressions) ---------------------

def incidents_cte() -> str:
    return "incidents AS (SELECT " + ",\n  ".join(INCIDENT_EXPRS) + "\nFROM events)"


def metrics_cte() -> str:
    return "metric_insights AS (SELECT " + ",\n  ".join(METRIC_EXPRS) + "\nFROM lineitem)"


def resolutions_cte() -> str:
    return (
        "resolutions AS (SELECT " + ", ".join(RESOLUTION_EXPRS)
        + " FROM (SELECT incident_id, detected_at, unnest([1, 2]) AS k"
        + " FROM incidents WHERE resolved_at IS NULL) o)"
    )


def lookup_cte() -> str:
    return "lookup_ids AS (SELECT " + ", ".join(LOOKUP_EXPRS) + " FROM events)"
