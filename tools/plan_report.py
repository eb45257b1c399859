"""Write PLANS.md: the physical-plan skeleton of the library's registered queries
(the training-data queries run jobs of their own while they are built).

For each query: the operators that decide cost at scale (exchanges, joins,
aggregates, top-k, windows, expands) and what reaches the Parquet scan
(pushed filters, read schema). Plans are built, not executed.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

KEEP = re.compile(
    r"^\s*[:+\- ]*(\*\(\d+\) )?("
    r"Exchange [^\[]*|BroadcastExchange.*|BroadcastHashJoin.*|SortMergeJoin.*|ShuffledHashJoin.*|"
    r"HashAggregate.*|ObjectHashAggregate.*|Expand.*|TakeOrderedAndProject.*|Window.*|"
    r"Union.*|Generate.*|Sort \[.*|CollectLimit.*|GlobalLimit.*|FileScan.*)")


def skeleton(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        m = KEEP.match(line)
        if not m:
            continue
        text = line.rstrip()
        text = re.sub(r"#\d+L?", "", text)
        if "FileScan" in text:
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text)
            schema = re.search(r"ReadSchema: (struct<[^>]*>)", text)
            head = text.split("FileScan")[0] + "FileScan parquet"
            text = head + (f" PushedFilters=[{pushed.group(1)}]" if pushed and pushed.group(1) else "")
            text += f" ReadSchema={schema.group(1)}" if schema else ""
        out.append(text[:220])
    return out


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    from relyscope import registry
    from relyscope.session import local_session

    spark = local_session()
    print("# PLANS\n")
    print(f"Physical plans of the registered queries (built on `{sf_dir}`, local[8], not "
          "executed), cut to the operators that matter at scale. Generated by "
          "`python tools/plan_report.py`.\n")
    for name, fn in registry.build().items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        print(f"## {name}\n\n```")
        print("\n".join(skeleton(plan)))
        print("```\n")


if __name__ == "__main__":
    main(sys.argv[1:])
