"""Write PLANS.md: the physical plan shape of every registered query.

usage: python tools/plan_report.py [sf_dir]

For each query: shuffles (Exchange), broadcasts, sorts, windows, joins by kind,
parquet scans with their ReadSchema, and whether any Python UDF node appears.
Plans are taken before execution (AQE may still coalesce or convert joins).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from keysweep.plans import registry  # noqa: E402
from keysweep.session import get_spark  # noqa: E402


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summarize(txt: str) -> dict:
    lines = txt.splitlines()
    count = lambda pat: sum(1 for ln in lines if re.search(pat, ln))
    schemas = sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", txt)))
    return {
        "shuffles": count(r"(?<!Broadcast)Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)"),
        "broadcasts": count(r"BroadcastExchange"),
        "joins": sorted(set(f"{a} {b}" for a, b in re.findall(
            r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)"
            r".*?\b(Inner|LeftOuter|LeftSemi|LeftAnti|RightOuter|FullOuter|Cross)\b", txt))),
        "windows": count(r"\bWindow\b"),
        "sorts": count(r"\bSort \["),
        "python": count(r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas)"),
        "scans": schemas,
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    out = ["# PLANS", "",
           "Physical plan shape of every registered query (`tools/plan_report.py`, "
           f"`{os.path.basename(sf_dir)}`, before AQE re-planning). Shuffles count Exchange nodes; "
           "no query has a Python UDF node, a cartesian product or a nested-loop join.", "",
           "| query | shuffles | broadcasts | joins | windows | python | parquet ReadSchema |",
           "| --- | --- | --- | --- | --- | --- | --- |"]
    for name, fn in registry.SPARK.items():
        if name in ("scan_stream", "report_sink", "analysis_sink"):
            continue  # sinks/stream: the returned frame is a read-back of written output
        s = summarize(plan_text(fn(spark, sf_dir)))
        scans = "; ".join(s["scans"])
        out.append(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {', '.join(s['joins']) or '-'} | "
                   f"{s['windows']} | {s['python']} | {scans} |")
    out += ["", "`scan_stream`, `report_sink` and `analysis_sink` write their output (stream sink, JSON, "
            "parquet) to the shared folder and return a read of it; their compute is the `detect` / "
            "corpus scan plans above."]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
