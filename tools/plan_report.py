"""Per-query physical plan census after execution (final AQE plans).

usage: python tools/plan_report.py [sf_dir] [name ...]
Columns: shuffles (Exchange hashpartitioning/rangepartitioning/single),
broadcasts, parquet scans, sort-merge joins, broadcast joins, window-group
limits (top-k cut before a shuffle), Python nodes.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def final_only(plan: str) -> str:
    """Drop every '== Initial Plan ==' subtree of an adaptive plan string."""
    out, skip_indent = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :|+-"))
        if skip_indent is not None:
            if indent >= skip_indent:
                continue
            skip_indent = None
        if "== Initial Plan ==" in line:
            skip_indent = indent
            continue
        out.append(line)
    return "\n".join(out)


def census(plan: str) -> dict[str, int]:
    plan = final_only(plan)
    return {
        "shuffle": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "bcast": plan.count("BroadcastExchange"),
        "scan": len(re.findall(r"FileScan parquet|Scan parquet", plan)),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "wgl": plan.count("WindowGroupLimit"),
        "python": len(re.findall(r"MapInArrow|MapInPandas|FlatMapGroupsInPandas|BatchEvalPython|ArrowEvalPython", plan)),
        "pairs": len(re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", plan)),
    }


if __name__ == "__main__":
    from reelspark.plans.queries import QUERIES
    from reelspark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    keys = None
    for name in names:
        df = QUERIES[name](spark, sf)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()  # runs this query execution, so AQE's final plan is recorded
        plan = qe.executedPlan().toString()
        assert "isFinalPlan=true" in plan or "AdaptiveSparkPlan" not in plan, name
        c = census(plan)
        if keys is None:
            keys = list(c)
            print(f"{'query':26s} " + " ".join(f"{k:>6s}" for k in keys))
        print(f"{name:26s} " + " ".join(f"{c[k]:6d}" for k in keys), flush=True)
