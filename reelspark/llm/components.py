"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import staged


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and a sum of hashes: equal for equal edge sets, whatever their order."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of any sortable type -> (node, root) for every node that is
    not the smallest of its component.

    Each round writes its edges and reads them back; rounds grow with the
    logarithm of a component's width.  A node of many edges costs a partial
    aggregate and a join that Spark can split.
    """
    now = staged(edges.select("u", "v").filter("u <> v").distinct(), "cc")
    mark = _fingerprint(now)
    while mark[0]:
        after = staged(_small_star(_large_star(now)), "cc")
        new = _fingerprint(after)
        if new == mark:
            break
        now, mark = after, new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, root) of earlier edges, brought up to date with further (u, v) edges.

    The new edges are seen between components, so only what they join is worked on.
    """
    if roots is None:
        return components(edges)
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("u", "v"))
    between = edges.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    moved = components(between)
    onward = moved.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    kept = roots.join(onward, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return staged(kept.unionByName(moved), "cc-merged")
