"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = least.select("u", F.col("m").alias("v"))
    rest = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(own).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) pairs of comparable ids -> (node, root), root the smallest id reachable; nodes without an edge are absent.

    Every round is written to the shared folder and the one before deleted, so lineage stays short and a lost executor costs one round. A hub's edges
    meet only in a map-side-combined minimum and in a join that adaptive execution can split. Null ends are dropped,
    self-loops and repeated edges ignored; an empty table gives no rows.
    """
    now = written(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = None
    for _ in range(rounds):
        last, now = now, written(_star(_star(now, True), False), "edges")
        discard(last)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == got:
            break
        mark = got
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
    out._lodewright_path = now._lodewright_path
    return out
