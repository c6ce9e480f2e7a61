"""Connected components by alternating large-star and small-star rounds on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace


def _digest(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(edges: DataFrame, work: Workspace, name: str = "cc", max_rounds: int = 100) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(id, comp)``: each id with the smallest id it reaches.

    Ids without an edge to another id are left out; rows with a null end are ignored. No
    neighbour list is ever gathered: a vertex's minimum is a partial aggregate and the rest are
    joins, so a hub's edges may be split over tasks. Every round is written to the shared folder, in files
    for the number of edges, which never grows; ``edges`` is read once for its number and once more, so
    it should be kept.
    """
    a, b = F.col("a"), F.col("b")
    n = edges.count()
    e = work.save(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{name}-0", n)
    seen, last = _digest(e), f"{name}-0"
    for k in range(1, max_rounds + 1):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = work.save(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-{k}l", 2 * n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e, now = work.save(small.distinct(), f"{name}-{k}", 2 * n), f"{name}-{k}"
        work.drop(f"{name}-{k}l", last)
        last, before, seen = now, seen, _digest(e)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
