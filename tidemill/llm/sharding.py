"""Proportional stratified interleaving into shards, in native column expressions.

Rows are shuffled by a seeded hash within each source and given the fractional rank
``(2 * rank - 1) / (2 * rows of the source)``; sorted by it, every stretch of rows has the mixture
of the whole, and the sequence is cut into shards whose counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ._common import Workspace

#: Rows that one bucket of a rank holds on average; no source or shard is ever sorted by one task.
BUCKET_ROWS = 4000
#: Buckets whose counts one window sums up; beyond, sums of so many buckets are summed up themselves.
WIDE = 4096


def _has_order(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_has_order(f.dataType) for f in kind.fields)
    return _has_order(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def _ties(rows: DataFrame) -> list[Column]:
    """The columns of ``row`` as sort keys: those of kinds without an order by their JSON."""
    at = [(F.col("row").getField(f.name), f.dataType) for f in rows.schema]
    return [c if _has_order(kind) else F.to_json(F.struct(c.alias("x"))) for c, kind in at]


def _ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str, work: Workspace) -> DataFrame:
    """``df`` with ``name``: the rank from 1 within ``group``, where ``order`` begins with what ``bucket`` rises with.

    Offsets come from counts by (group, bucket), so a sort sees one bucket at a time; the counts are summed up in two
    levels, so that no window sees all buckets of a large table.
    """
    df = df.withColumn("bucket", bucket)
    counts = work.save(df.groupBy(*group, "bucket").agg(F.count("*").alias("n")).withColumn("wide", F.floor(F.col("bucket") / WIDE)), f"{name}-counts")

    def before(within: list[str], at: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*within).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    wide = counts.groupBy(*group, "wide").agg(F.sum("n").alias("n"))
    wide = wide.select(*group, "wide", before(group, "wide").alias("far"))
    offsets = counts.select(*group, "bucket", "wide", before([*group, "wide"], "bucket").alias("near")).join(wide, [*group, "wide"]).select(*group, "bucket", (F.col("near") + F.col("far")).alias("before"))
    within = Window.partitionBy(*group, "bucket").orderBy(*order)
    return df.withColumn("at", F.row_number().over(within)).join(offsets, [*group, "bucket"]).withColumn(name, F.col("before") + F.col("at")).drop("bucket", "before", "at")


def interleaved(rows: DataFrame, *, shards: int = 8, source_col: str = "source", id_col: str = "doc_id", seed: str = "tidemill") -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, gapless in a shard).

    Law ``rows``: counts of shards differ by one at most. Copies aren't held together: rows with equal texts go
    where their ranks fall, since the method's law is the mixture. A null source is a source of its own. The
    order is that of the MD5 of seed and id; rows that tie (repeated or null ids) are ordered by all
    their other columns, of any type, so only equal rows are interchangeable. No row is dropped; an empty table
    gives an empty result. Columns ``shard`` and ``slot`` that come in are replaced, all others stay.
    """
    work = Workspace(rows.sparkSession, "shard")
    rows = rows.drop("shard", "slot")
    n = rows.count()
    buckets = max(1, n // BUCKET_ROWS)
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("-"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    keyed = rows.select(source.alias("from"), key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranked = _ranked(keyed, ["from"], F.floor(first * buckets / (1 << 32)).cast("long"), [F.col("key"), *_ties(rows)], "rank", work)
    totals = keyed.groupBy("from").agg(F.count("*").alias("total"))
    ranked = work.save(ranked.join(totals, "from").withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("total"))).drop("total", "rank"), "ranked")
    placed = _ranked(ranked.withColumn("all", F.lit(0)), ["all"], F.floor(F.col("fraction") * buckets).cast("long"), [F.col("fraction"), F.col("key"), F.col("from"), *_ties(rows)], "place", work)
    placed = placed.withColumn("shard", F.expr(f"cast((place - 1) * {shards} div {max(n, 1)} as int)"))
    return placed.select("row.*", "shard", (F.col("place") - 1 - F.expr(f"(cast(shard as long) * {n} + {shards - 1}) div {shards}")).alias("slot"))
