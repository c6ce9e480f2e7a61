"""From captured payloads to items. A source is a pure transform of a raw table; fetching is someone else's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import item_id

COLUMNS = ("id", "source_type", "title", "url", "content", "author", "published_at", "metadata", "profile", "ord")


def metadata(**values: Column | str | None) -> Column:
    """A map of the values that aren't null, as strings; arrays and structures as JSON."""
    pairs = [x for k, v in values.items() if v is not None for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")


def item(source: str, kind: Column | str, native: Column, *, title: Column, url: Column, content: Column, author: Column, published: Column, meta: Column, order: Column, profile: Column | None = None) -> list[Column]:
    route = F.lit(None).cast("array<string>") if profile is None else profile
    values = (item_id(source, kind, native), F.lit(source), title, url, content, author, published, meta, route, order)
    return [v.alias(n) for n, v in zip(COLUMNS, values, strict=True)]


def or_text(x: Column, default: str | Column) -> Column:
    """The text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def joined(*parts: Column, by: str = "\n\n") -> Column:
    """The parts that say something."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), by)


def all_sources(outcomes: dict[str, DataFrame]) -> DataFrame:
    """Items of all sources, in the order of registration and then each one's own."""
    tables = [df.select(*COLUMNS[:-1], F.struct(F.lit(k).alias("source"), F.col("ord").alias("row")).alias("__o")) for k, df in enumerate(outcomes.values())]
    if not tables:
        raise ValueError("no sources")
    # 2^40 rows a source
    return reduce(DataFrame.unionByName, tables).withColumn("ord", F.col("__o.source").cast("long") * (1 << 40) + F.col("__o.row")).drop("__o")


def fetch_outcomes(spark, outcomes: dict[str, DataFrame | Exception]) -> DataFrame:
    """``(source, status, item_count, error)``: what failed is a row like the others."""
    rows = []
    for name, got in outcomes.items():
        if isinstance(got, Exception):
            rows.append((name, "failure", 0, str(got)))
        else:
            n = got.count()
            rows.append((name, "success" if n else "empty", n, None))
    return spark.createDataFrame(rows, "source string, status string, item_count long, error string")


def selected_sources(known: Column, wanted: Column) -> Column:
    """Valid names in the order wanted, and unknown ones apart; nothing wanted means all."""
    every = F.size(F.coalesce(wanted, F.array().cast("array<string>"))) == 0
    return F.struct(F.when(every, known).otherwise(F.array_intersect(wanted, known)).alias("valid"), F.when(every, F.array().cast("array<string>")).otherwise(F.array_except(wanted, known)).alias("unknown"))
