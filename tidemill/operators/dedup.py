"""Merging and de-duplication: keep-first, cross-source merge, topic merge, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

#: Fixed value: how merged contents are marked.
FROM = "\n\n--- From {} ---\n"


def keep_first(rows: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """The first row of each key by ``order``; a key of nulls is a key like any other."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def route_of(profile: Column) -> Column:
    """The requested route as a key: trimmed, in order; null or blank is ``auto``. One name and a list of it are alike only if so stored."""
    trimmed = F.transform(profile, lambda x: F.btrim(x, F.lit(" \t\n\r\f\x0b")))
    name = F.array_join(trimmed, "\x1f")
    return F.when(profile.isNull() | (name == ""), F.lit("auto")).otherwise(name)


def is_falsy(value: Column) -> Column:
    """JSON values that a fill replaces: null, ``""``, 0, false, ``[]`` and ``{}``."""
    return value.isNull() | value.isin("", "null", '""', "0", "0.0", "-0.0", "false", "[]", "{}")


def filled(primary: Column, other: Column) -> Column:
    """``primary``'s metadata with what is missing or falsy there taken from ``other``."""
    fill = F.map_zip_with(F.coalesce(primary, F.create_map().cast("map<string,string>")), F.coalesce(other, F.create_map().cast("map<string,string>")), lambda k, a, b: F.when(is_falsy(a), F.coalesce(b, a)).otherwise(a))
    return fill


def merged_across_sources(items: DataFrame) -> DataFrame:
    """Items of one URL identity and route become one.

    It stands where the first of them stood (``ord``). The richest content wins, the first at ties;
    metadata is filled in the order of the input; other contents are appended, in order, unless what
    has been put together so far holds them or the winner's own is empty. ``merged_sources`` and
    ``members`` are in order of first appearance; ``merged_sources`` is null for single items.

    Groups are one row's array, so a group is as large as the copies of one link, not of a source.
    """
    key = items.withColumn("__key", urls.merge_key(F.col("url"))).withColumn("__route", route_of(F.col("profile")))
    row = F.struct("ord", *[c for c in items.columns if c != "ord"])
    groups = key.groupBy("__key", "__route").agg(F.array_sort(F.collect_list(row), lambda a, b: F.sign(a["ord"] - b["ord"]).cast("int")).alias("g"))
    size = F.transform("g", lambda x: F.length(F.coalesce(x["content"], F.lit(""))))
    groups = groups.withColumn("n", F.size("g")).withColumn("at", F.array_position(size, F.array_max(size)).cast("int"))
    groups = groups.withColumn("p", F.element_at("g", F.col("at")))

    def content(p: Column, g: Column, at: Column) -> Column:
        numbered = F.transform(g, lambda x, i: F.struct(x["content"].alias("content"), x["source_type"].alias("source"), (i + 1).alias("i")))
        others = F.filter(numbered, lambda x: (x["i"] != at) & (F.coalesce(x["content"], F.lit("")) != ""))
        start = F.coalesce(p["content"], F.lit(""))
        return F.aggregate(others, start, lambda acc, x: F.when((acc != "") & ~F.contains(acc, x["content"]), F.concat(acc, F.lit("\n\n--- From "), x["source"], F.lit(" ---\n"), x["content"])).otherwise(acc))

    metadata = F.aggregate("g", F.coalesce(F.col("p.metadata"), F.create_map().cast("map<string,string>")), lambda acc, x: filled(acc, x["metadata"]))
    plain = [F.col(f"p.{c}").alias(c) for c in items.columns if c not in ("ord", "content", "metadata")]
    sources = F.array_distinct(F.transform("g", lambda x: x["source_type"]))
    return groups.select(
        *plain,
        F.element_at("g", 1)["ord"].alias("ord"),
        F.when(F.col("n") == 1, F.col("p.content")).otherwise(content(F.col("p"), F.col("g"), F.col("at"))).alias("content"),
        F.when(F.col("n") == 1, F.col("p.metadata")).otherwise(metadata).alias("metadata"),
        F.when(F.col("n") > 1, sources).alias("merged_sources"),
        F.array_distinct(F.transform("g", lambda x: x["id"])).alias("members"),
    )


def merged_topics(items: DataFrame, groups: DataFrame, by: str | None = None) -> DataFrame:
    """``items(pos, id, content, source_type, ...)`` merged by proposed ``groups(group_id, members)`` of positions.

    The first member keeps, the others go; groups whose first member is out of range, and members that
    are out of range or the first itself, count for nothing. A dropped item may still give or take in a
    later group, so contents are folded in the order of the groups. Positions run from 0 within the table, or
    within each value of the column ``by``, which both tables then have; ``lineage`` lists the ids that went into each survivor.
    """
    keys = [] if by is None else [by]
    n = items.groupBy(*keys).agg(F.count("*").alias("__count"))
    counted = groups.join(n, keys) if keys else groups.crossJoin(F.broadcast(n))
    valid = counted.where((F.size("members") >= 2) & (F.element_at("members", 1) >= 0) & (F.element_at("members", 1) < F.col("__count")))
    flat = valid.select(*keys, "group_id", F.element_at("members", 1).alias("keep"), F.posexplode(F.slice("members", 2, F.size("members"))).alias("rank", "gone"), "__count").where("gone >= 0 and gone < __count and gone <> keep").drop("__count")
    given = flat.join(items.select(*keys, F.col("pos").alias("gone"), F.col("id").alias("gone_id"), F.col("content").alias("gone_content"), F.col("source_type").alias("gone_source")), [*keys, "gone"])
    gifts = given.groupBy(*keys, F.col("keep").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("group_id", "rank", "gone_id", "gone_content", "gone_source"))).alias("gifts"))

    def fold(acc: Column, x: Column) -> Column:
        add = F.concat(F.coalesce(acc, F.lit("")), F.lit("\n\n--- From "), x["gone_source"], F.lit(" ---\n"), x["gone_content"])
        return F.when((F.coalesce(x["gone_content"], F.lit("")) != "") & ~F.contains(F.coalesce(acc, F.lit("")), x["gone_content"]), add).otherwise(acc)

    kept = items.join(flat.select(*keys, F.col("gone").alias("pos")).distinct(), [*keys, "pos"], "left_anti").join(gifts, [*keys, "pos"], "left")
    content = F.when(F.col("gifts").isNull(), F.col("content")).otherwise(F.aggregate("gifts", F.col("content"), fold))
    lineage = F.array_distinct(F.concat(F.array("id"), F.coalesce(F.transform("gifts", lambda x: x["gone_id"]), F.array().cast("array<string>"))))
    return kept.withColumn("content", content).withColumn("lineage", lineage).drop("gifts")


def two_hop_lineage(selected: DataFrame, topic: DataFrame, url: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``selected(id, ord)`` with the snapshots that went into each, over two merges.

    ``topic(id, members)`` then ``url(id, members)``; an id without a row stands for itself. The result
    ``(id, ord, snapshot_ids)`` has each once, in order; ``missing`` counts members without a snapshot.
    """
    first = selected.join(topic, "id", "left").select("id", "ord", F.posexplode(F.coalesce("members", F.array("id"))).alias("i", "m1"))
    second = first.join(url.withColumnRenamed("id", "m1"), "m1", "left").select("id", "ord", "i", F.posexplode(F.coalesce("members", F.array("m1"))).alias("j", "m2"))
    found = second.join(snapshots.select(F.col("item_id").alias("m2"), "snapshot_id"), "m2", "left")
    grouped = found.groupBy("id", "ord").agg(F.array_sort(F.collect_list(F.struct("i", "j", "snapshot_id"))).alias("s"), F.count_if(F.col("snapshot_id").isNull()).alias("missing"))
    return grouped.select("id", "ord", F.array_distinct(F.filter(F.transform("s", lambda x: x["snapshot_id"]), lambda x: x.isNotNull())).alias("snapshot_ids"), "missing")


def copies_flagged(rows: DataFrame, hash_col: str = "object_hash") -> DataFrame:
    """``rows`` with ``copies``: how many share the hash; nulls share nothing. Counts are joined, so a hot hash isn't one task's."""
    counts = rows.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.count("*").alias("copies"))
    return rows.join(counts, hash_col, "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))


def origin_key(source_class: Column, copies: Column, object_hash: Column, final_url: Column) -> Column:
    """Cards of one origin count once: copies by their hash, else by URL and class, else none."""
    where = urls.evidence_url(final_url, ascii_hosts=True)
    return F.when(copies > 1, F.concat(F.lit("copy:"), object_hash)).when(source_class.isin("original", "competent_record"), F.concat(F.lit("url:"), where)).when(source_class == "independent_reporting", F.concat(F.lit("report:"), where))


def conflicting(rows: DataFrame, id_col: str, identity: list[str]) -> DataFrame:
    """Ids whose rows differ in an identity column; there should be none."""
    return rows.groupBy(id_col).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in identity])).alias("variants")).where("variants > 1")
