"""Selection: time windows, thresholds with inferred categories, quotas, orders and ranks."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in tags that stand for the category ``llm``, and for categories on tools and workflows.
LLM_ALIASES = ("llm", "largelanguagemodel", "localllm", "generativeai", "ai", "artificialintelligence")
TOOL_CATEGORIES = ("aitools", "aiworkflows", "aidev", "sdd", "specdrivendevelopment")
TOOL_ALIASES = ("sdd", "specdrivendevelopment", "aitools", "aiworkflow", "aiworkflows", "aidev", "aicoding", "promptengineering", "agentic", "vibecoding", "devtools", "developerproductivity")


@dataclass(frozen=True)
class ProfileSettings:
    """``threshold`` and ``category_thresholds`` in configured order; ``topic_dedup`` as configured."""

    threshold: float | None = None
    category_thresholds: dict[str, float] = field(default_factory=dict)
    topic_dedup: bool = True


@dataclass(frozen=True)
class Group:
    categories: tuple[str, ...]
    limit: int | None = None


def since(rows: DataFrame, now: dt.datetime, hours: float, column: str = "published_at", *, strict: bool = False) -> DataFrame:
    """Rows from the last ``hours``; the bound itself is in unless ``strict``. Rows without a time go."""
    bound = F.lit(now - dt.timedelta(hours=hours))
    return rows.where(F.col(column) > bound if strict else F.col(column) >= bound)


def plain_tag(tag: Column) -> Column:
    """Lower case, no ``#`` in front, no ``-``, ``_`` or space."""
    return F.translate(F.regexp_replace(F.lower(tag), "^#+", ""), "-_ ", "")


def _holds_any(words: tuple[str, ...]):
    return lambda tag: F.array_contains(F.array(*[F.contains(tag, F.lit(w)) for w in words]), True)


def inferred_category(category: Column, tags: Column, settings: ProfileSettings) -> Column:
    """The category, else the first configured one that the tags name, by substring or alias."""
    tags = F.transform(F.coalesce(tags, F.array().cast("array<string>")), plain_tag)
    found = F.when(F.coalesce(category, F.lit("")) != "", category)
    for key in settings.category_thresholds:
        name = key.lower().replace("-", "").replace("_", "").replace(" ", "")
        words = (name, *(LLM_ALIASES if name == "llm" else ()), *(TOOL_ALIASES if name in TOOL_CATEGORIES else ()))
        found = found.when(F.exists(tags, _holds_any(words)), F.lit(key))
    return found


def passes(items: DataFrame, settings: dict[str, ProfileSettings], override: float | None = None) -> DataFrame:
    """``items(profile_id, score, analysed, category, tags)`` with the category inferred and ``passed``.

    An override beats everything, and then no category is inferred. Otherwise a category's threshold
    beats its profile's. Without any threshold everything analysed passes, even unscored; with one, a
    null score fails.
    """
    if override is not None:
        limit = F.lit(float(override))
        category = F.col("category")
    else:
        limit = category = F
        for name, s in settings.items():
            here = F.col("profile_id") == name
            own = inferred_category(F.col("category"), F.col("tags"), s)
            category = category.when(here, own)
            chain = F
            for key, t in s.category_thresholds.items():
                chain = chain.when(own == key, F.lit(float(t)))
            top = F.lit(s.threshold).cast("double")
            limit = limit.when(here, chain.otherwise(top) if s.category_thresholds else top)
        category = category.otherwise(F.col("category")) if settings else F.col("category")
        limit = limit if settings else F.lit(None).cast("double")
    passed = F.coalesce(F.col("analysed"), F.lit(False)) & (limit.isNull() | F.coalesce(F.col("score") >= limit, F.lit(False)))
    return items.withColumns({"category": category, "passed": passed, "applied_threshold": limit})


def by_score(score: str = "score", order: str = "ord") -> list[Column]:
    """Best first, unscored as -1, ties as they came."""
    return [F.coalesce(F.col(score), F.lit(-1.0)).desc(), F.col(order).asc()]


def regrouped(items: DataFrame) -> DataFrame:
    """Where equal scores stand after topics were merged by profile: profiles by first appearance, then as they came."""
    first = items.groupBy("profile_id").agg(F.min("ord").alias("profile_ord"))
    return items.join(first, "profile_id").orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "profile_ord", "ord")


def group_of(category: Column, groups: dict[str, Group], default: str) -> Column:
    """The first configured group that lists the category, else the default."""
    seen: dict[str, str] = {}
    for name, g in groups.items():
        for c in g.categories:
            seen.setdefault(c, name)
    if not seen:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in seen.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit(default))


def duplicate_categories(groups: dict[str, Group]) -> list[str]:
    """Categories that more than one group lists."""
    seen: dict[str, str] = {}
    return sorted({c for name, g in groups.items() for c in g.categories if seen.setdefault(c, name) != name})


def balanced(items: DataFrame, groups: dict[str, Group], *, default: str = "other", default_limit: int | None = None, max_items: int | None = None) -> DataFrame:
    """Grouped top-k by score, then a cap over all, with ``group`` and ``rank``; unconfigured, the input in its order.

    A group's limit is pushed into its window, so at most the limit of each task's rows is shuffled;
    the cap is a top-k, never a sort of everything in one task.
    """
    if not groups and max_items is None:
        return items.withColumn("group", F.lit(None).cast("string"))
    grouped = items.withColumn("group", group_of(F.col("category"), groups, default))
    limits = {name: g.limit for name, g in groups.items()}
    limits.setdefault(default, default_limit)
    capped = [n for n, k in limits.items() if k is not None]
    if capped:
        most = max(limits[n] for n in capped)
        w = Window.partitionBy("group").orderBy(*by_score())
        limited = grouped.where(F.col("group").isin(*capped)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
        allowed = F
        for n in capped:
            allowed = allowed.when(F.col("group") == n, F.lit(limits[n]))
        limited = limited.where(F.col("__r") <= allowed).drop("__r")
        grouped = limited.unionByName(grouped.where(~F.col("group").isin(*capped)))
    return grouped.orderBy(*by_score()).limit(max_items) if max_items is not None else grouped.orderBy(*by_score())


def quota_counts(selected: DataFrame, groups: dict[str, Group], *, default: str = "other", default_limit: int | None = None) -> DataFrame:
    """``(group, count, limit)`` after the cap, empty groups included."""
    limits = {name: g.limit for name, g in groups.items()}
    limits.setdefault(default, default_limit)
    table = selected.sparkSession.createDataFrame([(k, v) for k, v in limits.items()], "group string, limit int")
    return table.join(selected.groupBy("group").agg(F.count("*").alias("count")), "group", "left").select("group", F.coalesce("count", F.lit(0).cast("long")).alias("count"), "limit")


def view_ranks(rows: DataFrame, group: str, order: list[Column], group_rank: Column | None = None) -> DataFrame:
    """``group_index``, ``group_count`` and ``global_index`` from 1; groups by ``group_rank``, else by first appearance.

    The view is what a digest shows, so it is bounded; ranks within groups and counts are joined, and only
    group offsets meet in one task.
    """
    ranked = rows.withColumn("group_index", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    sizes = rows.groupBy(group).agg(F.count("*").alias("group_count"), F.min("ord").alias("__first"))
    rank = F.col("__first") if group_rank is None else group_rank
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("group_count").over(Window.orderBy(rank, "__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(offsets.drop("__first"), group).withColumn("global_index", F.col("__before") + F.col("group_index")).drop("__before")


def head(rows: DataFrame, n: int, *, per: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """First ``n`` rows, of each ``per`` if given."""
    order = order or [F.col("ord").asc()]
    if per is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def tail(rows: DataFrame, n: int, *, per: str | None = None) -> DataFrame:
    """Last ``n`` rows by ``ord``, of each ``per`` if given."""
    return head(rows, n, per=per, order=[F.col("ord").desc()])


def shadow_eligible(items: DataFrame, priorities: dict[str, int], limit: int) -> DataFrame:
    """The first ``limit`` items of the profiles that have a priority, by it and then as they came."""
    table = F.create_map(*[F.lit(x) for pair in priorities.items() for x in pair])
    return items.withColumn("__p", F.try_element_at(table, F.col("profile_id"))).where("__p is not null").orderBy("__p", "ord").limit(limit).drop("__p")


def running_total_within(rows: DataFrame, size: str, limit: int, newest: str) -> DataFrame:
    """``kept``: newest first, as long as the running total stays within the limit; the newest row always.

    Rows are dealt out by ranges of the order and written once, so that ranges stay what they are; a range's total is one row, sums
    of those are what each range begins with, and no task sees more than a range.
    """
    from .. import storage

    spark = rows.sparkSession
    order = [F.col(newest).desc(), F.col("ord").asc()]
    path = storage.scratch(spark, "ranges")
    rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    starts = dealt.groupBy("__range").agg(F.sum(size).alias("__sum")).select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"), (F.row_number().over(Window.orderBy("__range")) == 1).alias("__newest"))
    inside = Window.partitionBy("__range").orderBy(*order)
    total = F.col("__start") + F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    kept = (total <= limit) | (F.col("__newest") & (F.row_number().over(inside) == 1))
    return dealt.join(F.broadcast(starts), "__range").withColumn("kept", kept).drop("__range", "__start", "__newest")
