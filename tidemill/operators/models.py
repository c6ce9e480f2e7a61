"""Model calls as a column: prompts in, answers out, and the contracts on what comes back.

A model is any picklable function from a list of ``(system, user)`` to a list of answers, where an answer
is a text or an exception. Tests inject a deterministic one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons

ModelFn = Callable[[list[tuple[str, str]]], list]

#: Messages after which a call is not tried again, and the output contract of scoring.
FINAL_ERRORS = ("gousagelimiterror", "weekly usage limit", "creditserror", "insufficient_quota", "insufficient balance", "account deactivated", "invalid api-key", "invalid api key")
ANALYSIS = "score double, reason string, summary string, tags array<string>"


def is_retryable(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    return ~F.exists(F.array(*[F.lit(x) for x in FINAL_ERRORS]), lambda x: F.contains(low, x))


def chained(*models: ModelFn) -> ModelFn:
    """The first model's answer, else the next one's where it failed or said nothing."""

    def call(prompts: list[tuple[str, str]]) -> list:
        out: list = [None] * len(prompts)
        left = list(range(len(prompts)))
        for model in models:
            if not left:
                break
            for i, answer in zip(left, model([prompts[i] for i in left]), strict=True):
                out[i] = answer
            left = [i for i in left if isinstance(out[i], Exception) or not out[i]]
        return out

    return call


def answered(rows: DataFrame, system: Column, user: Column, model: ModelFn) -> DataFrame:
    """``rows`` with ``answer`` and ``error``, a batch of rows at a time; one row's failure is its own."""
    asked = rows.withColumn("__system", system).withColumn("__user", user)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", answer string, error string"

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            said = model(list(zip(b.pop("__system"), b.pop("__user"), strict=True))) if len(b) else []
            b["answer"] = [None if isinstance(x, Exception) else x for x in said]
            b["error"] = [str(x) if isinstance(x, Exception) else None for x in said]
            yield b

    return asked.mapInPandas(run, schema)


def classified(items: DataFrame, model: ModelFn, profiles: list[str], default: str, prompt: Column) -> DataFrame:
    """Items with ``profile_id``, ``method``, ``confidence`` and ``class_reason``.

    One requested profile needs no model. Otherwise its answer counts if it names an allowed profile with a
    confidence from 0 to 1; if not, the default, or the first candidate where the default isn't one.
    """
    known = F.array(*[F.lit(p) for p in profiles])
    route = F.transform(F.coalesce("profile", F.array(F.lit("auto"))), F.btrim)
    fixed = (F.size(route) == 1) & (route[0] != "auto")
    rows = items.withColumn("__allowed", F.when(F.array_contains(route, "auto"), known).otherwise(route))
    given = rows.where(fixed).select(*items.columns, F.btrim(F.col("profile")[0]).alias("profile_id"), F.lit("source_override").alias("method"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("class_reason"))
    asked = answered(rows.where(~fixed), F.lit("Choose a profile. Answer with JSON: profile, confidence, reason."), prompt, model)
    a = F.from_json(jsons.salvaged(F.col("answer")), "profile string, confidence double, reason string")
    asked = asked.withColumn("__a", a)
    ok = F.coalesce(F.array_contains("__allowed", F.col("__a.profile")) & F.col("__a.confidence").between(0, 1), F.lit(False))
    fallback = F.when(F.array_contains("__allowed", default), F.lit(default)).otherwise(F.col("__allowed")[0])
    matched = asked.select(*items.columns, F.when(ok, F.col("__a.profile")).otherwise(fallback).alias("profile_id"), F.lit("ai_match").alias("method"), F.when(ok, F.col("__a.confidence")).otherwise(0.0).alias("confidence"), F.when(ok, F.col("__a.reason")).otherwise(F.concat(F.lit("Classification failed; used fallback profile "), fallback)).alias("class_reason"))
    return given.unionByName(matched)


def engagement(metadata: Column) -> Column:
    """What readers did, for the prompt."""
    get = lambda k: F.nullif(F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit("0")), F.lit(""))
    parts = [F.concat(F.lit("score: "), get("score")), *[F.concat(get(k), F.lit(f" {w}")) for k, w in (("descendants", "comments"), ("favorite_count", "likes"), ("retweet_count", "retweets"), ("reply_count", "replies"), ("views", "views"), ("bookmarks", "bookmarks"))], F.concat(F.lit("upvote ratio: "), F.format_number(get("upvote_ratio").cast("double") * 100, 0), F.lit("%"))]
    return F.array_join(F.array_compact(F.array(*parts)), ", ")


def _valid(answer: Column) -> Column:
    a = F.from_json(jsons.salvaged(answer), ANALYSIS)
    return F.when(a["score"].between(0, 10) & ~F.isnan(a["score"]), a)


def analysed(items: DataFrame, model: ModelFn, system: Column, user: Column) -> DataFrame:
    """Items with ``score``, ``reason``, ``summary``, ``tags`` and ``failed``; one repair for answers off the contract.

    What still isn't valid has a null score and its title as summary. Callers decide with
    :func:`assert_not_all_failed` whether a run goes on.
    """
    first = answered(items, system, user, model).withColumn("__a", _valid(F.col("answer"))).persist()
    again = first.where("__a is null and error is null").select(*items.columns)
    repaired = answered(again, system, F.concat(user, F.lit("\n\nYour previous answer was not the required JSON object. Answer with it alone.")), model).withColumn("__a", _valid(F.col("answer")))
    every = first.where("__a is not null or error is not null").unionByName(repaired)
    failed = F.col("__a").isNull()
    why = F.when(F.col("error").isNotNull(), "Analysis failed").otherwise("Analysis response parse failed")
    return every.select(*items.columns, F.col("__a.score").alias("score"), F.when(failed, why).otherwise(F.coalesce("__a.reason", F.lit(""))).alias("reason"), F.when(failed, F.col("title")).otherwise(F.coalesce("__a.summary", F.lit(""))).alias("summary"), F.coalesce("__a.tags", F.array().cast("array<string>")).alias("tags"), F.col("error").isNotNull().alias("failed"))


def assert_not_all_failed(rows: DataFrame) -> DataFrame:
    n, failed = rows.agg(F.count("*"), F.count_if("failed")).first()
    if n and n == failed:
        raise RuntimeError(f"analysis failed for all {n} items")
    return rows


def planned_tools(plans: DataFrame, limit: int = 3, allowed: tuple[str, ...] = ("web_search",)) -> DataFrame:
    """``plans(item_id, ord, tool, query)``: allowed ones, each once, at most so many of an item."""
    from .dedup import keep_first
    from .select import head

    once = keep_first(plans.where(F.col("tool").isin(*allowed) & (F.btrim(F.coalesce("query", F.lit(""))) != "")), "item_id", "tool", "query")
    return head(once, limit, per="item_id")


def discovery_hits(results: DataFrame) -> DataFrame:
    """``results(query, ord, url, title, snippet)`` with an id by query and URL; the rank counts rows without a URL too."""
    from pyspark.sql import Window

    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("ord")))
    return ranked.where("coalesce(url, '') <> ''").withColumn("discovery_id", jsons.sha_id(F.col("query"), F.col("url")))


def resolved_refs(blocks: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``blocks(item_id, block_id, refs)`` with references to whole requests expanded to their results, and the hits that are used.

    ``hits(item_id, request_ref, result_ref, url, title)``. A reference may name a request or a result;
    ``unknown`` counts those that name neither.
    """
    e = blocks.select("item_id", "block_id", F.posexplode_outer("refs").alias("pos", "ref"))
    names = hits.select("item_id", F.explode(F.array("request_ref", "result_ref")).alias("ref"), "result_ref").distinct()
    found = e.join(names, ["item_id", "ref"], "left")
    grouped = found.groupBy("item_id", "block_id").agg(F.array_distinct(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "result_ref"))), lambda x: x["result_ref"].isNotNull()), lambda x: x["result_ref"])).alias("source_refs"), F.count_if(F.col("ref").isNotNull() & F.col("result_ref").isNull()).alias("unknown"))
    used = hits.join(found.select("item_id", "result_ref").where("result_ref is not null"), ["item_id", "result_ref"], "left_semi")
    return grouped, used


def block_differences(generated: Column, required: Column, optional: Column) -> Column:
    """Missing, unknown and repeated block ids."""
    return F.struct(F.array_except(required, generated).alias("missing"), F.array_except(generated, F.concat(required, optional)).alias("unknown"), (F.size(generated) != F.size(F.array_distinct(generated))).alias("repeated"))


def resolved_tags(rows: DataFrame, tag: str, aliases: DataFrame) -> DataFrame:
    """``canonical`` by ``aliases(canonical, alias)`` whatever the case; unknown tags stand for themselves."""
    table = aliases.select(F.lower("alias").alias("__k"), "canonical").unionByName(aliases.select(F.lower("canonical").alias("__k"), "canonical")).groupBy("__k").agg(F.min("canonical").alias("canonical"))
    key = F.lower(F.btrim(F.col(tag)))
    return rows.join(table, key == F.col("__k"), "left").withColumn("canonical", F.coalesce("canonical", key)).drop("__k")
