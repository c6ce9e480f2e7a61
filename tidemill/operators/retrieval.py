"""Bounded retrieval of evidence over captured searches and fetches: what a claim's rounds would have asked for, fetched and met again.

A claim's rounds depend on one another: a search may bring as many hits as documents are left, and what has been
seen isn't fetched again. Of each search only so many hits can matter as documents are allowed, so these are
brought to the claim's row, and the rounds are a fold over its array of searches. Documents are joined to what
the rounds chose; which of an item's claims met a document first, and what is left of the item's model calls, follow
from the order of its claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.udfs import let

#: Kinds of claims with all their searches (others have one), failures that leave a check open, and calls of the model for one answer.
BROAD_KINDS, OPEN_FAILURES, MOST_CALLS = ("event", "other"), ("timeout", "network_error"), 3
DECIDED = ("supported_by_evidence", "contradicted_by_evidence", "mixed_evidence")

_SEEN = "array<struct<key:string,url:string>>"


def has_identity(url: Column) -> Column:
    """Whether a URL can be told apart from others: a port that is one, labels of 1 to 63 characters, brackets in pairs."""
    place = F.regexp_replace(urls.netloc(url), "^.*@", "")
    given = F.regexp_extract(place, "^(?:\\[[^\\]]*\\]|[^:\\[\\]]*):(.*)$", 1)
    labels = F.split(F.regexp_replace(urls.host(url), "\\.+$", ""), "\\.")
    port = (given == "") | (given.rlike("^[0-9]+$") & F.coalesce(given.try_cast("int") <= 65535, F.lit(False)))
    named = F.forall(labels, lambda x: F.length(x) < 64) & ((F.size(labels) == 1) | ~F.array_contains(labels, ""))
    paired = place.rlike("^\\[[^\\[\\]]*\\](:.*)?$") | ~place.rlike("[\\[\\]]")
    return F.coalesce(url.isNotNull() & port & named & paired, F.lit(False))


def rounds(claims: DataFrame, searches: DataFrame, hits: DataFrame, *, max_queries: int = 3, max_documents: int = 6, ascii_hosts: bool = False) -> DataFrame:
    """``claims(claim_id, kind, checkability, url, ...)`` with ``seen`` (array of key and url, in order), ``search_calls``, ``attempted``, ``search_errors``, ``invalid`` and ``stopped``.

    ``searches(claim_id, round, status, error_code)`` and ``hits(claim_id, round, rank, url)`` are captured; rounds count from 1. A search
    that wasn't captured is an unavailable one. Hits of a round beyond what is left of ``max_documents`` at its start aren't
    looked at. ``stopped`` is ``not_checkable``, ``budget``, ``backend_error`` or ``no_novelty``.
    """
    key = lambda c: F.when(has_identity(c), urls.evidence_url(c, ascii_hosts=ascii_hosts))
    first = Window.partitionBy("claim_id", "round").orderBy("rank", "url")
    near = hits.where(F.col("round") <= max_queries).withColumn("n", F.row_number().over(first)).where(F.col("n") <= max_documents)
    # keys are columns of their own, compiled, not evaluated within an aggregate or a fold
    found = near.withColumn("key", key(F.col("url"))).groupBy("claim_id", "round").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "key", "url"))), lambda x: F.struct(x["key"].alias("key"), x["url"].alias("url"))).alias("hits"))  # at most max_documents
    asked = searches.where(F.col("round") <= max_queries).groupBy("claim_id", "round").agg(F.max(F.struct("status", "error_code")).alias("s"))
    each = asked.join(found, ["claim_id", "round"], "full").groupBy("claim_id").agg(F.map_from_entries(F.collect_list(F.struct("round", F.struct("s.status", "s.error_code", "hits")))).alias("m"))  # at most max_queries
    limit = F.when(F.col("kind").isin(*BROAD_KINDS), max_queries).otherwise(min(max_queries, 1))
    none = F.array().cast(_SEEN)
    own = F.when(F.col("__own").isNull(), none).otherwise(F.array(F.struct(F.col("__own").alias("key"), F.col("url").alias("url"))))
    state = lambda seen, calls, errors, invalid, stopped: F.struct(seen.alias("seen"), calls.alias("calls"), errors.alias("errors"), invalid.alias("invalid"), stopped.alias("stopped"))
    strings = F.array().cast("array<string>")
    start = state(own.cast(_SEEN), F.lit(0), strings, F.when(F.col("url").isNotNull() & F.col("__own").isNull(), 1).otherwise(0), F.lit(None).cast("string"))

    def step(s: Column, n: Column) -> Column:
        left = F.lit(max_documents) - F.size(s["seen"])
        this = F.try_element_at(F.col("m"), n)
        failed = F.coalesce(this["status"], F.lit("error")) == "error"
        looked = F.slice(F.coalesce(this["hits"], none), F.lit(1), F.greatest(left, F.lit(0)))
        fresh = lambda looked: F.filter(looked, lambda h, i: h["key"].isNotNull() & ~F.exists(s["seen"], lambda y: y["key"] == h["key"]) & ~F.exists(F.slice(looked, F.lit(1), i), lambda y: F.coalesce(y["key"] == h["key"], F.lit(False))))
        after = let(looked, lambda x: state(F.concat(s["seen"], fresh(x)), s["calls"] + 1, s["errors"], s["invalid"] + F.size(F.filter(x, lambda h: h["key"].isNull())), F.lit(None).cast("string")))
        error = state(s["seen"], s["calls"] + 1, F.concat(s["errors"], F.array(F.coalesce(this["error_code"], F.lit("unavailable")))), s["invalid"], F.lit("backend_error"))
        full = state(s["seen"], s["calls"], s["errors"], s["invalid"], F.lit("budget"))
        return F.when(s["stopped"].isNotNull() | (n > limit), s).when(left <= 0, full).when(failed, error).otherwise(after)

    def finish(s: Column) -> Column:
        # a round that uses up the documents by its hits says so, even if it is the last
        used = (F.size(s["seen"]) >= max_documents) & (s["calls"] > 0) & s["stopped"].isNull()
        return state(s["seen"], s["calls"], s["errors"], s["invalid"], F.when(used, "budget").otherwise(F.coalesce(s["stopped"], F.lit("no_novelty"))))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(max_queries)), start, step, finish)
    out = claims.withColumn("__own", key(F.col("url"))).join(each, "claim_id", "left").withColumn("s", F.when(F.col("checkability") == "checkable", folded).otherwise(state(none, F.lit(0), strings, F.lit(0), F.lit("not_checkable"))))
    return out.select(*claims.columns, F.col("s.seen").alias("seen"), F.col("s.calls").alias("search_calls"), F.size("s.seen").alias("attempted"), F.col("s.errors").alias("search_errors"), F.col("s.invalid").alias("invalid"), F.col("s.stopped").alias("stopped"))


def retrieved(claims: DataFrame, searches: DataFrame, hits: DataFrame, documents: DataFrame, *, max_queries: int = 3, max_documents: int = 6, ascii_hosts: bool = False) -> DataFrame:
    """:func:`rounds` with ``fetched``, ``cache_reuse``, ``fetch_errors`` and ``snapshots`` (ids, in order) instead of ``seen``.

    ``claims`` (one row each) also have ``item_id`` and ``ord``, their order within the item. ``documents(key, status, snapshot_id)`` are the
    captured fetches by identity, one each; what wasn't captured is a network error, and an ``ok`` without a snapshot is
    an empty text. A document that an earlier claim of the item has met is a reuse, whatever it was.
    """
    base = rounds(claims, searches, hits, max_queries=max_queries, max_documents=max_documents, ascii_hosts=ascii_hosts)
    row = [c for c in base.columns if c not in ("claim_id", "seen")]
    # a row for each document met, or one without; the claim's own columns go with it, so that rounds are followed once
    met = base.select("claim_id", "item_id", "ord", F.struct(*row).alias("c"), F.posexplode_outer("seen").alias("at", "x")).select("claim_id", "item_id", "ord", "c", "at", "x.key")
    before = F.min("ord").over(Window.partitionBy("item_id", "key"))
    met = met.withColumn("again", (F.col("ord") > before) & F.col("key").isNotNull()).join(documents.select("key", "status", "snapshot_id"), "key", "left")
    ok = (F.col("status") == "ok") & F.col("snapshot_id").isNotNull()
    error = F.when(F.coalesce(ok, F.lit(False)), None).when(F.col("status") == "ok", "normalization_empty").otherwise(F.coalesce("status", F.lit("network_error")))
    out = met.groupBy("claim_id").agg(  # at most max_documents
        F.any_value("c").alias("c"),
        F.count_if(F.coalesce(ok, F.lit(False)) & ~F.col("again")).cast("int").alias("fetched"),
        F.count_if("again").cast("int").alias("cache_reuse"),
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", error.alias("error"), F.when(F.coalesce(ok, F.lit(False)), F.col("snapshot_id")).alias("id"))))).alias("d"),
    )
    said = lambda c: F.filter(F.transform("d", lambda x: x[c]), lambda x: x.isNotNull())
    out = out.select("claim_id", "c.*", "fetched", "cache_reuse", "d")
    errors = F.concat(said("error"), F.array_repeat(F.lit("invalid_url"), F.col("invalid")))
    return out.select(*claims.columns, "search_calls", "attempted", "search_errors", "stopped", "fetched", "cache_reuse", errors.alias("fetch_errors"), F.array_distinct(said("id")).alias("snapshots"))


def concluded(found: DataFrame, answers: DataFrame, statuses: DataFrame, *, model_calls: int) -> DataFrame:
    """:func:`retrieved` with ``model_calls``, ``stage_error`` and ``stop_reason`` instead of ``stopped``.

    ``answers(claim_id, call, outcome)`` are the model's captured answers: ``valid``, ``invalid`` or ``failed``; one that wasn't captured
    has failed. A claim with documents calls until a valid or failed answer, three times at most, and takes from the
    ``model_calls`` of its item, which claims use up in their order. ``statuses(claim_id, status)`` are what the cards of a valid
    answer lead to (see :func:`tidemill.operators.verify.final_status`).
    """
    told = answers.where(F.col("call").between(1, MOST_CALLS)).groupBy("claim_id").agg(F.map_from_entries(F.collect_list(F.struct("call", "outcome"))).alias("told"))  # at most three
    calls = F.sequence(F.lit(1), F.lit(MOST_CALLS))
    outcome = lambda n: F.coalesce(F.try_element_at(F.col("told"), n), F.lit("failed"))
    ended = F.element_at(F.concat(F.filter(calls, lambda n: outcome(n) != "invalid"), F.array(F.lit(MOST_CALLS))), 1)
    has = F.size("snapshots") > 0
    rows = found.join(told, "claim_id", "left").join(statuses.select("claim_id", "status"), "claim_id", "left").withColumn("needs", F.when(has, ended).otherwise(0)).withColumn("said", outcome(F.col("needs")))
    earlier = F.coalesce(F.sum("needs").over(Window.partitionBy("item_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", F.greatest(F.lit(0), F.lit(model_calls) - earlier).cast("int"))
    short = F.col("needs") > F.col("left")
    used = F.when(short, F.col("left")).otherwise(F.col("needs")).cast("int")
    open_ = (F.size("search_errors") > 0) | F.arrays_overlap("fetch_errors", F.array(*map(F.lit, OPEN_FAILURES)))
    moot = F.col("stopped") == "not_checkable"
    stage_error = F.when(moot, False).when(~has, open_).otherwise(short | (F.col("said") != "valid"))
    reason = (
        F.when(moot, "not_checkable")
        .when(~has & ~open_ & (F.col("attempted") > 0), "source_unavailable")
        .when(~has, F.col("stopped"))
        .when(short, "budget")
        .when(F.col("said") != "valid", "backend_error")
        .when(F.col("status").isin(*DECIDED), "sufficient")
        .when(F.col("stopped").isin("budget", "backend_error"), F.col("stopped"))
        .otherwise("no_novelty")
    )
    return rows.select(*[c for c in found.columns if c != "stopped"], used.alias("model_calls"), stage_error.alias("stage_error"), reason.alias("stop_reason"))
