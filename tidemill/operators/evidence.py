"""The evidence path: contracts of proposals, coverage, anchoring of excerpts, errors, summaries of runs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import dedup, verify

#: Vocabularies and limits of the contracts.
STANCES = ("supports", "contradicts", "context", "irrelevant", "unknown")
MATERIAL = ("supports", "contradicts", "context")
SOURCE_CLASSES = ("original", "competent_record", "independent_reporting", "interested_party", "unknown")
MATCHES = ("match", "mismatch", "unknown")
IMPORTANCE = ("headline", "load_bearing")
CHECKABILITY = ("checkable", "ambiguous", "not_checkable")
CLAIM_KEYS = ("source_field", "source_text", "normalized_claim", "kind", "importance", "checkability")
ASSESSMENT_KEYS = ("candidate_id", "excerpt", "source_class", "interested_party", "stance", "entity_match", "temporal_match", "quantity_match")
MOST_CLAIM, MOST_EXCERPT = 1000, 2000
CARD_SCHEMA = "evidence-card/v1"


def _outside(value: Column, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(value.isin(*allowed), F.lit(False))


def _extra(keys: Column | None, allowed: tuple[str, ...]) -> Column:
    return F.lit(False) if keys is None else F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) > 0, F.lit(False))


def claim_error(keys: Column | None = None) -> Column:
    """Why a proposed claim, in columns by ``CLAIM_KEYS``, breaks its contract; null if it holds. ``keys``: those that were sent."""
    col = F.col
    value = _outside(col("source_field"), ("title", "content")) | _outside(col("kind"), verify.KINDS) | _outside(col("importance"), IMPORTANCE) | _outside(col("checkability"), CHECKABILITY)
    long = lambda c: ~F.coalesce(F.length(c).between(1, MOST_CLAIM), F.lit(False))
    blank = (tx.strip(col("source_text")) == "") | (tx.strip(col("normalized_claim")) == "")
    return F.when(_extra(keys, CLAIM_KEYS), "extra_key").when(value, "value").when(long("source_text") | long("normalized_claim"), "length").when(blank, "blank").when((col("importance") == "headline") & (col("source_field") != "title"), "headline_outside_title")


def assessment_error(keys: Column | None = None) -> Column:
    """Why a proposed assessment, in columns by ``ASSESSMENT_KEYS``, breaks its contract; null if it holds. A null excerpt is an empty one."""
    col = F.col
    value = col("candidate_id").isNull() | col("interested_party").isNull() | _outside(col("source_class"), SOURCE_CLASSES) | _outside(col("stance"), STANCES)
    for name in ("entity_match", "temporal_match", "quantity_match"):
        value |= _outside(col(name), MATCHES)
    size = F.coalesce(F.length("excerpt"), F.lit(0))
    return F.when(_extra(keys, ASSESSMENT_KEYS), "extra_key").when(value, "value").when(size > MOST_EXCERPT, "length").when(col("stance").isin(*MATERIAL) & (size == 0), "no_excerpt")


def uncovered(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Keys that ``found`` doesn't have exactly once for one in ``expected``: ``(keys, problem)``.

    ``missing``, ``unknown`` or ``repeated``. Both sides are counted before they meet; nulls are keys like any other.
    """
    rows = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(found.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("f")))
    counts = rows.groupBy(*keys).agg(F.sum("e").alias("e"), F.sum("f").alias("f"))
    problem = F.when(F.col("f") == 0, "missing").when(F.col("e") == 0, "unknown").when((F.col("e") > 1) | (F.col("f") > 1), "repeated")
    return counts.select(*keys, problem.alias("problem")).where("problem is not null")


def covered(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """``found``, if it has every key of ``expected`` exactly once and no other; else an error that names some."""
    wrong = uncovered(expected, found, *keys).limit(5).collect()
    if wrong:
        raise ValueError("keys aren't covered exactly once: " + ", ".join(f"{tuple(r[k] for k in keys)} {r.problem}" for r in wrong))
    return found


def outcome_items(outcomes: DataFrame, snapshots: DataFrame, items: DataFrame) -> DataFrame:
    """``outcomes(snapshot_id, ...)`` with their snapshot's item, by id rather than by place; ``item_found`` is false where it is gone."""
    known = items.select("item_id").distinct().withColumn("item_found", F.lit(True))
    return outcomes.join(snapshots.select("snapshot_id", "item_id"), "snapshot_id").join(known, "item_id", "left").withColumn("item_found", F.coalesce("item_found", F.lit(False)))


def anchored_assessments(proposals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``proposals(claim_id, candidate_id, excerpt, stance, source_class, ...)`` placed in their snapshots.

    ``snapshots(claim_id, snapshot_id, normalized_text, object_hash, final_url)``. A material excerpt must occur
    exactly once in its text; ``error`` is ``not_exact`` or ``ambiguous`` where it doesn't, and ``coverage`` for
    every row of a claim whose proposals aren't one for each snapshot. Rows that hold have ``evidence_id``,
    ``excerpt_start``, ``excerpt_end`` and ``origin_key``; irrelevant and unknown ones neither these nor an error.
    """
    wrong = uncovered(snapshots.withColumnRenamed("snapshot_id", "candidate_id"), proposals, "claim_id", "candidate_id").select("claim_id").distinct().withColumn("wrong", F.lit(True))
    copies = snapshots.where("object_hash is not null").groupBy("claim_id", "object_hash").agg(F.count("*").alias("copies"))
    texts = snapshots.dropDuplicates(["claim_id", "snapshot_id"]).join(copies, ["claim_id", "object_hash"], "left").withColumnRenamed("snapshot_id", "candidate_id")
    rows = proposals.join(texts, ["claim_id", "candidate_id"], "left").join(wrong, "claim_id", "left")
    start = verify.span_start(F.col("normalized_text"), F.col("excerpt"))
    rows = rows.withColumn("excerpt_start", start).withColumn("material", F.coalesce(F.col("stance").isin(*MATERIAL), F.lit(False)))
    inside = F.coalesce(F.contains("normalized_text", F.coalesce("excerpt", F.lit(""))), F.lit(False))
    error = F.when(F.col("wrong"), "coverage").when(F.col("material") & ~inside, "not_exact").when(F.col("material") & F.col("excerpt_start").isNull(), "ambiguous")
    rows = rows.withColumn("error", error)
    card = F.col("material") & F.col("error").isNull()
    end = F.col("excerpt_start") + F.length("excerpt")
    evidence_id = F.sha2(F.concat_ws("\0", F.lit(CARD_SCHEMA), "claim_id", "candidate_id", F.col("excerpt_start").cast("string"), end.cast("string"), "stance", "source_class"), 256)
    origin = dedup.origin_key(F.col("source_class"), F.coalesce("copies", F.lit(1)), F.col("object_hash"), F.col("final_url"))
    made = {"evidence_id": evidence_id, "excerpt_start": F.col("excerpt_start"), "excerpt_end": end, "origin_key": origin}
    return rows.select(*proposals.columns, *[F.when(card, c).alias(n) for n, c in made.items()], "error")


def broken_excerpts(cards: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Cards whose excerpt isn't what their snapshot's text has at that place, or whose snapshot is gone; there should be none."""
    rows = cards.join(snapshots.select(F.col("snapshot_id").alias("evidence_snapshot_id"), "normalized_text"), "evidence_snapshot_id", "left")
    there = F.expr("substring(normalized_text, excerpt_start + 1, excerpt_end - excerpt_start)")
    return rows.where(~F.coalesce((there == F.col("excerpt")) & (F.length("excerpt") > 0), F.lit(False))).drop("normalized_text")


def error_results(claims: DataFrame, stop_reason: str = "backend_error", duration: float = 0.0) -> DataFrame:
    """``claims`` whose check broke off, as results: no evidence, nothing spent; what can't be checked stays so."""
    if stop_reason not in ("budget", "backend_error"):
        raise ValueError(stop_reason)
    uncheckable = F.col("checkability") != "checkable"
    none = F.array().cast("array<string>")
    spent = [F.lit(0).cast("long").alias(n) for n in ("search_calls", "documents_attempted", "documents_fetched", "cache_reuse")]
    return claims.select(
        *claims.columns,
        F.when(uncheckable, "not_checkable").otherwise("verification_error").alias("status"),
        F.when(uncheckable, F.array(F.lit("claim_not_checkable"))).otherwise(none).alias("satisfied"),
        F.when(uncheckable, none).otherwise(F.array(F.lit("required_stage_completed"))).alias("missing"),
        F.lit(stop_reason).alias("stop_reason"),
        *spent,
        F.lit(float(duration)).alias("duration_seconds"),
    )


def exact_texts(claims: DataFrame) -> DataFrame:
    """``(normalized_claim, source_text)`` of claims that have exactly one other wording in the articles."""
    rows = claims.select(tx.strip(F.col("normalized_claim")).alias("normalized_claim"), tx.strip(F.col("source_text")).alias("source_text"))
    rows = rows.where("normalized_claim <> '' and source_text <> '' and normalized_claim <> source_text")
    return rows.groupBy("normalized_claim").agg(F.min("source_text").alias("source_text"), F.max("source_text").alias("last")).where("source_text = last").drop("last")


def without_failed(items: DataFrame, failed: DataFrame, key: str = "id") -> DataFrame:
    """``items`` but for those whose enrichment failed."""
    return items.join(failed.select(key).distinct(), key, "left_anti")


def latest_runs(runs: DataFrame) -> DataFrame:
    """``runs(run_id, stage, has_claims)`` as one row: the newest attempt, its stage, and the newest run that got to its evidence."""
    return runs.agg(F.max("run_id").alias("latest"), F.max_by("stage", "run_id").alias("stage"), F.max(F.when((F.col("stage") == "evidence") & F.coalesce("has_claims", F.lit(False)), F.col("run_id"))).alias("complete"))


def run_summary(reports: DataFrame) -> DataFrame:
    """``(measure, name, n)`` over a run's reports: verdicts of claims, states of audits, models, and totals.

    ``reports(statuses, audit_status, unchecked_spans, model, search_errors, fetch_errors)``; a report without an
    audit counts as ``missing``. Each report becomes a few counts, which are partial sums.
    """
    one = F.lit(1).cast("long")

    def row(measure: str, name: Column, n: Column) -> Column:
        return F.struct(F.lit(measure).alias("measure"), name.alias("name"), n.cast("long").alias("n"))

    verdicts = F.transform(F.coalesce("statuses", F.array().cast("array<string>")), lambda s: row("verdict", s, one))
    totals = [row("total", F.lit(n), F.coalesce(F.col(n), F.lit(0))) for n in ("unchecked_spans", "search_errors", "fetch_errors")]
    plain = F.array(row("audit", F.coalesce("audit_status", F.lit("missing")), one), row("total", F.lit("reports"), one), *totals)
    model = F.when(F.coalesce("model", F.lit("")) != "", F.array(row("model", F.col("model"), one))).otherwise(F.array().cast("array<struct<measure:string,name:string,n:bigint>>"))
    return reports.select(F.explode(F.concat(verdicts, plain, model)).alias("r")).groupBy("r.measure", "r.name").agg(F.sum("r.n").alias("n"))


def report_totals(outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """``outcomes(item_id, status, error_code, duration_seconds)`` with the sums over their claims' ``results``.

    ``results(item_id, claim_id, status, stop_reason, search_calls, documents_attempted, documents_fetched,
    cache_reuse, duration_seconds)``. An item whose claims couldn't be extracted stops by budget after a timeout,
    else by a backend error; one without results found nothing new.
    """
    spent = ("search_calls", "documents_attempted", "documents_fetched", "cache_reuse")
    sums = results.groupBy("item_id").agg(*[F.sum(c).cast("long").alias(c) for c in spent], F.sum("duration_seconds").alias("spent"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("claim_id", "status")))).alias("status_by_claim"))
    rows = outcomes.join(sums, "item_id", "left").join(verify.stop_reasons(results, "item_id"), "item_id", "left")
    broken = F.col("status") == "error"
    stop = F.when(broken & (F.col("error_code") == "timeout"), "budget").when(broken, "backend_error").otherwise(F.coalesce("stop_reason", F.lit("no_novelty")))
    total = F.coalesce("duration_seconds", F.lit(0.0)) + F.coalesce("spent", F.lit(0.0))
    return rows.select("item_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in spent], F.coalesce("status_by_claim", F.create_map().cast("map<string,string>")).alias("status_by_claim"), stop.alias("stop_reason"), total.alias("duration_seconds"), F.when(broken, F.col("error_code")).alias("verification_error"))


def order_gaps(loaded: Column, listed: Column) -> tuple[Column, Column]:
    """(missing, unknown) profiles of an order that must list every loaded one, each sorted."""
    return F.array_sort(F.array_except(loaded, listed)), F.array_sort(F.array_except(listed, loaded))


def in_languages(language: Column, wanted: Column) -> Column:
    """Whether messages of a language go out: no list, or an empty one, is all of them."""
    return F.coalesce(F.size(wanted) <= 0, F.lit(True)) | F.coalesce(F.array_contains(wanted, language), F.lit(False))
