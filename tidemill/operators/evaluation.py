"""Replays: a table of hostile cases driven through adjudication and audit, and two runs over one frozen capture compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import publish, verify
from .evidence import _extra

#: Limits of a proposed factual span, and what a case's claim and cards are where it doesn't say.
MOST_SPANS, MOST_SPAN, MOST_SAID = 100, 2000, 1000
SPAN_KEYS = ("field_id", "source_text", "normalized_claim", "mapped_claim_id")
CASE = (
    "struct<id:string,type:string,expected_status:string,expected_unchecked:long,expected:string,required_stage_error:boolean,"
    "claim:struct<kind:string,checkability:string>,"
    "cards:array<struct<stance:string,source_class:string,interested_party:boolean,entity_match:string,temporal_match:string,quantity_match:string,origin_key:string>>,"
    "fields:array<struct<field_id:string,language:string,source_kind:string,text:string,block_id:string>>,"
    "proposals:array<struct<field_id:string,source_text:string,normalized_claim:string,mapped_claim_id:string>>,"
    "claim_results:array<struct<claim_id:string,status:string>>>"
)


def span_error(keys: Column | None = None) -> Column:
    """Why a proposed factual span, in columns by ``SPAN_KEYS``, breaks its contract; null if it holds. ``keys``: those that were sent."""
    within = lambda c, most: F.coalesce(F.length(c).between(1, most), F.lit(False))
    blank = (tx.strip(F.col("source_text")) == "") | (tx.strip(F.col("normalized_claim")) == "")
    return F.when(_extra(keys, SPAN_KEYS), "extra_key").when(F.col("field_id").isNull(), "value").when(~within("source_text", MOST_SPAN) | ~within("normalized_claim", MOST_SAID), "length").when(blank, "blank")


def replayed(cases: DataFrame, id_col: str = "case_id", case_col: str = "case") -> DataFrame:
    """``(case_id, type, expected, actual, passed, false_supported)`` for ``cases(case_id, case)``, a JSON object each.

    An adjudication case says what claim, cards and failed stage lead to; an audit case how many proposed spans of its fields
    stay without a checked claim (``error`` if one of them, or their number, breaks the contract). All cases go through the
    engine's own adjudication and audit at once. Of an unknown type the result is ``unknown_case_type``.
    """
    c = cases.select(F.col(id_col).alias("case_id"), F.from_json(case_col, CASE).alias("c")).select("case_id", "c.*")
    judged = c.where("type = 'adjudication'")
    claims = judged.select(F.col("case_id").alias("claim_id"), F.coalesce("claim.kind", F.lit("release")).alias("kind"), F.coalesce("claim.checkability", F.lit("checkable")).alias("checkability"), F.coalesce("required_stage_error", F.lit(False)).alias("stage_error"))
    default = {"source_class": F.lit("original"), "interested_party": F.lit(False), "entity_match": F.lit("match"), "temporal_match": F.lit("match"), "quantity_match": F.lit("match")}
    cards = judged.select(F.col("case_id").alias("claim_id"), F.explode("cards").alias("k")).select("claim_id", "k.stance", *[F.coalesce(f"k.{n}", d).alias(n) for n, d in default.items()], "k.origin_key")
    statuses = verify.adjudicated(claims, cards).select(F.col("claim_id").alias("case_id"), F.col("status").alias("adjudged"))
    audits = c.where("type = 'audit'")
    each = lambda name: audits.select(F.col("case_id").alias("item_id"), F.explode(name).alias("x")).select("item_id", "x.*")
    proposals = each("proposals")
    spans = publish.audited_spans(each("fields"), proposals, each("claim_results"))
    broken = proposals.withColumn("bad", span_error()).groupBy("item_id").agg((F.count("bad") > 0).alias("bad"), F.count("*").alias("n"))
    found = spans.groupBy("item_id").agg(F.count("error").alias("errors"), F.count_if(F.col("matched_claim_id").isNull()).alias("unchecked")).join(broken, "item_id")
    audited = found.select(F.col("item_id").alias("case_id"), F.when((F.col("errors") > 0) | F.col("bad") | (F.col("n") > MOST_SPANS), "error").otherwise(F.col("unchecked").cast("string")).alias("audited"))
    rows = c.join(statuses, "case_id", "left").join(audited, "case_id", "left")
    is_ = lambda kind: F.col("type") == kind
    actual = F.when(is_("adjudication"), F.col("adjudged")).when(is_("audit"), F.coalesce("audited", F.lit("0"))).otherwise("unknown_case_type")
    expected = F.when(is_("adjudication"), F.col("expected_status")).when(is_("audit"), F.col("expected_unchecked").cast("string")).otherwise(F.col("expected"))
    passed = actual.eqNullSafe(expected)
    return rows.select("case_id", "type", expected.alias("expected"), actual.alias("actual"), passed.alias("passed"), (is_("adjudication") & (actual == "supported_by_evidence") & ~passed).alias("false_supported"))


def replay_totals(replay: DataFrame) -> DataFrame:
    """``(cases, passed, failed, false_supported)`` of a replay."""
    return replay.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if("false_supported").alias("false_supported"))


def compared_runs(capture: DataFrame, one: DataFrame, two: DataFrame, key: str = "id", ignored: tuple[str, ...] = ()) -> DataFrame:
    """``(id, field, one, two)``: what two runs over one frozen capture made differently of an item; identical runs give no row.

    Fields are the columns that the runs have besides the key and ``ignored``, as JSON, so nested ones are compared as a whole. An item
    of the capture that only one run has differs in ``present``; items that aren't of the capture are in no result.
    A key that a table repeats is an error when its rows are joined to others, so keys must be unique in all three.
    """
    fields = sorted((set(one.columns) | set(two.columns)) - {key, *ignored})
    text = lambda df, f: F.to_json(F.struct(F.col(f).alias("v"))) if f in df.columns else F.lit(None).cast("string")
    packed = lambda df, name: df.select(key, F.struct(F.lit("true").alias("present"), *[text(df, f).alias(f) for f in fields]).alias(name))
    both = capture.select(key).join(packed(one, "a"), key, "left").join(packed(two, "b"), key, "left").where("a is not null or b is not null")
    missing = F.col("a").isNull() | F.col("b").isNull()
    shown = lambda x: F.get_json_object(x, "$.v")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), shown(F.col(f"a.{f}")).alias("one"), shown(F.col(f"b.{f}")).alias("two"), (~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias("apart")) for f in fields])
    only = F.array(F.struct(F.lit("present").alias("field"), F.coalesce("a.present", F.lit("false")).alias("one"), F.coalesce("b.present", F.lit("false")).alias("two"), F.lit(True).alias("apart")))
    rows = both.select(key, F.explode(F.when(missing, only).otherwise(pairs) if fields else F.when(missing, only)).alias("p"))
    return rows.where("p.apart").select(key, "p.field", "p.one", "p.two")


def run_costs(runs: DataFrame) -> DataFrame:
    """``runs(model, id, input_tokens, output_tokens, ok)`` summed by model: items, tokens, and how many succeeded and failed."""
    return runs.groupBy("model").agg(F.count("*").alias("items"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if("ok").alias("succeeded"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))
