"""Claims and evidence: anchoring of spans, eligibility, adjudication, public statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vocabularies and patterns of the verification contract.
KINDS = ("announcement", "release", "quote", "quantity", "event", "opinion", "other")
DIRECT = ("original", "competent_record")
RELEASE_TERMS = "(?iU)\\b(releas(?:e|ed|es)|launch(?:ed|es)?|ship(?:ped|s)?|publish(?:ed|es)?|выпустил[аи]?|выпущен[аоы]?|вышел|запустил[аи]?|опубликовал[аи]?)\\b"
ANNOUNCEMENT_TERMS = "(?iU)\\b(announce(?:d|ment|s)?|unveil(?:ed|s)?|introduc(?:e|ed|es|tion)|анонс(?:ировал[аи]?|ирует|ирован)?|объявил[аи]?|представил[аи]?)\\b"
QUANTITY_TERMS = "(?iU)(?:\\d|%|\\b(?:score|benchmark|parameter|token|second|minute|hour|byte|kb|mb|gb|tb|million|billion|trillion|цена|стоимост|балл|параметр|токен|секунд|минут|час|байт|кб|мб|гб|тб|млн|млрд|трлн)\\b)"
SUPPORTED_AS = {"announcement": "official_announcement", "release": "official_release", "quote": "attributed_quote", "quantity": "source_documented_quantity", "event": "corroborated_event", "opinion": "anecdotal"}
QUERY_TERMS = {"announcement": "official announcement", "release": "official release changelog", "quote": "original transcript", "quantity": "official methodology results", "event": "official record", "opinion": "original statement", "other": "primary source"}
STOP_ORDER = ("backend_error", "budget", "source_unavailable", "no_novelty")
CLAIM_SCHEMA = "claim/v1"


def eligible(kind: Column, card: Column | None = None) -> Column:
    """May a card count: it matches entity and time, isn't an interested party's unless the claim is the party's own, and says something definite."""
    c = (lambda n: card[n]) if card is not None else F.col
    own = kind.isin("announcement", "release", "quote")
    says = F.when((c("stance") == "supports") & (kind == "quantity"), c("quantity_match") == "match").otherwise(c("stance").isin("supports", "contradicts"))
    return F.coalesce((c("entity_match") == "match") & (c("temporal_match") == "match") & (~c("interested_party") | own) & says, F.lit(False))


def adjudicated(claims: DataFrame, cards: DataFrame) -> DataFrame:
    """``claims(claim_id, kind, checkability, stage_error)`` with ``status``, ``satisfied`` and ``missing`` gates.

    ``cards(claim_id, stance, source_class, interested_party, entity_match, temporal_match, quantity_match,
    origin_key)`` are reduced by claim to flags and a count of origins: partial aggregates, however many cards.
    """
    kinds = claims.select("claim_id", "kind")
    real = cards.join(kinds, "claim_id").where(eligible(F.col("kind")))
    support, against, direct = F.col("stance") == "supports", F.col("stance") == "contradicts", F.col("source_class").isin(*DIRECT)
    flags = real.groupBy("claim_id").agg(
        F.bool_or(support).alias("s"),
        F.bool_or(against).alias("c"),
        F.bool_or(against & direct).alias("direct_c"),
        F.bool_or(support & direct).alias("direct_s"),
        F.bool_or(support & (F.col("source_class") == "competent_record")).alias("record_s"),
        F.bool_or(support & direct & (F.col("quantity_match") == "match")).alias("quantity_s"),
        F.count_distinct(F.when(support, F.col("origin_key"))).alias("origins"),
    )
    rows = claims.join(flags, "claim_id", "left")
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    met = F.when(F.col("kind") == "event", flag("record_s") | (F.coalesce("origins", F.lit(0)) >= 2)).when(F.col("kind") == "quantity", flag("quantity_s")).otherwise(flag("direct_s"))
    gate = F.when(F.col("kind") == "event", "competent_record_or_two_origins").when(F.col("kind") == "quantity", "direct_quantity_with_matching_scope").otherwise("direct_primary_support")
    status = F.when(F.col("checkability") != "checkable", "not_checkable").when(F.coalesce("stage_error", F.lit(False)), "verification_error").when(flag("s") & flag("c"), "mixed_evidence").when(flag("direct_c"), "contradicted_by_evidence").when(met, "supported_by_evidence").otherwise("insufficient_evidence")
    rows = rows.withColumn("status", status)
    none = F.array().cast("array<string>")
    is_ = lambda s: F.col("status") == s
    satisfied = F.when(is_("not_checkable"), F.array(F.lit("claim_not_checkable"))).when(is_("mixed_evidence"), F.array(F.lit("eligible_support"), F.lit("eligible_contradiction"))).when(is_("contradicted_by_evidence"), F.array(F.lit("direct_contradiction"))).when(is_("supported_by_evidence"), F.array(gate)).otherwise(none)
    missing = F.when(is_("verification_error"), F.array(F.lit("required_stage_completed"))).when(is_("insufficient_evidence"), F.array(gate, F.lit("direct_contradiction"))).otherwise(none)
    return rows.select(*claims.columns, "status", satisfied.alias("satisfied"), missing.alias("missing"))


def final_status(status: Column, discarded: Column, search_errors: Column) -> Column:
    """A discarded assessment leaves a claim open; an open claim after a failed search is an error."""
    after = F.when(discarded > 0, "insufficient_evidence").otherwise(status)
    return F.when((after == "insufficient_evidence") & (search_errors > 0), "verification_error").otherwise(after)


def public_status(kind: Column, status: Column, age_hours: Column) -> Column:
    """What readers are told."""
    table = F.create_map(*[F.lit(x) for pair in SUPPORTED_AS.items() for x in pair])
    return (
        F.when(status == "verification_error", "check_error")
        .when(status.isin("contradicted_by_evidence", "mixed_evidence"), "disputed")
        .when((status == "not_checkable") & (kind == "opinion"), "anecdotal")
        .when(status == "not_checkable", "not_applicable")
        .when((status == "insufficient_evidence") & kind.isin("event", "other") & (age_hours < 72), "provisional")
        .when((status == "insufficient_evidence") & (kind == "quantity"), "primary_report_only")
        .when(status == "insufficient_evidence", "insufficient")
        .otherwise(F.coalesce(F.try_element_at(table, kind), F.lit("source_supported")))
    )


def public_states(items: DataFrame, claims: DataFrame) -> DataFrame:
    """``items(item_id, extraction_status)`` with the state of all their ``claims(item_id, status, public_status)``."""
    by = claims.groupBy("item_id").agg(F.count("*").alias("n"), F.bool_or(F.col("status") == "verification_error").alias("error"), F.bool_and(F.col("public_status").isin("anecdotal", "not_applicable")).alias("moot"), F.bool_or(F.col("public_status") == "provisional").alias("provisional"), F.bool_or(F.col("status").isin("insufficient_evidence", "not_checkable")).alias("open"))
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    state = F.when((F.col("extraction_status") == "error") | flag("error"), "check_error").when(F.col("n").isNull() | flag("moot"), "not_applicable").when(flag("provisional"), "provisional").when(flag("open"), "partial").otherwise("complete")
    return items.join(by, "item_id", "left").select(*items.columns, state.alias("state"))


def stop_reasons(reasons: DataFrame, key: str) -> DataFrame:
    """One reason a key: all not checkable, else the first of the order that occurs, else sufficient."""
    r = F.col("stop_reason")
    out = F.when(F.bool_and(r == "not_checkable"), "not_checkable")
    for name in STOP_ORDER:
        out = out.when(F.bool_or(r == name), name)
    return reasons.groupBy(key).agg(out.otherwise("sufficient").alias("stop_reason"))


def conservative_kind(kind: Column, source_text: Column, claim: Column) -> Column:
    """An announcement or release only where the words say so."""
    text = F.concat(source_text, F.lit(" "), claim)
    own = F.when(text.rlike(RELEASE_TERMS), "release").when(text.rlike(ANNOUNCEMENT_TERMS), "announcement").when(text.rlike(QUANTITY_TERMS), "quantity").otherwise("other")
    return F.when(kind.isin("announcement", "release"), own).when(kind.isin(*KINDS), kind).otherwise("other")


def span_start(source: Column, span: Column) -> Column:
    """Zero-based place of a span that occurs exactly once, else null."""
    first = F.instr(source, span)
    again = F.instr(F.substring(source, first + 1, F.length(source)), span)
    return F.when((F.length(span) > 0) & (first > 0) & (again == 0), first - 1)


def anchored_claims(proposals: DataFrame, max_claims: int = 3) -> DataFrame:
    """``proposals(snapshot_id, ord, source_field, source, source_text, normalized_claim, kind, ...)`` that hold, at most so many of a snapshot.

    A span must occur exactly once in its field; of equal spans, and of equal claims but for case, the first
    stays. The rule is greedy: a proposal is compared with those that stayed, so both keys are looked at in order.
    """
    found = proposals.withColumn("source_start", span_start(F.col("source"), F.col("source_text"))).where("source_start is not null")
    found = found.withColumn("source_end", F.col("source_start") + F.length("source_text"))
    row = F.struct("ord", F.concat_ws("\0", "source_field", F.col("source_start").cast("string"), F.col("source_end").cast("string")).alias("place"), F.lower("normalized_claim").alias("said"))
    start = F.array().cast("array<struct<ord:bigint,place:string,said:string>>")

    def step(acc: Column, x: Column) -> Column:
        known = F.exists(acc, lambda y: (y["place"] == x["place"]) | (y["said"] == x["said"]))
        return F.when(known | (F.size(acc) >= max_claims), acc).otherwise(F.concat(acc, F.array(F.struct(x["ord"].cast("long").alias("ord"), x["place"].alias("place"), x["said"].alias("said")))))

    kept = found.groupBy("snapshot_id").agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step).alias("k")).select("snapshot_id", F.explode("k.ord").alias("ord"))
    claim_id = F.sha2(F.concat_ws("\0", F.lit(CLAIM_SCHEMA), "snapshot_id", "source_field", F.col("source_start").cast("string"), F.col("source_end").cast("string"), "normalized_claim"), 256)
    return found.join(kept, ["snapshot_id", "ord"]).withColumn("claim_id", claim_id).withColumn("kind", conservative_kind(F.col("kind"), F.col("source_text"), F.col("normalized_claim")))


def search_queries(claim: Column, kind: Column) -> Column:
    """Three search phrases of a claim, from its first six different names and numbers."""
    words = F.regexp_extract_all(claim, F.lit("(?U)([^\\W_][\\w.-]*)"), F.lit(1))
    named = F.filter(words, lambda w: (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))) | w.rlike("(?U)\\d") | ((w == F.upper(w)) & (w != F.lower(w))))
    once = F.filter(named, lambda w, i: F.size(F.filter(F.slice(named, 1, F.greatest(i, F.lit(0))), lambda v: F.lower(v) == F.lower(w))) == 0)
    names = F.array_join(F.when(F.size(once) > 0, F.slice(once, 1, 6)).otherwise(F.slice(words, 1, 8)), " ")
    table = F.create_map(*[F.lit(x) for pair in QUERY_TERMS.items() for x in pair])
    quoted = F.concat(F.lit('"'), claim, F.lit('"'))
    return F.array(F.concat(quoted, F.lit(" "), F.try_element_at(table, kind)), F.concat(F.lit('"'), names, F.lit('" '), kind, F.lit(" independent report")), F.concat(quoted, F.lit(" correction denied false")))


def evidence_documents(hits: DataFrame, max_documents: int) -> DataFrame:
    """``hits(claim_id, ord, url)`` to fetch: the first of each evidence URL, at most so many of a claim."""
    from ..functions.urls import evidence_url
    from .dedup import keep_first

    once = keep_first(hits.withColumn("where", evidence_url(F.col("url"), ascii_hosts=True)), "claim_id", "where")
    return once.withColumn("__r", F.row_number().over(Window.partitionBy("claim_id").orderBy("ord"))).where(F.col("__r") <= max_documents).drop("__r")


def public_sources(cards: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Sources to show of each claim: the first of each URL and stance."""
    from .dedup import keep_first

    shown = cards.where(F.col("stance").isin("supports", "contradicts", "context")).join(snapshots.select("snapshot_id", "final_url"), "snapshot_id")
    return keep_first(shown, "claim_id", "final_url", "stance").select("claim_id", "ord", F.col("final_url").alias("url"), "stance", "source_class")


def evidence_snapshots(outcomes: DataFrame, normalizer: str = "text/v1", text: Column | None = None) -> DataFrame:
    """``outcomes(requested_url, final_url, status, mime_type, text)`` that hold a text, with content hash and id.

    ``text`` says what a document holds (see :func:`tidemill.sources.pages.document_text`); else it is the column's lines.
    """
    from ..functions.text import normalized_lines
    from ..functions.urls import evidence_url

    rows = outcomes.where("status = 'ok' and mime_type is not null and final_url is not null").withColumn("normalized_text", normalized_lines(F.col("text")) if text is None else text).where("normalized_text is not null")
    hash_ = F.sha2("normalized_text", 256)
    return rows.withColumn("object_hash", hash_).withColumn("snapshot_id", F.sha2(F.concat_ws("\0", evidence_url(F.col("final_url"), ascii_hosts=True), "object_hash", F.lit(normalizer)), 256))
