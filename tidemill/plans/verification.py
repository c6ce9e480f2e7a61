"""Claims, evidence and incidents. Order lines stand for claims and their cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, site_pages, verify
from ..streaming import incidents
from .registry import query

#: Passages up to this number (their texts and a key each) are broadcast.
BROADCAST_PASSAGES = 20_000

_KIND = "CASE l_orderkey % 7 WHEN 0 THEN 'announcement' WHEN 1 THEN 'release' WHEN 2 THEN 'quote' WHEN 3 THEN 'quantity' WHEN 4 THEN 'event' WHEN 5 THEN 'opinion' ELSE 'other' END"
_CHECK = "CASE WHEN l_orderkey % 11 = 0 THEN 'not_checkable' ELSE 'checkable' END"
_STANCE = "CASE WHEN l_linenumber % 5 = 4 THEN 'contradicts' WHEN l_linenumber % 7 = 6 THEN 'context' ELSE 'supports' END"
_CLASS = "CASE l_suppkey % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'competent_record' WHEN 2 THEN 'independent_reporting' ELSE 'interested_party' END"
_MATCH = "CASE WHEN l_partkey % 6 = 0 THEN 'mismatch' ELSE 'match' END"
_QUANTITY = "CASE WHEN l_partkey % 4 = 0 THEN 'unknown' ELSE 'match' END"

_STATUS_SQL = f"""
WITH cards AS (SELECT l_orderkey AS claim_id, {_KIND} AS kind, {_STANCE} AS stance, {_CLASS} AS cls, l_suppkey % 4 = 3 AS interested, {_MATCH} AS m, {_QUANTITY} AS q, 'o' || (l_suppkey % 3) AS origin FROM lineitem),
e AS (SELECT * FROM cards WHERE m = 'match' AND NOT (interested AND kind NOT IN ('announcement', 'release', 'quote')) AND CASE WHEN stance = 'supports' AND kind = 'quantity' THEN q = 'match' ELSE stance IN ('supports', 'contradicts') END),
f AS (SELECT claim_id, bool_or(stance = 'supports') AS s, bool_or(stance = 'contradicts') AS c, bool_or(stance = 'contradicts' AND cls IN ('original', 'competent_record')) AS dc, bool_or(stance = 'supports' AND cls IN ('original', 'competent_record')) AS ds,
  bool_or(stance = 'supports' AND cls = 'competent_record') AS rs, bool_or(stance = 'supports' AND cls IN ('original', 'competent_record') AND q = 'match') AS qs, count(DISTINCT origin) FILTER (stance = 'supports') AS o FROM e GROUP BY claim_id),
claims AS (SELECT DISTINCT l_orderkey AS claim_id, {_KIND} AS kind, {_CHECK} AS checkability, l_orderkey % 13 = 0 AS stage_error FROM lineitem),
st AS (SELECT claim_id, kind, CASE WHEN checkability <> 'checkable' THEN 'not_checkable' WHEN stage_error THEN 'verification_error' WHEN s AND c THEN 'mixed_evidence' WHEN dc THEN 'contradicted_by_evidence'
  WHEN CASE kind WHEN 'event' THEN rs OR o >= 2 WHEN 'quantity' THEN qs ELSE ds END THEN 'supported_by_evidence' ELSE 'insufficient_evidence' END AS status FROM claims LEFT JOIN f USING (claim_id)),
pub AS (SELECT *, CASE WHEN status = 'verification_error' THEN 'check_error' WHEN status IN ('contradicted_by_evidence', 'mixed_evidence') THEN 'disputed' WHEN status = 'not_checkable' THEN CASE WHEN kind = 'opinion' THEN 'anecdotal' ELSE 'not_applicable' END
  WHEN status = 'insufficient_evidence' THEN CASE WHEN kind IN ('event', 'other') AND claim_id % 100 < 72 THEN 'provisional' WHEN kind = 'quantity' THEN 'primary_report_only' ELSE 'insufficient' END
  ELSE CASE kind WHEN 'announcement' THEN 'official_announcement' WHEN 'release' THEN 'official_release' WHEN 'quote' THEN 'attributed_quote' WHEN 'quantity' THEN 'source_documented_quantity' WHEN 'event' THEN 'corroborated_event' WHEN 'opinion' THEN 'anecdotal' ELSE 'source_supported' END END AS public_status FROM st)"""


def _claims(t):
    return t("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.expr(_KIND).alias("kind"), F.expr(_CHECK).alias("checkability"), (F.col("l_orderkey") % 13 == 0).alias("stage_error")).distinct()


def _cards(t):
    return t("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.expr(_STANCE).alias("stance"), F.expr(_CLASS).alias("source_class"), (F.col("l_suppkey") % 4 == 3).alias("interested_party"), F.expr(_MATCH).alias("entity_match"), F.lit("match").alias("temporal_match"), F.expr(_QUANTITY).alias("quantity_match"), F.concat(F.lit("o"), (F.col("l_suppkey") % 3).cast("string")).alias("origin_key"))


def _public(t):
    age = (F.col("claim_id") % 100).cast("double")
    return verify.adjudicated(_claims(t), _cards(t)).withColumn("public_status", verify.public_status(F.col("kind"), F.col("status"), age))


@query(f"{_STATUS_SQL} SELECT claim_id, status, public_status FROM pub")
def claim_status(t):
    return _public(t).select("claim_id", "status", "public_status")


@query(f"""{_STATUS_SQL}, a AS (SELECT claim_id // 10 AS item_id, count(*) AS n, bool_or(status = 'verification_error') AS e, bool_and(public_status IN ('anecdotal', 'not_applicable')) AS moot, bool_or(public_status = 'provisional') AS p, bool_or(status IN ('insufficient_evidence', 'not_checkable')) AS o FROM pub GROUP BY 1)
SELECT item_id, CASE WHEN item_id % 17 = 0 OR e THEN 'check_error' WHEN moot THEN 'not_applicable' WHEN p THEN 'provisional' WHEN o THEN 'partial' ELSE 'complete' END AS state FROM a""")
def public_state(t):
    claims = _public(t).withColumn("item_id", F.expr("claim_id div 10"))
    items = claims.select("item_id").distinct().withColumn("extraction_status", F.when(F.col("item_id") % 17 == 0, "error").otherwise("ok"))
    return verify.public_states(items, claims).select("item_id", "state")


@query("SELECT user_id, CASE WHEN bool_and(r = 'not_checkable') THEN 'not_checkable' WHEN bool_or(r = 'backend_error') THEN 'backend_error' WHEN bool_or(r = 'budget') THEN 'budget' WHEN bool_or(r = 'source_unavailable') THEN 'source_unavailable' WHEN bool_or(r = 'no_novelty') THEN 'no_novelty' ELSE 'sufficient' END AS stop_reason FROM (SELECT user_id, CASE WHEN event_id % 37 = 0 THEN 'backend_error' WHEN event_id % 11 = 0 THEN 'budget' WHEN event_id % 5 = 0 THEN 'no_novelty' WHEN event_id % 3 = 0 THEN 'sufficient' ELSE 'not_checkable' END AS r FROM events) GROUP BY user_id")
def stop_reason(t):
    r = F.expr("CASE WHEN event_id % 37 = 0 THEN 'backend_error' WHEN event_id % 11 = 0 THEN 'budget' WHEN event_id % 5 = 0 THEN 'no_novelty' WHEN event_id % 3 = 0 THEN 'sufficient' ELSE 'not_checkable' END")
    return verify.stop_reasons(t("events").select("user_id", r.alias("stop_reason")), "user_id")


@query("SELECT b.item_id, d.doc_id, CAST(instr(d.text, b.text) - 1 AS INT) AS source_start FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> '' AND instr(substring(d.text, instr(d.text, b.text) + 1), b.text) = 0")
def anchored_spans(t):
    """Whole passages in whole documents. A passage's fourth to sixth words stand whole in any text that holds it, so
    that only documents with those three words in a row are searched for it; for one of three to seven words, only documents with
    its second word. Passages of one or two words are searched for in all.
    """
    b = t("benchmark").select("item_id", F.col("text").alias("span")).where("span <> ''").withColumn("w", F.split("span", "[\\s\\x0B]+"))
    words = F.filter(F.split("text", "[\\s\\x0B]+"), lambda w: w != "")
    docs = t("documents").select("doc_id", "text")
    three = lambda w, i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
    long, middle = F.size("w") >= 8, F.size("w").between(3, 7)
    keyed = b.where(long | middle).select("item_id", "span", F.when(long, three(F.col("w"), F.lit(4))).otherwise(F.xxhash64(F.element_at("w", 2))).alias("key"))
    # passages are few beside documents: where they are, each task looks its documents' keys up and nothing is shuffled
    asked = F.broadcast(keyed) if keyed.count() <= BROADCAST_PASSAGES else keyed
    rows = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: three(F.col("w"), i))).otherwise(F.array().cast("array<bigint>"))
    ones = F.transform("w", lambda x: F.xxhash64(x))
    keys = docs.select("doc_id", words.alias("w")).select("doc_id", F.explode(F.array_distinct(F.concat(rows, ones))).alias("key"))
    met = keys.join(asked, "key").select("doc_id", "item_id", "span").distinct().join(docs, "doc_id")
    few = docs.join(b.where(F.size("w") < 3).select("item_id", "span"), F.contains("text", F.col("span"))).select("doc_id", "item_id", "span", "text")
    pairs = met.unionByName(few).where(F.contains("text", F.col("span")))
    return pairs.select("item_id", "doc_id", verify.span_start(F.col("text"), F.col("span")).alias("source_start")).where("source_start is not null")


@query()
def incident_merge(t):
    spark = t("events").sparkSession
    e = t("events")
    state = incidents.state_of(F.col("event_id") % 50 == 0, F.when(F.col("event_id") % 3 == 0, "disputed").when(F.col("event_id") % 3 == 1, "corroborated_event"))
    rec = e.select(F.col("event_id").alias("ord"), F.concat(F.lit("incident-"), F.col("user_id").cast("string")).alias("incident_id"), F.lit("security").alias("profile"), F.col("props").alias("claim"), state.alias("state"), F.col("event_id").cast("string").alias("item_id"), F.concat(F.lit("https://example.org/"), F.col("event_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("checked_at"), F.lit(None).cast("string").alias("next_check_at"))
    old = incidents.merged(spark.createDataFrame([], incidents.SCHEMA), rec.where("ord % 2 = 0"), "2024-01-29T00:00:00Z")
    return incidents.merged(old, rec.where("ord % 2 = 1"), "2024-01-30T00:00:00Z")


_STANCE_OF = "CASE o_orderstatus WHEN 'F' THEN 'supports' WHEN 'O' THEN 'contradicts' ELSE 'context' END"
_CLASS_OF = "CASE o_orderpriority WHEN '1-URGENT' THEN 'original' WHEN '2-HIGH' THEN 'competent_record' ELSE 'independent_reporting' END"
_MATCH_OF = "CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 = o_custkey % 3 THEN 'match' ELSE 'mismatch' END"
_EXPECTED = "CASE c_custkey % 3 WHEN 0 THEN 'supported_by_evidence' WHEN 1 THEN 'insufficient_evidence' ELSE 'mixed_evidence' END"


@query(f"""
WITH k AS (SELECT o_custkey AS id, {_STANCE_OF} AS stance, {_CLASS_OF} AS class, o_orderkey % 2 AS origin FROM orders WHERE {_MATCH_OF} = 'match'),
g AS (SELECT id, bool_or(stance = 'supports') AS s, bool_or(stance = 'contradicts') AS c, bool_or(stance = 'contradicts' AND class <> 'independent_reporting') AS dc, bool_or(stance = 'supports' AND class <> 'independent_reporting') AS ds,
  bool_or(stance = 'supports' AND class = 'competent_record') AS rs, count(DISTINCT origin) FILTER (stance = 'supports') AS origins FROM k GROUP BY id),
a AS (SELECT c_custkey AS case_id, {_EXPECTED} AS expected, CASE WHEN c_custkey % 7 = 0 THEN 'not_checkable' WHEN c_custkey % 10 = 0 THEN 'verification_error' WHEN s AND c THEN 'mixed_evidence' WHEN dc THEN 'contradicted_by_evidence'
  WHEN CASE WHEN c_nationkey % 2 = 0 THEN rs OR origins >= 2 ELSE ds END THEN 'supported_by_evidence' ELSE 'insufficient_evidence' END AS actual FROM customer LEFT JOIN g ON id = c_custkey)
SELECT case_id, expected, actual, expected = actual AS passed, actual = 'supported_by_evidence' AND expected <> actual AS false_supported FROM a""")
def adversarial_replay(t):
    """A case of adjudication for each customer, its cards the customer's orders."""
    orders = t("orders").selectExpr("o_custkey", f"struct({_STANCE_OF} AS stance, {_CLASS_OF} AS source_class, {_MATCH_OF} AS entity_match, cast(o_orderkey % 2 as string) AS origin_key) AS card")
    cards = orders.groupBy("o_custkey").agg(F.collect_list("card").alias("cards"))  # the cards of one case
    rows = t("customer").join(cards, F.col("c_custkey") == F.col("o_custkey"), "left")
    case = F.struct(F.lit("adjudication").alias("type"), F.expr(_EXPECTED).alias("expected_status"), (F.col("c_custkey") % 10 == 0).alias("required_stage_error"), F.struct(F.when(F.col("c_nationkey") % 2 == 0, "event").otherwise("release").alias("kind"), F.when(F.col("c_custkey") % 7 == 0, "not_checkable").otherwise("checkable").alias("checkability")).alias("claim"), "cards")
    return evaluation.replayed(rows.select(F.col("c_custkey").alias("case_id"), F.to_json(case).alias("case"))).drop("type")


@query("""
WITH p AS (SELECT doc_id, doc_id % 11 > 0 AS a, doc_id % 13 > 0 AS b, lang, n_chars FROM documents)
SELECT doc_id, 'present' AS field, CAST(a AS VARCHAR) AS one, CAST(b AS VARCHAR) AS two FROM p WHERE a <> b
UNION ALL SELECT doc_id, 'lang', lang, 'xx' FROM p WHERE a AND b AND doc_id % 5 = 0
UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR), CAST(n_chars + 1 AS VARCHAR) FROM p WHERE a AND b AND doc_id % 7 = 0""")
def compared_runs(t):
    """Two runs over all documents that differ in some, and that each lack some."""
    docs = t("documents").select("doc_id", "lang", "n_chars", "source")
    two = docs.where("doc_id % 13 > 0").withColumns({"lang": F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")), "n_chars": F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)})
    return evaluation.compared_runs(docs, docs.where("doc_id % 11 > 0"), two, key="doc_id")


_PAGE_KIND = "CASE l_linenumber % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'quote' ELSE 'opinion' END"
_PAGE_STATUS = "CASE l_linenumber % 4 WHEN 0 THEN 'mixed_evidence' WHEN 1 THEN 'verification_error' ELSE 'supported_by_evidence' END"
_PAGE_STANCE = "CASE s_suppkey % 5 WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'context' ELSE 'supports' END"


@query(f"""
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem WHERE l_linenumber % 6 > 0 GROUP BY ALL),
ids AS (SELECT l_orderkey, l_linenumber, 0 AS n, l_suppkey AS e FROM l UNION ALL SELECT l_orderkey, l_linenumber, 1, l_partkey % 40 FROM l UNION ALL SELECT l_orderkey, l_linenumber, 2, l_suppkey FROM l),
c AS (SELECT s_suppkey AS e, {_PAGE_STANCE} AS stance, 'https://s' || s_suppkey % 9 || '.example/' AS url FROM supplier WHERE s_suppkey % 5 > 0),
f AS (SELECT l_orderkey, l_linenumber, url, stance, min(n) AS n FROM ids JOIN c USING (e) GROUP BY ALL),
s AS (SELECT l_orderkey, l_linenumber, string_agg(stance || ' ' || url, ' ' ORDER BY n) AS sources FROM f GROUP BY ALL),
k AS (SELECT l.*, {_PAGE_KIND} AS kind, {_PAGE_STATUS} AS status, coalesce(sources, '') AS sources FROM l LEFT JOIN s USING (l_orderkey, l_linenumber)),
t AS (SELECT l_orderkey, count(*) AS n, string_agg(l_returnflag || l_linenumber || ' ' || kind || ' ' || CASE status WHEN 'mixed_evidence' THEN 'disputed' WHEN 'verification_error' THEN 'check_error' ELSE CASE kind WHEN 'event' THEN 'corroborated_event' WHEN 'quote' THEN 'attributed_quote' ELSE 'anecdotal' END END || ': ' || sources, '; ' ORDER BY l_linenumber) AS said FROM k GROUP BY l_orderkey)
SELECT o_orderkey AS report_id, c_name AS title, CAST(coalesce(n, 0) AS INTEGER) AS claims, coalesce(said, '') AS said FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN t ON l_orderkey = o_orderkey""")
def page_models(t):
    """A report for each order about its customer, its lines the claims; suppliers are cards."""
    key = F.concat("l_orderkey", F.lit("-"), "l_linenumber")
    named = lambda x: F.concat(F.lit("e"), x.cast("string"))
    # the lines of one order are dealt out once, by it: what groups by order and line, and then by order, finds them together
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    row = F.struct("l_linenumber", key.alias("key"), F.expr(_PAGE_STATUS).alias("status"), F.array(named(F.col("l_suppkey")), named(F.col("l_partkey") % 40), named(F.col("l_suppkey"))).alias("ids"))
    of = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("x"))  # the lines of one order
    maps = of.select("l_orderkey", F.map_from_arrays("x.key", "x.status").alias("status_by_claim"), F.map_from_arrays("x.key", "x.ids").alias("evidence_ids_by_claim"))
    reports = t("orders").join(maps, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("item_id"), F.col("o_orderdate").alias("checked_at"), "status_by_claim", "evidence_ids_by_claim")
    items = t("customer").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("title"), F.lit("https://n.example/").alias("url"), F.lit(None).cast("timestamp").alias("published_at"))
    own = t("lineitem").where("l_linenumber % 6 > 0").select(key.alias("claim_id"), "l_linenumber", "l_returnflag").repartition("claim_id").groupBy("claim_id").agg(F.min("l_linenumber").alias("l_linenumber"), F.min("l_returnflag").alias("l_returnflag"))
    claims = own.select("claim_id", F.expr(_PAGE_KIND).alias("kind"), F.concat("l_returnflag", "l_linenumber").alias("source_text"), F.lit("said").alias("normalized_claim"))
    cards = t("supplier").select(named(F.col("s_suppkey")).alias("evidence_id"), F.col("s_suppkey").alias("snapshot_id"), F.expr(_PAGE_STANCE).alias("stance"), F.lit("original").alias("source_class"))
    snapshots = t("supplier").select(F.col("s_suppkey").alias("snapshot_id"), F.concat(F.lit("https://s"), (F.col("s_suppkey") % 9).cast("string"), F.lit(".example/")).alias("final_url"))
    said = F.transform("claims", lambda c: F.concat(c["text"], F.lit(" "), c["kind"], F.lit(" "), c["public_status"], F.lit(": "), F.array_join(F.transform(c["sources"], lambda s: F.concat(s["stance"], F.lit(" "), s["url"])), " ")))
    return site_pages.page_models(reports, items, claims, cards, snapshots).select("report_id", "title", F.size("claims").alias("claims"), F.array_join(said, "; ").alias("said"))
