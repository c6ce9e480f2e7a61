"""The evidence path over the tables: lines stand for proposals, turns of conversations for snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import storage
from ..operators import evidence
from ..streaming import ledger
from .registry import query

_NOW = dt.datetime(2024, 8, 6, 10)

_FIELD = "CASE l_orderkey % 5 WHEN 0 THEN 'title' WHEN 4 THEN 'summary' ELSE 'content' END"
_TEXT = "CASE l_linenumber % 6 WHEN 0 THEN repeat('x', 1001) WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN NULL ELSE l_returnflag || l_linestatus END"
_IMPORTANCE = "CASE l_partkey % 4 WHEN 0 THEN 'headline' WHEN 1 THEN 'minor' ELSE 'load_bearing' END"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 17 = 0 THEN 'extra_key' WHEN field = 'summary' OR importance = 'minor' THEN 'value' WHEN txt IS NULL OR length(txt) NOT BETWEEN 1 AND 1000 THEN 'length'
  WHEN trim(txt) = '' THEN 'blank' WHEN importance = 'headline' AND field <> 'title' THEN 'headline_outside_title' END AS error FROM (SELECT *, {_FIELD} AS field, {_TEXT} AS txt, {_IMPORTANCE} AS importance FROM lineitem)""")
def claim_contracts(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.expr(_FIELD).alias("source_field"), F.expr(_TEXT).alias("source_text"), F.lit(" claim ").alias("normalized_claim"), F.lit("event").alias("kind"), F.expr(_IMPORTANCE).alias("importance"), F.lit("checkable").alias("checkability"))
    keys = F.when(F.col("l_suppkey") % 17 == 0, F.array(F.lit("kind"), F.lit("note"))).otherwise(F.array(F.lit("kind")))
    return rows.select("l_orderkey", "l_linenumber", evidence.claim_error(keys).alias("error"))


_STANCE = "CASE turn % 5 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'irrelevant' WHEN 3 THEN 'context' ELSE 'agrees' END"
_EXCERPT = "CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END"


@query(f"""SELECT conv_id, turn, CASE WHEN stance = 'agrees' OR conv_id % 9 = 0 THEN 'value' WHEN length(excerpt) > 2000 THEN 'length' WHEN stance <> 'irrelevant' AND coalesce(excerpt, '') = '' THEN 'no_excerpt' END AS error
  FROM (SELECT *, {_STANCE} AS stance, {_EXCERPT} AS excerpt FROM conversations)""")
def assessment_contracts(t):
    rows = t("conversations").select("conv_id", "turn", F.expr(_STANCE).alias("stance"), F.expr(_EXCERPT).alias("excerpt"), F.col("role").alias("candidate_id"), F.lit("original").alias("source_class"), F.lit(False).alias("interested_party"), F.when(F.col("conv_id") % 9 == 0, "yes").otherwise("match").alias("entity_match"), F.lit("unknown").alias("temporal_match"), F.lit("mismatch").alias("quantity_match"))
    return rows.select("conv_id", "turn", evidence.assessment_error().alias("error"))


@query("""SELECT c_custkey AS k, CASE WHEN o.n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1) o ON c_custkey = o_custkey
  WHERE c_custkey % 7 > 0 AND (o.n IS NULL OR o.n > 1) UNION ALL SELECT DISTINCT o_custkey, 'unknown' FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 7 = 0""")
def coverage_gaps(t):
    found = t("orders").where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("k"))
    return evidence.uncovered(t("customer").where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("k")), found, "k")


_QUOTED = "split_part(text, ' ', 2)"
_SAID = "CASE turn % 4 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'context' ELSE 'irrelevant' END"
_CLASS = "CASE conv_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'independent_reporting' ELSE 'unknown' END"


@query(f"""WITH s AS (SELECT conv_id::VARCHAR AS claim_id, turn::VARCHAR AS snapshot_id, text, sha256(text) AS hash, {_SAID} AS stance, {_CLASS} AS cls, CASE WHEN turn % 9 = 8 THEN 'absent!' ELSE {_QUOTED} END AS excerpt, conv_id, turn FROM conversations),
  p AS (SELECT * FROM s WHERE NOT (conv_id % 10 = 3 AND turn = 0)), gap AS (SELECT DISTINCT claim_id FROM s WHERE conv_id % 10 = 3 AND turn = 0),
  c AS (SELECT claim_id, hash, count(*) AS copies FROM s GROUP BY ALL),
  e AS (SELECT p.*, copies, strpos(text, excerpt) AS pos, strpos(substr(text, strpos(text, excerpt) + 1), excerpt) AS again, gap.claim_id IS NOT NULL AS wrong FROM p JOIN c USING (claim_id, hash) LEFT JOIN gap USING (claim_id)),
  r AS (SELECT *, CASE WHEN wrong THEN 'coverage' WHEN stance = 'irrelevant' THEN NULL WHEN pos = 0 THEN 'not_exact' WHEN excerpt = '' OR again > 0 THEN 'ambiguous' END AS error FROM e)
  SELECT claim_id, snapshot_id AS candidate_id, error, CASE WHEN ok THEN pos - 1 END AS excerpt_start, CASE WHEN ok THEN pos - 1 + length(excerpt) END AS excerpt_end,
    CASE WHEN ok THEN sha256('evidence-card/v1' || chr(0) || claim_id || chr(0) || snapshot_id || chr(0) || (pos - 1) || chr(0) || (pos - 1 + length(excerpt)) || chr(0) || stance || chr(0) || cls) END AS evidence_id,
    CASE WHEN NOT ok THEN NULL WHEN copies > 1 THEN 'copy:' || hash WHEN cls = 'original' THEN 'url:https://s.example/' || snapshot_id WHEN cls = 'independent_reporting' THEN 'report:https://s.example/' || snapshot_id END AS origin_key
  FROM (SELECT *, error IS NULL AND stance <> 'irrelevant' AS ok FROM r)""")
def anchored_assessments(t):
    """Each claim's snapshots are its conversation's turns; a tenth of the claims lack a proposal."""
    rows = t("conversations").select(F.col("conv_id").cast("string").alias("claim_id"), F.col("turn").cast("string").alias("snapshot_id"), F.col("text").alias("normalized_text"), F.sha2("text", 256).alias("object_hash"), F.concat(F.lit("https://s.example/"), F.col("turn").cast("string")).alias("final_url"), F.expr(_SAID).alias("stance"), F.expr(_CLASS).alias("source_class"), F.expr(f"CASE WHEN turn % 9 = 8 THEN 'absent!' ELSE {_QUOTED} END").alias("excerpt"), "conv_id", "turn")
    proposals = rows.where("not (conv_id % 10 = 3 and turn = 0)").select("claim_id", F.col("snapshot_id").alias("candidate_id"), "excerpt", "stance", "source_class")
    found = evidence.anchored_assessments(proposals, rows.select("claim_id", "snapshot_id", "normalized_text", "object_hash", "final_url"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return found.select("claim_id", "candidate_id", "error", long("excerpt_start"), long("excerpt_end"), "evidence_id", "origin_key")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 5 = 0 OR length(text) < 3 OR turn % 4 = 1 AND upper(substr(text, 2, 3)) <> substr(text, 2, 3)")
def broken_excerpts(t):
    rows = t("conversations").withColumn("sid", F.concat_ws("-", "conv_id", "turn"))
    there = F.expr("substring(text, 2, 3)")
    cards = rows.select("conv_id", "turn", F.col("sid").alias("evidence_snapshot_id"), F.lit(1).alias("excerpt_start"), (F.length(there) + 1).alias("excerpt_end"), F.when(F.length("text") < 3, F.lit("")).when(F.col("turn") % 4 == 1, F.upper(there)).otherwise(there).alias("excerpt"))
    return evidence.broken_excerpts(cards, rows.where("conv_id % 5 > 0").select(F.col("sid").alias("snapshot_id"), F.col("text").alias("normalized_text"))).select("conv_id", "turn")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'not_checkable' ELSE 'verification_error' END AS status, CASE WHEN o_orderstatus = 'F' THEN ['claim_not_checkable'] ELSE [] END AS satisfied,
  CASE WHEN o_orderstatus = 'F' THEN [] ELSE ['required_stage_completed'] END AS missing, 'budget' AS stop_reason, 0::BIGINT AS search_calls FROM orders""")
def error_results(t):
    claims = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "ambiguous").otherwise("checkable").alias("checkability"))
    return evidence.error_results(claims, "budget").select("o_orderkey", "status", "satisfied", "missing", "stop_reason", "search_calls")


@query("""SELECT said AS normalized_claim, min(src) AS source_text FROM (SELECT trim(p_brand || ' ') AS said, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type || (p_partkey % 2) END AS src FROM part) WHERE said <> src GROUP BY said HAVING count(DISTINCT src) = 1
  UNION ALL SELECT p_name || p_partkey, p_type FROM part WHERE p_type <> ''""")
def exact_texts(t):
    p = t("part")
    rows = p.select(F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("normalized_claim"), F.expr("CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type || cast(p_partkey % 2 as string) END").alias("source_text"))
    return evidence.exact_texts(rows.unionByName(p.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("normalized_claim"), F.concat(F.lit("\t"), "p_type").alias("source_text"))))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def enriched_customers(t):
    return evidence.without_failed(t("customer").select(F.col("c_custkey").alias("id")), t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")))


_STAGE = "CASE event_type WHEN 'purchase' THEN 'evidence' ELSE 'claims' END"


@query(f"SELECT max(event_id) AS latest, arg_max({_STAGE}, event_id) AS stage, max(event_id) FILTER ({_STAGE} = 'evidence' AND value > 50) AS complete FROM events")
def latest_runs(t):
    runs = t("events").select(F.col("event_id").alias("run_id"), F.expr(_STAGE).alias("stage"), (F.col("value") > 50).alias("has_claims"))
    return evidence.latest_runs(runs)


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, count(l_orderkey) FILTER (l_returnflag = 'A') AS a, count(l_orderkey) FILTER (l_tax > 0.04) AS x, count(l_orderkey) FILTER (l_discount > 0.05) AS y FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
  SELECT 'verdict' AS measure, l_returnflag AS name, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 2 UNION ALL SELECT 'audit', CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE o_orderstatus END, count(*) FROM r GROUP BY 2
  UNION ALL SELECT 'model', o_orderpriority, count(*) FROM r WHERE o_orderpriority <> '' GROUP BY 2 UNION ALL SELECT 'total', 'reports', count(*) FROM r UNION ALL SELECT 'total', 'unchecked_spans', sum(a)::BIGINT FROM r
  UNION ALL SELECT 'total', 'search_errors', sum(x)::BIGINT FROM r UNION ALL SELECT 'total', 'fetch_errors', sum(y)::BIGINT FROM r""")
def run_summary(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("statuses"), F.count_if(F.col("l_returnflag") == "A").alias("unchecked_spans"), F.count_if(F.col("l_tax") > 0.04).alias("search_errors"), F.count_if(F.col("l_discount") > 0.05).alias("fetch_errors"))
    reports = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("statuses", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("audit_status"), "unchecked_spans", F.col("o_orderpriority").alias("model"), "search_errors", "fetch_errors")
    return evidence.run_summary(reports)


_LINE = "l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag"
_STOP = "CASE l_partkey % 9 WHEN 0 THEN 'no_novelty' WHEN 1 THEN 'budget' WHEN 2 THEN 'not_checkable' ELSE 'sufficient' END"


@query(f"""WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_linenumber)::BIGINT AS calls, sum(l_quantity) AS q, bool_and({_STOP} = 'not_checkable') AS nc, bool_or({_STOP} = 'budget') AS b, bool_or({_STOP} = 'no_novelty') AS nn, string_agg(DISTINCT {_LINE} || '=' || l_returnflag, ',' ORDER BY {_LINE} || '=' || l_returnflag) AS st FROM lineitem WHERE l_orderkey % 4 > 0 GROUP BY 1)
  SELECT o_orderkey AS item_id, coalesce(calls, 0) AS search_calls, coalesce(n, 0) AS documents_fetched, coalesce(st, '') AS statuses, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'budget' ELSE 'backend_error' END WHEN n IS NULL THEN 'no_novelty' WHEN nc THEN 'not_checkable' WHEN b THEN 'budget' WHEN nn THEN 'no_novelty' ELSE 'sufficient' END AS stop_reason,
    CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'timeout' ELSE 'model_error' END END AS verification_error, 1 + coalesce(q, 0) AS duration_seconds FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def report_totals(t):
    results = t("lineitem").where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("item_id"), F.expr(_LINE).alias("claim_id"), F.col("l_returnflag").alias("status"), F.expr(_STOP).alias("stop_reason"), F.col("l_linenumber").alias("search_calls"), F.lit(1).alias("documents_attempted"), F.lit(1).alias("documents_fetched"), F.lit(0).alias("cache_reuse"), F.col("l_quantity").alias("duration_seconds"))
    outcomes = t("orders").select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"), F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "timeout").otherwise("model_error")).alias("error_code"), F.lit(1.0).alias("duration_seconds"))
    found = evidence.report_totals(outcomes, results)
    said = F.array_join(F.transform(F.map_entries("status_by_claim"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("item_id", "search_calls", "documents_fetched", said.alias("statuses"), "stop_reason", "verification_error", "duration_seconds")


@query("""SELECT s_suppkey, list_sort(list_filter(['a', 'b', 'k' || s_suppkey % 3], lambda x: NOT list_contains(listed, x))) AS missing, list_sort(list_filter(listed, lambda x: NOT list_contains(['a', 'b', 'k' || s_suppkey % 3], x))) AS unknown, s_nationkey % 2 = 0 OR list_contains(listed, 'a') AS sent
  FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN ['k1', 'a'] ELSE ['z', 'k2'] END AS listed FROM supplier)""")
def order_gaps(t):
    listed = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("k1"), F.lit("a"))).otherwise(F.array(F.lit("z"), F.lit("k2")))
    loaded = F.array(F.lit("a"), F.lit("b"), F.concat(F.lit("k"), (F.col("s_suppkey") % 3).cast("string")))
    missing, unknown = evidence.order_gaps(loaded, listed)
    wanted = F.when(F.col("s_nationkey") % 2 > 0, listed).otherwise(F.when(F.col("s_nationkey") % 4 == 0, F.array().cast("array<string>")))
    return t("supplier").select("s_suppkey", missing.alias("missing"), unknown.alias("unknown"), evidence.in_languages(F.lit("a"), wanted).alias("sent"))


_SHA = lambda schema, payload: f"sha256('{schema}' || chr(0) || {payload})"
_FETCHED, _SELECTED = "'fetched ' || doc_id || ' ' || coalesce(text, '')", "'selected ' || top || ' ' || source"


@query(f"""
WITH f AS (SELECT doc_id, source, {_SHA("fetched-input/v1", _FETCHED)} AS snapshot FROM documents),
m AS (SELECT doc_id // 6 * 6 AS top, min(doc_id) OVER (PARTITION BY doc_id // 6) AS first, doc_id, snapshot FROM f),
s AS (SELECT top, (SELECT source FROM documents d WHERE d.doc_id = top) AS source, list(snapshot ORDER BY doc_id) AS snapshots FROM m GROUP BY top)
SELECT top AS doc_id, {_SHA("selected-input/v1", _SELECTED)} AS snapshot_id, sha256(array_to_string(snapshots, ',')) AS lineage, CAST(len(snapshots) AS INTEGER) AS n, 'selected' AS stage FROM s""")
def ledger_lineage(t):
    """All documents fetched in one run; every sixth selected, for three pairs that were merged by URL and then by topic."""
    docs = t("documents").select("doc_id", "text", "source")
    book = ledger.Ledger(docs.sparkSession, storage.scratch(docs.sparkSession, "ledger"))
    named = lambda c: F.col(c).cast("string")
    book.start("run-1", docs.select(named("doc_id").alias("item_id"), F.col("source").alias("source_type"), F.expr(_FETCHED).alias("payload")), _NOW)
    pairs = docs.select(F.expr("cast(doc_id div 2 * 2 as string)").alias("survivor"), F.expr("cast(doc_id % 2 as int)").alias("ord"), named("doc_id").alias("member"))
    topics = docs.where("doc_id % 2 = 0").select(F.expr("cast(doc_id div 6 * 6 as string)").alias("survivor"), F.expr("cast(doc_id % 6 as int)").alias("ord"), named("doc_id").alias("member"))
    chosen = docs.where("doc_id % 6 = 0").withColumn("top", F.col("doc_id"))
    book.capture_selected("run-1", chosen.select(named("doc_id").alias("item_id"), F.col("source").alias("source_type"), F.lit("tech").alias("profile"), F.expr(_SELECTED).alias("payload")), pairs, topics, _NOW)
    return book.table("run-1", "selected").select(F.col("item_id").cast("long").alias("doc_id"), "snapshot_id", F.sha2(F.array_join("fetched_snapshots", ","), 256).alias("lineage"), F.size("fetched_snapshots").alias("n"), F.lit(book.manifest("run-1")["stage"]).alias("stage"))


@query("SELECT 'fetched' AS measure, source AS name, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'selected', lang, count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang")
def ledger_collection(t):
    """What the newest readable run fetched and selected; a newer one has written no manifest."""
    docs, good = t("documents"), t("labels").where("quality = 1").select("doc_id").distinct()
    book = ledger.Ledger(docs.sparkSession, storage.scratch(docs.sparkSession, "ledger"))
    items = lambda df: df.select(F.col("doc_id").cast("string").alias("item_id"), F.col("source").alias("source_type"), F.col("lang").alias("profile"), F.to_json(F.struct("doc_id", "text")).alias("payload"))
    none = docs.sparkSession.createDataFrame([], "survivor string, ord int, member string")
    book.start("run-1", items(docs), _NOW)
    book.capture_selected("run-1", items(docs.join(good, "doc_id")), none, none, _NOW)
    docs.select("doc_id").write.parquet(f"{book.root}/runs/run-2/fetched-unfinished")
    return book.collection(book.readable())
