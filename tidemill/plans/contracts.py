"""Queries of single rules: each function's contract over a table, beside SQL that states the same rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times, urls
from ..operators import dedup, select, stats, text_packing, verify
from ..sources import sinks
from .registry import query

_WORDS = r"regexp_extract_all(replace(lower(coalesce({0}, '')), 'ё', 'е'), '[\pL\pM\p{{Nd}}\p{{Pc}}-]+')"


@query(r"SELECT doc_id, regexp_replace(text || ' [tool-' || doc_id || '-1]\[tool-2-3\] end' || chr(9) || '[tool-x-1]', '[ \t]*(?:\\?\[tool-[0-9]+-[0-9]+\\?\])+', '', 'g') AS text FROM documents")
def tool_tokens(t):
    marked = F.concat("text", F.lit(" [tool-"), F.col("doc_id").cast("string"), F.lit("-1]\\[tool-2-3\\] end\t[tool-x-1]"))
    return t("documents").select("doc_id", tx.without_tool_tokens(marked).alias("text"))


_LEAKS = "CASE doc_id % 6 WHEN 0 THEN text || '中' WHEN 1 THEN 'カ' || text WHEN 2 THEN text || '한' WHEN 3 THEN text || '豈' WHEN 4 THEN NULL ELSE text END"


@query(f"SELECT doc_id, coalesce(regexp_matches({_LEAKS}, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7af}}\\x{{f900}}-\\x{{faff}}]'), false) AS in_russian, false AS in_chinese FROM documents")
def cjk_leaks(t):
    text = F.expr(_LEAKS)
    return t("documents").select("doc_id", tx.has_cjk_leak(text, "ru").alias("in_russian"), tx.has_cjk_leak(text, "zh-TW").alias("in_chinese"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, 'e', '中'), 'o', '㐀'), '([\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}])([A-Za-z0-9])', '\1 \2', 'g'), '([A-Za-z0-9])([\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}])', '\1 \2', 'g') AS text FROM documents")
def spaced_scripts(t):
    return t("documents").select("doc_id", tx.spaced_scripts(F.replace(F.replace("text", F.lit("e"), F.lit("中")), F.lit("o"), F.lit("㐀"))).alias("text"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def untagged_pages(t):
    return t("pages").select("page_id", tx.untagged(F.col("html")).alias("text"))


_URL = "CASE page_id % 5 WHEN 0 THEN replace(url, '://', '://me:pw@') || '#top' WHEN 1 THEN regexp_replace(url, '^([^/]*//[^/?#]*)', '\\1:8080/bot42:Ab_c-d') WHEN 2 THEN 'no url' WHEN 3 THEN upper(url) || '?x=1' ELSE url END"
_SPARK_URL = _URL.replace("'\\1:8080", "'$1:8080").replace("\\", "\\\\")
_AUTHORITY = "regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_BARE_PATH = "regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, {_URL} AS u FROM pages)
SELECT page_id, CASE WHEN {_AUTHORITY} = '' THEN '<redacted-url>' ELSE lower(split_part(u, '://', 1)) || '://' || regexp_replace({_AUTHORITY}, '^.*@', '') || regexp_replace({_BARE_PATH}, '/bot[0-9]+:[A-Za-z0-9_-]+', '/bot<redacted>', 'g') END AS shown,
  CASE WHEN {_AUTHORITY} <> '' THEN lower(split_part(u, '://', 1)) || '://' || lower(regexp_replace({_AUTHORITY}, '^.*@', '')) || {_BARE_PATH} || CASE WHEN contains(lower({_AUTHORITY}), 'example') AND contains(regexp_extract(u, '\\?([^#]*)', 1), 'utm_source=') THEN '?' || regexp_extract(u, '\\?([^#]*)', 1) ELSE '' END END AS public FROM p""")
def shown_urls(t):
    p = t("pages").select("page_id", F.expr(_SPARK_URL).alias("u"))
    return p.select("page_id", urls.without_secrets(F.col("u")).alias("shown"), urls.public_link(F.col("u"), {"example": "utm_source="}).alias("public"))


_WATCH = "CASE page_id % 4 WHEN 0 THEN 'https://www.example.com/watch?list=1&v=' || substring(sha256(url), 1, 11) || '&t=2' WHEN 1 THEN 'https://youtu.be/' || substring(sha256(url), 1, 11) WHEN 2 THEN 'https://m.example.com/live/short/' ELSE url END"


@query(f"SELECT page_id, CASE WHEN regexp_matches(u, '(v=|/shorts/|/live/|youtu\\.be/)[0-9A-Za-z_-]{{11}}') THEN regexp_extract(u, '(v=|/shorts/|/live/|youtu\\.be/)([0-9A-Za-z_-]{{11}})', 2) ELSE string_split(rtrim(u, '/'), '/')[-1] END AS video FROM (SELECT page_id, {_WATCH} AS u FROM pages)")
def video_ids(t):
    return t("pages").select("page_id", urls.video_id(F.expr(_WATCH.replace("sha256(url)", "sha2(url, 256)"))).alias("video"))


@query("SELECT p_partkey, 'item-' || CASE WHEN s = '' THEN 'unclassified' ELSE s END || '-' || p_size AS anchor FROM (SELECT p_partkey, p_size, trim(regexp_replace(CASE WHEN p_partkey % 9 = 0 THEN ' ## ' ELSE '#' || p_name || ' / ' || p_brand || '!' END, '[^a-zA-Z0-9_-]+', '-', 'g'), '-') AS s FROM part)")
def anchors(t):
    name = F.when(F.col("p_partkey") % 9 == 0, F.lit(" ## ")).otherwise(F.concat(F.lit("#"), "p_name", F.lit(" / "), "p_brand", F.lit("!")))
    return t("part").select("p_partkey", urls.anchor(name, F.col("p_size")).alias("anchor"))


@query("SELECT event_id, CASE WHEN s >= 8 THEN 'high' WHEN s >= 6 THEN 'mid' WHEN s IS NOT NULL THEN 'low' END AS tier, CASE WHEN s IS NOT NULL THEN least(greatest((s - 4) / 6, 0.04), 1.0) END AS fill FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN floor(value) % 11 END AS s FROM events)")
def score_tiers(t):
    s = F.when(F.col("event_id") % 5 > 0, F.floor("value") % 11).cast("double")
    return t("events").select("event_id", tx.score_tier(s).alias("tier"), F.when(s.isNotNull(), tx.score_fill(s)).alias("fill"))


@query("SELECT event_id, CASE WHEN greatest(1, ceil(value)) <= 100 THEN 'when:' || CAST(greatest(1, ceil(value)) AS BIGINT) || 'h' ELSE 'after:' || strftime(ts, '%Y-%m-%d') END AS asked, strftime(ts, '%b %-d, %H:%M') AS byline FROM events")
def time_forms(t):
    ts = F.col("ts").cast("timestamp")
    return t("events").select("event_id", times.window_operator(F.col("value"), ts).alias("asked"), times.byline(ts).alias("byline"))


@query("SELECT event_id, CASE event_id % 7 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS at, event_id % 7 IN (0, 6) AS zoned, CASE WHEN event_id % 7 = 3 THEN epoch(date_trunc('second', ts))::BIGINT END AS compact FROM events")
def parsed_times(t):
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 7
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(kind == 0, F.concat(iso, F.lit("Z"))).when(kind == 1, iso).when(kind == 2, F.date_format(ts, "dd MMM yyyy HH:mm:ss 'GMT'")).when(kind == 3, F.concat(F.lit("Tue, "), F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))).when(kind == 4, F.lit("yesterday")).when(kind == 6, F.concat(F.date_format(ts + F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0300")))
    packed = F.when(kind == 3, F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")).when(kind == 5, F.lit("20240101"))
    return t("events").select("event_id", F.unix_seconds(times.feed_time(text)).alias("at"), F.coalesce(times.iso(text, need_zone=True).isNotNull(), F.lit(False)).alias("zoned"), F.unix_seconds(times.compact(packed)).alias("compact"))


_KIND = "CASE event_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'other' ELSE 'release' END"
_STATUS = "CASE event_id % 5 WHEN 0 THEN 'supported_by_evidence' WHEN 1 THEN 'mixed_evidence' ELSE 'insufficient_evidence' END"
_FINAL = "CASE WHEN event_id % 4 = 0 THEN 'insufficient_evidence' ELSE {0} END"


@query(f"SELECT user_id, min(CASE WHEN {_KIND} = 'release' OR {_STATUS} = 'supported_by_evidence' THEN NULL WHEN epoch_us(ts) + 86400000000 > epoch_us(TIMESTAMP '2024-01-20') THEN epoch_us(ts) + 86400000000 WHEN epoch_us(ts) + 259200000000 > epoch_us(TIMESTAMP '2024-01-20') THEN epoch_us(ts) + 259200000000 END) AS next FROM events GROUP BY user_id")
def next_checks(t):
    """The earliest check that an item's claims still need."""
    due = times.next_check(F.expr(_KIND), F.expr(_STATUS), F.col("ts").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return t("events").groupBy("user_id").agg(F.min(F.unix_micros(due)).alias("next"))


@query(f"SELECT event_id, CASE WHEN {_FINAL.format(_STATUS)} = 'insufficient_evidence' AND event_id % 7 = 0 THEN 'verification_error' ELSE {_FINAL.format(_STATUS)} END AS status FROM events")
def final_statuses(t):
    discarded, failed = (F.col("event_id") % 4 == 0).cast("int"), (F.col("event_id") % 7 == 0).cast("int")
    return t("events").select("event_id", verify.final_status(F.expr(_STATUS), discarded, failed).alias("status"))


_SAID = "CASE p_partkey % 6 WHEN 0 THEN 'Acme Released ' || p_name WHEN 1 THEN 'Acme unveils, then unveiled ' || p_name WHEN 2 THEN p_name || ' costs 5 %' WHEN 3 THEN p_name || ' prereleased' WHEN 4 THEN 'an introduction: ' || p_name ELSE 'it shipped' END"
_ASKED = "CASE p_partkey % 7 WHEN 0 THEN 'release' WHEN 1 THEN 'quote' WHEN 2 THEN 'rumour' ELSE 'announcement' END"


@query(f"""SELECT p_partkey, CASE WHEN k = 'quote' THEN k WHEN k = 'rumour' THEN 'other' WHEN regexp_matches(s, '(?i)\\b(released|releases|release|launch(ed|es)?|shipp?(ed|s)?|publish(ed|es)?)\\b') THEN 'release'
  WHEN regexp_matches(s, '(?i)\\b(announce(d|ment|s)?|unveil(ed|s)?|introduc(e|ed|es|tion))\\b') THEN 'announcement' WHEN regexp_matches(s, '(?i)[0-9%]|\\b(score|benchmark|parameter|token|second|minute|hour|byte|kb|mb|gb|tb|million|billion|trillion)\\b') THEN 'quantity' ELSE 'other' END AS kind
FROM (SELECT p_partkey, {_ASKED} AS k, {_SAID} || ' ' || p_type AS s FROM part)""")
def claim_kinds(t):
    return t("part").select("p_partkey", verify.conservative_kind(F.expr(_ASKED), F.expr(_SAID), F.col("p_type")).alias("kind"))


@query("""WITH c AS (SELECT p_partkey, p_name || ' and ' || p_brand || ' beat ' || p_type || ' x' || p_size || ' as ' || lower(p_type) || ' ' || p_type AS s, CASE WHEN p_partkey % 2 = 0 THEN 'event' ELSE 'quote' END AS k FROM part),
w AS (SELECT *, regexp_extract_all(s, '[\\pL\\p{N}][\\pL\\p{N}_.-]*') AS words FROM c),
n AS (SELECT *, list_filter(words, lambda x: x[1] <> lower(x[1]) OR regexp_matches(x, '[0-9]')) AS named FROM w),
o AS (SELECT *, list_filter(named, lambda x, i: NOT list_contains(list_transform(named[1:i - 1], lambda y: lower(y)), lower(x)))[1:6] AS once FROM n)
SELECT p_partkey, ['"' || s || '" ' || CASE k WHEN 'event' THEN 'official record' ELSE 'original transcript' END, '"' || array_to_string(CASE WHEN len(once) > 0 THEN once ELSE words[1:8] END, ' ') || '" ' || k || ' independent report', '"' || s || '" correction denied false'].array_to_string(chr(10)) AS asked FROM o""")
def claim_searches(t):
    claim = F.concat("p_name", F.lit(" and "), "p_brand", F.lit(" beat "), "p_type", F.lit(" x"), F.col("p_size").cast("string"), F.lit(" as "), F.lower("p_type"), F.lit(" "), "p_type")
    kind = F.when(F.col("p_partkey") % 2 == 0, F.lit("event")).otherwise(F.lit("quote"))
    return t("part").select("p_partkey", F.array_join(verify.search_queries(claim, kind), "\n").alias("asked"))


_LABEL = "CASE c_nationkey % 8 WHEN 0 THEN 'r/' || c_mktsegment WHEN 1 THEN c_mktsegment WHEN 2 THEN '@' || c_mktsegment WHEN 3 THEN 'ossinsight:all' WHEN 4 THEN 'google_news:' || c_mktsegment WHEN 5 THEN c_mktsegment WHEN 6 THEN 'unknown' ELSE c_name END"


@query(f"SELECT source, label, count(*) AS count FROM (SELECT c_nationkey AS source, {_LABEL} AS label FROM customer) GROUP BY source, label QUALIFY count(*) OVER (PARTITION BY source) > 1")
def sub_sources(t):
    """Counts by readable label of the sources that have more than one."""
    seg = F.col("c_mktsegment")
    keys = [("subreddit",), ("feed_name",), ("channel",), ("repo", "period"), ("gn_query",), ("domain",), (), ()]
    maps = [F.map_filter(F.create_map(F.lit("subreddit"), F.lit(""), *[x for k in ks for x in (F.lit(k), seg)]), lambda k, v: v != "") if "subreddit" not in ks else F.create_map(F.lit("subreddit"), seg) for ks in keys]
    m = maps[-1]
    for i, made in enumerate(maps[:-1]):
        m = F.when(F.col("c_nationkey") % 8 == i, made).otherwise(m)
    author = F.when(F.col("c_nationkey") % 8 == 6, F.lit("")).otherwise(F.col("c_name"))
    return stats.sub_source_counts(t("customer").select(F.col("c_nationkey").alias("source"), stats.label_of(m, author).alias("label")), "source", "label")


@query("SELECT count(*) AS attempted, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'failure' ELSE 'partial_failure' END AS status FROM events")
def enrichment_status(t):
    return stats.enrichment_status(t("events").select(F.col("event_id").alias("item_id"), F.when(F.col("event_type") == "error", F.col("props")).alias("error")))


@query("SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (event_id % 9 = 0) AS errors, max_by(value, event_id) AS last_ms FROM events GROUP BY 1")
def tool_calls(t):
    return stats.call_metrics(t("events").select(F.col("event_id").alias("at"), F.col("event_type").alias("tool"), F.when(F.col("event_id") % 9 == 0, "failed").alias("error_code"), F.col("value").alias("ms")))


@query("SELECT conv_id, CAST(coalesce(max_by(turn * 100.0 + len, turn) FILTER (length(trim(text, ' ' || chr(10))) / greatest(len, 0.01) > 3), 0.0) AS DOUBLE) AS ends FROM (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 20.0 WHEN 1 THEN 0.0 ELSE 90.0 END AS len FROM conversations) GROUP BY conv_id")
def speech_ends(t):
    long = F.when(F.col("turn") % 3 == 0, 20.0).when(F.col("turn") % 3 == 1, 0.0).otherwise(90.0)
    segments = F.array_sort(F.collect_list(F.struct((F.col("turn") * 100.0).alias("start"), (F.col("turn") * 100.0 + long).alias("end"), "text")))
    return t("conversations").groupBy("conv_id").agg(stats.speech_end(segments).alias("ends"))


@query(f"""WITH w AS (SELECT a.conv_id, a.turn, {_WORDS.format("a.text")} AS s, {_WORDS.format("b.text")} AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
l AS (SELECT *, s[greatest(len(s) - 9, 1):] AS last FROM w), o AS (SELECT *, list_filter(last, lambda x: len(list_filter(s, lambda y: y = x)) = 1) AS once FROM l),
a AS (SELECT *, CASE WHEN len(once) > 0 THEN once ELSE last END AS asked FROM o)
SELECT conv_id, turn, CASE WHEN len(s) = 0 THEN 1.0 ELSE len(list_filter(asked, lambda x: list_contains(h, x))) / len(asked) END AS reached FROM a""")
def tail_recalls(t):
    c = t("conversations")
    heard = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("heard"))
    return c.join(heard, ["conv_id", "turn"]).select("conv_id", "turn", stats.tail_recall(F.col("text"), F.col("heard")).alias("reached"))


@query("SELECT conv_id, turn, array_to_string(p[1:greatest(1, len(list_filter(range(1, len(p) + 1), lambda k: length(array_to_string(p[1:k], '. ')) <= 200)))], '. ') AS cut FROM (SELECT conv_id, turn, string_split(text, '. ') AS p FROM conversations)")
def whole_segments(t):
    return t("conversations").select("conv_id", "turn", text_packing.truncated_segments(F.col("text"), 200, ". ").alias("cut"))


_STANCE = "CASE l_linenumber % 4 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'context' ELSE 'irrelevant' END"


@query(f"SELECT claim_id, ord, url, stance FROM (SELECT l_orderkey AS claim_id, l_linenumber AS ord, 'https://s' || l_suppkey % 3 || '.example/' AS url, {_STANCE} AS stance FROM lineitem WHERE l_suppkey % 5 > 0) WHERE stance <> 'irrelevant' QUALIFY row_number() OVER (PARTITION BY claim_id, url, stance ORDER BY ord) = 1")
def shown_sources(t):
    cards = t("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("ord"), F.col("l_suppkey").alias("snapshot_id"), F.expr(_STANCE).alias("stance"), F.lit("original").alias("source_class"))
    snapshots = cards.select("snapshot_id").distinct().where("snapshot_id % 5 > 0").withColumn("final_url", F.concat(F.lit("https://s"), (F.col("snapshot_id") % 3).cast("string"), F.lit(".example/")))
    return verify.public_sources(cards, snapshots).select("claim_id", "ord", "url", "stance")


@query("SELECT o_custkey, count(DISTINCT (coalesce(o_orderstatus, ''), o_orderpriority)) AS variants FROM orders GROUP BY o_custkey HAVING variants > 1")
def conflicting_ids(t):
    return dedup.conflicting(t("orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT conv_id AS issue, count(*) FILTER (role <> 'system') AS articles FROM conversations GROUP BY 1 ORDER BY 1 DESC LIMIT 60")
def issue_pages(t):
    return sinks.site_index(t("conversations").select(F.col("conv_id").alias("issue"), F.when(F.col("role") == "system", "index").otherwise(F.col("role")).alias("name")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus = 'F'")
def upserted_index(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    return sinks.upserted(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("id % 3 = 0").select("id", (F.col("price") + 1).alias("price")))


@query("SELECT email FROM (SELECT DISTINCT 'user' || o_custkey || '@example.org' AS email FROM orders) EXCEPT SELECT 'user' || c_custkey || '@example.org' FROM customer WHERE c_nationkey = 3")
def subscribers(t):
    mail = lambda c: F.concat(F.lit(" User"), F.col(c).cast("string"), F.lit("@Example.org"))
    o = t("orders").select(mail("o_custkey").alias("email"), F.col("o_orderkey").alias("ord"))
    return sinks.subscribed(o.where("ord % 2 = 0"), o.where("ord % 2 = 1"), t("customer").where("c_nationkey = 3").select(mail("c_custkey").alias("email"))).select("email")


@query("SELECT s_suppkey, sum(s_suppkey % 50 + 1) OVER w <= 500 OR row_number() OVER w = 1 AS kept FROM supplier WINDOW w AS (ORDER BY s_suppkey DESC ROWS UNBOUNDED PRECEDING)")
def retained_files(t):
    rows = t("supplier").select("s_suppkey", F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") % 50 + 1).alias("size"))
    return select.running_total_within(rows, "size", 500, "s_suppkey").select("s_suppkey", "kept")
