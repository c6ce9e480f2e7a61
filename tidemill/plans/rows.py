"""Rules of rows and groups, each a query of its own with SQL that states the rule anew."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import jsons, narration, times, urls
from ..functions import text as tx
from ..operators import dedup, models, publish, render, select, stats, text_packing, verify
from ..session import spread
from ..sources import archive, collection, common, feeds, sinks, video
from ..streaming import incidents, ledger
from .registry import query

_GAPS = "".join(f"chr({ord(c)}) || " for c in tx.GAPS).removesuffix(" || ")


@query("""
WITH i AS (SELECT doc_id, coalesce(text, '') AS text, source, count(*) OVER () AS n FROM documents),
k AS (SELECT a.doc_id, a.text, b.text AS t1, b.source AS s1, b.doc_id AS d1, c.text AS t2, c.source AS s2, c.doc_id AS d2 FROM i a LEFT JOIN i b ON b.doc_id = a.doc_id + 1 LEFT JOIN i c ON c.doc_id = a.doc_id + 2 WHERE a.doc_id % 5 = 0 AND a.doc_id % 15 > 0),
f AS (SELECT *, CASE WHEN coalesce(t1, '') <> '' AND NOT contains(text, t1) THEN text || chr(10) || chr(10) || '--- From ' || s1 || ' ---' || chr(10) || t1 ELSE text END AS u FROM k),
g AS (SELECT *, CASE WHEN coalesce(t2, '') <> '' AND NOT contains(u, t2) THEN u || chr(10) || chr(10) || '--- From ' || s2 || ' ---' || chr(10) || t2 ELSE u END AS v FROM f)
SELECT doc_id, sha256(v) AS content, concat_ws(',', doc_id, d1, d2) AS lineage FROM g
UNION ALL SELECT doc_id, sha256(text), CAST(doc_id AS VARCHAR) FROM i WHERE doc_id % 15 < 5 OR doc_id % 5 > 2""")
def topic_merge(t):
    """Proposed groups of three documents; each names its first twice and two places that aren't there, and some are void."""
    docs = t("documents")
    items = docs.select(F.col("doc_id").cast("int").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("source_type"), "doc_id")
    k = F.col("doc_id").cast("int")
    groups = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("group_id"), F.array(F.when(k % 15 == 0, -1).otherwise(k), k, k + 1, F.lit(-1), k + 2, F.lit(10**9)).alias("members"))
    return dedup.merged_topics(items, groups).select("doc_id", F.sha2("content", 256).alias("content"), F.array_join("lineage", ",").alias("lineage"))


@query("SELECT CAST(count(*) + count(*) FILTER (turn % 2 = 0) AS BIGINT) AS citations FROM conversations")
def citations(t):
    source = F.struct(F.col("turn").alias("id"))
    made = t("conversations").groupBy("conv_id").agg(F.create_map(F.lit("en"), F.struct(F.collect_list(source).alias("sources")), F.lit("ru"), F.struct(F.collect_list(F.when(F.col("turn") % 2 == 0, source)).alias("sources"))).alias("artifacts"))
    return stats.citation_count(made)


_SPAN_STATUS = "CASE doc_id % 4 WHEN 0 THEN 'supported_by_evidence' WHEN 1 THEN 'not_checkable' WHEN 2 THEN 'verification_error' ELSE 'mixed_evidence' END"


@query(rf"""
WITH p AS (SELECT doc_id, lang, text, CASE WHEN doc_id % 9 = 0 THEN 'q' ELSE 'en:title' END AS field, CASE WHEN doc_id % 10 = 0 THEN '' ELSE split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) END AS span,
  CASE doc_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'unknown' END AS claim, {_SPAN_STATUS} AS status FROM documents),
e AS (SELECT *, instr(text, span) AS place FROM p)
SELECT doc_id, CASE WHEN trim(span) = '' THEN 'blank' WHEN field = 'q' THEN 'unknown_field' WHEN claim = 'unknown' THEN 'unknown_claim' WHEN place = 0 THEN 'not_exact' WHEN instr(substring(text, place + 1), span) > 0 THEN 'ambiguous' END AS error,
  CASE WHEN claim = 'c' AND status NOT IN ('not_checkable', 'verification_error') THEN 'c' END AS matched_claim_id, CASE WHEN field <> 'q' THEN lang END AS language FROM e""")
def audited_titles(t):
    """The first two words of each document proposed as a factual span."""
    docs = t("documents")
    fields = docs.select(F.col("doc_id").alias("item_id"), F.lit("en:title").alias("field_id"), F.col("lang").alias("language"), F.lit("title").alias("source_kind"), F.lit(None).cast("string").alias("block_id"), "text")
    span = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" "), F.split_part("text", F.lit(" "), F.lit(2))))
    proposals = docs.select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 9 == 0, "q").otherwise("en:title").alias("field_id"), span.alias("source_text"), F.lit("said").alias("normalized_claim"), F.when(F.col("doc_id") % 3 == 0, "c").when(F.col("doc_id") % 3 == 1, "unknown").alias("mapped_claim_id"))
    claims = docs.select(F.col("doc_id").alias("item_id"), F.lit("c").alias("claim_id"), F.expr(_SPAN_STATUS).alias("status"))
    return publish.audited_spans(fields, proposals, claims).select(F.col("item_id").alias("doc_id"), "error", "matched_claim_id", "language")


@query(rf"""
WITH p AS (SELECT page_id, url, list_filter(list_transform(string_split(regexp_replace(html, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\t\f\x0B ]+', ' ', 'g'), {_GAPS})), lambda x: x <> '') AS lines FROM pages WHERE page_id % 5 > 0 AND page_id % 7 > 0),
n AS (SELECT *, substring(array_to_string(lines, chr(10)), 1, 100000) AS text FROM p WHERE len(lines) > 0)
SELECT page_id, sha256(text) AS object_hash, sha256(regexp_replace(regexp_replace(url, '#.*$', ''), '^([^/]*//[^/?]*)(\?|$)', '\1/\2') || chr(0) || sha256(text) || chr(0) || 'text/v1') AS snapshot_id FROM n""")
def page_snapshots(t):
    """Snapshots of fetched pages; some weren't found, some have no type."""
    outcomes = t("pages").select("page_id", F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.when(F.col("page_id") % 5 > 0, "ok").otherwise("not_found").alias("status"), F.when(F.col("page_id") % 7 > 0, "text/html").alias("mime_type"), F.col("html").alias("text"))
    return verify.evidence_snapshots(outcomes).select("page_id", "object_hash", "snapshot_id")


@query("SELECT conv_id, array_to_string(CASE WHEN n <= 3 THEN f ELSE [f[1], f[CAST(round_even((n - 1) / 2, 0) AS INTEGER) + 1], f[n]] END, ',') AS frames FROM (SELECT conv_id, list(turn ORDER BY turn) AS f, count(*) AS n FROM conversations GROUP BY conv_id)")
def sampled_frames(t):
    frames = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("f"))  # a conversation's turns
    return frames.select("conv_id", F.array_join(F.transform(text_packing.sampled_frames(F.col("f"), 3), lambda x: x.cast("string")), ",").alias("frames"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS incident_id, strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(s_suppkey * 37 % 1000 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS last_seen_at FROM supplier ORDER BY last_seen_at DESC, incident_id LIMIT 20")
def incident_page(t):
    """The page of incidents shows the last twenty."""
    seen = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("s_suppkey") * 37 % 1000 * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return incidents.latest(t("supplier").select(F.col("s_suppkey").cast("string").alias("incident_id"), seen.alias("last_seen_at")))


@query("""
WITH h AS (SELECT conv_id, list('tool-1-' || turn ORDER BY 'tool-1-' || turn) AS results FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn < 3) GROUP BY conv_id)
SELECT c.conv_id, c.turn, CASE c.turn % 3 WHEN 0 THEN array_to_string(coalesce(results, []), ',') WHEN 1 THEN CASE WHEN list_contains(results, 'tool-1-1') THEN 'tool-1-1' ELSE '' END ELSE '' END AS source_refs,
  CAST(CASE c.turn % 3 WHEN 0 THEN CASE WHEN len(coalesce(results, [])) = 0 THEN 2 WHEN NOT list_contains(results, 'tool-1-0') THEN 1 ELSE 0 END WHEN 1 THEN 1 + CASE WHEN list_contains(results, 'tool-1-1') THEN 0 ELSE 1 END ELSE 0 END AS BIGINT) AS unknown
FROM (SELECT DISTINCT conv_id, turn FROM conversations) c LEFT JOIN h USING (conv_id)""")
def resolved_refs(t):
    """Turns as blocks: references to a whole request, to one result, and to nothing."""
    turns = t("conversations").select("conv_id", "turn").distinct()
    refs = F.when(F.col("turn") % 3 == 0, F.array(F.lit("tool-1"), F.lit("tool-1-0"))).when(F.col("turn") % 3 == 1, F.array(F.lit("tool-1-1"), F.lit("bad"))).otherwise(F.array().cast("array<string>"))
    blocks = turns.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("block_id"), refs.alias("refs"))
    hits = turns.where("turn < 3").select(F.col("conv_id").alias("item_id"), F.lit("tool-1").alias("request_ref"), F.concat(F.lit("tool-1-"), F.col("turn").cast("string")).alias("result_ref"), F.lit("https://x/").alias("url"), F.lit("t").alias("title"))
    return models.resolved_refs(blocks, hits)[0].select(F.col("item_id").alias("conv_id"), F.col("block_id").alias("turn"), F.array_join("source_refs", ",").alias("source_refs"), "unknown")


_TAG = "CASE c_custkey % 4 WHEN 0 THEN ' X-' || c_nationkey WHEN 1 THEN upper(n_name) || ' ' WHEN 2 THEN c_mktsegment ELSE lower(n_name) END"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN lower(trim(c_mktsegment)) ELSE n_name END AS canonical, {_TAG} AS tag FROM customer JOIN nation ON n_nationkey = c_nationkey")
def resolved_tags(t):
    """Tags by alias, by another case of the name, and unknown ones."""
    nation = t("nation").select("n_nationkey", "n_name")
    rows = t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.expr(_TAG).alias("tag"))  # nations are 25
    return models.resolved_tags(rows, "tag", nation.select(F.col("n_name").alias("canonical"), F.concat(F.lit("x-"), F.col("n_nationkey").cast("string")).alias("alias")))


@query("""
WITH g AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter(['user', 'assistant'], lambda x: NOT list_contains(r, x)), ',') AS missing, CAST(len(list_filter(list_distinct(r), lambda x: x NOT IN ('user', 'assistant', 'tool'))) AS INTEGER) AS unknown, len(r) <> len(list_distinct(r)) AS repeated FROM g""")
def block_differences(t):
    """The roles of a conversation as generated block ids."""
    made = t("conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r"))  # a conversation's turns
    d = models.block_differences(F.col("r"), F.array(F.lit("user"), F.lit("assistant")), F.array(F.lit("tool")))
    return made.select("conv_id", d.alias("d")).select("conv_id", F.array_join("d.missing", ",").alias("missing"), F.size("d.unknown").alias("unknown"), "d.repeated")


_FETCH = "CASE page_id % 6 WHEN 1 THEN replace(url, '://', '://me@') WHEN 2 THEN regexp_replace(url, '^([^/]*//[^/]*)', '{0}1:8080') WHEN 3 THEN 'http://localhost/x' ELSE url END"


@query(f"SELECT page_id, page_id % 4 = 0 AND page_id % 6 NOT IN (1, 2, 3) AS ok FROM (SELECT *, {_FETCH.format(chr(92))} AS u FROM pages)")
def fetchable_urls(t):
    """Pages' addresses, some with a user, another port or a local name, and what they resolve to."""
    k = F.col("page_id") % 4
    resolved = F.when(k == 0, F.array(F.lit("8.8.8.8"), F.lit("2606:4700::1111"))).when(k == 1, F.array(F.lit("10.0.0.1"))).when(k == 2, F.array(F.lit("8.8.8.8"), F.lit("127.0.0.1"))).otherwise(F.array().cast("array<string>"))
    rows = t("pages").select("page_id", F.expr(_FETCH.format("$")).alias("u"), resolved.alias("addresses"))
    return rows.select("page_id", urls.is_fetchable(F.col("u"), F.col("addresses")).alias("ok"))


@query("SELECT c_custkey AS ord FROM customer WHERE c_custkey % 7 > 0 AND c_custkey % 6 IN (2, 3, 4, 5)")
def invalid_routes(t):
    """Routes by customer: one profile, ``auto``, ``auto`` in a list, a name twice, an empty and an unknown name."""
    kinds = [["tech"], ["auto"], ["tech", "auto"], ["tech", " tech"], [" "], ["tech", "unknown"]]
    route = F.element_at(F.array(*[F.array(*map(F.lit, k)) for k in kinds]), (F.col("c_custkey") % 6 + 1).cast("int"))
    known = t("region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "tech").otherwise("news").alias("id"))
    return archive.invalid_routes(t("customer").select(F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 7 > 0, route).alias("profile")), known).select("ord")


@query("SELECT c_custkey, '{\"Name\":\"' || c_name || '\",\"X-A\":\"' || c_nationkey || '\"}' AS headers FROM customer")
def request_headers(t):
    """Header lines as a map: the last of a name wins, lines without a name or colon go."""
    lines = F.concat(F.lit("X-A: 1\r\n Name : "), "c_name", F.lit("\nno colon\n: no name\n\nX-A:  "), F.col("c_nationkey").cast("string"), F.lit(" "))
    return spread(t("customer")).select("c_custkey", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tx.headers(lines))))).alias("headers"))


_MARKED = "replace(replace(replace(text, ' the', ' <mark>the'), 'on ', 'on</mark> '), ' de ', '<mark> de')"


@query(f"""
WITH m AS (SELECT doc_id, string_split(regexp_replace({_MARKED}, '(</?mark>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM m),
k AS (SELECT doc_id, i, x, lag(x, 1, '</mark>') OVER (PARTITION BY doc_id ORDER BY i) AS before, last_value(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM u WHERE x IN ('<mark>', '</mark>')),
j AS (SELECT u.doc_id, u.i, CASE WHEN k.x IS NULL OR k.x <> k.before THEN u.x ELSE '' END AS x, k.final FROM u LEFT JOIN k USING (doc_id, i))
SELECT doc_id, sha256(string_agg(x, '' ORDER BY i) || CASE WHEN max(final) = '<mark>' THEN '</mark>' ELSE '' END) AS text FROM j GROUP BY doc_id""")
def balanced_marks(t):
    return t("documents").select("doc_id", F.sha2(tx.balanced_highlights(F.expr(_MARKED)), 256).alias("text"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(date_trunc('minute', o_orderdate) - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M') WHEN 1 THEN '2024-08-06 07:05' WHEN 2 THEN '2024-08-05 06:05' END AS said, strftime(to_timestamp(o_orderkey * 1000)::TIMESTAMP, '%Y-%m-%d %H:%M') AS at FROM orders")
def forum_times(t):
    """Moscow dates as forums write them, and seconds since 1970."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "dd.MM.yyyy, HH:mm")).when(k == 1, "Сегодня, 10:05").when(k == 2, "вчера, 9:05").otherwise("давно")
    now = F.lit(dt.datetime(2024, 8, 5, 22, 30))
    shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    return t("orders").select("o_orderkey", shown(times.forum_time(text, now)).alias("said"), shown(times.epoch(F.col("o_orderkey") * 1000)).alias("at"))


@query(f"""
WITH s AS (SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '<[^>]+>', '', 'g'), chr(10)), lambda x: trim(x, {_GAPS})), lambda x: x <> ''), ' ') AS text FROM conversations)
SELECT conv_id, CAST(turn * 61 + 0.25 AS DOUBLE) AS start, CAST(turn * 61 + 3600 + 0.5 AS DOUBLE) AS "end", text FROM s WHERE text <> ''""")
def caption_cues(t):
    """Turns as cues of one caption file a conversation."""
    def clock(s):
        return F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), s % 60)

    start = (F.col("turn") * 61 + F.lit(0.25)).cast("double")
    cue = F.concat(clock(start), F.lit(" --> "), clock(start + 3600.25), F.lit(" align:start\n<c>"), F.regexp_replace("text", "\n\\s*\n", "\n"), F.lit("</c>"))
    files = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n\n").alias("c"))  # a conversation's turns
    segments = F.explode(video.vtt_segments(F.concat(F.lit("WEBVTT\n\n"), "c")))
    return files.select("conv_id", segments.alias("s")).select("conv_id", "s.start", "s.end", "s.text")


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'live_status=is_upcoming' WHEN event_type = 'error' THEN 'live_status=is_live' WHEN value > 0 AND value < 10 THEN 'duration ' || CAST(trunc(value) AS INTEGER) || 's < min_duration_sec 10' END AS reason,
  event_type = 'view' AS gate FROM events""")
def skipped_videos(t):
    status = F.when(F.col("event_type") == "click", "is_upcoming").when(F.col("event_type") == "error", "is_live").when(F.col("event_type") == "view", "was_live")
    said = F.when(F.col("event_type") == "view", "ERROR: Sign in to confirm you're NOT a bot").when(F.col("event_type") == "error", "HTTP 500")
    return t("events").select("event_id", video.skip_reason(status, F.col("value"), 10).alias("reason"), video.is_bot_gate(said).alias("gate"))


@query("""SELECT count(*) AS videos, count(*) FILTER (value > 5) AS graded, count(*) FILTER (value > 5 AND event_id % 3 > 0) AS with_text, count(*) FILTER (value > 5 AND event_id % 3 > 0) / count(*) FILTER (value > 5) AS rate,
  count(*) FILTER (event_type = 'click') AS subtitles, count(*) FILTER (event_type = 'view') AS asr, count(*) FILTER (event_type = 'error') AS vision, count(*) FILTER (event_type = 'purchase') AS description FROM events""")
def video_statistics(t):
    source = F.when(F.col("event_type") == "click", "subtitles").when(F.col("event_type") == "view", "asr").when(F.col("event_type") == "error", "vision").when(F.col("event_type") == "purchase", "description")
    return stats.video_stats(t("events").select(source.alias("content_source"), (F.col("value") > 5).alias("graded"), (F.col("event_id") % 3 > 0).alias("with_text")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 8 = 0 OR o_orderdate < TIMESTAMP '1997-06-01 00:00:00'")
def stale_inboxes(t):
    """Envelopes by order, some without a readable time."""
    at = F.when(F.col("o_orderkey") % 8 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return video.stale(t("orders").select("o_orderkey", at.alias("generated_at")), dt.datetime(1997, 6, 3), 48).select("o_orderkey")


_BODY = "CASE doc_id % 3 WHEN 0 THEN text || chr(10) || '--- Top Comments ---' || chr(10) || ' [x]: ' || source || '  ' WHEN 1 THEN '--- Top Comments ---' || text ELSE '  ' || text END"


@query(f"SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN trim(text, {_GAPS}) WHEN 1 THEN '' ELSE trim(text, {_GAPS}) END) AS main, sha256(CASE doc_id % 3 WHEN 0 THEN '[x]: ' || source WHEN 1 THEN trim(text, {_GAPS}) ELSE '' END) AS comments FROM documents")
def discussion_parts(t):
    parts = tx.content_parts(F.expr(_BODY))
    return t("documents").select("doc_id", parts.alias("p")).select("doc_id", F.sha2("p.main", 256).alias("main"), F.sha2("p.comments", 256).alias("comments"))


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 10) AS key FROM documents")
def audio_keys(t):
    return t("documents").select("doc_id", jsons.short_hash(F.coalesce("text", F.lit("")), 10).alias("key"))


@query("""
WITH k AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0 ELSE 9 END AS rank FROM documents), f AS (SELECT lang, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY lang)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY k.lang ORDER BY doc_id) AS INTEGER) AS group_index, n AS group_count, row_number() OVER (ORDER BY rank, first, doc_id) AS global_index FROM k JOIN f USING (lang)""")
def profile_order(t):
    """Documents by language as a digest's profiles: two have a place, the others follow as they came."""
    rows = t("documents").select("doc_id", "lang", F.col("doc_id").alias("ord"))
    ranks = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 0).otherwise(9)
    return select.view_ranks(rows, "lang", [F.col("ord").asc()], group_rank=ranks).select("doc_id", "group_index", "group_count", F.col("global_index").cast("long").alias("global_index"))


@query("""
SELECT 'github:event:' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN c_name || ' pushed 2 commit(s) to o/r' || o_custkey WHEN 'O' THEN c_name || ' starred o/r' || o_custkey ELSE c_name || ' made o/r' || o_custkey || ' public' END AS title,
  CASE o_orderstatus WHEN 'F' THEN 'one' || chr(10) ELSE '' END AS content, 'https://github.com/o/r' || o_custkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'""")
def repository_events(t):
    """Orders as public events, a JSON array for each customer."""
    kind = F.when(F.col("o_orderstatus") == "F", "PushEvent").when(F.col("o_orderstatus") == "O", "WatchEvent").otherwise("PublicEvent")
    commits = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("one").alias("message")), F.struct(F.lit("").alias("message"))))
    event = F.struct(F.col("o_orderkey").cast("string").alias("id"), kind.alias("type"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.struct(F.concat(F.lit("o/r"), F.col("o_custkey").cast("string")).alias("name")).alias("repo"), F.struct(commits.alias("commits")).alias("payload"))
    bodies = t("orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(event)).alias("body"))  # a customer's orders
    raw = bodies.join(t("customer").select("c_custkey", F.col("c_name").alias("username")), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("ord"), "username", "body")
    return feeds.github_events(raw, dt.datetime(1995, 1, 1)).select("id", "title", "content", "url", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _raw(t, body, *more):
    """Each order as one captured JSON payload."""
    return t("orders").select(F.col("o_orderkey").alias("ord"), *more, F.to_json(body).alias("body"))


def _shown(items, *more):
    return items.select("id", "title", "content", "url", "author", F.date_format("published_at", "yyyy-MM-dd").alias("day"), *more)


@query(f"SELECT 'github:release:' || o_orderkey AS id, 'o' || o_custkey || '/r released v' || o_orderkey AS title, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS content, 'https://x/' || o_orderkey AS url, 'me' AS author, {_DAY} AS day, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS prerelease FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'")
def repository_releases(t):
    release = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("tag_name"), F.concat(F.lit("https://x/"), F.col("o_orderkey").cast("string")).alias("html_url"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("body"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), F.when(F.col("o_orderstatus") == "F", True).alias("prerelease"), F.struct(F.lit("me").alias("login")).alias("author"))
    raw = _raw(t, F.array(release), F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("owner"), F.lit("r").alias("repo"))
    return _shown(feeds.github_releases(raw, dt.datetime(1995, 1, 1)), F.col("metadata")["prerelease"].alias("prerelease"))


@query(f"""
WITH k AS (SELECT l_orderkey, list('[' || l_returnflag || ']: ' || l_shipmode ORDER BY l_linenumber) AS said FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_shipmode, min(l_suppkey) AS s FROM lineitem GROUP BY ALL) WHERE l_linenumber <= 3 AND s % 4 > 0 GROUP BY l_orderkey)
SELECT 'hackernews:story:' || o_orderkey AS id, 'Story ' || o_orderpriority AS title, array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END, CASE WHEN len(said) > 0 THEN chr(10) || '--- Top Comments ---' || chr(10) || chr(10) || array_to_string(said, chr(10) || chr(10)) END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS content,
  CASE WHEN o_orderstatus = 'F' THEN 'https://a/' || o_orderkey ELSE 'https://news.ycombinator.com/item?id=' || o_orderkey END AS url, 'c' || o_custkey AS author, {_DAY} AS day FROM orders LEFT JOIN k ON l_orderkey = o_orderkey WHERE o_totalprice::BIGINT % 500 >= 100 AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'""")
def discussed_stories(t):
    """Orders as stories, their first lines as comments, of which some are gone."""
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("by"), F.min("l_linestatus").alias("text"), F.min("l_suppkey").alias("s"))
    comments = lines.select(key.alias("id"), "by", "text", (F.col("s") % 4 == 0).alias("deleted"), F.lit(False).alias("dead"))
    kids = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.col("l_orderkey") * 100 + n).alias("kids"))  # an order's lines
    firsts = kids.select("l_orderkey", F.filter("kids", lambda k: k % 100 <= 3).alias("kids"))
    stories = t("orders").join(firsts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("id"), F.concat(F.lit("Story "), "o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://a/"), F.col("o_orderkey").cast("string"))).alias("url"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("by"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("time"), (F.round("o_totalprice").cast("long") % 500).alias("score"), F.lit(None).cast("long").alias("descendants"), F.lit("story").alias("type"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("text"), "kids")
    return _shown(feeds.hacker_news(stories, comments, dt.datetime(1996, 1, 1)))


@query(f"""SELECT 'twitter:tweet:' || o_orderkey AS id, '@c' || o_custkey || ': ' || substring('Said & done ' || o_orderpriority || ' ' || repeat('x', o_orderkey % 60) || '.', 1, 50) || CASE WHEN length('Said & done ' || o_orderpriority || ' ' || repeat('x', o_orderkey % 60) || '.') > 50 THEN '...' ELSE '' END AS title,
  'Said & done ' || o_orderpriority || ' ' || repeat('x', o_orderkey % 60) || '.' AS content, CASE WHEN o_orderstatus = 'F' THEN 'https://t/' || o_orderkey ELSE 'https://twitter.com/c' || o_custkey || '/status/' || o_orderkey END AS url, 'c' || o_custkey AS author, {_DAY} AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'""")
def tweets(t):
    k = F.col("o_orderkey").cast("string")
    tweet = F.struct(k.alias("id_str"), F.date_format("o_orderdate", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"), F.concat(F.lit("Said &amp; done "), "o_orderpriority", F.lit(" "), F.repeat(F.lit("x"), F.col("o_orderkey").cast("int") % 60), F.lit(".")).alias("full_text"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://t/"), k)).alias("url"), F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("screen_name")).alias("user"))
    return _shown(feeds.tweets(_raw(t, tweet), dt.datetime(1996, 1, 1)))


@query("""SELECT 'gdelt:article:' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '::https://g/' || o_orderkey AS id, o_orderpriority AS title, 'https://g/' || o_orderkey AS url, 'd' || o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0""")
def news_articles(t):
    """Orders as articles, some without a title, some without a time."""
    k = F.col("o_orderkey").cast("string")
    article = F.struct(F.concat(F.lit(" https://g/"), k).alias("url"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).otherwise(" ").alias("title"), F.when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'")).otherwise("then").alias("seendate"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("domain"))
    return _shown(feeds.gdelt(_raw(t, F.struct(F.array(article).alias("articles"))))).drop("content")


@query("""SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || chr(10) || '--- Top Comments ---' || chr(10) || source || chr(10) || lang WHEN 2 THEN '--- Top Comments ---' || chr(10) || source || chr(10) || lang
  ELSE text || '--- Top Comments ---' || chr(10) || source || CASE WHEN doc_id % 8 = 3 THEN chr(10) || lang ELSE chr(10) || source || chr(10) || lang END END) AS content FROM documents""")
def added_discussion(t):
    """Lines added to texts: none, below a text, to nothing, below other comments, and where they are already."""
    k = F.col("doc_id")
    lines = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("source", "lang"))
    shown = F.when(k % 4 == 2, "").when(k % 4 == 3, F.concat("text", F.lit("--- Top Comments ---\n"), "source", F.when(k % 8 == 3, F.concat(F.lit("\n"), "lang")).otherwise(""))).otherwise(F.col("text"))
    return t("documents").select("doc_id", F.sha2(feeds.with_discussion(shown, lines), 256).alias("content"))


@query("""
WITH c AS (SELECT c_custkey AS ord, 0 AS fresh, 'https://a/' || c_nationkey AS k FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1, 'https://a/' || c_custkey % 40 FROM customer WHERE c_custkey % 2 = 1)
SELECT ord, fresh FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY fresh, ord) = 1""")
def merged_sources(t):
    """Configured feeds by customer and new ones: what is there wins."""
    c = t("customer")
    config = lambda url: F.create_map(F.lit("url"), url)
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ord"), F.lit("rss").alias("type"), config(F.concat(F.lit("https://a/"), F.col("c_nationkey").cast("string"))).alias("config"), F.lit(0).alias("fresh"))
    new = c.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("ord"), F.lit("rss").alias("type"), config(F.concat(F.lit("https://a/"), (F.col("c_custkey") % 40).cast("string"))).alias("config"), F.lit(1).alias("fresh"))
    return archive.merged_config(old, new).select("ord", "fresh")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'code=' || event_id % 7 WHEN 1 THEN 'StatusCode=19001' END AS feishu, CASE event_id % 4 WHEN 2 THEN 'errcode=' || 40000 + event_id % 3 END AS dingtalk FROM events WHERE event_id % 4 > 0 OR event_id % 7 > 0 UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 4 = 0 AND event_id % 7 = 0")
def response_errors(t):
    """Answers of chat platforms: errors in them, none, and what isn't JSON."""
    k = F.col("event_id")
    body = F.when(k % 4 == 0, F.concat(F.lit('{"code": '), (k % 7).cast("string"), F.lit(', "msg": "x"}'))).when(k % 4 == 1, F.lit('{"code": 0, "StatusCode": 19001}')).when(k % 4 == 2, F.concat(F.lit('{"errcode": '), (40000 + k % 3).cast("string"), F.lit("}"))).otherwise("<html>")
    return t("events").select("event_id", sinks.response_error("feishu", body).alias("feishu"), sinks.response_error("dingtalk", body).alias("dingtalk"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{"a":[' || event_id || ',{"y":null,"z":"é"}],"b":"' || event_type || '"}' END AS canonical FROM events""")
def canonical_objects(t):
    k = F.col("event_id")
    text = F.when(k % 5 == 0, F.lit('{"a": NaN}')).otherwise(F.concat(F.lit('{ "b" : "'), "event_type", F.lit('", "a": ['), k.cast("string"), F.lit(', {"z": "\\u00e9", "y": null}]}')))
    return t("events").select("event_id", jsons.canonical(text).alias("canonical"))


@query("""
WITH p AS (SELECT user_id, event_id, 'q' || event_id % 5 AS q FROM events WHERE event_type IN ('click', 'view') AND event_id % 6 > 0), f AS (SELECT user_id, q, min(event_id) AS event_id FROM p GROUP BY ALL)
SELECT user_id, q FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3""")
def planned_tools(t):
    """Tool calls that a model plans, by user: an allowed tool, each query once, at most three."""
    tool = F.when(F.col("event_type").isin("click", "view"), "web_search").otherwise("shell")
    plans = t("events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("ord"), tool.alias("tool"), F.when(F.col("event_id") % 6 > 0, F.concat(F.lit("q"), (F.col("event_id") % 5).cast("string"))).otherwise(" ").alias("query"))
    return models.planned_tools(plans).select(F.col("item_id").alias("user_id"), F.col("query").alias("q"))


@query("SELECT source || ' ' || lang AS profile, CASE WHEN lang = 'en' THEN 'English' ELSE upper(lang[1]) || lang[2:] END AS shown, count(*) AS n FROM documents GROUP BY ALL")
def display_names(t):
    name = render.display_name(F.col("lang"), {"en": "English"})
    return t("documents").groupBy(F.concat("source", F.lit(" "), "lang").alias("profile"), name.alias("shown")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, CASE WHEN n % 3 = 0 THEN 'rss,reddit,hn' ELSE 'hn,rss' END AS valid, CASE WHEN n % 3 = 0 THEN '' ELSE 'x' || conv_id END AS unknown FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def selected_sources(t):
    """Sources asked for by conversation: none, which is all, or some of them and an unknown one."""
    rows = t("conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    wanted = F.when(F.col("n") % 3 > 0, F.array(F.lit("hn"), F.concat(F.lit("x"), F.col("conv_id").cast("string")), F.lit("rss")))
    chosen = common.selected_sources(F.array(*map(F.lit, ("rss", "reddit", "hn"))), wanted)
    return rows.select("conv_id", F.array_join(chosen["valid"], ",").alias("valid"), F.array_join(chosen["unknown"], ",").alias("unknown"))


@query("""
SELECT conv_id, turn, sha256('{"content":' || to_json(text) || ',"id":"' || conv_id || '-' || turn || '","title":' || CASE WHEN role = 'system' THEN 'null' ELSE to_json(role) END || '}') AS fetched,
  sha256(CASE turn % 3 WHEN 0 THEN '{"content":' || to_json(text) || ',"id":"' || conv_id || '-' || turn || '","title":' || CASE WHEN role = 'system' THEN 'null' ELSE to_json(role) END || '}'
    ELSE '{"content":' || to_json('A' || chr(10) || text || chr(10) || chr(10) || 'B' || chr(10) || role) || ',"id":"' || conv_id || '-' || turn || '","title":' || to_json(CASE turn % 3 WHEN 1 THEN 'ru ' ELSE 'en ' END || role) || ',"verification_language":"' || CASE turn % 3 WHEN 1 THEN 'ru' ELSE 'en' END || '"}' END) AS selected FROM conversations""")
def item_payloads(t):
    """Turns as items: as fetched, and as readers see them, by the first of their artifacts."""
    block = lambda a, b: F.struct(F.lit(a).alias("title"), b.alias("content"))
    made = lambda k: F.struct(F.concat(F.lit(f"{k} "), "role").alias("title"), F.array(block("A", F.col("text")), block("B", F.col("role"))).alias("blocks"))
    k = F.col("turn") % 3
    artifacts = F.when(k == 1, F.create_map(F.lit("en"), made("en"), F.lit("ru"), made("ru"))).when(k == 2, F.create_map(F.lit("en"), made("en")))
    items = t("conversations").select("conv_id", "turn", F.concat("conv_id", F.lit("-"), "turn").alias("id"), F.when(F.col("role") != "system", F.col("role")).alias("title"), F.col("text").alias("content"), artifacts.alias("artifacts"))
    columns = ("id", "title", "content")
    return items.select("conv_id", "turn", F.sha2(ledger.fetched_payload(*columns), 256).alias("fetched"), F.sha2(ledger.selected_payload(*columns, languages=("ru", "en")), 256).alias("selected"))


@query(r"""
WITH w AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' '), lambda x: x <> '')[1:60] AS w FROM documents),
u AS (SELECT doc_id, text, unnest(w) AS written, generate_subscripts(w, 1) AS ord FROM w),
v AS (SELECT * FROM u WHERE ord % 3 > 0 AND regexp_matches(text, '(^|[^A-Za-z0-9])(?i:' || written || ')([^A-Za-z0-9]|$)')),
f AS (SELECT doc_id, lower(written) AS k, min(ord) AS ord FROM v GROUP BY ALL)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, k AS name FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 40""")
def accepted_readings(t):
    """The first sixty Latin words of each text suggested as readings, a third of them said in Latin letters."""
    docs = t("documents").select("doc_id", "text")
    # nothing is looked at behind the sixtieth word; an outer generator asks for the words once, not for its filters too
    begins = F.regexp_extract("text", "\\A(?:[^A-Za-z]*+[A-Za-z]++){0,60}+", 0)
    words = F.filter(F.split(begins, "[^A-Za-z]+"), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode_outer(words).alias("at", "written")).where("at is not null").select("doc_id", (F.col("at") + 1).alias("ord"), "written", F.when((F.col("at") + 1) % 3 > 0, "слово").otherwise("word").alias("spoken"))
    return narration.accepted_readings(rows, docs).select("doc_id", "ord", F.lower("written").alias("name"))


@query("""
WITH f AS (SELECT c_custkey AS config_id, 1 AS ord, 'rss' AS source, c_name || ' \\[' || c_mktsegment || '\\]' AS label, 'https://h' || c_nationkey || '.example/f' AS url, CASE c_custkey % 3 WHEN 0 THEN 'tech' WHEN 1 THEN 'news,tech' ELSE 'auto' END AS profiles FROM customer WHERE c_custkey % 4 > 0),
x AS (SELECT c_custkey AS config_id, CASE WHEN c_custkey % 4 > 0 THEN 2 ELSE 1 END AS ord, 'twitter' AS source, '@u' || c_nationkey AS label, 'https://x.com/u' || c_nationkey AS url, 'news' AS profiles FROM customer WHERE c_acctbal > 0)
SELECT c_custkey AS config_id, 0 AS ord, 'hackernews' AS source, 'top stories' AS label, NULL AS url, 'auto' AS profiles FROM customer UNION ALL SELECT * FROM f UNION ALL SELECT * FROM x""")
def configured_sources(t):
    """A configuration for each customer: a feed with a key in its address, an account, and sections that are off."""
    c = F.col
    profile = F.when(c("c_custkey") % 3 == 0, F.lit('"tech"')).when(c("c_custkey") % 3 == 1, F.lit('["news", " ", "tech"]')).otherwise("null")
    feed = F.concat(F.lit('{"name": "'), "c_name", F.lit(" ["), "c_mktsegment", F.lit(']", "url": "https://me:pw@H'), c("c_nationkey").cast("string"), F.lit('.example/f?key=1#x", "enabled": '), (c("c_custkey") % 4 > 0).cast("string"), F.lit(', "profile": '), profile, F.lit("}"))
    config = F.concat(F.lit('{"token": "t", "sources": {"rss": ['), feed, F.lit('], "twitter": {"enabled": '), (c("c_acctbal") > 0).cast("string"), F.lit(', "profile": "news", "users": ["u'), c("c_nationkey").cast("string"), F.lit('"]}, "ossinsight": {"enabled": false}, "video": {"channels": [{"channel": "@v"}]}}}'))
    found = collection.configured_sources(t("customer").select(F.col("c_custkey").alias("config_id"), config.alias("config")))
    return found.select("config_id", "ord", "source", "label", "url", F.array_join("profiles", ",").alias("profiles"))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:[._/+:-][A-Za-z0-9]+)*')) AS name FROM documents) WHERE regexp_matches(name, '[A-Za-z]') GROUP BY name")
def latin_names(t):
    return stats.latin_names(t("documents"))


@query("""
WITH i AS (SELECT doc_id // 50 AS issue, doc_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS n FROM documents),
k AS (SELECT issue, string_agg('- [T ' || doc_id || '](https://site/day-' || issue || '-en/p-' || n || '/) ⭐️ 7.5/10', chr(10) ORDER BY n) AS lines FROM i GROUP BY issue)
SELECT 'day-' || issue || '-en' AS issue, 'p-' || n AS slug, 'T ' || doc_id AS title, sha256('<a id="item-p-' || n || '"></a>' || chr(10) || '# [T ' || doc_id || '](https://n.example/' || doc_id || ') ⭐️ 7.5/10' || chr(10) || chr(10) || 'said' || chr(10)) AS text FROM i
UNION ALL SELECT 'day-' || issue || '-en', 'index', 'day-' || issue, sha256('# day-' || issue || chr(10) || chr(10) || lines || chr(10)) FROM k""")
def republished_pages(t):
    """Issues of fifty documents each, read back from their Markdown as pages."""
    d = t("documents").select("doc_id", F.expr("doc_id div 50").alias("k"), (F.col("doc_id") % 50 + 1).alias("n"))
    item = F.concat(F.lit('<a id="item-p-'), F.col("n").cast("string"), F.lit('"></a>\n### [T '), F.col("doc_id").cast("string"), F.lit("](https://n.example/"), F.col("doc_id").cast("string"), F.lit(") ⭐️ 7.5/10\n\nsaid\n\n---\n\n"))
    issues = d.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))), lambda v: v["x"]), "").alias("md"))  # fifty documents
    pages = archive.republished(issues.select(F.concat(F.lit("day-"), F.col("k").cast("string")).alias("date"), F.lit("en").alias("language"), F.concat(F.lit("# head\n\n---\n\n"), "md").alias("markdown")), "https://site")
    return pages.select("issue", "slug", "title", F.sha2("markdown", 256).alias("text"))


@query("""
WITH r AS (SELECT o_orderkey AS ord, o_orderpriority AS title, 'https://n/' || o_custkey % 700 AS url, o_orderdate AS made, o_orderstatus AS s FROM orders WHERE o_custkey % 9 > 0 AND o_orderdate > TIMESTAMP '1996-01-01 00:00:00')
SELECT 'openbb:news:' || strftime(made, '%Y%m%dT%H%M%S') || '::' || url AS id, title, url, CASE WHEN s = 'P' THEN 'excerpt' ELSE 'body ' || ord END AS content, CASE s WHEN 'F' THEN 'A' WHEN 'O' THEN 'Z' ELSE 'me' END AS author, strftime(made, '%Y-%m-%d') AS day FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1""")
def market_news(t):
    """Orders as news records of one watchlist, each link once; a missing author is the first symbol."""
    s = F.col("o_orderstatus")
    record = F.struct(F.when(F.col("o_custkey") % 9 > 0, F.col("o_orderpriority")).otherwise(" ").alias("title"), F.concat(F.lit("https://n/"), (F.col("o_custkey") % 700).cast("string")).alias("url"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.when(s == "P", "me").alias("author"), F.when(s != "P", F.concat(F.lit("body "), F.col("o_orderkey").cast("string"))).alias("body"), F.lit("excerpt").alias("excerpt"), F.when(s == "F", " a ,b,a").alias("symbols"))
    return _shown(feeds.openbb(_raw(t, record, F.lit("w").alias("watchlist"), F.array(F.lit("Z")).alias("watch_symbols")), dt.datetime(1996, 1, 1)))


@query("""
WITH p AS (SELECT p_partkey, p_partkey * 37 % 500 AS stars FROM part WHERE p_partkey * 37 % 500 >= 50 AND p_partkey % 3 > 0)
SELECT 'ossinsight:trending:' || p_partkey AS id, 'o' || p_partkey % 11 || '/r' || p_partkey || ' (+' || stars || '⭐ past_24_hours)' AS title, 'https://github.com/o' || p_partkey % 11 || '/r' || p_partkey AS url, 'o' || p_partkey % 11 AS author FROM p ORDER BY stars DESC, p_partkey LIMIT 30""")
def trending_repositories(t):
    """The thirty repositories that gained most stars, among those about a keyword."""
    k = F.col("p_partkey")
    row = F.struct(k.cast("string").alias("repo_id"), F.concat(F.lit("o"), (k % 11).cast("string"), F.lit("/r"), k.cast("string")).alias("repo_name"), (k * 37 % 500).cast("string").alias("stars"), F.when(k % 3 > 0, "An LLM tool").otherwise("a game").alias("description"))
    raw = t("part").select(k.alias("ord"), F.lit("Python").alias("language"), F.to_json(row).alias("body"))
    return feeds.oss_insight(raw, dt.datetime(2024, 8, 6), min_stars=50, keywords=("llm",)).select("id", "title", "url", "author")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, '[@u' || o_orderkey % 5 || ' | ❤️ ' || o_orderkey % 50 || ' | 💬 ' || o_orderkey % 7 || '] ' || o_orderpriority AS line, (o_orderkey % 50) * 2 + o_orderkey % 7 AS points FROM orders WHERE o_orderkey % 5 <> 3 AND o_orderkey % 50 >= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY points DESC, o_orderkey) AS rank FROM r)
SELECT o_custkey AS tweet_id, string_agg(line, chr(10) ORDER BY rank) AS lines FROM k WHERE rank <= 3 GROUP BY o_custkey""")
def best_replies(t):
    """Orders as replies to a customer's tweet; the author's own don't count, nor do those with few likes."""
    k = F.col("o_orderkey")
    replies = t("orders").select(F.col("o_custkey").cast("string").alias("tweet_id"), F.lit("@@U3").alias("own_author"), k.alias("ord"), F.concat(F.lit("tweet-r"), k.cast("string")).alias("id"), F.concat(F.lit("u"), (k % 5).cast("string")).alias("handle"), F.concat(F.lit(" "), "o_orderpriority").alias("text"), (k % 50).alias("likes"), (k % 7).alias("replies"))
    return feeds.reply_lines(replies, 3, 5).select(F.col("tweet_id").cast("long").alias("tweet_id"), F.array_join("lines", "\n").alias("lines"))


def _channel(t, tag, extra):
    """A feed for each customer, an entry for each order."""
    k = F.col("o_orderkey").cast("string")
    entry = F.concat(F.lit(f"<{tag}><title>T "), "o_orderpriority", F.lit(" &amp; "), k, F.lit("</title>"), extra(k), F.lit(f"</{tag}>"))
    bodies = t("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x["e"]), "").alias("b"))  # a customer's orders
    return bodies.select(F.col("o_custkey").alias("ord"), F.concat(F.lit("<feed>"), "b", F.lit("</feed>")).alias("body"))


@query("""SELECT 'rss:f_' || o_custkey || ':' || substr(sha256('g' || o_orderkey), 1, 16) AS id, 'T ' || o_orderpriority || ' & ' || o_orderkey AS title, 'said' AS content, 'https://l/' || o_orderkey AS url, 'feed ' || o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'""")
def feed_items(t):
    stamp = F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    raw = _channel(t, "item", lambda k: F.concat(F.lit("<guid>g"), k, F.lit("</guid><link>https://l/"), k, F.lit("</link><pubDate>"), stamp, F.lit("</pubDate><description>said</description>")))
    return _shown(feeds.rss(raw.withColumns({"feed_url": F.concat(F.lit("https://f/"), F.col("ord").cast("string")), "name": F.concat(F.lit("feed "), F.col("ord").cast("string"))}), dt.datetime(1996, 1, 1)))


@query("""SELECT 'video:youtube:v' || o_orderkey AS id, 'T ' || o_orderpriority || ' & ' || o_orderkey AS title, 'https://l/' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2""")
def channel_videos(t):
    """The first two videos of each channel within the window."""
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    raw = _channel(t, "entry", lambda k: F.concat(F.lit("<videoId>v"), k, F.lit("</videoId><link href='https://l/"), k, F.lit("'/><published>"), stamp, F.lit("</published>")))
    return _shown(feeds.youtube(raw.withColumn("channel", F.lit("c")).withColumn("channel", F.col("ord").cast("string")), dt.datetime(1996, 1, 1), 2)).select("id", "title", "url", "day")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END = min(CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END) OVER (PARTITION BY conv_id)")
def source_ladder(t):
    """Of each conversation the turns of the first role that it has: system, assistant, user."""
    turns = t("conversations").select("conv_id", "turn", "role")
    return feeds.first_that_has([turns.where(F.col("role") == r) for r in ("system", "assistant", "user")], "conv_id")


@query("""
WITH c AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'supported_by_evidence' WHEN 1 THEN 'mixed_evidence' ELSE 'verification_error' END AS status FROM conversations)
SELECT conv_id, 'complete' AS state, CAST(count(*) AS INTEGER) AS claims, string_agg(role || ' ' || CASE status WHEN 'supported_by_evidence' THEN 'official_release' WHEN 'mixed_evidence' THEN 'disputed' ELSE 'check_error' END, ',' ORDER BY turn, role) AS said, round(greatest(0, 100 - conv_id % 120 + 0.0), 1) AS age FROM c GROUP BY conv_id""")
def public_payloads(t):
    """Conversations as items, their turns as claims without sources; some are published after they were checked."""
    turns = t("conversations")
    checked = dt.datetime(2024, 8, 6, 4)
    items = turns.select("conv_id").distinct().select(F.col("conv_id").alias("item_id"), F.timestamp_seconds(F.lit(int((checked - dt.datetime(1970, 1, 1)).total_seconds()) - 100 * 3600) + F.col("conv_id") % 120 * 3600).alias("published_at"), F.lit("complete").alias("state"), F.lit("en").alias("language"))
    status = F.when(F.col("turn") % 3 == 0, "supported_by_evidence").when(F.col("turn") % 3 == 1, "mixed_evidence").otherwise("verification_error")
    claims = turns.select(F.col("conv_id").alias("item_id"), F.concat("conv_id", F.lit("-"), "turn").alias("claim_id"), F.col("turn").alias("ord"), F.col("role").alias("text"), F.lit("release").alias("kind"), status.alias("status"))
    none = t("region").where("false").select(F.lit("").alias("claim_id"), F.lit(0).alias("ord"), F.lit("").alias("url"), F.lit("").alias("stance"), F.lit("").alias("source_class"))
    p = F.col("payload")
    return publish.payloads(items, claims, none, checked).select(F.col("item_id").alias("conv_id"), p["state"].alias("state"), F.size(p["claims"]).alias("claims"), F.array_join(F.transform(p["claims"], lambda c: F.concat(c["text"], F.lit(" "), c["public_status"])), ",").alias("said"), p["source_age_hours"].alias("age"))


_OFFER = "CASE o_orderkey % 5 WHEN 0 THEN 'github_user' WHEN 1 THEN 'rss' WHEN 2 THEN 'telegram' WHEN 3 THEN 'hackernews' ELSE 'reddit_user' END"


@query(f"""
WITH o AS (SELECT o_custkey, o_orderkey, {_OFFER} AS type, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
k AS (SELECT * FROM o WHERE n NOT IN (2, 5) OR o_custkey % 2 = 1 AND n = 5)
SELECT c_custkey AS request_id, coalesce(string_agg('u' || o_orderkey, ',' ORDER BY o_orderkey) FILTER (type = 'github_user'), '') AS github, coalesce(string_agg('https://f/' || o_orderkey, ',' ORDER BY o_orderkey) FILTER (type = 'rss'), '') AS rss,
  count(o_orderkey) = 0 OR coalesce(bool_or(type = 'hackernews'), false) AS stories, coalesce(bool_or(type = 'reddit_user'), false) AS reddit, CAST(count(*) FILTER (type = 'telegram') AS INTEGER) AS channels FROM customer LEFT JOIN k ON c_custkey = o_custkey GROUP BY c_custkey""")
def routed_sources(t):
    """Orders as preset sources offered to a customer, who turns the second off and the fifth off, or off and on again."""
    k = F.col("o_orderkey").cast("string")
    config = F.create_map(F.lit("username"), F.concat(F.lit("u"), k), F.lit("url"), F.concat(F.lit("https://f/"), k), F.lit("channel"), k)
    offers = t("orders").select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("ord"), F.expr(_OFFER).alias("type"), config.alias("config"))
    requests = t("customer").select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(2), F.lit(5), F.lit(99))).otherwise(F.array(F.lit(5), F.lit(2), F.lit(5))).alias("toggles"))
    made = archive.routed_sources(archive.toggled(offers, requests), requests).select("request_id", F.from_json("config", "sources struct<github:array<struct<username:string>>,rss:array<struct<url:string>>,hackernews:struct<enabled:boolean>,reddit:struct<enabled:boolean>,telegram:struct<channels:array<struct<channel:string>>>>")["sources"].alias("s"))
    return made.select("request_id", F.array_join("s.github.username", ",").alias("github"), F.array_join("s.rss.url", ",").alias("rss"), F.col("s.hackernews.enabled").alias("stories"), F.col("s.reddit.enabled").alias("reddit"), F.size("s.telegram.channels").alias("channels"))
