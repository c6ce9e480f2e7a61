"""URL identities, merging, selection and counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import times, urls
from ..operators import dedup, select, stats
from .registry import query

_TRACKERS = ", ".join(f"'{t}'" for t in urls.TRACKERS)
_HOST = "lower(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\\[[^\\]]*\\]|[^:/?#]*)', 1), '[\\[\\]]', '', 'g'))"
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_PORT = "regexp_extract(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), ':([0-9]+)$', 1)"
_USER = "regexp_extract(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^(.*)@', 1)"
_PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_ASKED = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_OWN_PORT = f"CASE WHEN ({_SCHEME} = 'http' AND {_PORT} = '80') OR ({_SCHEME} = 'https' AND {_PORT} = '443') THEN '' ELSE {_PORT} END"
_KEPT = f"array_to_string(list_filter(string_split({_ASKED}, '&'), lambda p: NOT (starts_with(lower(url_decode(split_part(p, '=', 1))), 'utm_') OR lower(url_decode(split_part(p, '=', 1))) IN ({_TRACKERS}))), '&')"
_KEY = f"concat_ws('|', {_SCHEME}, split_part({_USER}, ':', 1), regexp_extract({_USER}, '^[^:]*:(.*)$', 1), {_HOST}, {_OWN_PORT}, CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END, {_KEPT})"
_SITE = "regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^www\\.', '')"
_NOW = dt.datetime(2024, 1, 20)


@query(f"SELECT page_id, {_KEY} AS key, {_HOST} AS host, {_SITE} AS site FROM pages")
def url_keys(t):
    u = F.col("url")
    return t("pages").select("page_id", urls.merge_key(u).alias("key"), urls.host(u).alias("host"), urls.site(u).alias("site"))


@query(f"SELECT page_id, {_SCHEME} || '://' || regexp_replace({_HOST}, '\\.+$', '') || CASE WHEN {_OWN_PORT} <> '' THEN ':' || {_OWN_PORT} ELSE '' END || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_ASKED} <> '' THEN '?' || {_ASKED} ELSE '' END AS canonical FROM pages")
def evidence_urls(t):
    return t("pages").select("page_id", urls.evidence_url(F.col("url"), ascii_hosts=True).alias("canonical"))


@query(f"SELECT page_id, url, key FROM (SELECT page_id, url, {_KEY} AS key, row_number() OVER (PARTITION BY {_KEY} ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def dedup_first(t):
    return dedup.keep_first(t("pages").select("page_id", "url", urls.merge_key(F.col("url")).alias("key")), "key", order="page_id")


@query(f"SELECT min(page_id) AS page_id, array_to_string(list(page_id ORDER BY page_id), ',') AS members, count(*) AS n FROM pages GROUP BY {_KEY}")
def dedup_members(t):
    return t("pages").groupBy(urls.merge_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("page_id"), F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("members"), F.count("*").alias("n")).drop("key")


@query(f"""
WITH k AS (SELECT page_id, url, {_KEY} AS key, {_SITE} AS site FROM pages),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS n, count(*) OVER (PARTITION BY key) AS members FROM k) WHERE n = 1),
s AS (SELECT f.*, quality FROM f LEFT JOIN labels ON doc_id = page_id)
SELECT site, page_id, url, members, quality, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY coalesce(quality, -1) DESC, page_id) AS rank FROM s) WHERE rank <= 5""")
def digest_by_url(t):
    k = t("pages").select("page_id", "url", urls.merge_key(F.col("url")).alias("key"), urls.site(F.col("url")).alias("site"))
    members = k.groupBy("key").agg(F.count("*").alias("members"), F.min("page_id").alias("page_id"))
    first = k.join(members.select("page_id", "members"), "page_id")
    from pyspark.sql import Window

    scored = first.join(t("labels").select(F.col("doc_id").alias("page_id"), "quality"), "page_id", "left")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.coalesce("quality", F.lit(-1)).desc(), "page_id")))
    return ranked.where("rank <= 5").select("site", "page_id", "url", "members", "quality", "rank")


def _items(t):
    """Documents as items: source and text stand for a link's sources and content, the whole text but for case and gaps for its link."""
    d = t("documents")
    link = F.md5(F.lower(F.regexp_replace("text", "\\s+", " ")))
    return d.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("source_type"), F.concat(F.lit("https://example.org/"), link, F.lit("/?utm_source="), "source").alias("url"), F.col("text").alias("content"), F.lit(None).cast("string").alias("author"), F.create_map(F.lit("lang"), F.to_json(F.struct("lang"))).alias("metadata"), F.array("lang").alias("profile"), F.col("doc_id").alias("ord"))


@query("""
WITH i AS (SELECT doc_id, source, text AS content, md5(lower(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS k, lang FROM documents),
g AS (SELECT list({'doc_id': doc_id, 'source': source, 'content': content} ORDER BY doc_id) AS g FROM i GROUP BY k, lang),
p AS (SELECT g, list_position(list_transform(g, lambda x: length(x.content)), list_max(list_transform(g, lambda x: length(x.content)))) AS k0 FROM g),
o AS (SELECT g, g[k0] AS p, list_filter(g, lambda x, i: i <> k0 AND x.content <> '') AS rest FROM p)
SELECT 'doc:' || p.doc_id AS id, g[1].doc_id AS ord, list_reduce(list_prepend(p.content, list_transform(rest, lambda x: chr(1) || x.source || chr(1) || x.content)),
    lambda acc, x: CASE WHEN acc <> '' AND NOT contains(acc, split_part(x, chr(1), 3)) THEN acc || chr(10) || chr(10) || '--- From ' || split_part(x, chr(1), 2) || ' ---' || chr(10) || split_part(x, chr(1), 3) ELSE acc END) AS content,
  CASE WHEN len(g) > 1 THEN array_to_string(list_transform(list_filter(g, lambda x, i: list_position(list_transform(g, lambda y: y.source), x.source) = i), lambda x: x.source), ',') END AS sources,
  array_to_string(list_transform(g, lambda x: 'doc:' || x.doc_id), ',') AS members
FROM o""")
def merge_fold(t):
    m = dedup.merged_across_sources(_items(t))
    return m.select("id", "ord", "content", F.array_join("merged_sources", ",").alias("sources"), F.array_join("members", ",").alias("members"))


_SETTINGS = {"en": select.ProfileSettings(0.5, {"high": 1.0, "llm": 0.0}), "fr": select.ProfileSettings(1.0), "de": select.ProfileSettings(None)}


def _scored(t):
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", F.col("doc_id").alias("ord"), F.col("lang").alias("profile_id"), F.col("quality").cast("double").alias("score"), F.col("quality").isNotNull().alias("analysed"), F.when(F.col("doc_id") % 3 == 0, "high").alias("category"), F.array(F.concat(F.lit("#"), F.col("source")), F.when(F.col("doc_id") % 7 == 0, "Generative-AI").otherwise("news")).alias("tags"))


_SCORED_SQL = "SELECT d.doc_id, d.doc_id AS ord, lang AS profile_id, CAST(quality AS DOUBLE) AS score, quality IS NOT NULL AS analysed, CASE WHEN d.doc_id % 3 = 0 THEN 'high' WHEN lang = 'en' AND d.doc_id % 7 = 0 THEN 'llm' END AS category FROM documents d LEFT JOIN labels l USING (doc_id)"


@query(f"""
WITH s AS ({_SCORED_SQL}),
l AS (SELECT *, CASE WHEN profile_id = 'en' THEN CASE category WHEN 'high' THEN 1.0 WHEN 'llm' THEN 0.0 ELSE 0.5 END WHEN profile_id = 'fr' THEN 1.0 END AS lim FROM s)
SELECT doc_id, category, analysed AND (lim IS NULL OR coalesce(score >= lim, false)) AS passed FROM l""")
def threshold_filter(t):
    return select.passes(_scored(t), _SETTINGS).select("doc_id", "category", "passed")


@query("SELECT d.doc_id, quality IS NOT NULL AND coalesce(quality >= 1, false) AS passed FROM documents d LEFT JOIN labels l USING (doc_id)")
def threshold_override(t):
    return select.passes(_scored(t), _SETTINGS, override=1.0).select("doc_id", "passed")


_GROUPS = {"first": select.Group(("URGENT", "src0"), 15), "second": select.Group(("src1", "src2", "src0"), 7), "third": select.Group(("src3",), None)}
_GROUP_SQL = "CASE WHEN source = 'src0' THEN 'first' WHEN source IN ('src1', 'src2') THEN 'second' WHEN source = 'src3' THEN 'third' ELSE 'other' END"
_RANKED_SQL = f"WITH s AS (SELECT d.doc_id, source, quality, {_GROUP_SQL} AS g FROM documents d LEFT JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY coalesce(quality, -1) DESC, doc_id) AS n FROM s), k AS (SELECT * FROM r WHERE (g = 'first' AND n <= 15) OR (g = 'second' AND n <= 7) OR g = 'third' OR (g = 'other' AND n <= 40)), c AS (SELECT *, row_number() OVER (ORDER BY coalesce(quality, -1) DESC, doc_id) AS m FROM k)"


def _balanced(t):
    rows = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", F.col("doc_id").alias("ord"), F.col("source").alias("category"), F.col("quality").cast("double").alias("score"))
    return select.balanced(rows, _GROUPS, default_limit=40, max_items=60)


@query(f"{_RANKED_SQL} SELECT doc_id, source AS category, g AS \"group\", CAST(quality AS DOUBLE) AS score FROM c WHERE m <= 60")
def quota_topk(t):
    return _balanced(t).select("doc_id", "category", "group", "score")


@query(f"{_RANKED_SQL} SELECT x.g AS \"group\", count(c.doc_id) AS count, x.lim AS \"limit\" FROM (VALUES ('first', 15), ('second', 7), ('third', NULL), ('other', 40)) x(g, lim) LEFT JOIN c ON c.g = x.g AND m <= 60 GROUP BY ALL")
def quota_counts(t):
    return select.quota_counts(_balanced(t), _GROUPS, default_limit=40)


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS group_index, count(*) OVER (PARTITION BY source) AS group_count, min(doc_id) OVER (PARTITION BY source) AS f FROM documents)
SELECT doc_id, source, group_index, group_count, row_number() OVER (ORDER BY f, group_index) AS global_index FROM r""")
def view_ranks(t):
    return select.view_ranks(t("documents").select("doc_id", "source", F.col("doc_id").alias("ord")), "source", [F.col("doc_id").asc()]).select("doc_id", "source", "group_index", "group_count", F.col("global_index").cast("long").alias("global_index"))


@query("""SELECT b AS bucket, count(v) AS count FROM (VALUES ('0-2'), ('3-4'), ('5-6'), ('7-8'), ('9-10'), ('unscored')) x(b)
LEFT JOIN (SELECT CASE WHEN s IS NULL THEN 'unscored' WHEN s < 3 THEN '0-2' WHEN s < 5 THEN '3-4' WHEN s < 7 THEN '5-6' WHEN s < 9 THEN '7-8' ELSE '9-10' END AS k, 1 AS v
  FROM (SELECT CASE WHEN event_type = 'click' THEN value / 10 WHEN event_type = 'view' THEN 1.5 END AS s FROM events)) ON k = b GROUP BY b""")
def score_histogram(t):
    score = F.when(F.col("event_type") == "click", F.col("value") / 10).when(F.col("event_type") == "view", F.lit(1.5))
    return stats.score_histogram(t("events").select(score.alias("score")))


@query("SELECT source, lang, count(*) AS count FROM documents GROUP BY ALL")
def source_counts(t):
    return stats.source_counts(t("documents"), "source", "lang")


@query("""SELECT 'partial_failure' AS status, count(*) AS attempted, count(*) - count(*) FILTER (n < 40) AS successful, count(*) FILTER (n BETWEEN 40 AND 49) AS empty, count(*) FILTER (n < 40) AS failed, CAST(sum(n) AS BIGINT) AS item_count, false AS all_failed
FROM (SELECT source, CASE WHEN source = 'src7' THEN 3 ELSE count(*) + 50 END AS n FROM documents GROUP BY source)""")
def fetch_report(t):
    n = F.when(F.col("source") == "src7", 3).otherwise(F.col("n") + 50)
    rows = t("documents").groupBy("source").agg(F.count("*").alias("n")).select("source", n.alias("item_count"))
    return stats.fetch_report(rows.withColumn("status", F.when(F.col("item_count") < 40, "failure").when(F.col("item_count") < 50, "empty").otherwise("success")))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-18 00:00:00'")
def window_since(t):
    return select.since(t("events"), _NOW, 48, "ts").select("event_id")


@query("SELECT CAST(ts AS DATE) AS issue_day, event_type, count(*) AS items FROM events GROUP BY ALL")
def daily_issues(t):
    return t("events").groupBy(times.issue_day(F.col("ts")).alias("issue_day"), "event_type").agg(F.count("*").alias("items"))


@query("SELECT conv_id, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations WHERE role <> 'system') WHERE rank <= 2")
def comment_topk(t):
    from ..sources.feeds import top_comments

    c = t("conversations").select("conv_id", "turn", F.col("turn").alias("ord"), F.col("text").alias("body"), F.length("text").alias("score"), F.when(F.col("role") == "system", "moderator").alias("distinguished"))
    return top_comments(c, 2, "conv_id").select("conv_id", "turn", "rank")


@query("SELECT doc_id FROM (SELECT doc_id, CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 END AS p FROM documents) WHERE p IS NOT NULL ORDER BY p, doc_id LIMIT 25")
def shadow_eligible(t):
    return select.shadow_eligible(t("documents").select("doc_id", F.col("source").alias("profile_id"), F.col("doc_id").alias("ord")), {"src3": 1, "src1": 2}, 25).select("doc_id")


@query("""
WITH f AS (SELECT doc_id, text, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents),
u AS (SELECT min(doc_id) AS doc_id, list(doc_id ORDER BY doc_id) AS members FROM documents GROUP BY text),
t AS (SELECT min(doc_id) AS doc_id, list(doc_id ORDER BY doc_id) AS members FROM f WHERE n = 1 GROUP BY source),
a AS (SELECT t.doc_id, m1, i FROM t, unnest(members) WITH ORDINALITY AS x(m1, i)),
b AS (SELECT a.doc_id, a.i, m2, j FROM a JOIN u ON u.doc_id = m1, unnest(u.members) WITH ORDINALITY AS y(m2, j))
SELECT doc_id, len(list(m2)) AS n, md5(array_to_string(list(m2 ORDER BY i, j), ',')) AS snapshots, 0 AS missing FROM b GROUP BY doc_id""")
def lineage_two_hop(t):
    d = t("documents").select("doc_id", "text", "source")
    url = d.groupBy("text").agg(F.min("doc_id").alias("id"), F.array_sort(F.collect_list("doc_id")).alias("members"), F.min_by("source", "doc_id").alias("source"))
    topic = url.groupBy("source").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("members")).select("id", "members")
    found = dedup.two_hop_lineage(topic.select("id", F.col("id").alias("ord")), topic, url.select("id", "members"), d.select(F.col("doc_id").alias("item_id"), F.col("doc_id").cast("string").alias("snapshot_id")))
    return found.select(F.col("id").alias("doc_id"), F.size("snapshot_ids").cast("long").alias("n"), F.md5(F.array_join("snapshot_ids", ",")).alias("snapshots"), F.col("missing").cast("int").alias("missing"))


@query("SELECT text_hash, copies FROM (SELECT DISTINCT md5(text) AS text_hash, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents)")
def copy_flags(t):
    return dedup.copies_flagged(t("documents").select(F.md5("text").alias("text_hash")), "text_hash").distinct()


@query("SELECT event_type AS provider, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(least(c, i)) AS BIGINT) AS cached_input_tokens, CAST(sum(i) + sum(o) AS BIGINT) AS total_tokens FROM (SELECT event_type, user_id % 1000 AS i, event_id % 500 AS o, event_id % 700 AS c FROM events) WHERE i > 0 OR o > 0 GROUP BY ROLLUP (event_type)")
def token_usage(t):
    calls = t("events").select(F.col("event_type").alias("provider"), (F.col("user_id") % 1000).alias("input_tokens"), (F.col("event_id") % 500).alias("output_tokens"), (F.col("event_id") % 700).alias("cached_input_tokens"))
    return stats.token_usage(calls)


@query("SELECT l_orderkey, l_linenumber, round(((l_partkey - least(l_suppkey, l_partkey)) * 3.0 + least(l_suppkey, l_partkey) * 1.0 + l_orderkey * 15.0) / 1000000, 8) AS cost FROM lineitem")
def token_cost(t):
    cached = F.least("l_suppkey", "l_partkey")
    return t("lineitem").select("l_orderkey", "l_linenumber", stats.token_cost(F.col("l_partkey"), F.col("l_orderkey"), cached, F.lit(3.0), F.lit(15.0), F.lit(1.0)).alias("cost"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n <= 3")
def tail_limit(t):
    return select.tail(t("documents").select("doc_id", "source", F.col("doc_id").alias("ord")), 3, per="source").select("doc_id")


@query("SELECT provider, i AS input_tokens, o AS output_tokens FROM (SELECT event_type AS provider, CAST(sum(user_id) - sum(user_id) FILTER (ts < TIMESTAMP '2024-01-10') AS BIGINT) AS i, CAST(count(*) - count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS BIGINT) AS o FROM events GROUP BY 1)")
def usage_delta(t):
    def total(rows):
        return rows.groupBy(F.col("event_type").alias("provider")).agg(F.sum("user_id").alias("input_tokens"), F.count("*").alias("output_tokens"), F.lit(0).alias("cached_input_tokens"))

    e = t("events")
    return stats.usage_between(total(e), total(e.where("ts < '2024-01-10'"))).select("provider", "input_tokens", "output_tokens")
