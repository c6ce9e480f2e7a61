"""Text, time, JSON, packing, rendering and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..functions import configs, jsons, templates, times
from ..functions import text as tx
from ..operators import archive_index, messages, render, stats, text_packing
from ..session import spread
from ..sources import archive, captures, feeds, pages
from .registry import query


_GAPS = "".join(f"chr({ord(c)}) || " for c in tx.GAPS).removesuffix(" || ")


@query(f"""
WITH s AS (SELECT doc_id, trim(text, {_GAPS}) AS t, {_GAPS} AS gaps FROM documents),
n AS (SELECT *, length(t) AS n, 600 - length('[Opening excerpt].' || '..[Middle excerpt].' || '..[Closing excerpt].') AS room FROM s),
k AS (SELECT *, CAST(floor(room * 0.4) AS BIGINT) AS f, CAST(floor(room * 0.3) AS BIGINT) AS m FROM n)
SELECT doc_id, CASE WHEN n <= 600 THEN t ELSE '[Opening excerpt]' || chr(10) || rtrim(substring(t, 1, f), gaps) || chr(10) || chr(10) || '[Middle excerpt]' || chr(10) || trim(substring(t, n // 2 - m // 2 + 1, m), gaps)
  || chr(10) || chr(10) || '[Closing excerpt]' || chr(10) || ltrim(right(t, room - f - m), gaps) END AS content FROM k""")
def content_sample(t):
    return t("documents").select("doc_id", tx.selected_content(F.col("text"), 600, "head-middle-tail").alias("content"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN substring(text, 1, 77) || '...' ELSE text END AS title FROM conversations")
def truncate_ellipsis(t):
    return t("conversations").select("conv_id", "turn", tx.ellipsis(F.col("text"), 80).alias("title"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{}\[\]()#!])', '\\\1', 'g'), '(?m)^( {0,3})([-+] |\p{Nd}+[.] )', '\1\\\2', 'g') AS md FROM documents")
def escape_markdown(t):
    return t("documents").select("doc_id", tx.escaped_markdown(F.col("text")).alias("md"))


@query("SELECT doc_id, sha256(source || chr(0) || lang || chr(0) || doc_id::VARCHAR) AS id, substring(sha256(text), 1, 16) AS short, 'doc:text:' || doc_id AS item_id FROM documents")
def sha_ids(t):
    return t("documents").select("doc_id", jsons.sha_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"), jsons.short_hash(F.col("text"), 16).alias("short"), jsons.item_id("doc", "text", F.col("doc_id").cast("string")).alias("item_id"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || 'Z' AS stamp, greatest(0.0, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 3600000000) AS age FROM events")
def stamps(t):
    ts = F.col("ts").cast("timestamp")
    return t("events").select("event_id", times.stamp(ts).alias("stamp"), times.age_hours(ts, F.lit("2024-01-20").cast("timestamp")).alias("age"))


@query(r"""
WITH w AS (SELECT a.conv_id, a.turn, a.text AS s, b.text AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
s AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(replace(lower(s), 'ё', 'е'), '[\pL\pM\p{Nd}\p{Pc}-]+')) AS word FROM w) GROUP BY ALL),
h AS (SELECT conv_id, turn, word, count(*) AS m FROM (SELECT conv_id, turn, unnest(regexp_extract_all(replace(lower(h), 'ё', 'е'), '[\pL\pM\p{Nd}\p{Pc}-]+')) AS word FROM w) GROUP BY ALL),
r AS (SELECT conv_id, turn, sum(least(n, coalesce(m, 0))) / sum(n) AS recall FROM s LEFT JOIN h USING (conv_id, turn, word) GROUP BY ALL)
SELECT w.conv_id || '-' || w.turn AS id, coalesce(recall, 1.0) AS recall FROM w LEFT JOIN r USING (conv_id, turn)""")
def word_recall(t):
    c = t("conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("h"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("s")).join(nxt, ["conv_id", "turn"]).select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "s", "h")
    return stats.word_recall(pairs, "id", "s", "h")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.page') AS BIGINT) AS page, json_extract_string(props, '$.ref') AS ref FROM events")
def props_json(t):
    p = F.from_json("props", "page string, ref string")
    return t("events").select("event_id", F.expr("try_cast(from_json(props, 'page string').page as bigint)").alias("page"), p["ref"].alias("ref"))


def _search_sql(words: list[str], text: str = "text", title: str = "''") -> str:
    terms = lambda x: rf"list_filter(regexp_split_to_array(lower({x}), '[^\pL\pM\p{{Nd}}\p{{Pc}}]+'), lambda x: x <> '')"
    tf = ", ".join(f"3 * len(list_filter(t, lambda x: x = '{w}')) + len(list_filter(c, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(words)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return rf"""WITH w AS (SELECT doc_id, {terms(text)} AS c, {terms(title)} AS t FROM documents),
f AS (SELECT doc_id, 3 * len(t) + len(c) AS len, {tf} FROM w), s AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM f)
SELECT doc_id, round(0.0 + {score}, 6) AS score FROM f, s WHERE {hit} ORDER BY score DESC, doc_id LIMIT 30"""


def _found(docs, path, words):
    return archive_index.search(docs.sparkSession, path, words).select(F.col("id").alias("doc_id"), "score")


@query(_search_sql(["the", "thing"]))
def search_topk(t):
    docs = t("documents").withColumn("title", F.lit(""))
    path = storage.scratch(docs.sparkSession, "archive")
    archive_index.upsert(docs, path, id_col="doc_id", content_col="text")
    return _found(docs, path, "The thing")


@query(_search_sql(["en", "la", "thing"], "CASE WHEN doc_id % 3 = 0 THEN text || ' la thing' ELSE text END", "CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END"))
def search_upserted(t):
    """A third of the documents comes again with another title and text."""
    docs = t("documents").select("doc_id", "text", F.lit("").alias("title"), "lang")
    path = storage.scratch(docs.sparkSession, "archive")
    archive_index.upsert(docs, path, id_col="doc_id", content_col="text")
    again = docs.where("doc_id % 3 = 0").select("doc_id", F.concat("text", F.lit(" la thing")).alias("text"), F.col("lang").alias("title"))
    archive_index.upsert(again, path, id_col="doc_id", content_col="text")
    return _found(docs, path, "la en THING, la")


@query("SELECT doc_id, CASE WHEN length(text) < 2 THEN NULL ELSE trim(text) END IS NOT NULL AS searchable FROM (SELECT doc_id, substring(trim(regexp_replace(text, '[\\s\\x0B\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')), 1, 200) AS text FROM documents)")
def searchable(t):
    return t("documents").select("doc_id", tx.search_text(F.col("text")).isNotNull().alias("searchable"))


@query("""
WITH RECURSIVE l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text FROM conversations),
p AS (SELECT conv_id, n, 0 AS seq, text FROM l WHERE n = 1
  UNION ALL SELECT l.conv_id, l.n, p.seq + (length(p.text) + 1 + length(l.text) > 3900)::INT, CASE WHEN length(p.text) + 1 + length(l.text) > 3900 THEN l.text ELSE p.text || chr(10) || l.text END FROM p JOIN l ON l.conv_id = p.conv_id AND l.n = p.n + 1)
SELECT conv_id, seq, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, seq ORDER BY n DESC) AS back FROM p) WHERE back = 1""")
def packed_headlines(t):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t("conversations").groupBy("conv_id").agg(lines.alias("lines")).select("conv_id", F.posexplode(text_packing.packed_lines(F.col("lines"))).alias("seq", "text"))


@query()
def spoken(t):
    return t("documents").select("doc_id", F.posexplode(text_packing.spoken_chunks(F.col("text"))).alias("seq", "chunk"))


@query()
def json_salvage(t):
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return t("events").select("event_id", jsons.salvaged(F.when(F.col("event_id") % 2 == 0, wrapped).otherwise(F.concat(F.lit("so {x "), "props"))).alias("found"))


@query()
def readable_pages(t):
    return t("pages").select("page_id", pages.readable("html").alias("text"))


@query()
def daily_issue(t):
    docs = t("documents").withColumn("date", F.expr("cast(date_add(date'2024-08-06', cast(doc_id div 100 as int)) as string)"))  # a day has a hundred documents
    best = docs.join(t("labels").where("quality = 1"), "doc_id")
    items = best.select("date", F.col("source").alias("profile_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"), F.col("quality").alias("score"), F.col("text").alias("summary"), F.array("lang").alias("tags"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit("rss").alias("source_type"), F.lit("desk").alias("author"), F.col("date").cast("timestamp").alias("published_at"), F.lit(None).cast("struct<language:string,title:string,blocks:array<struct<id:string,type:string,title:string,content:string,source_refs:array<string>,primary:boolean>>,sources:array<struct<id:string,title:string,url:string>>>").alias("artifact"))
    return render.issues(items, docs.groupBy("date").agg(F.count("*").alias("total")))


@query("SELECT conv_id, list_reduce(list_prepend('', list('[' || role || ']: ' || CASE WHEN length(text) > 500 THEN substring(text, 1, 497) || '...' ELSE text END ORDER BY turn)), lambda a, x: CASE WHEN a = '' THEN x ELSE a || chr(10) || chr(10) || x END) AS thread FROM conversations GROUP BY conv_id")
def comment_join(t):
    block = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    line = lambda c: F.concat(F.lit("["), c["role"], F.lit("]: "), tx.ellipsis(c["text"], 500))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(block, line), "\n\n").alias("thread"))


@query("SELECT doc_id, list_distinct(list_transform(['#' || upper(source), '#Large-Language_Models', source], lambda x: replace(replace(replace(regexp_replace(lower(x), '^#+', ''), '-', ''), '_', ''), ' ', ''))).list_sort().array_to_string(',') AS tags FROM documents")
def tag_normalize(t):
    from ..operators.select import plain_tag

    tags = F.array(F.concat(F.lit("#"), F.upper("source")), F.lit("#Large-Language_Models"), F.col("source"))
    return t("documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(tags, plain_tag))), ",").alias("tags"))


@query("""
WITH p(domain, keywords, tags) AS (VALUES ('d', ['the', 'Data', 'zebra', 'Lorem'], ['time', 'of']), ('e', ['quick'], ['ing']), ('none', []::VARCHAR[], ['the'])),
s AS (SELECT doc_id, domain, least(1.0, (1.0 * len(list_filter(keywords, lambda k: contains(lower(text), lower(k)))) + 0.3 * len(list_filter(tags, lambda k: contains(lower(text), lower(k))))) / greatest(len(keywords), 1)) AS score FROM documents, p)
SELECT doc_id, domain, CAST(score AS DOUBLE) AS score FROM s WHERE score >= 0.1""")
def interest_match(t):
    spark = t("documents").sparkSession
    presets = [("d", ["the", "Data", "zebra", "Lorem"], [(["time"],), (["of"],)]), ("e", ["quick"], [(["ing"],), (None,)]), ("none", [], [(["the"],)])]
    domains = spark.createDataFrame(presets, "domain string, keywords array<string>, sources array<struct<tags:array<string>>>")
    return archive.interest_scores(t("documents").select(F.col("doc_id").alias("id"), "text"), domains).withColumnRenamed("id", "doc_id")


@query()
def appended_discussion(t):
    lines = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("lines"))
    return t("documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("content")).join(lines, "conv_id", "left").select("conv_id", feeds.with_discussion(F.col("content"), F.col("lines")).alias("content"))


@query("SELECT event_id, 'capture-' || event_id % 3 AS capture, 'events' AS source, json_extract_string(props, '$.k') AS k, event_type FROM events")
def captured_events(t):
    """All events written as three captures of one source and read back by the data source."""
    events = t("events").select("event_id", "event_type", "props")
    path = storage.scratch(events.sparkSession, "captures")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).select(F.to_json(F.struct("event_id", "event_type", "props"))).write.text(f"{path}/events/capture-{k}")
    read = captures.captured(events.sparkSession, path, "events").select("capture", "source", F.from_json("body", "event_id long, event_type string, props string").alias("e"))
    return read.select("e.event_id", "capture", "source", F.get_json_object("e.props", "$.k").alias("k"), "e.event_type")


@query(r"""
WITH s AS (SELECT doc_id, source, text, string_split(text, '. ') AS p FROM documents),
k AS (SELECT *, array_to_string(p[1:list_max(list_filter(range(1, least(len(p), 102) + 1), lambda k: k = 1 OR length(array_to_string(p[1:k], '. ')) <= 200))], '. ') AS short FROM s)
SELECT doc_id, '{"kind": "note", "n": 3, "content": {"title": ' || to_json('From "' || source || '": ' || short)::VARCHAR || ', "all": [' || to_json(text)::VARCHAR || ', "#{nobody}"]}}' AS body FROM k""")
def webhook_bodies(t):
    """A message's body for every document: a whole text and its first sentences in a tree of templates."""
    docs = t("documents")
    tree = {"kind": "note", "n": 3, "content": {"title": 'From "#{source}": #{text?limit=200&split=. }', "all": ["#{text}", "#{nobody}"]}}
    return docs.select("doc_id", templates.compiled_json(tree, {"source": F.col("source"), "text": F.col("text")}).alias("body"))


_ENV = {"HOST": "h.example", "TOKEN": "t-1", "WHO": "${HOST}"}


@query("""SELECT c_custkey, '{"api_key":"<redacted>","feeds":[{"deep":[[{"name":"' || c_name || ' ${HOST} ${NOBODY}"}]],"url":"https://<redacted>@h.example:8443/' || c_custkey || '?token=%3Credacted%3E&n=' || c_nationkey || '"}],"headers":"Authorization: <redacted>\\nX-Segment: ' || c_mktsegment || '","limit":' || c_nationkey || ',"token_env":"TOKEN"}' AS config FROM customer""")
def config_trees(t):
    """A configuration for each customer, references put in and secrets taken out."""
    c = F.col
    feed = F.struct(F.concat(F.lit("https://me:${TOKEN}@${HOST}:8443/"), c("c_custkey").cast("string"), F.lit("?token=${TOKEN}&n="), c("c_nationkey").cast("string")).alias("url"), F.array(F.array(F.struct(F.concat("c_name", F.lit(" ${WHO} ${NOBODY}")).alias("name")))).alias("deep"))
    tree = F.struct(F.array(feed).alias("feeds"), F.lit("k-${TOKEN}").alias("api_key"), F.lit("TOKEN").alias("token_env"), c("c_nationkey").alias("limit"), F.concat(F.lit("Authorization: Bearer ${TOKEN}\nX-Segment: "), "c_mktsegment").alias("headers"))
    env = F.create_map(*[F.lit(x) for pair in _ENV.items() for x in pair])
    return spread(t("customer")).select("c_custkey", F.to_json(configs.redacted(configs.expanded(F.parse_json(F.to_json(tree)), env))).alias("config"))


@query("""
WITH g AS (SELECT d.doc_id, 'issue-' || d.doc_id // 100 AS date, lang FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
p AS (SELECT *, min(doc_id) OVER (PARTITION BY date, lang) AS first, row_number() OVER (PARTITION BY date, lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY date, lang) AS kn, count(*) OVER (PARTITION BY date) AS n FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY first, doc_id) AS i FROM p)
SELECT date, CAST(n - i AS INTEGER) AS seq, 'item' AS kind, upper(lang[1]) || lang[2:] || ' ' || k || '/' || kn || ' title ' || doc_id AS title, CAST(i AS INTEGER) AS item_index, n AS item_count FROM r
UNION ALL SELECT 'issue-' || k.i, CAST(coalesce(max(n), 0) AS INTEGER), 'overview', 'Digest issue-' || k.i || ' Overview', 0, coalesce(max(n), 0) FROM (SELECT DISTINCT doc_id // 100 AS i FROM documents) k LEFT JOIN r ON r.date = 'issue-' || k.i GROUP BY k.i""")
def item_messages(t):
    """A message for each good document and an overview for each issue of a hundred ids, the overview last."""
    docs = t("documents").withColumn("date", F.concat(F.lit("issue-"), F.expr("cast(doc_id div 100 as string)")))
    none = F.lit(None)
    artifact = none.cast("struct<language:string,title:string,blocks:array<struct<id:string,type:string,title:string,content:string,source_refs:array<string>,primary:boolean>>,sources:array<struct<id:string,title:string,url:string>>>")
    items = docs.join(t("labels").where("quality = 1").select("doc_id").distinct(), "doc_id").select("date", F.col("lang").alias("profile_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("title "), F.col("doc_id").cast("string")).alias("title"), F.lit("https://n.example/").alias("url"), none.cast("double").alias("score"), F.col("text").alias("summary"), none.cast("array<string>").alias("tags"), none.cast("map<string,string>").alias("metadata"), F.col("source").alias("source_type"), none.cast("string").alias("author"), none.cast("timestamp").alias("published_at"), artifact.alias("artifact"))
    issues = docs.groupBy("date").agg(F.count("*").alias("total"), F.lit("").alias("markdown"))
    return messages.daily_messages(items, issues, delivery=messages.ITEMS, overview_last=True).select("date", "seq", "kind", "title", F.coalesce("item_index", F.lit(0)).alias("item_index"), "item_count")
