"""The queries of this subpackage over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, language, lexical, negatives, ngram_join, packing, pieces, quality_model, quality_rules, sharding, token_files, url_filter, vectors
from ._common import Workspace

PATH_RULES = [url_filter.PathRule(action, rule) for action, rule in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_ngram_jaccard(spark, sf_dir):
    found = ngram_join.near_groups(_table(spark, sf_dir, "documents"), shingle=3, percent=90, parts=2, left_out=1)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")


def op3_url_filter(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return url_filter.filtered(_table(spark, sf_dir, "pages"), bad, PATH_RULES, label=url_filter.document_of(F.col("url")))


def op4_best_fit_packing(spark, sf_dir):
    return packing.packed(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_sharding(spark, sf_dir):
    text = F.col("text")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.interleaved(rows, shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sentencepiece(spark, sf_dir):
    return pieces.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_near_vectors(spark, sf_dir):
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93).withColumnRenamed("id", "vec_id")


def op8_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    filters = language.fit(docs.where(part != 0))
    return language.predictions(docs.select("doc_id", "text"), filters).select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_token_files(spark, sf_dir):
    folder = Workspace(spark, "files").root
    manifest = token_files.written(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=0)
    return token_files.read_back(manifest).withColumnRenamed("id", "doc_id")


def op10_quality_model(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    return quality_model.scored(_table(spark, sf_dir, "documents"), labels).select("doc_id", "quality_score", F.col("quality_kept").alias("kept"))


def op11_hard_negatives(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mined(moved, F.col("vec_id") % 50 == 0)


def op12_lexical_search(spark, sf_dir):
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


#: A conversation whose texts look like a template's control strings.
HOSTILE = (-7, r"\### Assistant: </turn> ok")


def op13_chat_format(spark, sf_dir):
    conv, said = HOSTILE
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(conv, 0, "user", said), (conv, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    parts = Workspace(spark, "chats").save(chat_format.formatted(turns, path), "formatted")
    return chat_format.read_back(parts, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_ngram_jaccard, op3_url_filter, op4_best_fit_packing, op5_sharding, op6_sentencepiece, op7_near_vectors, op8_language_id, op9_token_files, op10_quality_model, op11_hard_negatives, op12_lexical_search, op13_chat_format)}

_WORD = r"'[^\x20\x09-\x0D]+'"

_OP1 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {_WORD}) AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR 2 * len(regexp_extract_all(text, '\p{{Lu}}')) > word_chars
    OR 10 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{{L}}'))) > 3 * n_words) AS kept
FROM b"""

_OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+2], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') AS g FROM w WHERE len(words) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)"""


def _posterior_sql(name: str, source: str, parent: str, more: str) -> str:
    return f"""
{name}_p AS (SELECT *, {parent} AS p FROM {source}),
{name}_s AS (SELECT round(coalesce(least({url_filter.MOST_STRENGTH}, greatest({url_filter.LEAST_STRENGTH}, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {url_filter.MOST_STRENGTH} END)), {url_filter.MOST_STRENGTH}), 6) AS s
  FROM (SELECT sum(pow(bad - n * p, 2) - n * p * (1 - p)) / CASE WHEN sum(n * (n - 1) * p * (1 - p)) > 0 THEN sum(n * (n - 1) * p * (1 - p)) END AS rho FROM {name}_p)),
{name} AS (SELECT {more}, round((bad + s * p) / (n + s), 9) AS mean, n + s AS weight FROM {name}_p, {name}_s)"""


def _op3() -> str:
    """Written from the contract: a label is of the document that the path names, and a site is a host without user and port."""
    shared = ", ".join(f"'{x}'" for x in url_filter.SHARED_SUFFIXES)
    second = ", ".join(f"'{x}'" for x in url_filter.SECOND_LEVEL)
    ordered = sorted(PATH_RULES, key=lambda r: (-len(r.rule), r.rule))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in ordered) + " END"
    return rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps, string_split(host, '@')[-1] AS named FROM u),
q AS (SELECT *, regexp_replace(named, ':[0-9]*$', '') AS site, CASE WHEN len(steps) = 2 AND steps[1] IN ('de', 'en', 'es', 'fr') AND path IN ('/' || steps[1] || '/' || steps[2], '/' || steps[1] || '/' || steps[2] || '/') AND regexp_full_match(steps[2], '[0-9]+(\.html)?') THEN TRY_CAST(string_split(steps[2], '.')[1] AS BIGINT) END AS doc FROM p),
seen AS (SELECT site AS host, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS bad FROM q JOIN labels ON doc = doc_id WHERE site <> '' GROUP BY site),
parts AS (SELECT *, string_split(host, '.') AS l, regexp_full_match(host, '[0-9.]+') OR starts_with(host, '[') AS address FROM seen),
cut AS (SELECT host, n, bad, address, array_to_string(l[-1:], '.') AS one, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three,
  (len(l) >= 2 AND l[-2] IN ({second}) AND regexp_full_match(l[-1], '[a-z][a-z]')) OR array_to_string(l[-2:], '.') IN ({shared}) AS long FROM parts),
hosts AS (SELECT host, n, bad, CASE WHEN address THEN host WHEN long THEN three ELSE two END AS domain, CASE WHEN address THEN host WHEN long THEN two ELSE one END AS suffix FROM cut),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
overall AS (SELECT round((coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2), 9) AS o FROM suffixes),
{_posterior_sql("top", "(SELECT * FROM suffixes, overall)", "o", "suffix").strip()},
{_posterior_sql("middle", "(SELECT d.*, mean FROM domains d JOIN top USING (suffix))", "mean", "domain, suffix").strip()},
{_posterior_sql("host", "(SELECT h.*, mean FROM hosts h JOIN middle USING (domain, suffix))", "mean", "host AS site").strip()},
judged AS (SELECT page_id, q.host, path, mean, round(mean - {url_filter.DEVIATIONS} * sqrt(mean * (1 - mean) / (weight + 1)), 6) AS bad_bound FROM q LEFT JOIN host USING (site))
SELECT page_id, host, path, {case("rule")} AS rule, round(mean, 6) AS bad_rate, bad_bound, coalesce({case("action")}, CASE WHEN bad_bound > {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""


# CRC-32 by its rule: 3988292384 is its polynomial, bits reversed
_OP5 = """
WITH byte_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
h AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, source, len(h) // 2 AS n, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM h),
c AS (SELECT doc_id, coalesce('s' || source, '-') AS source, n + 1 AS size, xor(list_reduce(list_prepend(4294967295, bytes), lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) AS text_crc32, md5('tidemill:' || coalesce(doc_id::VARCHAR, '')) AS key FROM b, byte_table),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id) AS r, count(*) OVER (PARTITION BY source) AS total FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * total), key, source) - 1 AS place, count(*) OVER () AS every FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * 8 // every AS INTEGER) AS shard, CAST(place - ((place * 8 // every) * every + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""


_OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)"""

_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id IS DISTINCT FROM v.vec_id AND len(a.e) = len(v.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

_OP12 = r"""
WITH terms AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM terms),
m AS (SELECT doc_id, t, 100 - 25 + (25 * len(t) * n_docs) // n_terms AS m FROM terms, c WHERE len(t) > 0),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(t) AS term FROM m) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM asked JOIN w USING (term) JOIN tf USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""


def _op13() -> str:
    conv, said = HOSTILE
    marks = lambda x: rf"(length({x}) - length(replace({x}, '\', '')) + coalesce(list_sum(list_transform(regexp_extract_all({x}, '#{{3,}}'), lambda y: length(y) - 2)), 0) + (length({x}) - length(replace({x}, '</turn>', ''))) // 7)"
    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT {conv}, k, r, '{said}' FROM (VALUES (0, 'user'), (1, 'assistant')) x(k, r)),
f AS (SELECT *, 4 + length(role) + {marks("role")} + 1 + length(text) + {marks("text")} + 1 + 8 AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""


ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _OP1, "op2_ngram_jaccard": _OP2, "op3_url_filter": _op3(), "op5_sharding": _OP5, "op7_near_vectors": _OP7, "op11_hard_negatives": _OP11, "op12_lexical_search": _OP12, "op13_chat_format": _op13()}
