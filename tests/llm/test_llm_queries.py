"""Every query and the pipeline over tables with nulls, repeats, ties, long and empty texts and clashing columns."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.test_chat_format import plain as plain_chats
from tests.llm.test_lexical import brute as brute_ranks
from tests.llm.test_models import brute_links
from tests.llm.test_negatives import brute as brute_negatives
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_ngram_join import shingle_set
from tests.llm.test_quality_rules import brute as brute_rules
from tidemill.llm import pieces, queries

SF = "/root/testdata/sf0.001"
CLASHES = ["id", "size", "block", "bin", "kept", "score", "lang_pred", "lang_score", "quality_score", "shard", "slot", "n_words", "component_id", "n_links", "host", "verdict", "failed_rule", "label_of", "piece", "start"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with odd rows and columns by the names that operators make."""
    root = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("n_chars > 500").orderBy("doc_id").first()
    odd = [(None, None, None, None), (None, first.text, "en", "s"), (None, first.text, "en", "s"), (9001, None, "en", None), (9002, "", None, "s"), (9003, " \t\n\x0b ", "en", "s"), (9004, "123 !? 😀", "de", "t")]
    odd += [(9005, (first.text + "\n") * 400, first.lang, None), (9006, "é" * 60_000, None, None), (first.doc_id, first.text, first.lang, first.source), (first.doc_id, "another text by the same id", "en", "u"), (9007, first.text, None, None), (9007, first.text, None, None), (9008, "x\0y ▁ <|endoftext|>", "fr", "")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (9001, None, None), (9007, 1, 0), (9007, 0, 0), (first.doc_id, 1, 0), (77777, 1, 1)], "doc_id long, quality int, toxic int"))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages = pages.unionByName(spark.createDataFrame([(None, None, None), (1, "no scheme", ""), (1, "HTTP://U@EXAMPLE.com:80/en/7?x", None), (2, "://", "x"), (3, "http://a.example.net/de/81#f", None)], "page_id long, url string, html string"))
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = vecs.first()
    vecs = vecs.unionByName(spark.createDataFrame([(None, v.embedding, v.label), (v.vec_id, v.embedding, v.label), (8001, v.embedding, v.label), (8002, v.embedding, None), (8003, None, 1), (8004, [0.0] * 64, 1), (8005, [None] + [1.0] * 63, 1), (8006, [float("nan")] + [1.0] * 63, 1), (8007, [], 1)], vecs.schema))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = items.unionByName(spark.createDataFrame([(None, first.text), (0, "x"), (901, None), (902, "")], items.schema))
    talks = spark.read.parquet(f"{SF}/conversations.parquet")
    talks = talks.unionByName(spark.createDataFrame([(None, 0, "user", "x"), (0, None, None, None), (0, 1, "assistant", "\\### </turn>"), (0, 1, "assistant", "\\### </turn>"), (77, 5, "assistant", "é" * 60_000)], talks.schema))
    for name, df in (("documents", rows), ("labels", labels), ("pages", pages), ("embeddings", vecs), ("benchmark", items), ("conversations", talks)):
        clash = [c for c in CLASHES if c not in df.columns]
        df.withColumns({c: F.lit("clash") for c in clash}).repartition(3).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "pages", "embeddings", "benchmark", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()


@pytest.fixture(scope="module")
def good(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("name", [*sorted(queries.QUERIES), "pipeline"])
def test_empty_tables_give_empty_results(spark, empty, name):
    run = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    rows = run(spark, empty).collect()
    assert rows == [] or name == "op13_chat_format" and [r.conv_id for r in rows] == [-7]


def test_op1(spark, folder, docs):
    got = queries.op1_quality_rules(spark, folder)
    assert dict(got.dtypes)["n_words"] == "bigint" and dict(got.dtypes)["kept"] == "boolean"
    assert ordered(r[:-1] for r in got.collect()) == ordered((d.doc_id, *w, w[0] < 20 or 100 * w[4] > 30 * w[0]) for d in docs for w in [brute_rules(d.text)])


def test_op2(spark, folder, docs):
    got = queries.op2_ngram_jaccard(spark, folder).collect()
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups([(d.doc_id, d.text) for d in docs], 3, 90)


def test_op3(spark, folder):
    def parts(url):
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [r for r in queries.PATH_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.rule), default=None)

    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()
    got = queries.op3_url_filter(spark, folder).collect()
    want = [(p.page_id, *hp, r.rule if r else None) for p in pages for hp in [parts(p.url)] for r in [rule(*hp)]]
    assert ordered((r.page_id, r.host, r.path, r.rule) for r in got) == ordered(want)
    action = {r.rule: r.action for r in queries.PATH_RULES}
    assert all(r.verdict == action[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)


def bins_are_right(got, docs):
    size = {}
    for d in docs:
        size.setdefault(d.doc_id, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")))
    assert Counter(r.doc_id for r in got) == Counter({i: sum(max(1, -(-n // 2048)) for n in sizes) for i, sizes in size.items()})
    assert sum(r["size"] for r in got) == sum(map(sum, size.values()))
    source = {d.doc_id: d.source for d in docs}
    bins = {}
    for r in got:
        assert r.start == 2048 * r.piece
        bins.setdefault((r.block, r.bin), []).append(r)
    for held in bins.values():
        assert sum(r["size"] for r in held) <= 2048
        named = [source[r.doc_id] for r in held if len(size[r.doc_id]) == 1 and source[r.doc_id] is not None]
        assert len(named) == len(set(named))


def test_op4(spark, folder, docs):
    bins_are_right(queries.op4_best_fit_packing(spark, folder).collect(), docs)


def test_op5(spark, folder, docs):
    got = queries.op5_sharding(spark, folder).collect()
    data = lambda d: (d.text or "").encode()
    assert ordered((r.doc_id, r.size, r.text_crc32) for r in got) == ordered((d.doc_id, len(data(d)) + 1, zlib.crc32(data(d))) for d in docs)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_op6(spark, folder, docs):
    best = brute.BestPath(pieces.load(public_tokenizers.path("piece_bpe_32k.model")))
    got = queries.op6_sentencepiece(spark, folder).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((d.doc_id, zlib.crc32((d.text or "").encode())) for d in docs)
    plain = [d for d in docs if d.text and "▁" not in d.text]
    assert len(plain) >= 200
    found = {(r.doc_id, r.n_pieces, r.ids_crc32) for r in got}
    for d in plain:
        ids = best.of_text(d.text)
        assert (d.doc_id, len(ids), zlib.crc32(np.array(ids, "<i4").tobytes())) in found


def test_op7(spark, folder):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = queries.op7_near_vectors(spark, folder).collect()
    assert ordered((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows, 0.93)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def near_shares(got, text, learned, slack=0.01):
    """Whether (language, score) is what counting without Bloom filters gives, but for their false positives."""
    share = brute.language_shares(text, learned)
    if share is None:
        return got == ("und", 0.0)
    return got[0] in share and abs(got[1] - share[got[0]]) <= slack and share[got[0]] >= max(share.values()) - slack


def test_op8(spark, folder, docs):
    learned = brute.learned_languages([(d.doc_id, d.text, d.lang) for d in docs if d.doc_id is not None and not held_out(d.doc_id)])
    got = queries.op8_language_id(spark, folder).collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((d.doc_id, held_out(d.doc_id)) for d in docs)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert len(learned) > 2
    for d in docs:
        assert any(near_shares(x, d.text, learned) for x in by[d.doc_id]), d.doc_id
    right = [(d.lang in {x[0] for x in by[d.doc_id]}) for d in docs if held_out(d.doc_id) and d.lang and d.text and len(d.text) > 100]
    assert np.mean(right) > 0.9


def test_op9(spark, folder, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for d in sorted(docs, key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.text is not None, (d.text or "").encode())):
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        want.append((d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.op9_token_files(spark, folder).collect()
    assert ordered((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == ordered(want)


def test_op10(spark, folder, docs, good):
    scores = brute.quality_scores([(d.doc_id, d.text, d.source, d.lang) for d in docs], good)
    got = queries.op10_quality_model(spark, folder).collect()
    mine = sorted(((str(r.doc_id), r.quality_score) for r in got))
    want = sorted((str(d.doc_id), s) for d, s in zip(docs, scores, strict=True))
    assert [i for i, _ in mine] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(mine, want, strict=True)) < 1e-3
    assert all(r.kept == (r.quality_score >= 0.5) for r in got)


def test_op11(spark, folder):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    moved = [(i, v, (k + 1) % 10 if i is not None and k is not None and i % 7 == 0 else k) for i, v, k in rows]
    assert ordered(queries.op11_hard_negatives(spark, folder).collect()) == brute_negatives(moved, lambda i: i % 50 == 0)


def test_op12(spark, folder, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert ordered(queries.op12_lexical_search(spark, folder).collect()) == brute_ranks([(d.doc_id, d.text) for d in docs], items)


def test_op13(spark, folder):
    turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    got = queries.op13_chat_format(spark, folder).collect()
    assert ordered(tuple(r)[:5] for r in got) == plain_chats(turns)
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_pipeline(spark, folder, docs, good):
    """Stage by stage against the plain versions; what lies on a threshold may go either way."""
    now = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(stage, kept, open_):
        nonlocal now
        now = spark.createDataFrame(stages[stage](spark, now, folder).collect(), "doc_id long, text string, lang string, source string, n_chars long")
        rows = now.collect()
        have, sure, may = Counter(map(tuple, rows)), Counter(map(tuple, kept)), Counter(map(tuple, kept + open_))
        assert not sure - have and not have - may
        return rows

    scores = brute.quality_scores([(d.doc_id, d.text, d.source, d.lang) for d in docs], good)
    rows = after("quality", [d for d, s in zip(docs, scores, strict=True) if s >= 0.501], [d for d, s in zip(docs, scores, strict=True) if 0.499 < s < 0.501])
    learned = brute.learned_languages([(d.doc_id, d.text, d.lang) for d in rows if d.doc_id is not None and not held_out(d.doc_id)])
    best = [max((brute.language_shares(d.text, learned) or {"": -1}).values()) for d in rows]
    rows = after("languages", [d for d, s in zip(rows, best, strict=True) if s >= 0.21], [d for d, s in zip(rows, best, strict=True) if 0.19 < s < 0.21])
    groups = {(i, n): c for i, n, c in brute_groups([(d.doc_id, d.text) for d in rows], 5, 80) if i is not None}
    gone = {i for (i, _), c in groups.items() if c != i}
    rows = after("near_duplicates", [d for d in rows if d.doc_id not in gone], [])
    sets = [shingle_set(d.text, 5) for d in rows if d.doc_id is not None]
    ids = [d.doc_id for d in rows if d.doc_id is not None]
    assert not any(i != j and a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in zip(ids, sets, strict=True) for j, b in zip(ids, sets, strict=True))
    bins_are_right(stages["pack"](spark, now, folder).collect(), rows)


def test_pipeline_runs_over_odd_tables(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "size", "block", "bin"] and out.count() > 50
