import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemill.llm import _words, pieces, token_files
from tidemill.llm._common import Workspace

TEXTS = ["", " ", "a", "Hello  world", " leading", "trailing ", "tabs\tand\n\nlines \n x", "é日本😀 ▁mark ▁▁", "don't I'll", "x\n  y", "a\u00a0 b", "<|endoftext|> in text", "\0null", "word " * 3000, "ab" * 5000, "\r\n\x1c  z"]


@pytest.fixture(scope="module")
def model():
    return pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts(n):
    r = random.Random(2)
    return ["".join(r.choice("ab \n\t é▁'1 ,日😀\u00a0") for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_sentencepiece_round_trip(model):
    for t in TEXTS + odd_texts(2000):
        assert model.decode(model.encode(t)) == t
    assert len(model.encode(None)) == 0


def test_viterbi_is_the_best_path(model):
    vocabulary = {p: s for p, s, k in zip(model.pieces, model.scores, model.types, strict=True) if k in (1, 4)}
    longest = max(map(len, vocabulary))
    for t in [t for t in TEXTS if len(t) < 60 and "▁" not in t] + [x.replace("▁", "") for x in odd_texts(300)]:
        if not t:
            continue
        text = "▁" + t.replace(" ", "▁")
        best = [0.0] + [-1e18] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = best[end - 1] + model.missing
            for start in range(max(0, end - longest), end):
                if text[start:end] in vocabulary:
                    best[end] = max(best[end], best[start] + vocabulary[text[start:end]])
        ids, score, run = model.encode(t), 0.0, bytearray()
        for i in ids.tolist():
            if model.types[i] == 6:
                run.append(int(model.pieces[i][3:5], 16))
            else:
                score += model.scores[i]
                score += len(run.decode()) * model.missing
                run.clear()
        score += len(run.decode()) * model.missing
        assert abs(score - best[-1]) < 1e-6 * max(1, abs(best[-1])), t


def test_own_ids_are_the_librarys(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path, by_type=True)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    for t in [t for t in TEXTS if t and "▁" not in t] + [x for t in odd_texts(2000) if (x := t.replace("▁", ""))] + [t for t in docs if "▁" not in t]:
        assert own.encode(t).tolist() == library.encode(t), t[:80]
        assert own.decode(own.encode(t)) == t
    for t in TEXTS + odd_texts(2000):
        assert own.decode(own.encode(t)) == t
    rows = spark.createDataFrame([(1, "the documents")], "doc_id long, text string")
    want = library.encode("the documents")
    assert pieces.encoded(rows, path, by_type=True).first().piece_ids == want
    assert pieces.digests(rows, path, by_type=True).first()[1:3] == (len(want), zlib.crc32(np.array(want, "<i4").tobytes()))


def test_sentencepiece_tables(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, n_pieces string")
    back = pieces.decoded(pieces.encoded(rows, path), path).collect()
    assert [r.piece_text for r in back] == [*TEXTS, ""]
    for r in pieces.digests(rows, path).collect():
        assert r.text_crc32 == zlib.crc32(([*TEXTS, ""][r.doc_id]).encode())
    assert pieces.digests(rows.where("false"), path).collect() == []


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    r = np.random.default_rng(1)
    for ids in ([], [0], [2**32 - 1, 0, 7], r.integers(0, 50257, 5000), r.integers(0, 2**20, 63)):
        a = np.asarray(ids, np.uint32)
        assert np.array_equal(token_files.merged(token_files.planes(a, bits), len(a), bits), a)


@pytest.mark.parametrize("bits", [False, True])
def test_files_round_trip(bits):
    r = np.random.default_rng(3)
    docs = [r.integers(0, 60000, n).astype(np.uint32) for n in (0, 1, 5, 100, 1000, 3, 0, 257)]
    f = io.BytesIO()
    w = token_files.Writer(f, bits, 64)
    for i, d in enumerate(docs):
        w.add(d, i if i else None)
    w.close()
    reader = token_files.Reader(f)
    back = list(reader.documents())
    assert [i for i, _ in back] == [None, *range(1, len(docs))]
    assert all(np.array_equal(a, b) for a, (_, b) in zip(docs, back, strict=True))
    assert np.array_equal(reader.block(1), np.concatenate(docs)[64:128])


def test_words_encode_as_whole_texts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, kept = Tokenizer.from_file(path), token_files.WordEncoder(path)
    assert kept.by_words
    monkeypatch.setattr(_words, "CACHE", 50)
    for t in TEXTS + odd_texts(3000):
        assert kept.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(9, "b c"), (3, None), (5, ""), (5, "again"), (None, "no id"), (4, "word " * 2000), (-2, "x  y")]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, start long, id long")
    manifest = token_files.written(df, path, Workspace(spark, "t").root, block_ids=128)
    got = sorted((tuple(r) for r in token_files.read_back(manifest).collect()), key=lambda r: r[1])
    plain, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    empty = token_files.written(df.where("false"), path, Workspace(spark, "t").root)
    assert token_files.read_back(empty).collect() == []
