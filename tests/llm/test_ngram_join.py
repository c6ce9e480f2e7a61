import random
import re

import numpy as np
import pytest

from tidemill.llm import _hashing as h
from tidemill.llm import ngram_join as nj
from tidemill.llm.graph import components
from tidemill.llm._common import Workspace


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(60)]
    rows, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.choice([1, 2, 3, 5, 8, 20, 60, 150]))] + (passage if r.random() < 0.5 else [])
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                copy[r.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy) if r.random() < 0.8 else "\n".join(copy).upper()))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \t\n"), (None, rows[0][1]), (i + 3, "É x y"), (i + 4, "é x y")]


@pytest.mark.parametrize(("n", "percent", "parts"), [(3, 90, 2), (5, 80, 2), (5, 80, 4)])
def test_groups_match_brute_force(spark, n, percent, parts):
    rows = corpus(n)
    df = spark.createDataFrame([(a, t, 7) for a, t in rows], "doc_id long, text string, component_id long")
    got = sorted(((r.id, r.size, r.component_id) for r in nj.near_groups(df, shingle=n, percent=percent, parts=parts).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_large_group_goes_block_by_block(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(120)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(nj, "BLOCK", 16)
    monkeypatch.setattr(nj, "BROADCAST_IDS", 0)
    got = sorted(((x.id, x.size, x.component_id) for x in nj.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=90, parts=2).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_a_pair_is_named_once_not_by_each_signature(spark, monkeypatch, tmp_path):
    r, run, to = random.Random(7), nj._run, str(tmp_path)
    base = [f"w{i}" for i in range(600)]
    rows = []
    for i in range(24):
        copy = list(base)
        for at in r.sample(range(600), 7):
            copy[at] = f"x{i}-{at}"
        rows += [(2 * i, " ".join(copy))] + [(2 * i + 1, " ".join([*copy, "end"]))] * (i % 3 > 1)

    def counted(work, **how):
        def made(batches):
            import uuid

            for b in run(work, **how)(batches):
                with open(f"{to}/{work.__name__}-{uuid.uuid4().hex}", "w") as f:
                    f.write("\n".join(f"{x} {y}" for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
                yield b

        return made if work.__name__ == "_pairs" else run(work, **how)

    monkeypatch.setattr(nj, "_run", counted)
    got = sorted(((x.id, x.size, x.component_id) for x in nj.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, percent=80).collect()), key=str)
    assert got == brute(rows, 5, 80)
    named = [x for p in tmp_path.iterdir() for x in p.read_text().split("\n")]
    assert len(set(named)) > 100 and len(named) < 2 * len(set(named))


def test_empty_and_repeated_rows(spark):
    assert nj.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    assert sorted(tuple(r) for r in nj.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


@pytest.mark.parametrize(("percent", "n2", "k2"), [(90, 2, 1), (80, 3, 1), (80, 4, 2), (70, 1, 0)])
def test_sets_that_link_share_a_signature(percent, n2, k2):
    r = np.random.default_rng(percent)
    for size in [2, 5, 9, 10, 11, 30, 77, 200, 513]:
        for _ in range(40):
            a = np.unique(h.mix(r.integers(0, 2**63, size, dtype=np.uint64)))
            gone = r.integers(0, max(1, int(size * (100 - percent) / 100)) + 1)
            more = r.integers(0, max(1, int(size * (100 - percent) / 100)) + 1)
            b = np.unique(np.concatenate([a[gone:], h.mix(r.integers(0, 2**63, more, dtype=np.uint64))]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert np.intersect1d(nj.signatures(a, percent, n2, k2), nj.signatures(b, percent, n2, k2)).size


def test_words_hash_alike_in_pieces(monkeypatch):
    text = ("Ab cd\u00e9 \n" * 500 + "x" * 9000 + " end").encode()
    whole = h.word_hashes(text)
    monkeypatch.setattr(h, "CHUNK", 64)
    assert np.array_equal(whole, h.word_hashes(text))
    assert np.array_equal(h.word_hashes(b"AB c", h.LOWER), h.word_hashes(b"ab C", h.LOWER))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (None, 3), (60, 50), (60, 50), (51, 60)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(chain, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 51: 50, 60: 50}


def test_sketches_bound_the_intersection():
    r = np.random.default_rng(1)
    for size in [100, 900, 9000] * 9:
        a, b = (np.unique(r.integers(0, 90000, size).astype(np.uint64)) for _ in range(2))
        x, y = nj._counts([nj.sketch(s) for s in (a, b)]).astype(int)
        assert x.sum() == len(a) and y.sum() == len(b)
        assert np.minimum(x, y).sum() >= len(np.intersect1d(a, b))
    assert nj.sketch(np.arange(300, dtype=np.uint64) * np.uint64(nj.SKETCH)) == b""


def test_sets_without_a_sketch_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(nj, "sketch", lambda found: b"")
    rows = corpus(11)
    got = sorted(((x.id, x.size, x.component_id) for x in nj.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=80).collect()), key=str)
    assert got == brute(rows, 3, 80)


def test_wide_sketches_never_rule_out_a_link():
    r = np.random.default_rng(8)
    for n in (1, 3, 128, 512, 513, 700, 2049, 9000):
        x = nj.mix(r.integers(0, 2**62, n, dtype=np.uint64))
        for share in (1.0, 0.9, 0.8):
            kept = x[: max(1, int(n * share))]
            assert nj._may_link(nj.wide_sketch(x), nj.wide_sketch(kept), len(x), len(kept), int(100 * len(kept) / len(x)))
        other = nj.mix(r.integers(0, 2**62, n, dtype=np.uint64))
        if n >= 128:
            assert not nj._may_link(nj.wide_sketch(x), nj.wide_sketch(other), n, n, 80)
    same = np.full(600, 7, np.uint64)
    assert nj.wide_sketch(same) == b"" and nj._may_link(b"", b"", 600, 600, 80)
