import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import lexical


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    """Every document for every item: (item, rank, id, score), sorted as text."""
    held = [(i, t) for i, text in docs if (t := terms(text))]
    n, total = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    counts = [(i, len(t), Counter(t)) for i, t in held]
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, size, tf in counts:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 12 * m)) for x, c in asked.items() if tf[x])
            if score > 0:
                scored.append((i, score))
        best = sorted(scored, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (i, s) in enumerate(best)]
    return sorted(out, key=str)


def corpus(seed, n=300):
    r = random.Random(seed)
    words = [w + s for w in ("Alpha", "beta", "gam-ma", "Été", "日本", "x1") for s in ("", "s", "2", "é")] + [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(r.choice(words[: r.choice([5, 20, 104])]) for _ in range(r.choice([1, 5, 40])))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (None, None), (3, docs[3][1]), (900, None), (901, ""), (902, " .,! "), (903, "beta " * 100_000), (904, "\0beta\0")]
    items = [(0, docs[3][1]), (1, "beta BETA beta w1 nowhere"), (2, ""), (3, None), (4, "?!"), (5, "w2 w3 w4"), (None, "w5"), (5, "w6"), (6, " ".join(words))]
    return docs, items


def test_ranked_matches_brute_force(spark):
    docs, items = corpus(1)
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "n", "terms", "times", "score", "query", "rank")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("item", "query", "rank")})
    for k in (20, 3):
        assert sorted(map(tuple, lexical.ranked(a.repartition(5), b, k=k).collect()), key=str) == brute(docs, items, k)
    assert sorted(map(tuple, lexical.ranked(a, b, block_bytes=300).collect()), key=str) == brute(docs, items)
    assert lexical.ranked(a.where("false"), b).collect() == []
    assert lexical.ranked(a, b.where("false")).collect() == []
    assert lexical.ranked(a.where("text is null"), b).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_a_task_of_many_shards(monkeypatch, seed):
    monkeypatch.setattr(lexical, "LEVELS", 4)
    monkeypatch.setattr(lexical, "NODES", 2)
    docs, items = corpus(seed, 150)

    class Sent:
        value = lexical.Block.of(items)

    rows = pa.table({"id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())})
    postings = list(lexical._postings(iter(rows.to_batches(max_chunksize=23)), Sent))
    counts = [r for b in lexical._counts((b.select(["n", "terms"]) for b in postings), len(Sent.value.vocabulary)) for r in b.to_pylist()]
    n, total = next((r["df"], r["terms"]) for r in counts if r["term"] == -1)
    weights = np.zeros(len(Sent.value.vocabulary), np.int64)
    for r in counts[:-1]:
        weights[r["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    got = [tuple(r.values()) for b in lexical._searched(iter(postings), Sent, n, total, weights, 7) for r in b.to_pylist()]
    asked, rank, mine = Sent.value.queries, Counter(), []
    for q, i, s in got:
        rank[q] += 1
        mine.append((asked[q].item, rank[q], i, s))
    assert sorted(mine, key=str) == brute(docs, items, 7)


def test_nodes_that_cannot_win_stay_closed():
    r = np.random.default_rng(2)
    docs = np.repeat(np.arange(4096), 3)
    made = lexical.DualTree(np.arange(4096), np.tile(np.arange(3), 4096), docs, r.integers(1, 900_000, len(docs)).astype(np.int64), 3)
    opened = []
    ones = made.ones
    made.ones = lambda level, at: opened.append(level.size) or ones(level, at)
    scores, ids = made.search(np.arange(3), np.array([5, 3, 1]), 5, (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert len(ids) == 5 and (np.diff(scores) <= 0).all()
    assert sum(opened[::4]) < 2000  # of 8,191 nodes
