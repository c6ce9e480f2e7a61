import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import negatives


def brute(rows, is_anchor, n_positives=5, k=3, least=50, most=95, scale=256):
    """Every row against every anchor. ``rows`` of (id, vector, label); the result sorted as text."""
    good = [(i, [math.floor(scale * x) for x in v], k_) for i, v, k_ in rows if v is not None and k_ is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for a, av, al in good:
        if a is None or not is_anchor(a):
            continue
        scored = [(i, sum(x * y for x, y in zip(av, v, strict=True)), label) for i, v, label in good if len(v) == len(av)]
        positives = sorted((r for r in scored if r[2] == al and r[0] != a), key=order)[:n_positives]
        for p, ps, _ in positives:
            found = sorted((r for r in scored if r[2] != al and least * ps <= 100 * r[1] <= most * ps), key=order)[:k]
            out += [(a, p, n + 1, i, ps, s) for n, (i, s, _) in enumerate(found)]
    return sorted(out, key=str)


def crowd(seed, n=400, dim=6):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, dim))
    return [(i, [float(x) for x in np.float32(centres[i % 5] + r.standard_normal(dim) * r.choice([0.0, 0.05, 0.6]))], int(r.integers(0, 3))) for i in range(n)]


def test_mined_matches_brute_force(spark):
    rows = crowd(1)
    v = rows[10][1]
    rows += [(None, v, 1), (None, v, 2), (10, v, 0), (20, rows[20][1], rows[20][2]), (1000, v, None), (1010, None, 1), (1020, [None] + v[1:], 1), (1030, [float("nan")] + v[1:], 1), (1040, [float("inf")] + v[1:], 1), (1050, [1.0, 2.0], 1), (1060, [2.0, 1.0], 1), (1070, [2.0, 1.5], 2), (1080, [], 1), (1090, [0.0] * 6, 1), (1100, [0.0] * 6, 2), (1110, [-x for x in v], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("id", "score", "ask", "rank", "v", "anchor")})
    want = brute(rows, lambda i: i % 10 == 0)
    got = sorted(map(tuple, negatives.mined(df, F.col("vec_id") % 10 == 0).collect()), key=str)
    assert got == want and len(want) > 100
    blocks = negatives.mined(df.repartition(7), F.col("vec_id") % 10 == 0, block=9)
    assert sorted(map(tuple, blocks.collect()), key=str) == want
    assert negatives.mined(df.where("false"), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mined(df, F.lit(None).cast("boolean")).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_a_task_of_many_shards(monkeypatch, seed):
    """Small shards and leaves: what is found in one bounds the search of the next."""
    monkeypatch.setattr(negatives, "SHARD", 50)
    monkeypatch.setattr(negatives, "LEAF", 4)
    r = random.Random(seed)
    rows = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in crowd(seed + 10)]
    r.shuffle(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows[at : at + 90]]), pa.array([x[2] for x in rows[at : at + 90]], pa.int64()), pa.array([x[1] for x in rows[at : at + 90]], pa.list_(pa.int64()))], ["id", "label", "v"]) for at in range(0, len(rows), 90)]

    class Sent:
        pass

    chosen = rows[:40]
    windows = np.array([(a, lo, lo + r.randint(-100, 20_000)) for a in range(40) for lo in (-5000, 3000, 40_000)], np.int64)
    for asked_windows in (None, windows):
        sent = Sent()
        sent.value = negatives.Anchors(np.array([c[0] for c in chosen]), np.array([c[2] for c in chosen]), [np.array(c[1]) for c in chosen], asked_windows)
        got = [tuple(x.values()) for b in negatives._searched(iter(batches), sent, 3) for x in b.to_pylist()]
        want = []
        for i, (a, lo, hi) in enumerate([(a, None, None) for a in range(40)] if asked_windows is None else windows.tolist()):
            scored = [(j, int(np.dot(chosen[a][1], v)), k) for j, v, k in rows]
            ok = [(j, s) for j, s, k in scored if (k == chosen[a][2] and j != chosen[a][0] if lo is None else k != chosen[a][2] and lo <= s <= hi)]
            want += [(i, j, s) for j, s in sorted(ok, key=lambda x: (-x[1], x[0]))[:3]]
        assert got == want


def test_leaves_hold_what_their_bounds_say():
    r = np.random.default_rng(3)
    x = r.integers(-200, 200, (700, 8))
    tree = negatives.VantageTree(np.arange(700), np.zeros(700, np.int64), x)
    anchors = r.integers(-200, 200, (9, 8))
    low, high = tree.bounds(anchors)
    assert sorted(tree.ids.tolist()) == list(range(700)) and (tree.x == x[tree.ids]).all() and len(tree.spans) > 8
    for a, anchor in enumerate(anchors):
        norm = float(anchor @ anchor)
        away = np.array([tree.distance(norm, s) for s in tree.x @ anchor])
        for leaf, (i, j) in enumerate(tree.spans):
            assert low[a, leaf] - 1e-6 <= away[i:j].min() and away[i:j].max() <= high[a, leaf] + 1e-6


def test_leaves_out_of_reach_stay_closed():
    r = np.random.default_rng(4)
    x = r.standard_normal((20, 8))[np.arange(2000) % 20] + 0.02 * r.standard_normal((2000, 8))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    tree = negatives.VantageTree(np.arange(2000), np.zeros(2000, np.int64), x)
    low, high = tree.bounds(x[:1])
    one = negatives.Search(tree, x[0], low[0], high[0])
    scores, ids = one.first(3, None, None, lambda rows: np.ones(len(rows), bool), (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert scores.tolist() == sorted(x @ x[0])[:-4:-1] and one.read.mean() < 0.5


def test_large_whole_numbers_are_exact():
    x, y = np.array([[1 << 28, 3]]), np.array([[(1 << 28) - 1, 5]])
    assert negatives.inner(x, y)[0, 0] == (1 << 28) * ((1 << 28) - 1) + 15
