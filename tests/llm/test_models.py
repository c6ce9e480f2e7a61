import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import language, quality_model, vectors
from tidemill.llm._common import SHARE, training_share

WORDS = {"xx": ["alpha", "beta", "gamma"], "yy": ["schiff", "wasser", "über"], "zz": ["maison", "été", "chien"]}


def language_rows(n=300):
    r = random.Random(4)
    return [(i, " ".join(r.choice(WORDS[k]) for _ in range(30)), k) for i in range(n) for k in [r.choice(list(WORDS))]]


def test_language_held_out_accuracy_and_edges(spark):
    rows = language_rows()
    train = spark.createDataFrame([*rows[:200], (900, None, "xx"), (901, "alpha", None), (None, "alpha", "xx")], "doc_id long, text string, lang string")
    filters = language.fit(train)
    assert filters.langs == ["xx", "yy", "zz"]
    edge = [(1000, None, "q"), (1001, "", "q"), (1002, "123 !?", "q"), (1003, "alpha " * 200_000, "q"), (1004, "ПРИВЕТ", "q")]
    test = spark.createDataFrame([*rows[200:], *edge], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.predictions(test, filters).collect()}
    assert all(got[i][0] == k for i, _, k in rows[200:])
    assert all(got[i] == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003][0] == "xx" and got[1004][0] in filters.langs
    assert all(0 <= s <= 1 for _, s in got.values())


def test_training_share_of_any_size():
    for n in (0, 1, 19_999, 20_000, 20_001, 10**6, 10**11, 10**15):
        share = training_share(20_000, n)
        assert abs(share / SHARE * n - min(n, 20_000)) < 1 and share >= 1 or n == 0 and share == SHARE
    assert 0 < training_share(20_000, 10**30)


def test_labels_of_which_none_is_chosen_are_an_error(spark, monkeypatch):
    train = spark.createDataFrame([(1, "alpha beta", "xx")], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "training_share", lambda most, n: 0)
    with pytest.raises(RuntimeError, match="no labelled row"):
        language.fit(train)
    monkeypatch.setattr(quality_model, "training_share", lambda most, n: 0)
    with pytest.raises(RuntimeError, match="no labelled document"):
        quality_model.fit_evidence(train, spark.createDataFrame([(1, 1)], "id long, good int"))


def test_language_without_a_cap_and_with_one(spark):
    train = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    every, few = language.fit(train), language.fit(train, max_grams=5)
    bits = lambda f: int(np.bitwise_count(f.masks).sum())
    assert bits(every) > bits(few) > 0 and bits(few) <= 3 * 5 * language.HASHES


def test_language_without_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    filters = language.fit(empty)
    rows = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert language.predictions(rows, filters).first().lang_pred == "und"
    assert language.predictions(empty, filters).collect() == []


def test_one_lookup_gives_all_languages_and_false_positives_are_corrected():
    r = np.random.default_rng(0)
    of = {f"l{i:02}": language.mix(r.integers(0, 2**62, 400, dtype=np.uint64)) for i in range(70)}
    shared = of["l03"][:50]
    of["l69"] = np.concatenate([of["l69"], shared])
    f = language.Filters.build(of, slots=1 << 14)
    for i, name in enumerate(f.langs):
        masks = None
        for at in language._places(of[name], len(f.masks)):
            masks = f.masks[at] if masks is None else masks & f.masks[at]
        assert np.all((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))
        unknown = language.mix(r.integers(0, 2**62, 20000, dtype=np.uint64))
        masks = None
        for at in language._places(unknown, len(f.masks)):
            masks = f.masks[at] if masks is None else masks & f.masks[at]
        rate = np.mean((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) != 0)
        assert abs(rate - f.wrong[i]) < 0.002


def test_pieces_of_a_long_text_give_the_same_grams(monkeypatch):
    text = "Één tëxt, with wörds 123 and more. " * 40
    whole = np.concatenate(list(language.grams(text)))
    monkeypatch.setattr(language, "PIECE", 37)
    assert np.array_equal(np.sort(whole), np.sort(np.concatenate(list(language.grams(text)))))


def test_quality_held_out_accuracy_and_edges(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        good = r.random() < 0.7
        rows.append((i, " ".join(r.choice(["plain", "words", "here"]) if good else r.choice(["BUY!!", "NOW!!", "$$$"]) for _ in range(40)), f"s{i % 5}", r.choice(["p", "q", None]), int(good)))
    docs = spark.createDataFrame([*[x[:4] for x in rows], (900, None, None, None), (901, "", "s0", "p"), (902, "plain " * 300_000, "new", "p"), (5, rows[5][1], "s0", "p")], "doc_id long, text string, source string, lang string").withColumn("quality_score", F.lit("clash")).withColumn("n", F.lit(1))
    labels = spark.createDataFrame([*[(x[0], x[4]) for x in rows[:250]], (None, 1), (3000, None)], "id long, good int")
    scored = quality_model.scored(docs, labels)
    got = {x.doc_id: (x.quality_score, x.quality_kept) for x in scored.collect()}
    assert scored.count() == docs.count() and "n" in scored.columns
    assert np.mean([got[x[0]][1] == bool(x[4]) for x in rows[250:]]) > 0.98
    assert got[902][1] and all(0 <= s <= 1 for s, _ in got.values())


def test_quality_uses_the_site(spark):
    docs = spark.createDataFrame([(i, "same text here", "bad" if i % 2 else "good", "p") for i in range(400)] + [(1000, "same text here", "bad", "p"), (1001, "same text here", "good", "p")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "id long, good int")
    got = {x.doc_id: x.quality_kept for x in quality_model.scored(docs, labels).collect()}
    assert got[1001] and not got[1000]


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "s", "p")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "id long, good int")
    assert quality_model.scored(docs, none).first().quality_kept
    assert quality_model.scored(docs.where("false"), none).collect() == []


def brute_links(rows, cosine):
    n, parent = {}, {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def ok(i, v, k):
        return i is not None and v and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for a, (i, v, k) in enumerate(rows):
        for b, (j, w, m) in enumerate(rows):
            if a != b and ok(i, v, k) and ok(j, w, m) and k == m and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                n[a] = n.get(a, 0) + 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, n.get(a, 0), find(i) if i is not None else None) for a, (i, _, _) in enumerate(rows)), key=str)


def test_vectors_match_brute_force(spark, monkeypatch):
    r = np.random.default_rng(7)
    rows = []
    for c in range(12):
        centre = r.standard_normal(16)
        for _ in range(12):
            rows.append((len(rows), [float(x) for x in np.float32(centre + r.standard_normal(16) * r.choice([0.05, 0.2, 0.4]))], int(c % 2)))
    rows += [(500, rows[3][1], 0), (501, rows[3][1], 0), (502, rows[3][1], 1), (503, rows[3][1], None), (504, None, 0), (505, [0.0] * 16, 0), (506, [float("nan")] + [1.0] * 15, 0), (507, [None] + [1.0] * 15, 0), (508, [], 0), (509, [1.0, 2.0], 0), (510, [2.0, 4.0], 0), (511, [x * 3 for x in rows[3][1]], 0), (None, rows[3][1], 0), (512, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    want = brute_links(rows, 0.93)
    for tile in (2048, 5):
        monkeypatch.setattr(vectors, "TILE", tile)
        got = sorted(((x.id, x.n_links, x.component_id) for x in vectors.near_vectors(df).collect()), key=str)
        assert got == want
    assert all(x.kept == (x.id == x.component_id) for x in vectors.near_vectors(df).collect())
    assert vectors.near_vectors(df.where("false")).collect() == []


def test_rotation_is_orthogonal():
    for d in (1, 3, 16, 64):
        q = vectors.rotation(d)
        assert np.allclose(q @ q.T, np.eye(d))
