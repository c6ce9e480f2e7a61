import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemill import storage
from tidemill.operators import archive_index as ai
from tidemill.operators import render

SCHEMA = "id string, title string, content string, date string"


def documents(seed, ids):
    r = random.Random(seed)
    words = ["the", "Thing", "квантизация", "Été", "x1", "rare", "a-b", "snake_case"]
    text = lambda n: " ".join(r.choice(words[: r.randint(2, 8)]) for _ in range(n))
    return [(f"d{i}", text(3), text(r.choice([0, 5, 60])), f"2024-08-{1 + i % 28:02}") for i in ids]


def same(spark, path, rows, queries=("the thing", "RARE квантизация", "nothing here", "...", "a b snake_case Été x1")):
    docs = spark.createDataFrame(rows, SCHEMA)
    for q in queries:
        every = [(r.id, r.score) for r in render.search(docs, q, limit=10_000).collect()]
        date = {r[0]: r[3] for r in rows}
        want = sorted(sorted(every), key=lambda r: (r[1], date[r[0]]), reverse=True)
        want = [x for _, same in itertools.groupby(want, key=lambda r: (r[1], date[r[0]])) for x in sorted(same)][:30]
        assert [(r.id, r.score) for r in ai.search(spark, path, q).collect()] == want


@pytest.fixture
def path(spark):
    return storage.scratch(spark, "test-archive")


def test_upserts_replace_and_compaction_keeps(spark, path):
    held = {}
    for seed, ids in ((1, range(60)), (2, range(40, 90)), (3, [5, 50, 200])):
        rows = documents(seed, ids)
        ai.upsert(spark.createDataFrame(rows, SCHEMA), path, date_col="date", buckets=8)
        held |= {r[0]: r for r in rows}
        same(spark, path, list(held.values()))
    assert storage.committed(spark, f"{path}/versions")[1]["n"] == len(held)
    ai.compacted(spark, path)
    assert len(storage.committed(spark, f"{path}/versions")[1]["segments"]) == 1
    same(spark, path, list(held.values()))
    ai.upsert(spark.createDataFrame(documents(4, [5, 300]), SCHEMA), path, date_col="date", buckets=8)
    same(spark, path, list((held | {r[0]: r for r in documents(4, [5, 300])}).values()))


def test_a_search_reads_its_terms_folders_only(spark, path):
    ai.upsert(spark.createDataFrame(documents(1, range(30)), SCHEMA), path, date_col="date")
    found = ai.search(spark, path, "the rare")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan and "/documents/" not in plan
    read = {f for f in found.inputFiles() if "/postings/" in f}
    every = {f for f in spark.read.parquet(f"{path}/postings").inputFiles()}
    assert 0 < len(spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin([r.b for r in spark.createDataFrame([("the",), ("rare",)], "t string").select(ai._bucket(F.col("t"), 64).alias("b")).collect()])).select("bucket").distinct().collect()) <= 2 < len(every)
    assert read


def test_what_is_not_committed_is_not_read(spark, path, monkeypatch):
    rows = documents(1, range(20))
    ai.upsert(spark.createDataFrame(rows, SCHEMA), path, date_col="date")

    def broken(*a):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(storage, "commit", broken)
        ai.upsert(spark.createDataFrame(documents(2, range(20)), SCHEMA), path, date_col="date")
    same(spark, path, rows)
    ai.upsert(spark.createDataFrame(documents(2, range(20)), SCHEMA), path, date_col="date")
    same(spark, path, documents(2, range(20)))


def test_odd_rows(spark, path):
    with pytest.raises(ValueError):
        ai.search(spark, path, "the")
    ai.upsert(spark.createDataFrame([], SCHEMA), path)
    assert ai.search(spark, path, "the").collect() == []
    ai.upsert(spark.createDataFrame([(None, "the", "the", None), ("a", None, None, None), ("b", None, "the", None)], SCHEMA), path)
    assert [r.id for r in ai.search(spark, path, "the").collect()] == ["b"]
    with pytest.raises(ValueError):
        ai.upsert(spark.createDataFrame([("a", "x", "", None)] * 2, SCHEMA), path)
    with pytest.raises(ValueError):
        ai.upsert(spark.createDataFrame([("a", "x", "", None)], SCHEMA), path, buckets=7)
    with pytest.raises(Exception, match="already exists"):
        storage.commit(spark, f"{path}/versions", 1, {})


def test_a_term_counts_once_a_row(spark):
    cases = [(["a", "b"], ["b", "c", "b", "a1"]), ([], []), (["a"], []), ([], ["z", "a", "z"]), (["b", "b", "ab"], ["a", "b", "abc", "ab"])]
    df = spark.createDataFrame(cases, "t array<string>, c array<string>")
    for (t, c), r in zip(cases, df.coalesce(1).select(ai._frequencies(F.col("t"), F.col("c"), 3.0).alias("x")).collect(), strict=True):
        assert [(x.term, x.tf) for x in r.x] == [(w, 3.0 * t.count(w) + c.count(w)) for w in sorted({*t, *c})]
