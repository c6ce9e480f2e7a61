import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.functions import urls
from tidemill.operators import dedup, select, stats
from tidemill.schema import ITEM

T0 = dt.datetime(2024, 8, 6, 12)


def items(spark, *rows):
    full = [{"id": f"i{k}", "source_type": "rss", "title": "t", "url": "https://a.b/c", "content": None, "author": None, "published_at": T0, "fetched_at": T0, "metadata": {}, "profile": None, "ord": k} | r for k, r in enumerate(rows)]
    return spark.createDataFrame(full, ITEM)


def keys(spark, *links):
    rows = spark.createDataFrame([(u,) for u in links], "url string")
    return [r[0] for r in rows.select(urls.merge_key(F.col("url"))).collect()]


def test_merge_key(spark):
    same = keys(spark, "https://Example.COM:443/Path/?utm_source=x&a=1&GCLID=2#f", "HTTPS://example.com/Path?a=1")
    assert same[0] == same[1]
    a, b, c, d, e = keys(spark, "http://a.b/", "https://a.b/", "https://a.b:8443/", "https://a.b/?source=1", "https://u:p@a.b/")
    assert len({a, b, c, d, e}) == 5
    assert keys(spark, "https://a.b/?x=1&y=2") != keys(spark, "https://a.b/?y=2&x=1")
    assert keys(spark, "https://a.b", "https://a.b/?%75tm_x=1&fbclid=z") == keys(spark, "https://a.b/", "https://a.b/")
    assert keys(spark, None) == [None]


def test_evidence_url_keeps_what_merging_drops(spark):
    rows = spark.createDataFrame([("https://u@Bücher.de.:443/a/?utm_x=1#f",), ("http://[::1]:8080",)], "url string")
    assert [r[0] for r in rows.select(urls.evidence_url(F.col("url"))).collect()] == ["https://xn--bcher-kva.de/a/?utm_x=1", "http://[::1]:8080/"]


def test_links(spark):
    rows = spark.createDataFrame([("https://a.b/x?y=1&z",), ("javascript:alert(1)",), ("https://a b/",), (None,), ("https://a.b/(x",)], "u string")
    got = rows.select(urls.html_link(F.col("u")), urls.is_markdown_link(F.col("u")), urls.without_secrets(F.lit("https://u:p@a.b/c?t=1#f")), urls.video_id(F.lit("https://youtu.be/abcdefghijk"))).collect()
    assert [r[0] for r in got] == ["https://a.b/x?y=1&amp;z", "", "https://a%20b/", "", "https://a.b/%28x"]
    assert [bool(r[1]) for r in got] == [True, False, False, False, False]
    assert got[0][2] == "https://a.b/c" and got[0][3] == "abcdefghijk"


@pytest.mark.parametrize(("url", "ips", "ok"), [("https://a.b/", ["93.184.216.34"], True), ("https://a.b/", ["93.184.216.34", "10.0.0.1"], False), ("https://a.b/", [], False), ("https://u@a.b/", ["93.184.216.34"], False), ("http://localhost/", ["127.0.0.1"], False), ("https://a.b:8080/", ["93.184.216.34"], False), ("ftp://a.b/", ["93.184.216.34"], False)])
def test_only_public_addresses_are_fetched(spark, url, ips, ok):
    row = spark.createDataFrame([(url, ips)], "u string, a array<string>")
    assert row.select(urls.is_fetchable(F.col("u"), F.col("a"))).first()[0] is ok


def test_merge_folds_contents_and_fills_metadata(spark):
    rows = items(spark, {"content": "short", "metadata": {"score": "0", "x": "1"}, "source_type": "rss"}, {"content": "the longest content", "metadata": {"score": "5"}, "source_type": "hackernews", "url": "https://a.b/c/?utm_source=q"}, {"content": "longest", "source_type": "reddit", "metadata": {"y": '"z"'}}, {"url": "https://other.org/"}, {"content": None, "profile": ["p"]})
    got = {r.id: r for r in dedup.merged_across_sources(rows).collect()}
    m = got["i1"]
    assert m.ord == 0 and m.members == ["i0", "i1", "i2"] and m.merged_sources == ["rss", "hackernews", "reddit"]
    assert m.content == "the longest content\n\n--- From rss ---\nshort"
    assert m.metadata == {"score": "5", "x": "1", "y": '"z"'}
    assert got["i3"].merged_sources is None and got["i4"].members == ["i4"]
    again = dedup.merged_across_sources(dedup.merged_across_sources(rows).drop("merged_sources", "members")).collect()
    assert {r.id: r.content for r in again} == {k: v.content for k, v in got.items()}


def test_list_routes_are_ordered(spark):
    rows = items(spark, {"profile": ["a", "b"]}, {"profile": ["b", "a"]}, {"profile": ["a ", " b"]}, {"profile": [""]}, {})
    assert sorted(len(r.members) for r in dedup.merged_across_sources(rows).collect()) == [1, 2, 2]


def test_topics(spark):
    rows = spark.createDataFrame([(0, "a", "A", "rss"), (1, "b", "B", "hn"), (2, "c", None, "x"), (3, "d", "A", "y")], "pos int, id string, content string, source_type string")
    groups = spark.createDataFrame([(0, [0, 1, 3, 9, 0]), (1, [9, 2]), (2, [2, 1])], "group_id int, members array<int>")
    got = {r.id: r for r in dedup.merged_topics(rows, groups).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"].content == "A\n\n--- From hn ---\nB" and got["a"].lineage == ["a", "b", "d"]
    assert got["c"].content == "\n\n--- From hn ---\nB" and got["c"].lineage == ["c", "b"]


def scored(spark, *rows):
    return spark.createDataFrame([(k, *r, True) for k, r in enumerate(rows)], "ord int, profile_id string, score double, category string, tags array<string>, analysed boolean")


def test_thresholds_and_inferred_categories(spark):
    settings = {"p": select.ProfileSettings(7.0, {"llm": 5.0, "ai-tools": 6.0, "open": 1.0}), "free": select.ProfileSettings(None)}
    rows = scored(spark, ("p", 6.0, None, ["#Large-Language-Models"]), ("p", 6.0, None, ["cats"]), ("p", None, "llm", []), ("p", 6.5, None, ["vibe_coding"]), ("p", 5.5, "open", ["llm"]), ("free", None, None, None), ("unknown", 1.0, None, None), ("p", 5.0, None, ["email"]))
    got = select.passes(rows, settings).orderBy("ord").collect()
    assert [r.passed for r in got] == [True, False, False, True, True, True, True, True]
    assert [r.category for r in got] == ["llm", None, "llm", "ai-tools", "open", None, None, "llm"]
    over = select.passes(rows, settings, override=6.4).orderBy("ord").collect()
    assert [r.passed for r in over] == [False, False, False, True, False, False, False, False] and over[0].category is None


def digest(spark):
    rows = [("ai-high", 9.0, "ai"), ("ai-mid", 8.0, "ai"), ("ai-low", 7.0, "ai"), ("finance-high", 8.5, "finance"), ("finance-low", 6.0, "finance"), ("other-high", 9.5, "x"), ("other-low", None, None)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord int, id string, score double, category string")


def test_balanced_digest(spark):
    groups = {"ai": select.Group(("ai",), 2), "finance": select.Group(("finance", "ai"), 1)}
    got = select.balanced(digest(spark), groups, default_limit=1)
    assert [r.id for r in got.collect()] == ["other-high", "ai-high", "finance-high", "ai-mid"]
    assert {r.group: r["count"] for r in select.quota_counts(got, groups, default_limit=1).collect()} == {"ai": 2, "finance": 1, "other": 1}
    assert select.duplicate_categories(groups) == ["ai"]
    assert [r.id for r in select.balanced(digest(spark), groups, default_limit=1, max_items=2).collect()] == ["other-high", "ai-high"]
    assert [r.id for r in select.balanced(digest(spark), {}, max_items=3).collect()] == ["other-high", "ai-high", "finance-high"]
    assert [r.ord for r in select.balanced(digest(spark), {}).collect()] == list(range(7))


def test_balanced_plan_limits_before_the_shuffle(spark):
    plan = select.balanced(digest(spark), {"ai": select.Group(("ai",), 2)}, max_items=3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


def test_windows_and_limits(spark):
    rows = spark.createDataFrame([(1, T0), (2, T0 - dt.timedelta(hours=24)), (3, T0 - dt.timedelta(hours=25)), (4, None)], "ord int, published_at timestamp")
    assert [r.ord for r in select.since(rows, T0, 24).collect()] == [1, 2]
    assert [r.ord for r in select.since(rows, T0, 24, strict=True).collect()] == [1]
    assert sorted(r.ord for r in select.tail(rows, 2).collect()) == [3, 4]
    sized = spark.createDataFrame([(1, 5, 3), (2, 9, 2), (3, 1, 1)], "ord int, size int, mtime int")
    assert {r.ord: r.kept for r in select.running_total_within(sized, "size", 4, "mtime").collect()} == {1: True, 2: False, 3: False}


def test_reports(spark):
    schema = "source string, status string, item_count long, error string"
    assert stats.fetch_report(spark.createDataFrame([], schema)).first().status == "not_attempted"
    r = stats.fetch_report(spark.createDataFrame([("a", "failure", 0, "x"), ("b", "empty", 0, None), ("c", "success", 3, None)], schema)).first()
    assert (r.status, r.attempted, r.successful, r.empty, r.failed, r.item_count, r.all_failed) == ("partial_failure", 3, 2, 1, 1, 3, False)
    assert stats.fetch_report(spark.createDataFrame([("a", "failure", 0, "x")], schema)).first().all_failed
    h = {r.bucket: r["count"] for r in stats.score_histogram(spark.createDataFrame([(2.9,), (3.0,), (9.0,), (None,)], "score double")).collect()}
    assert h == {"0-2": 1, "3-4": 1, "5-6": 0, "7-8": 0, "9-10": 1, "unscored": 1}


def test_recall(spark):
    rows = spark.createDataFrame([("a", "раз два два всё", "два все раз"), ("b", "", "x"), ("c", "one two", "")], "id string, s string, h string")
    assert {r.id: r.recall for r in stats.word_recall(rows, "id", "s", "h").collect()} == {"a": 0.75, "b": 1.0, "c": 0.0}
    tail = spark.createDataFrame([("a b a b x y", "x y"), ("", "q"), ("a a", "b")], "s string, h string")
    assert [r[0] for r in tail.select(stats.tail_recall(F.col("s"), F.col("h"))).collect()] == [1.0, 1.0, 0.0]
    seg = spark.createDataFrame([([(0.0, 1.0, "hello"), (1.0, 9.0, "uh"), (9.0, 9.0, "none"), (9.0, 30.0, "hm")],)], "s array<struct<start:double,end:double,text:string>>")
    assert seg.select(stats.speech_end(F.col("s"))).first()[0] == 9.0  # a segment without length is counted as a hundredth


def test_labels(spark):
    rows = spark.createDataFrame([({"subreddit": "x"}, "a"), ({"period": "p", "repo": "r"}, "a"), ({"repo": "r"}, "a"), ({"feed_name": ""}, "a"), ({}, None), ({"gn_query": "q"}, "")], "m map<string,string>, author string")
    assert [r[0] for r in rows.select(stats.label_of(F.col("m"), F.col("author"))).collect()] == ["r/x", "ossinsight:all", "r", "a", "unknown", "google_news:q"]


def test_lineage(spark):
    t = spark.createDataFrame
    got = dedup.two_hop_lineage(t([("a", 0), ("z", 1)], "id string, ord int"), t([("a", ["a", "b"])], "id string, members array<string>"), t([("b", ["c", "d", "c"])], "id string, members array<string>"), t([("a", "sa"), ("c", "sc"), ("d", "sd")], "item_id string, snapshot_id string")).orderBy("ord").collect()
    assert [(r.id, r.snapshot_ids, r.missing) for r in got] == [("a", ["sa", "sc", "sd"], 0), ("z", [], 1)]


def test_running_totals_over_ranges(spark):
    import itertools
    import random

    r = random.Random(2)
    data = [(i, r.choice([None, *range(1, 40)]), r.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "ord int, size int, mtime int").repartition(7)
    ordered = sorted(data, key=lambda x: (-x[2], x[0]))
    totals = itertools.accumulate(x[1] or 0 for x in ordered)
    want = {x[0]: k == 0 or total <= 900 for k, (x, total) in enumerate(zip(ordered, totals, strict=True))}
    assert {x.ord: x.kept for x in select.running_total_within(df, "size", 900, "mtime").collect()} == want
    assert select.running_total_within(df.where("false"), "size", 900, "mtime").collect() == []
