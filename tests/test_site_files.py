import json

import pytest

from tidemill.functions import narration
from tidemill.sources import sinks
from tidemill.streaming import ledger

PAGES = "issue string, slug string, title string, markdown string"


def test_site_pages(spark, tmp_path):
    rows = [("2024-08-06-en", "tech-1", 'A "quoted" title\n', "# One"), ("2024-08-06-en", "index", None, "list"), ("2024-08-07-en", "news-1", "", None)]
    sinks.write_site_pages(spark.createDataFrame(rows, PAGES).repartition(3), str(tmp_path))
    read = lambda p: (tmp_path / p).read_text()
    assert read("2024-08-06-en/tech-1.md") == '---\ntitle: "A \\"quoted\\" title\\n"\nsearch:\n  exclude: true\n---\n\n# One'
    assert read("2024-08-07-en/news-1.md") == "---\nsearch:\n  exclude: true\n---\n\n"
    assert [x for x in read("index.md").split("\n") if x.startswith("<li>")] == ['<li><a href="2024-08-07-en/"><span>2024-08-07</span><span>1</span></a></li>', '<li><a href="2024-08-06-en/"><span>2024-08-06</span><span>1</span></a></li>']
    sinks.write_site_pages(spark.createDataFrame([("2024-08-06-en", "tech-1", "T", "again")], PAGES), f"file://{tmp_path}")
    assert read("2024-08-06-en/tech-1.md").endswith("again") and sorted(p.name for p in (tmp_path / "2024-08-06-en").iterdir()) == ["index.md", "tech-1.md"]
    for bad in (("../x", "a", "", ""), ("x", "../../a", "", ""), ("x", ".hidden", "", ""), ("x", None, "", ""), ("x", "a/b", "", "")):
        with pytest.raises(ValueError, match="not a page's name"):
            sinks.write_site_pages(spark.createDataFrame([bad], PAGES), str(tmp_path))


def test_snapshots_of_what_readers_see(spark):
    blocks = [("B1", "one"), ("B2", "two")]
    df = spark.createDataFrame([("i1", "raw", None, {"ru": ("Р", blocks), "en": ("E", [])}), ("i2", "raw", "c", {}), ("i3", None, "c", None)], "id string, title string, content string, artifacts map<string,struct<title:string,blocks:array<struct<title:string,content:string>>>>")
    got = [tuple(r) for r in df.orderBy("id").select(ledger.fetched_payload("title", "id", "content").alias("f"), ledger.selected_payload("title", "id", "content", languages=("ru", "en")).alias("s")).collect()]
    assert got[0][0] == '{"content":null,"id":"i1","title":"raw"}'
    assert json.loads(got[0][1]) == {"content": "B1\none\n\nB2\ntwo", "id": "i1", "title": "Р", "verification_language": "ru"}
    assert got[1][0] == got[1][1] == '{"content":"c","id":"i2","title":"raw"}' and got[2][1] == '{"content":"c","id":"i3","title":null}'


def test_readings(spark):
    text = "The Kubernetes release, C++ and a.b (x\\Ey) \\E here; kube"
    rows = [(0, "Kubernetes", " кубернетис "), (1, "KUBERNETES", "второй"), (2, "kuber", "кубер"), (3, "C++", "си плюс плюс"), (4, "a.b", "а бэ"), (5, "aXb", "а"), (6, "release", "release"), (7, "here", "<b>тут</b>"), (8, "", "а"), (9, "kube", None), (10, "x\\Ey", "икс"), (11, "the", "т" * 161), (12, "и", "и"), (13, "and", "энд\nи")]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, 0, "kube", "кьюб")], "doc_id int, ord int, written string, spoken string")
    sources = spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc_id int, text string")
    got = [(r.written, r.spoken) for r in narration.accepted_readings(df, sources).orderBy("ord").collect()]
    assert got == [("Kubernetes", "кубернетис"), ("C++", "си плюс плюс"), ("a.b", "а бэ"), ("x\\Ey", "икс")]
    assert narration.accepted_readings(df, sources, limit=2).count() == 2


def test_readings_of_names_at_edges(spark):
    text = "Kube (kube) kubeX é-Ünit ünit ﬁne Fine a\\nb C++C tail"
    rows = [(0, "x", "икс"), (1, "kube", "кьюб"), (2, "KUBE", "куб"), (3, "Ünit", "юнит"), (4, "ÜNIT", "юнит"), (5, "ﬁne", "файн"), (6, "FINE", "файн два"), (7, "C++", "си"), (8, "tail", "тейл"), (9, "x" * 101, "икс"), (10, "a<b", "а"), (11, "42", "сорок"), (12, "a", "т" * 160), (13, None, "а")]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(4, 0, "one", "один")], "doc_id int, ord int, written string, spoken string")
    sources = spark.createDataFrame([(1, text), (2, None), (3, "x"), (4, "one")], "doc_id int, text string")
    got = [(r.doc_id, r.ord) for r in narration.accepted_readings(df, sources).orderBy("doc_id", "ord").collect()]
    assert got == [(1, 1), (1, 3), (1, 5), (1, 8), (1, 12), (4, 0)]


def test_readings_are_dealt_out_by_text_once(spark):
    from tidemill.plans import registry

    most = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(most)
    spark.conf.set(most, "-1")  # as with texts that are too large to be broadcast
    try:
        plan = registry.QUERIES["accepted_readings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(most, before)
    assert plan.count("Exchange hashpartitioning") == 2


def test_republished_issues(spark):
    from tests.test_texts import rows_for_issue
    from tidemill.operators import render, stats
    from tidemill.sources import archive

    issues = render.issue(rows_for_issue(spark), "2024-08-06", 10)
    pages = {r.slug: r for r in archive.republished(issues, "https://site/").collect()}
    assert set(pages) == {"tech-1", "tech-2", "news-1", "index"} and {r.issue for r in pages.values()} == {"2024-08-06-en"}
    one = pages["tech-1"]
    assert one.title == "Made <title>" and one.markdown.startswith('<a id="item-tech-1"></a>\n# [Made &lt;title&gt;](https://a.b/1) ⭐️ 9.0/10\n\nlead') and not one.markdown.rstrip().endswith("---")
    assert pages["index"].markdown == "# 2024-08-06\n\n- [Made &lt;title&gt;](https://site/2024-08-06-en/tech-1/) ⭐️ 9.0/10\n- [third](https://site/2024-08-06-en/tech-2/) ⭐️ 7.0/10\n" + pages["index"].markdown.split("\n", 4)[4]
    assert archive.republished(spark.createDataFrame([("d", "en", "nothing")], "date string, language string, markdown string"), "x").collect() == []
    texts = spark.createDataFrame([("Kubernetes и kube-proxy 1.2 v1.36, Kubernetes",), (None,), ("кириллица 42",)], "text string")
    assert sorted(map(tuple, stats.latin_names(texts).collect())) == [("Kubernetes", 2), ("kube-proxy", 1), ("v1.36", 1)]
    assert sorted(map(tuple, stats.latin_names(texts, lexicon={"kubernetes": "кубернетис"}).collect())) == [("kube-proxy", 1), ("v1.36", 1)]


def test_links_and_documents(spark):
    from pyspark.sql import functions as F

    from tidemill.functions import urls
    from tidemill.sources import pages

    cases = {
        "https://a.b/c?x=1&y='2'": "https://a.b/c?x=1&amp;y=&#x27;2&#x27;", " https://a.b/é 日(1)\"<x>|`\\😀 ": "https://a.b/%C3%A9%20%E6%97%A5%281%29%22%3Cx%3E%7C%60%5C%F0%9F%98%80", "HTTPS://U@A.b:8080/%41": "HTTPS://U@A.b:8080/%41",
        "http://a.b:x/": "", "http://a:70000/": "", "javascript:1": "", "https:///x": "", "https://a.b/\nc": "", "mailto:a@b": "", "": "", "//a.b/": "", "https://[::1]:80/x": "https://[::1]:80/x",
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*cases, None])], "i int, u string")
    assert [r.v for r in df.orderBy("i").select(urls.html_link(F.col("u")).alias("v")).collect()] == [*cases.values(), ""]
    docs = [("﻿ a \t b\r\n\r\nc", "text/plain", "a b\nc"), ('﻿{"b": [1, "é"], "a": null}', "application/json", '{\n"a": null,\n"b": [\n1,\n"é"\n]\n}'), ("{not  json", "application/json", "{not json"), ("  \n", "text/plain", None), (None, "text/plain", None), ("<html><head><script>x()</script></head><body><p>One &amp; two</p><p>three</p></body></html>", "text/html", None)]
    got = [r.v for r in spark.createDataFrame([(i, *d[:2]) for i, d in enumerate(docs)], "i int, t string, m string").orderBy("i").select(pages.document_text(F.col("t"), F.col("m")).alias("v")).collect()]
    assert got[:5] == [d[2] for d in docs[:5]] and "One & two" in got[5] and "x()" not in got[5]


def test_feeds_that_stand_in(spark):
    import datetime as dt

    from tidemill.sources import feeds

    entry = lambda i, day: f"<entry><id>t3_{i}</id><title>T{i}</title><link href='https://r/{i}'/><updated>2024-08-{day:02}T10:00:00+00:00</updated><author><name>/u/me</name></author><summary>&lt;p&gt;said &amp;amp; done&lt;/p&gt;</summary></entry>"
    body = "<feed xmlns='http://www.w3.org/2005/Atom'>" + entry(1, 1) + entry(2, 6) + entry(3, 6) + entry(4, 6) + "</feed>"
    raw = spark.createDataFrame([(0, "llm", body), (1, "x", "not xml")], "ord int, subreddit string, body string")
    got = [(r.id, r.title, r.url, r.content, r.author, r.metadata["fallback"]) for r in feeds.reddit_feed(raw, dt.datetime(2024, 8, 5), 3).orderBy("ord").collect()]
    assert got == [(f"reddit:subreddit-rss:t3_{i}", f"T{i}", f"https://r/{i}", "said & done", "/u/me", "rss") for i in (2, 3)]
    ask = lambda **k: feeds.gdelt_request(" llm ", dt.datetime(2024, 8, 5), dt.datetime(2024, 8, 6, 1, 2, 3), **k)
    assert ask(language="english", country="US", timespan="1d") == {"query": "llm sourcelang:english sourcecountry:US", "mode": "artlist", "format": "json", "maxrecords": "75", "sort": "datedesc", "timespan": "1d"}
    assert ask()["startdatetime"] == "20240805000000" and ask()["enddatetime"] == "20240806010203" and feeds.gdelt_request(" ", dt.datetime.min, dt.datetime.max) is None
