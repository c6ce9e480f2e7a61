import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.operators import site_pages as sp

T = dt.datetime(2024, 8, 6, 10)
REPORTS = "report_id string, item_id string, checked_at timestamp, status_by_claim array<struct<k:string,v:string>>, evidence_ids_by_claim map<string,array<string>>"


@pytest.fixture(scope="module")
def models(spark):
    df = spark.createDataFrame
    reports = df([("r1", "i1", T, [("c2", "supported_by_evidence"), ("c1", "mixed_evidence"), ("gone", "supported_by_evidence")], {"c2": ["e3", "e1", "e1", "lost", "e2"], "c1": ["e4", "e5"]}), ("r2", "i2", None, None, None), ("r3", "nowhere", T, [("c3", "insufficient_evidence")], {})], REPORTS).withColumn("status_by_claim", F.map_from_entries("status_by_claim"))
    items = df([("i1", "T [x](javascript:1) <b>", "https://n.example/a", T - dt.timedelta(hours=5)), ("i2", "", "javascript:alert(1)", None)], "item_id string, title string, url string, published_at timestamp")
    claims = df([("c1", "event", "It\nhappened", "n"), ("c2", "release", "Product was released", "n"), ("c3", "event", "", "Said <script>x</script>")], "claim_id string, kind string, source_text string, normalized_claim string")
    cards = df([("e1", "s1", "supports", "original"), ("e2", "s1", "context", "original"), ("e3", "s2", "supports", "competent_record"), ("e4", "s1", "irrelevant", "original"), ("e5", "s9", "supports", "original")], "evidence_id string, snapshot_id string, stance string, source_class string")
    snapshots = df([("s1", "https://a.example/1"), ("s2", "https://b.example/(x")], "snapshot_id string, final_url string")
    return sp.page_models(reports, items, claims, cards, snapshots).cache()


def test_models(models):
    got = {r.report_id: r for r in models.collect()}
    one = got["r1"]
    assert (one.title, one.url, one.age_hours) == ("T [x](javascript:1) <b>", "https://n.example/a", 5.0)
    assert [(c.text, c.kind, c.status, c.public_status) for c in one.claims] == [("Product was released", "release", "supported_by_evidence", "official_release"), ("It\nhappened", "event", "mixed_evidence", "disputed")]
    assert [tuple(s) for s in one.claims[0].sources] == [("https://b.example/(x", "supports", "competent_record"), ("https://a.example/1", "supports", "original"), ("https://a.example/1", "context", "original")]
    assert one.claims[1].sources == [] and got["r2"].claims == [] and got["r2"].age_hours is None
    assert (got["r3"].title, got["r3"].claims[0].text, got["r3"].claims[0].public_status) == (None, "Said <script>x</script>", "insufficient")


def test_pages_are_inert(models):
    got = {r.report_id: r.markdown for r in sp.page_sections(models, statuses={"official_release": "Official", "disputed": "Disputed"}).collect()}
    assert got["r1"] == "### [T \\[x\\]\\(javascript:1\\) &lt;b&gt;](https://n.example/a)\n\n- **Official** Product was released\n  - b.example · supports\n  - [a.example](https://a.example/1) · supports\n  - [a.example](https://a.example/1) · context\n- **Disputed** It happened"
    assert got["r2"] == "### i2" and got["r3"].startswith("### nowhere\n\n- **insufficient** Said &lt;script&gt;")


def test_untrusted_html(spark):
    cases = {
        "plain & <b>bold</b> &amp; &lt;x&gt; &#39; &bogus": "plain &amp; <b>bold</b> &amp; &lt;x&gt; &#39; &amp;bogus",
        '<a href="https://x.org/?a=1&amp;b=2" onclick="evil()">x</a>': '<a href="https://x.org/?a=1&amp;b=2" rel="nofollow">x</a>',
        "<a onclick='1' HREF='javascript:alert(1)'>x</a>": "x",
        '<a title="href=https://ok.example" href="data:text/html,x">x</a>': "x",
        "<script>alert('<b>')</script>after<style>p{}</style>": "after",
        "<ScRiPt src=x>alert(1)": "",
        "<img src=x onerror=alert(1)>text": "text",
        "<!-- <b>no</b> -->yes": "yes",
        "<p onmouseover=\"x>y\">a<br/>b": "<p>a<br>b</p>",
        "<ul><li>1<li>2</ul>3</li>": "<ul><li>1<li>2</li></li></ul>3",
        "</b>stray <i>open <b>both</i> rest": "stray <i>open <b>both</b></i> rest",
        "a < b > c <3 <": "a &lt; b &gt; c &lt;3 &lt;",
        '<b "><img src=x onerror=1>': '&lt;b "&gt;',
        "<iframe src='https://x'></iframe><object>o</object>": "o",
        "<a href=\"https://x.org/\" href=\"javascript:1\">x</a>": '<a href="https://x.org/" rel="nofollow">x</a>',
        "": "",
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*cases, None])], "i int, t string")
    assert [r.v for r in df.orderBy("i").select(sp.sanitized_html(F.col("t")).alias("v")).collect()] == [*cases.values(), None]


def test_any_soup_comes_out_inert_and_balanced(spark):
    import random
    from html.parser import HTMLParser

    r = random.Random(3)
    bits = ["<", ">", "a", " href=", '"', "'", "https://x.org/", "javascript:1", "<a href=\"https://x.org/?q=1&r\">", "</a>", "<b>", "</b>", "<script>", "</script>", "<!--", "-->", "<ul>", "<li>", "</ul>", "&", "&lt;", "<img onerror=x>", "/", " ", "\n", "<p class='x>y'>", "<br>", "é", "<style>", "</style>", "</", "\\"]
    soup = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(soup)], "i int, t string")

    class Seen(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.bad = [], []

        def handle_starttag(self, tag, attrs):
            if tag not in sp.TAGS or {k for k, _ in attrs} - {"href", "rel"} or any(not v.startswith("https://x.org/") for k, v in attrs if k == "href"):
                self.bad.append((tag, attrs))
            if tag not in sp.VOID:
                self.open.append(tag)

        def handle_endtag(self, tag):
            if not self.open or self.open.pop() != tag:
                self.bad.append(tag)

        def handle_comment(self, data):
            self.bad.append(data)

    for row in df.select("i", sp.sanitized_html(F.col("t")).alias("v")).collect():
        seen = Seen()
        seen.feed(row.v)
        seen.close()
        assert not seen.bad and not seen.open, (soup[row.i], row.v)


def test_claims_and_sources_named_more_than_once(spark):
    df = spark.createDataFrame
    reports = df([("r1", "i1", T, [("c1", "supported_by_evidence"), ("c2", "mixed_evidence")], {"c1": ["e1", None, "e2", "e3", "e1", "e4"], "c2": None}), ("r2", None, T, [("c1", "insufficient_evidence"), ("gone", "mixed_evidence")], None), ("r3", "i1", T, [], {})], REPORTS).withColumn("status_by_claim", F.map_from_entries("status_by_claim"))
    items = df([("i1", "T", "https://n.example/", T)], "item_id string, title string, url string, published_at timestamp")
    claims = df([("c1", "event", "one", ""), ("c1", "event", "one", ""), ("c1", "opinion", None, "again"), ("c2", "quote", "two", ""), (None, "quote", "no one's", "")], "claim_id string, kind string, source_text string, normalized_claim string")
    cards = df([("e1", "s1", "supports", "z"), ("e1", "s1", "supports", "a"), ("e2", "s2", "context", "b"), ("e3", "s3", "supports", "c"), ("e4", "s4", "context", "d"), (None, "s1", "supports", "x"), ("e2", None, "supports", "y")], "evidence_id string, snapshot_id string, stance string, source_class string")
    snapshots = df([("s1", "https://a.example/"), ("s2", None), ("s3", "https://a.example/"), ("s4", ""), (None, "https://b.example/")], "snapshot_id string, final_url string")
    got = {r.report_id: r.claims for r in sp.page_models(reports, items, claims, cards, snapshots).collect()}
    sources = [("https://a.example/", "supports", "a"), (None, "context", "b"), ("", "context", "d")]
    assert [(c.text, c.kind, c.public_status, [tuple(s) for s in c.sources]) for c in got["r1"]] == [("again", "opinion", "anecdotal", sources), ("one", "event", "corroborated_event", sources), ("one", "event", "corroborated_event", sources), ("two", "quote", "disputed", [])]
    assert [(c.text, c.public_status, c.sources) for c in got["r2"]] == [("again", "insufficient", []), ("one", "insufficient", []), ("one", "insufficient", [])] and got["r3"] == []


def test_pages_deal_rows_out_by_claim_and_report_only(spark):
    from tidemill.plans import registry

    plan = registry.QUERIES["page_models"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6 and "hashpartitioning(evidence_id" not in plan and "hashpartitioning(snapshot_id" not in plan
