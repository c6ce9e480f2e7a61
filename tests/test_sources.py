import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemill.sources import archive, common, feeds, pages, sinks, video

SINCE = dt.datetime(2024, 8, 5)
NOW = dt.datetime(2024, 8, 6, 12)


def test_github(spark):
    event = lambda i, kind, payload, at="2024-08-06T00:00:00Z": {"id": str(i), "type": kind, "created_at": at, "repo": {"name": "o/r"}, "payload": payload}
    body = json.dumps([event(1, "PushEvent", {"commits": [{"message": m} for m in "abcd"]}), event(2, "ReleaseEvent", {"release": {"tag_name": "v1", "body": "notes", "html_url": "https://h/r"}}), event(3, "ForkEvent", {}), event(4, "WatchEvent", {}, "2024-08-01T00:00:00Z"), event(5, "CreateEvent", {"description": "d"}), event(6, "PublicEvent", {})])
    got = feeds.github_events(spark.createDataFrame([(0, "me", body)], "ord long, username string, body string"), SINCE).orderBy("ord").collect()
    assert [r.title for r in got] == ["me pushed 4 commit(s) to o/r", "me released v1 in o/r", "me created repository in o/r", "me made o/r public"]
    assert got[0].content == "a\nb\nc" and got[1].url == "https://h/r" and got[0].id == "github:event:1" and got[0].metadata["repo"] == "o/r"
    rel = json.dumps([{"id": 7, "tag_name": "v2", "html_url": "https://h", "body": None, "published_at": "2024-08-06T01:00:00Z", "prerelease": True, "author": {"login": "x"}}])
    r = feeds.github_releases(spark.createDataFrame([(0, "o", "r", rel)], "ord long, owner string, repo string, body string"), SINCE).first()
    assert (r.title, r.author, r.metadata["prerelease"]) == ("o/r released v2", "x", "true")


def test_hacker_news(spark):
    t = int(dt.datetime(2024, 8, 6, tzinfo=dt.timezone.utc).timestamp())
    stories = spark.createDataFrame([(0, 1, "T", None, "by", t, 100, 3, "story", "text", [11, 12, 13]), (1, 2, "low", None, None, t, 99, 0, None, None, None), (2, 3, "old", None, None, t - 10**6, 500, 0, None, None, None), (3, 4, "bare", "https://u", None, t, 300, None, None, None, None)], "ord long, id long, title string, url string, by string, time long, score long, descendants long, type string, text string, kids array<bigint>")
    comments = spark.createDataFrame([(12, None, "<p>" + "x" * 600 + "</p>", None, None), (11, "a", "hi <i>you</i>", False, False), (13, "z", "gone", True, None)], "id long, by string, text string, deleted boolean, dead boolean")
    got = {r.id: r for r in feeds.hacker_news(stories, comments, SINCE).collect()}
    assert set(got) == {"hackernews:story:1", "hackernews:story:4"}
    one = got["hackernews:story:1"]
    assert one.content.startswith("text\n\n\n--- Top Comments ---\n\n[a]: hi  you") and one.content.endswith("x" * 497 + "...") and "[anon]: " in one.content
    assert one.url == "https://news.ycombinator.com/item?id=1" and one.metadata["comment_count"] == "2"
    assert got["hackernews:story:4"].content == ""


def test_reddit(spark):
    html = '<div class="thing link self" data-fullname="t3_a1" data-subreddit="s" data-author="me" data-score="1,234" data-timestamp="1722902400000" data-permalink="/r/s/comments/a1/"><a class="title" href="x">A  title</a><a class="comments">1,002 comments</a><div class="md"><p>self text</p></div><span class="linkflairlabel">F</span></div><div class="thing link" data-fullname="t3_b2" data-subreddit="s" data-url="https://ext/" data-score="x"><a class="title">B</a><time datetime="2024-08-06T00:00:00+00:00"></time></div><div class="thing comment" data-fullname="t1_x"></div>'
    posts = pages.listing(spark.createDataFrame([(0, html)], "ord long, body string"), 10)
    comments = spark.createDataFrame([("a1", 0, "u", "low", 1, None), ("a1", 1, "v", "best", 9, None), ("a1", 2, "m", "rules", 99, "moderator"), ("a1", 3, "w", "tie", 9, None), ("a1", 4, "d", "[deleted]", 50, None)], "post_id string, ord long, author string, body string, score long, distinguished string")
    got = {r.id: r for r in feeds.reddit(posts, comments, SINCE, k=2).collect()}
    one = got["reddit:subreddit:a1"]
    assert one.url == "https://www.reddit.com/r/s/comments/a1/" and one.metadata["score"] == "1234" and one.metadata["num_comments"] == "1002" and one.metadata["flair"] == "F"
    assert one.content == "self text\n\n\n--- Top Comments ---\n\n[v (9 pts)]: best\n\n[w (9 pts)]: tie"
    assert got["reddit:subreddit:b2"].url == "https://ext/" and got["reddit:subreddit:b2"].published_at == dt.datetime(2024, 8, 6)
    ladder = feeds.first_that_has([spark.createDataFrame([("x", 1)], "sub string, v int"), spark.createDataFrame([("x", 2), ("y", 2)], "sub string, v int")], "sub")
    assert sorted(tuple(r) for r in ladder.collect()) == [("x", 1), ("y", 2)]


def test_rss_and_google_news(spark):
    body = """<rss><channel><item><title>T &amp; t</title><link>https://a.b/1</link><guid>g1</guid><pubDate>Tue, 06 Aug 2024 10:00:00 +0000</pubDate><description>sum</description><category>x</category><source url="q">Pub</source></item><item><title>old</title><link>https://a.b/2</link><pubDate>Tue, 06 Aug 2019 10:00:00 +0000</pubDate></item><item><title>no date</title></item></channel></rss>"""
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e</id><title>A</title><link href="https://c.d/"/><updated>2024-08-06T09:00:00Z</updated><author><name>N</name></author><content>body</content></entry></feed>'
    raw = spark.createDataFrame([(0, "https://f.x/rss", "Feed", body), (1, "https://f.y/atom", "Atom", atom), (2, "https://f.z/", "Bad", "not xml"), (3, "https://f.w/", "Null", None)], "ord long, feed_url string, name string, body string")
    got = feeds.rss(raw, SINCE).orderBy("ord").collect()
    assert [(r.title, r.author, r.content) for r in got] == [("T & t", "Feed", "sum"), ("A", "N", "body")]
    assert got[0].id.startswith("rss:f.x_rss:") and len(got[0].id.split(":")[-1]) == 16 and got[0].metadata["tags"] == '["x"]'
    news = feeds.google_news(raw.select("ord", "body"), SINCE, limit=1, query="q").collect()
    assert [(r.author, r.metadata["source_name"]) for r in news] == [("Pub", "Pub")]
    full = feeds.with_full_text(feeds.rss(raw, SINCE), spark.createDataFrame([(got[0].id, "whole"), (got[1].id, "")], "id string, full_text string"))
    assert sorted(r.content for r in full.collect()) == ["body", "whole"]


def test_tweets(spark):
    tweet = {"id": "tweet-9", "created_at": "Tue Aug 06 10:00:00 +0000 2024", "full_text": "a &amp; b\n" + "x" * 60, "user": {"handle": "h", "name": "N"}, "permalink": "/h/9"}
    other = {"id_str": "5", "created_at": "2024-08-06T10:00:00Z", "text": "short", "user": {"screen_name": "s"}}
    got = feeds.tweets(spark.createDataFrame([(0, json.dumps(tweet)), (1, json.dumps(other)), (2, "{}"), (3, "bad")], "ord long, body string"), SINCE).orderBy("ord").collect()
    assert [r.id for r in got] == ["twitter:tweet:9", "twitter:tweet:5"]
    assert got[0].title == "@h: a & b " + "x" * 44 + "..." and got[0].author == "N" and got[1].url == "https://twitter.com/s/status/5"
    replies = spark.createDataFrame([("9", "@H", i, *r) for i, r in enumerate([("tweet-9", "x", "self", 5, 0), ("1", "h", "own", 5, 0), ("2", "a", "low", 1, 9), ("3", "b", "top", 9, 0), ("4", None, " ", 9, 9)])], "tweet_id string, own_author string, ord int, id string, handle string, text string, likes long, replies long")
    lines = feeds.reply_lines(replies, 2).first().lines
    assert lines == ["[@b | ❤️ 9 | 💬 0] top", "[@a | ❤️ 1 | 💬 9] low"]
    add = lambda c: spark.createDataFrame([(c, ["x", "y"])], "c string, l array<string>").select(feeds.with_discussion(F.col("c"), F.col("l"))).first()[0]
    once = add("body")
    assert once == "body\n\n--- Top Comments ---\nx\ny" and add(once) == once and add(None) == "--- Top Comments ---\nx\ny"
    nested = json.dumps({"a": [{"rest_id": 1, "legacy": {"full_text": "t", "favorite_count": 3}}, {"b": {"rest_id": 2, "legacy": {}}}]})
    assert [x["id"] for x in spark.createDataFrame([(nested,)], "b string").select(pages.nested_tweets("b")).first()[0]] == ["1", "2"]


def test_openbb_insight_gdelt(spark):
    rec = lambda **k: json.dumps({"title": "T", "url": "https://u", "date": "2024-08-06T00:00:00Z"} | k)
    raw = spark.createDataFrame([(0, "w1", ["Z"], rec(symbols=["a ", "A", "b"])), (1, "w2", ["Z"], rec()), (2, "w2", ["Z"], rec(url="https://v", date="2024-08-05T00:00:00Z")), (3, "w2", ["Z"], rec(url="https://x", symbols="q,r", body="B"))], "ord long, watchlist string, watch_symbols array<string>, body string")
    got = feeds.openbb(raw, SINCE).orderBy("ord").collect()
    assert [(r.url, r.metadata["symbols"], r.author) for r in got] == [("https://u", '["A","B"]', "A"), ("https://x", '["Q","R"]', "Q")]
    row = lambda **k: json.dumps({"repo_id": "1", "repo_name": "o/r", "stars": "5", "description": "An LLM tool"} | k)
    trend = spark.createDataFrame([(0, "Go", row(stars="1")), (1, "C", row(stars="9")), (2, "C", row(repo_id="2", repo_name="p/q", stars="7", description="x"))], "ord long, language string, body string")
    assert [(r.author, r.metadata["stars_gained"]) for r in feeds.oss_insight(trend, NOW, min_stars=2).collect()] == [("o", "9"), ("p", "7")]
    assert [r.id for r in feeds.oss_insight(trend, NOW, keywords=("llm",)).collect()] == ["ossinsight:trending:1"]
    art = json.dumps({"articles": [{"url": "https://u", "title": "T", "seendate": "20240806T100000Z", "domain": "d"}, {"url": "", "title": "x"}, {"url": "https://v", "title": "y", "seendate": "bad"}]})
    r = feeds.gdelt(spark.createDataFrame([(0, art)], "ord long, body string")).collect()
    assert [x.id for x in r] == ["gdelt:article:20240806T100000Z::https://u"] and r[0].metadata == {"domain": "d"}


def test_telegram_and_forum(spark):
    msg = lambda i, text, at="2024-08-06T01:00:00+00:00": f'<div class="tgme_widget_message" data-post="ch/{i}"><div class="tgme_widget_message_text js-message_text">{text}</div><time datetime="{at}"></time></div>'
    html = msg(1, "first") + msg(2, 'one<br>two <a href="https://t.me/x">t</a><a href="https://out.side/">o</a>') + msg(3, "") + msg(4, "old", "2024-01-01T00:00:00+00:00")
    got = pages.telegram(spark.createDataFrame([(0, "ch", html)], "ord long, channel string, body string"), SINCE, 3).collect()
    assert [(r.id, r.url, r.title) for r in got] == [("telegram:ch:2", "https://out.side/", "one two to")]
    post = lambda i, text, at="Сегодня, 10:05": f'<div data-post="{i}"><span class="post_date">{at}</span><span class="post_nick"><a>Ник</a></span><div class="post_body"><div class="quote_body">q</div>{text}</div></div>'
    body = ("<html>" + post(1, "достаточно длинный текст") + post(1, "повтор достаточно длинный") + post(2, "коротко") + post(3, "без даты, но длинный текст", "") + "</html>").encode("windows-1251")
    got = pages.forum(spark.createDataFrame([(0, "77", bytearray(body))], "ord long, topic_id string, body binary"), SINCE, NOW, 5).orderBy("ord").collect()
    assert [(r.id, r.author, r.content) for r in got] == [("fourpda:topic:77:1", "Ник", "достаточно длинный текст"), ("fourpda:topic:77:3", "Ник", "без даты, но длинный текст")]
    assert got[0].published_at == dt.datetime(2024, 8, 6, 7, 5) and got[1].published_at == NOW


def test_video(spark):
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\n<c>hello</c>\n\n1\n00:00:02.500 --> 00:00:04.000 align:start\nhello\nworld\n\n01:00:00.000 --> 01:00:01.000\n \n"
    one = lambda c: spark.range(1).select(c).first()[0]
    seg = one(video.vtt_segments(F.lit(vtt)))
    assert [(s.start, s.end, s.text) for s in seg] == [(1.0, 2.5, "hello"), (2.5, 4.0, "hello world")]
    assert one(video.transcript(F.lit(vtt))) == "[00:01] hello world"
    assert one(video.coverage(F.lit("[00:10] a\n[61:05] b"), F.lit(7330))) == 0.5 and one(video.coverage(F.lit("none"), F.lit(10))) is None
    assert one(video.skip_reason(F.lit("is_live"), F.lit(5), 60)) == "live_status=is_live" and one(video.skip_reason(F.lit(None).cast("string"), F.lit(5), 60)).startswith("duration 5s") and one(video.skip_reason(F.lit(None).cast("string"), F.lit(None).cast("int"), 60)) is None
    assert one(video.is_bot_gate(F.lit("Sign in to confirm you're")))
    assert one(video.best_text(subtitles=F.lit(" "), asr=F.lit("x"), description=F.lit("d"))).content_source == "asr"


def test_inbox(spark, tmp_path):
    items = spark.createDataFrame([("v1", "T", "https://y/1", "c", "a", NOW, {"k": "v"})], "id string, title string, url string, content string, author string, published_at timestamp, metadata map<string,string>")
    video.write_inbox(items, str(tmp_path / "in"), NOW)
    (tmp_path / "in" / "bad.json").write_text("{broken")
    (tmp_path / "in" / "foreign.json").write_text(json.dumps({"version": 9, "generated_at": "2024-08-06T00:00:00Z", "items": [{"id": "x"}]}))
    env = video.read_inbox(spark, str(tmp_path / "in" / "*.json"))
    got = video.inbox_items(env, SINCE).collect()
    assert [(r.id, r.metadata) for r in got] == [("v1", {"k": "v"})]
    assert video.stale(env, NOW + dt.timedelta(hours=30), 24).count() == 3


def test_archive(spark, tmp_path):
    md = '# D\n\n<a id="item-tech-1"></a>\n### [Title \\*x\\*](https://u) ⭐️ 9.0/10\n\nLead text\n\nrss · me\n\n**「Why」** because\n\n**Tags**: `#a`, `#b`\n\n---\n\n<a id="item-tech-2"></a>\nbroken\n\n<a id="item-blog-1"></a>\n### Plain ⭐️ ?/10\n\nBody'
    got = archive.issue_articles(spark.createDataFrame([("2024-08-06", "en", md)], "date string, language string, markdown string"), "https://s").collect()
    assert [(r.id, r.source_url, r.score) for r in got] == [("2024-08-06-en-tech-1", "https://u", "9.0"), ("2024-08-06-en-blog-1", None, "?")]
    assert got[0].block_titles == ["Why"] and got[0].tags == ["a", "b"] and got[0].url == "https://s/2024-08-06-en/tech-1/"
    (tmp_path / "p.json").write_text(json.dumps({"domains": [{"id": "Ai_Tools", "name": "N", "keywords": ["llm"], "sources": [{"type": "rss", "description": "d", "tags": ["t"], "config": {"url": "https://X/"}}, {"type": "reddit", "config": {"subreddit": "S"}}]}]}))
    presets = archive.presets(spark, str(tmp_path / "p.json"))
    assert [(r.domain, r.type) for r in presets.orderBy("pos").collect()] == [("ai-tools", "rss"), ("ai-tools", "reddit")]
    mine = spark.createDataFrame([(0, "rss", {"url": "https://x/"})], "ord int, type string, config map<string,string>")
    assert sorted(r.type for r in archive.merged_config(mine, presets.select(F.col("pos").alias("ord"), "type", "config")).collect()) == ["reddit", "rss"]
    for name, pid in (("a", "x"), ("b", "y")):
        (tmp_path / "prof" / name).mkdir(parents=True)
        (tmp_path / "prof" / name / "profile.json").write_text(json.dumps({"id": pid, "name": name}))
    known = archive.profiles(spark, str(tmp_path / "prof"))
    routes = spark.createDataFrame([(0, ["x"]), (1, ["x", "x"]), (2, ["auto", "x"]), (3, ["zz"]), (4, None), (5, []), (6, ["auto"])], "ord int, profile array<string>")
    assert sorted(r.ord for r in archive.invalid_routes(routes, known).collect()) == [1, 2, 3, 5]
    (tmp_path / "prof" / "c").mkdir()
    (tmp_path / "prof" / "c" / "profile.json").write_text('{"id": "x"}')
    with pytest.raises(ValueError, match="twice"):
        archive.profiles(spark, str(tmp_path / "prof"))


def test_sinks(spark, tmp_path):
    issues = spark.createDataFrame([("2024-08-06", "en", "one"), ("2024-08-05", "en", "old")], "date string, language string, markdown string")
    sinks.write_issues(issues, str(tmp_path / "i"))
    sinks.write_issues(issues.where("date = '2024-08-06'").withColumn("markdown", F.lit("two")), str(tmp_path / "i"))
    assert sorted(r.markdown for r in spark.read.parquet(str(tmp_path / "i")).collect()) == ["old", "two"]
    items = spark.createDataFrame([(0, "a"), (1, "b")], "ord int, markdown string")
    assert [r.text for r in sinks.messages(items, "top").collect()] == ["top", "a", "b"]
    assert [r.text for r in sinks.messages(items, "top", overview_last=True).collect()] == ["b", "a", "top"]
    old, new = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string"), spark.createDataFrame([("2", "c")], "id string, v string")
    assert sorted(tuple(r) for r in sinks.upserted(old, new).collect()) == [("1", "a"), ("2", "c")]
    assert sinks.bulk_lines(new, "ix").first().value == '{"index":{"_index":"ix","_id":"2"}}\n{"id":"2","v":"c"}'
    e = "email string, ord long"
    got = sinks.subscribed(spark.createDataFrame([("A@x", 0), ("b@x", 1)], e), spark.createDataFrame([("a@x ", 0), ("c@x", 1)], e), spark.createDataFrame([("B@x",)], "email string"))
    assert [r.email for r in got.orderBy("ord").collect()] == ["a@x", "c@x"]
    mails = spark.createDataFrame([(0, "p@x", "Subscribe"), (1, "no-reply@x", "subscribe"), (2, "q@x", "Re: subscribe")], "ord int, sender string, subject string")
    assert [r.email for r in sinks.subscription_requests(mails, "subscribe").collect()] == ["p@x"]
    bodies = spark.createDataFrame([('{"code":0}',), ('{"code":19}',), ("ok",)], "b string")
    assert [r[0] for r in bodies.select(sinks.response_error("feishu", F.col("b"))).collect()] == [None, "code=19", None]
    pages_ = spark.createDataFrame([("i2", "index"), ("i2", "a"), ("i1", "b")], "issue string, name string")
    assert [tuple(r) for r in sinks.site_index(pages_, 1).collect()] == [("i2", 1)]
    seen = spark.sparkContext.accumulator(0)
    sinks.send(items, lambda rows: seen.add(sum(1 for _ in rows)))
    assert seen.value == 2


def test_union_and_selection(spark):
    row = lambda i, o: (i, "rss", "t", "https://u", None, None, NOW, {}, None, o)
    schema = "id string, source_type string, title string, url string, content string, author string, published_at timestamp, metadata map<string,string>, profile array<string>, ord long"
    a, b = spark.createDataFrame([row("a1", 1), row("a0", 0)], schema), spark.createDataFrame([row("b0", 0)], schema)
    assert [r.id for r in common.all_sources({"a": a, "b": b}).orderBy("ord").collect()] == ["a0", "a1", "b0"]
    out = common.fetch_outcomes(spark, {"a": a, "none": b.where("false"), "bad": RuntimeError("x")}).collect()
    assert [(r.status, r.item_count, r.error) for r in out] == [("success", 2, None), ("empty", 0, None), ("failure", 0, "x")]
    s = spark.createDataFrame([(["a", "b"], ["b", "z"]), (["a"], None)], "k array<string>, w array<string>").select(common.selected_sources(F.col("k"), F.col("w")).alias("s")).collect()
    assert [(x.s.valid, x.s.unknown) for x in s] == [(["b"], ["z"]), (["a"], [])]
    html = spark.createDataFrame([("<html><body><nav><p>menu</p></nav><p>One &amp; two</p><script>x</script><ul><li>li</li></ul></body></html>",), (None,)], "h string")
    assert [r[0] for r in html.select(pages.extractor("readable")("h")).collect()] == ["One & two\nli", None] and pages.extractor("none") is None


def test_batches_for_python_are_bounded(spark):
    from tidemill.session import BATCHES, configured

    rows, size = BATCHES
    spark.conf.set(rows, "10000")
    spark.conf.set(size, str(1 << 28))
    configured(spark)
    assert int(spark.conf.get(rows)) == 1000 and int(str(spark.conf.get(size)).removesuffix("b")) == 4 << 20
    spark.conf.set(rows, "7")
    configured(spark)
    assert spark.conf.get(rows) == "7"
    spark.conf.set(rows, "1000")


def test_a_page_leaves_no_cycles():
    import gc

    from tidemill.sources.pages import _readable

    gc.collect()
    gc.disable()
    try:
        assert _readable("<html><body><article><p>a <b>b</b></p><ul><li>c</li></ul></article></body></html>") == "a b\nc"
        assert gc.collect() == 0
    finally:
        gc.enable()
