import json

from pyspark.sql import functions as F

from tidemill.operators import site_pages as sp
from tidemill.sources import collection as col

CONFIG = {
    "api_key": "secret",
    "sources": {
        "github": [{"type": "repo_releases", "owner": "o", "repo": "r", "profile": ["tech", " ", "news"]}, {"type": "user_events", "username": "ann", "enabled": False}, {"username": "bob", "category": "`dev` tools"}],
        "hackernews": {"profile": "tech"},
        "rss": [{"name": "Feed [1] <b>", "url": "https://me:pw@Feeds.example:8443/a?key=secret#x"}, {"url": "ftp://x/"}],
        "reddit": {"subreddits": [{"subreddit": "llm"}], "users": [{"username": "u"}, {"username": "v", "enabled": False}]},
        "telegram": {"enabled": False, "channels": [{"channel": "c"}]},
        "twitter": {"users": ["a", "b"], "profile": "news"},
        "openbb": {"watchlists": [{"name": "w", "symbols": ["X", "Y"]}]},
        "ossinsight": {"enabled": False},
        "gdelt": [{"query": "q  q"}],
        "video": {"channels": [{"channel": "@v"}]},
        "fourpda": {"enabled": True, "topics": [{"topic_id": 7}, {"topic_id": 8, "name": "n" * 300}]},
    },
}


def test_configured_sources(spark):
    df = spark.createDataFrame([(1, json.dumps(CONFIG)), (2, "{not json"), (3, None), (4, '{"sources": {}}')], "config_id int, config string")
    rows = col.configured_sources(df).orderBy("config_id", "ord").collect()
    assert [(r.config_id, r.source, r.label, r.url) for r in rows] == [
        (1, "github", "o/r — releases", "https://github.com/o/r/releases"), (1, "github", "@bob — user&#x27;s events", "https://github.com/bob"), (1, "hackernews", "top stories", None),
        (1, "rss", "Feed \\[1\\] &lt;b&gt;", "https://feeds.example:8443/a"), (1, "rss", "RSS feed", None), (1, "reddit", "r/llm", "https://reddit.com/r/llm"), (1, "reddit", "u/u", "https://reddit.com/u/u"),
        (1, "twitter", "@a", "https://x.com/a"), (1, "twitter", "@b", "https://x.com/b"), (1, "openbb", "w: X, Y", None), (1, "gdelt", "search: q q", None),
        (1, "fourpda", "topic 7", "https://4pda.to/forum/index.php?showtopic=7"), (1, "fourpda", "n" * 179 + "…", "https://4pda.to/forum/index.php?showtopic=8"),
        (4, "hackernews", "top stories", None), (4, "ossinsight", "trending repositories", None),
    ]
    assert [r.profiles for r in rows[:3]] == [["tech", "news"], ["auto"], ["tech"]] and rows[1].category == "dev tools" and rows[7].profiles == ["news"]
    assert not any("secret" in str(r) or "pw" in str(r) for r in rows)


def test_page_by_profile(spark):
    df = spark.createDataFrame([(1, json.dumps(CONFIG))], "config_id int, config string")
    order = spark.createDataFrame([(1, 0, "news"), (1, 1, "tech"), (1, 2, "idle")], "config_id int, rank int, profile string")
    pages = [r.markdown for r in col.profile_sections(col.sources_by_profile(col.configured_sources(df), order), names={"tech": "Technology", "github": "GitHub"}).orderBy("rank").collect()]
    assert pages[0] == "### news\n\n- **GitHub:** [o/r — releases](https://github.com/o/r/releases) · chosen among several profiles\n- **twitter:** [@a](https://x.com/a)\n- **twitter:** [@b](https://x.com/b)"
    assert pages[1].startswith("### Technology\n\n- **GitHub:** [o/r") and pages[1].endswith("- **hackernews:** top stories") and pages[2] == "### idle\n\nNo source is assigned."
    assert pages[3].startswith("### auto\n\n- **GitHub:** [@bob — user&#x27;s events](https://github.com/bob) · tag `dev tools`\n")
    assert [r[0] for r in spark.range(1).select(col.profile_order(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c")))).collect()] == [["b", "a", "c"]]


def test_page_states(spark):
    cases = [
        (["supported_by_evidence"], ["official_release"], 0, None, None, "complete"), (["supported_by_evidence", "verification_error"], ["official_release"], 0, None, None, "check_error"), ([], [], 5, None, None, "not_applicable"),
        (["supported_by_evidence"], ["official_release"], 1, None, None, "partial"), (["not_checkable"], ["anecdotal", "not_applicable"], 0, None, None, "not_applicable"), (["insufficient_evidence", "supported_by_evidence"], ["provisional", "official_release"], 0, None, None, "provisional"),
        (["insufficient_evidence"], ["provisional", "insufficient"], 0, None, None, "partial"), (["supported_by_evidence"], ["official_release"], 0, True, None, "check_error"), (["supported_by_evidence"], ["official_release"], None, None, "error", "check_error"), (["mixed_evidence"], ["disputed"], 0, False, "ok", "complete"),
    ]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, s array<string>, p array<string>, u int, e boolean, a string")
    got = [r.v for r in df.orderBy("i").select(sp.page_state(F.col("s"), F.col("p"), F.col("u"), F.col("e"), F.col("a")).alias("v")).collect()]
    assert got == [c[5] for c in cases]


def test_items_with_their_profiles(spark):
    import pytest

    from tidemill.sources import archive

    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i int, profile_id string")
    known = spark.createDataFrame([("a", 5.0), ("b", 6.0), ("c", 7.0)], "id string, threshold double")
    assert sorted((r.i, r.threshold) for r in archive.with_definitions(items, known).collect()) == [(1, 5.0), (2, 6.0), (3, 5.0)]
    with pytest.raises(ValueError, match="unknown profile: b"):
        archive.with_definitions(items, known.where("id <> 'b'"))
    with pytest.raises(ValueError, match="twice"):
        archive.with_definitions(items, known.unionByName(known))


def test_selected_presets_become_a_configuration(spark):
    from tidemill.sources import archive

    kinds = [("github_user", {"username": "ann"}), ("github_repo", {"owner": "o", "repo": "r"}), ("rss", {"name": "n", "url": "https://x/"}), ("reddit_subreddit", {"subreddit": "llm", "fetch_limit": "7"}), ("reddit_user", {"username": "u"}), ("telegram", {"channel": "c"}), ("hackernews", {}), ("unheard_of", {})]
    offers = spark.createDataFrame([(q, i, k, c) for q in (1, 2, 3, 4) for i, (k, c) in enumerate(kinds)], "request_id int, ord long, type string, config map<string,string>")
    requests = spark.createDataFrame([(1, None), (2, [2, 3, 3, 99, 0, 7]), (3, list(range(1, 9))), (4, [3, 4, 5, 6, 7])], "request_id int, toggles array<int>")
    taken = archive.toggled(offers, requests)
    assert [(r.request_id, r.type) for r in taken.where("request_id = 2").orderBy("ord").collect()] == [(2, k) for k, _ in kinds if k not in ("github_repo", "hackernews")]
    got = {r.request_id: json.loads(r.config) for r in archive.routed_sources(taken, requests).collect()}
    one = got[1]["sources"]
    assert one["github"] == [{"type": "user_events", "enabled": True, "username": "ann"}, {"type": "repo_releases", "enabled": True, "owner": "o", "repo": "r"}] and one["rss"] == [{"name": "n", "url": "https://x/", "enabled": True, "category": ""}]
    assert one["reddit"] == {"enabled": True, "subreddits": [{"subreddit": "llm", "sort": "hot", "fetch_limit": 7, "min_score": 50}], "users": [{"username": "u"}], "fetch_comments": 10} and one["telegram"]["channels"] == [{"channel": "c", "fetch_limit": 20}] and one["hackernews"]["enabled"]
    assert not got[2]["sources"]["hackernews"]["enabled"] and len(got[2]["sources"]["github"]) == 1
    assert got[3] == {"sources": {"github": [], "hackernews": {"enabled": True, "fetch_top_stories": 30, "min_score": 100}, "rss": [], "reddit": {"enabled": False, "subreddits": [], "users": [], "fetch_comments": 10}, "telegram": {"enabled": False, "channels": []}}, "collection": {"time_window_hours": 24}}
    assert got[4]["sources"]["reddit"]["enabled"] is False and got[4]["sources"]["telegram"]["enabled"] is False and not got[4]["sources"]["hackernews"]["enabled"]
    # the page reads what was routed
    rows = col.configured_sources(archive.routed_sources(taken, requests).withColumnRenamed("request_id", "config_id")).where("config_id = 1").orderBy("ord").collect()
    assert [r.source for r in rows] == ["github", "github", "hackernews", "rss", "reddit", "reddit", "telegram", "ossinsight"]
