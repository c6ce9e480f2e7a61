"""JSON and XML feeds."""

from __future__ import annotations

import datetime as dt
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times
from ..functions.jsons import short_hash
from ..functions.udfs import vectorized
from .common import item, joined, metadata, or_text

COMMENTS = "\n--- Top Comments ---"

GITHUB_EVENT = "id string, type string, created_at string, repo struct<name:string>, payload struct<commits:array<struct<message:string>>, ref_type:string, description:string, release:struct<tag_name:string, body:string, html_url:string>>"
GITHUB_RELEASE = "id long, tag_name string, html_url string, body string, published_at string, prerelease boolean, author struct<login:string>"


def github_events(raw: DataFrame, since: dt.datetime) -> DataFrame:
    """``raw(ord, username, body)``, a JSON array of events a row: pushes, creations, releases, publications and stars."""
    e = raw.select("username", "ord", F.posexplode(F.from_json("body", f"array<struct<{_struct(GITHUB_EVENT)}>>")).alias("pos", "e"))
    kind, repo, who, p = F.col("e.type"), F.col("e.repo.name"), F.col("username"), "e.payload"
    commits = F.coalesce(F.col(f"{p}.commits"), F.array().cast("array<struct<message:string>>"))
    title = (
        F.when(kind == "PushEvent", F.concat(who, F.lit(" pushed "), F.size(commits).cast("string"), F.lit(" commit(s) to "), repo))
        .when(kind == "CreateEvent", F.concat(who, F.lit(" created "), F.coalesce(F.col(f"{p}.ref_type"), F.lit("repository")), F.lit(" in "), repo))
        .when(kind == "ReleaseEvent", F.concat(who, F.lit(" released "), F.coalesce(F.col(f"{p}.release.tag_name"), F.lit("")), F.lit(" in "), repo))
        .when(kind == "PublicEvent", F.concat(who, F.lit(" made "), repo, F.lit(" public")))
        .when(kind == "WatchEvent", F.concat(who, F.lit(" starred "), repo))
    )
    content = F.when(kind == "PushEvent", F.array_join(F.transform(F.slice(commits, 1, 3), lambda c: F.coalesce(c["message"], F.lit(""))), "\n")).when(kind == "CreateEvent", F.col(f"{p}.description")).when(kind == "ReleaseEvent", F.coalesce(F.col(f"{p}.release.body"), F.lit(""))).otherwise("")
    url = F.coalesce(F.when(kind == "ReleaseEvent", F.col(f"{p}.release.html_url")), F.concat(F.lit("https://github.com/"), repo))
    made = e.select(*item("github", "event", F.col("e.id"), title=title, url=url, content=content, author=who, published=times.iso(F.col("e.created_at")), meta=metadata(event_type=kind, repo=repo), order=F.col("ord") * 1000 + F.col("pos")))
    return made.where(F.col("title").isNotNull() & (F.col("published_at") >= F.lit(since)))


def github_releases(raw: DataFrame, since: dt.datetime) -> DataFrame:
    """``raw(ord, owner, repo, body)``, a JSON array of releases a row."""
    e = raw.select("owner", "repo", "ord", F.posexplode(F.from_json("body", f"array<struct<{_struct(GITHUB_RELEASE)}>>")).alias("pos", "e"))
    name = F.concat("owner", F.lit("/"), "repo")
    made = e.select(*item("github", "release", F.col("e.id").cast("string"), title=F.concat(name, F.lit(" released "), "e.tag_name"), url=F.col("e.html_url"), content=F.coalesce("e.body", F.lit("")), author=F.col("e.author.login"), published=times.iso(F.col("e.published_at")), meta=metadata(repo=name, tag=F.col("e.tag_name"), prerelease=F.coalesce("e.prerelease", F.lit(False))), order=F.col("ord") * 1000 + F.col("pos")))
    return made.where(F.col("published_at") >= F.lit(since))


def _struct(ddl: str) -> str:
    """``a int, b string`` as the inside of a struct."""
    out, depth = [], 0
    for part in ddl.split(","):
        if depth:
            out[-1] += "," + part
        else:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}:{kind}")
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def discussion(comments: Column, line) -> Column:
    """The block of comments, in order."""
    return F.when(F.size(comments) > 0, F.concat(F.lit(COMMENTS + "\n\n"), F.array_join(F.transform(comments, line), "\n\n")))


def hacker_news(stories: DataFrame, comments: DataFrame, since: dt.datetime, *, min_score: int = 100, top_comments: int = 5) -> DataFrame:
    """``stories(ord, id, title, url, by, time, score, descendants, type, text, kids)`` with their first comments.

    ``comments(id, by, text, deleted, dead)``. A missing score is 0. Of the first ``top_comments`` children
    those that are alive and have a text are shown, in their order.
    """
    real = stories.where((F.coalesce("score", F.lit(0)) >= min_score) & (times.epoch(F.col("time")) >= F.lit(since)))
    asked = real.select(F.col("id").alias("story"), F.posexplode(F.slice(F.coalesce("kids", F.array().cast("array<bigint>")), 1, top_comments)).alias("pos", "kid"))
    alive = comments.where((F.coalesce("text", F.lit("")) != "") & ~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False))).select(F.col("id").alias("kid"), F.col("by").alias("who"), F.col("text").alias("said"))
    shown = asked.join(alive, "kid").groupBy("story").agg(F.array_sort(F.collect_list(F.struct("pos", "who", "said"))).alias("comments"))
    rows = real.join(shown, real["id"] == shown["story"], "left")
    found = F.coalesce("comments", F.array().cast("array<struct<pos:int,who:string,said:string>>"))
    line = lambda c: F.concat(F.lit("["), F.coalesce(c["who"], F.lit("anon")), F.lit("]: "), tx.ellipsis(tx.strip(tx.untagged(c["said"])), 500))
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string"))
    meta = metadata(score=F.coalesce("score", F.lit(0)), descendants=F.coalesce("descendants", F.lit(0)), type=F.coalesce("type", F.lit("story")), discussion_url=page, comment_count=F.size(found))
    return rows.select(*item("hackernews", "story", F.col("id").cast("string"), title=F.coalesce("title", F.lit("")), url=F.coalesce("url", page), content=joined(F.col("text"), discussion(found, line)), author=F.coalesce("by", F.lit("unknown")), published=times.epoch(F.col("time")), meta=meta, order=F.col("ord")))


def top_comments(comments: DataFrame, k: int, parent: str = "post_id") -> DataFrame:
    """The best ``k`` of each parent by score, ties as they came; moderators' and deleted ones don't count."""
    real = comments.where(~F.coalesce(F.col("distinguished") == "moderator", F.lit(False)) & ~F.coalesce(F.col("body").isin("[deleted]", "[removed]"), F.lit(True)))
    w = Window.partitionBy(parent).orderBy(F.coalesce("score", F.lit(0)).desc(), "ord")
    return real.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reddit(posts: DataFrame, comments: DataFrame, since: dt.datetime, *, kind: str = "subreddit", min_score: int = 0, k: int = 5) -> DataFrame:
    """``posts(ord, id, title, is_self, subreddit, permalink, author, created_utc, score, upvote_ratio, num_comments, selftext, url, flair)`` with their best comments."""
    real = posts.where((times.epoch(F.coalesce("created_utc", F.lit(0))) >= F.lit(since)) & (F.coalesce("score", F.lit(0)) >= min_score))
    best = top_comments(comments, k).groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("author").alias("who"), "body", F.col("score").alias("pts")))).alias("comments"))
    rows = real.join(best, real["id"] == best["post_id"], "left")
    found = F.coalesce("comments", F.array().cast("array<struct<rank:int,who:string,body:string,pts:bigint>>"))
    line = lambda c: F.concat(F.lit("["), F.coalesce(c["who"], F.lit("anon")), F.lit(" ("), F.coalesce(c["pts"], F.lit(0)).cast("string"), F.lit(" pts)]: "), tx.ellipsis(tx.strip(c["body"]), 500))
    page = F.concat(F.lit("https://www.reddit.com"), F.coalesce("permalink", F.lit("")))
    meta = metadata(score=F.coalesce("score", F.lit(0)), upvote_ratio=F.col("upvote_ratio"), num_comments=F.coalesce("num_comments", F.lit(0)), subreddit=F.col("subreddit"), is_self=F.coalesce("is_self", F.lit(False)), flair=F.col("flair"), discussion_url=page)
    return rows.select(*item("reddit", kind, F.col("id"), title=F.coalesce("title", F.lit("")), url=F.when(F.coalesce("is_self", F.lit(False)), page).otherwise(F.coalesce("url", page)), content=joined(tx.ellipsis(F.col("selftext"), 1500), discussion(found, line)), author=F.coalesce("author", F.lit("unknown")), published=times.epoch(F.coalesce("created_utc", F.lit(0))), meta=meta, order=F.col("ord")))


def first_that_has(tables: list[DataFrame], key: str) -> DataFrame:
    """A ladder of sources: for each key the rows of the first table that has any."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [t.withColumn("__rung", F.lit(i)) for i, t in enumerate(tables)])
    best = every.groupBy(key).agg(F.min("__rung").alias("__rung"))
    return every.join(best, [key, "__rung"]).drop("__rung")


TWEET = "id string, id_str string, conversation_id string, created_at string, full_text string, text string, url string, permalink string, handle string, username string, user struct<screen_name:string, username:string, handle:string, name:string>, favorite_count long, retweet_count long, reply_count long, view_count long, is_reply boolean, in_reply_to_status_id string"


def tweets(raw: DataFrame, since: dt.datetime) -> DataFrame:
    """``raw(ord, body)``, a JSON tweet a row, in either of two shapes."""
    t = raw.select("ord", F.from_json("body", f"struct<{_struct(TWEET)}>").alias("t")).select("ord", "t.*")
    native = F.coalesce(F.when(F.col("id").startswith("tweet-"), F.replace("id", F.lit("tweet-"), F.lit(""))), F.nullif("id_str", F.lit("")), F.nullif("id", F.lit("")))
    named = F.coalesce(F.nullif("id_str", F.lit("")), F.nullif("id", F.lit("")))
    handle = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("user.screen_name", "user.username", "user.handle", "handle", "username")], F.lit("unknown"))
    said = tx.unescaped(or_text(F.col("full_text"), F.col("text")))
    t = t.withColumns({"__said": said, "__native": native, "__handle": handle, "__named": named})
    url = F.coalesce(F.nullif("url", F.lit("")), F.when((F.coalesce("permalink", F.lit("")) != "") & (F.col("__handle") != "unknown"), F.concat(F.lit("https://twitter.com/"), "__handle", "permalink")), F.concat(F.lit("https://twitter.com/"), "__handle", F.lit("/status/"), "__named"))
    first = tx.strip(F.replace(F.substring("__said", 1, 50), F.lit("\n"), F.lit(" ")))
    title = F.concat(F.lit("@"), "__handle", F.lit(": "), first, F.when(F.length("__said") > 50, F.lit("...")).otherwise(F.lit("")))
    meta = metadata(tweet_id=F.col("__native"), conversation_id=F.coalesce(F.nullif("conversation_id", F.lit("")), "__native"), favorite_count=F.coalesce("favorite_count", F.lit(0)), retweet_count=F.coalesce("retweet_count", F.lit(0)), reply_count=F.coalesce("reply_count", F.lit(0)), view_count=F.col("view_count"), is_reply=F.coalesce("is_reply", F.lit(False)), in_reply_to_status_id=F.col("in_reply_to_status_id"))
    made = t.where("__native is not null and coalesce(__said, '') <> ''").select(*item("twitter", "tweet", F.col("__native"), title=title, url=url, content=F.col("__said"), author=or_text(F.col("user.name"), F.col("__handle")), published=times.tweet_time(F.col("created_at")), meta=meta, order=F.col("ord")))
    return made.where(F.col("published_at") >= F.lit(since))


def reply_lines(replies: DataFrame, k: int, min_likes: int = 0) -> DataFrame:
    """``replies(tweet_id, own_author, ord, id, handle, text, likes, replies)`` -> the best ``k`` lines of each tweet."""
    who = F.coalesce("handle", F.lit("unknown"))
    said = tx.unescaped(tx.strip(F.coalesce("text", F.lit(""))))
    likes, answers = F.coalesce("likes", F.lit(0)), F.coalesce("replies", F.lit(0))
    own = F.lower(who) == F.lower(F.regexp_replace(F.coalesce("own_author", F.lit("")), "^@+", ""))
    real = replies.where((F.regexp_replace("id", "^tweet-", "") != F.col("tweet_id")) & ~own & (likes >= max(0, min_likes))).withColumn("__said", said).where("__said <> ''")
    line = F.concat(F.lit("[@"), who, F.lit(" | ❤️ "), likes.cast("string"), F.lit(" | 💬 "), answers.cast("string"), F.lit("] "), F.substring("__said", 1, 280))
    w = Window.partitionBy("tweet_id").orderBy((likes * 2 + answers).desc(), "ord")
    top = real.select("tweet_id", line.alias("line"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    return top.groupBy("tweet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))


def with_discussion(content: Column, lines: Column) -> Column:
    """Reply lines below the marker; what is there already isn't added again."""
    block, has = F.array_join(lines, "\n"), F.coalesce(content, F.lit(""))
    marker = F.lit(tx.COMMENTS)
    return F.when(F.size(F.coalesce(lines, F.array().cast("array<string>"))) == 0, content).when(F.contains(has, marker) & F.contains(has, block), content).when(F.contains(has, marker), F.concat(has, F.lit("\n"), block)).when(has != "", F.concat(has, F.lit("\n\n"), marker, F.lit("\n"), block)).otherwise(F.concat(marker, F.lit("\n"), block))


def openbb(raw: DataFrame, since: dt.datetime) -> DataFrame:
    """``raw(ord, watchlist, watch_symbols, body)``, a JSON news record a row; each URL once over all watchlists. The window's bound itself is out."""
    from ..operators.dedup import keep_first

    r = raw.select("ord", "watchlist", "watch_symbols", F.from_json("body", "title string, url string, date string, author string, body string, excerpt string, symbols string").alias("r"))
    listed = F.coalesce(F.from_json("r.symbols", "array<string>"), F.split("r.symbols", ","))
    own = F.array_distinct(F.filter(F.transform(listed, lambda s: F.upper(tx.strip(s))), lambda s: s != ""))
    symbols = F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, own).otherwise(F.col("watch_symbols"))
    at, url, title = times.iso(F.col("r.date")), tx.strip(F.col("r.url")), tx.strip(F.col("r.title"))
    rows = keep_first(r.withColumns({"__at": at, "__url": url, "__title": title, "__s": symbols}).where((F.coalesce("__url", F.lit("")) != "") & (F.coalesce("__title", F.lit("")) != "") & (F.col("__at") > F.lit(since))), "__url")
    native = F.concat(F.date_format("__at", "yyyyMMdd'T'HHmmss"), F.lit("::"), "__url")
    return rows.select(*item("openbb", "news", native, title=F.col("__title"), url=F.col("__url"), content=or_text(F.col("r.body"), F.col("r.excerpt")), author=or_text(F.col("r.author"), F.try_element_at("__s", F.lit(1))), published=F.col("__at"), meta=metadata(watchlist=F.col("watchlist"), symbols=F.to_json("__s")), order=F.col("ord")))


def oss_insight(raw: DataFrame, now: dt.datetime, *, period: str = "past_24_hours", min_stars: int = 0, keywords: tuple[str, ...] = (), limit: int = 30) -> DataFrame:
    """``raw(ord, language, body)``, a JSON row of trends each; filters first, then each repository once, then the most stars."""
    from ..operators.dedup import keep_first

    r = raw.select("ord", "language", F.from_json("body", "repo_id string, repo_name string, stars string, forks string, pushes string, pull_requests string, primary_language string, description string, collection_names string").alias("r")).select("ord", "language", "r.*").where("coalesce(repo_name, '') <> '' and coalesce(repo_id, '') <> ''")
    whole = lambda c: F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0).cast("long"))
    r = r.withColumns({"n": whole("stars"), "said": tx.strip(F.coalesce("description", F.lit(""))), "lang": or_text(F.col("primary_language"), F.col("language"))})
    hay = F.lower(F.concat_ws(" ", "repo_name", "said", F.coalesce("collection_names", F.lit(""))))
    if min_stars:
        r = r.where(F.col("n") >= min_stars)
    if keywords:
        r = r.where(F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(hay, k)))
    best = keep_first(r, "repo_id").orderBy(F.desc("n"), "ord").limit(limit)
    lines = [F.concat(F.lit("Trending GitHub repo: "), "repo_name"), F.concat(F.lit(f"Stars gained ({period}): "), F.col("n").cast("string")), *[F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit("0"))) for name, c in (("Forks gained", "forks"), ("Pushes", "pushes"), ("Pull requests", "pull_requests"))], F.concat(F.lit("Language: "), F.coalesce("lang", F.lit("")))]
    content = F.concat(F.concat_ws("\n", *lines), F.when(F.col("said") != "", F.concat(F.lit("\n\n"), "said")).otherwise(F.lit("")), F.when(F.coalesce("collection_names", F.lit("")) != "", F.concat(F.lit("\n\nOSS Insight collections: "), "collection_names")).otherwise(F.lit("")))
    meta = metadata(repo=F.col("repo_name"), stars_gained=F.col("n"), forks_gained=whole("forks"), pushes=whole("pushes"), pull_requests=whole("pull_requests"), primary_language=F.col("lang"), period=period, collection_names=F.col("collection_names"), description=F.col("said"))
    owner = F.when(F.contains("repo_name", F.lit("/")), F.split_part("repo_name", F.lit("/"), F.lit(1)))
    return best.select(*item("ossinsight", "trending", F.col("repo_id"), title=F.concat("repo_name", F.lit(" (+"), F.col("n").cast("string"), F.lit(f"⭐ {period})")), url=F.concat(F.lit("https://github.com/"), "repo_name"), content=content, author=owner, published=F.lit(now), meta=meta, order=F.col("ord")))


def gdelt(raw: DataFrame, query: str | None = None) -> DataFrame:
    """``raw(ord, body)``, a response a row; articles without URL, title or a readable time are left out."""
    e = raw.select("ord", F.posexplode(F.from_json("body", "articles array<struct<url:string,title:string,seendate:string,domain:string,sourcecountry:string,language:string>>")["articles"]).alias("pos", "a"))
    url, title, seen = (tx.strip(F.coalesce(F.col(f"a.{c}"), F.lit(""))) for c in ("url", "title", "seendate"))
    made = e.where((url != "") & (title != "")).select(*item("gdelt", "article", F.concat(seen, F.lit("::"), url), title=title, url=url, content=F.lit(None).cast("string"), author=F.col("a.domain"), published=times.compact(seen), meta=metadata(domain=F.col("a.domain"), sourcecountry=F.col("a.sourcecountry"), language=F.col("a.language"), query=query), order=F.col("ord") * 1000 + F.col("pos")))
    return made.where("published_at is not null")


_ENTRY = "array<struct<id:string,title:string,link:string,author:string,published:string,updated:string,created:string,summary:string,content:string,source:string,tags:array<string>,video_id:string>>"


def _entries(body: str | None) -> list[dict]:
    """RSS items and Atom entries; a feed that isn't XML has none."""
    try:
        root = ET.fromstring(body or "")
    except ET.ParseError:
        return []
    name = lambda e: e.tag.rpartition("}")[2].lower()
    out = []
    for e in root.iter():
        if name(e) not in ("item", "entry"):
            continue
        row = dict.fromkeys(("id", "title", "link", "author", "published", "updated", "created", "summary", "content", "source", "video_id")) | {"tags": []}
        for c in e:
            key, said = name(c), ("".join(c.itertext())).strip()
            if key == "link":
                row["link"] = row["link"] or c.get("href") or said or None
            elif key in ("guid", "id"):
                row["id"] = row["id"] or said
            elif key in ("pubdate", "published", "date"):
                row["published"] = row["published"] or said
            elif key in ("description", "summary"):
                row["summary"] = said if row["summary"] is None else row["summary"]
            elif key in ("encoded", "content"):
                row["content"] = said
            elif key in ("author", "creator"):
                row["author"] = next(("".join(n.itertext()).strip() for n in c if name(n) == "name"), said)
            elif key == "category":
                row["tags"].append(c.get("term") or said)
            elif key == "videoid":
                row["video_id"] = said
            elif key == "group":
                row["summary"] = row["summary"] or next(("".join(n.itertext()).strip() for n in c if name(n) == "description"), None)
            elif key in ("title", "updated", "created", "source"):
                row[key] = said
        out.append(row)
    return out


@vectorized(_ENTRY)
def feed_entries(body: pd.Series) -> pd.Series:
    return body.map(_entries)


def rss(raw: DataFrame, since: dt.datetime) -> DataFrame:
    """``raw(ord, feed_url, name, body)``, a feed a row."""
    e = raw.select("ord", "feed_url", "name", F.posexplode(feed_entries("body")).alias("pos", "e"))
    place = F.replace(F.split_part("feed_url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit("_"))
    made = e.select(*item("rss", place, short_hash(F.coalesce("e.id", "e.link", F.lit("")), 16), title=F.coalesce("e.title", F.lit("Untitled")), url=F.coalesce("e.link", "feed_url"), content=F.coalesce("e.summary", "e.content", F.lit("")), author=F.coalesce("e.author", "name"), published=times.feed_time(F.col("e.published"), F.col("e.updated"), F.col("e.created")), meta=metadata(feed_name=F.col("name"), tags=F.to_json("e.tags")), order=F.col("ord") * 1000 + F.col("pos")))
    return made.where(F.col("published_at") >= F.lit(since))


def with_full_text(items: DataFrame, extracted: DataFrame) -> DataFrame:
    """``extracted(id, full_text)`` takes the content's place where it says something."""
    return items.join(extracted, "id", "left").withColumn("content", F.coalesce(F.nullif("full_text", F.lit("")), "content")).drop("full_text")


def reddit_feed(raw: DataFrame, since: dt.datetime, limit: int) -> DataFrame:
    """``raw(ord, subreddit, body)``, a community's feed where its listing can't be had: the first ``limit`` entries, and of these those in the window.

    A feed tells no scores, so there are none.
    """
    e = raw.select("ord", "subreddit", F.posexplode(feed_entries("body")).alias("pos", "e")).where(F.col("pos") < limit)
    home = F.concat(F.lit("https://www.reddit.com/r/"), "subreddit", F.lit("/"))
    link = or_text(F.col("e.link"), home)
    native = F.coalesce(F.nullif("e.id", F.lit("")), F.nullif("e.link", F.lit("")), "e.title", F.lit(""))
    said = tx.strip(tx.unescaped(tx.untagged(F.coalesce("e.summary", "e.content", F.lit("")))))
    made = e.select(*item("reddit", "subreddit-rss", native, title=or_text(F.col("e.title"), "Untitled"), url=link, content=said, author=or_text(F.col("e.author"), "unknown"), published=times.feed_time(F.col("e.published"), F.col("e.updated"), F.col("e.created")), meta=metadata(subreddit=F.col("subreddit"), discussion_url=link, fallback="rss"), order=F.col("ord") * 1000 + F.col("pos")))
    return made.where(F.col("published_at") >= F.lit(since))


def gdelt_request(query: str, since: dt.datetime, now: dt.datetime, *, language: str | None = None, country: str | None = None, timespan: str | None = None, mode: str = "artlist", max_records: int = 75) -> dict[str, str] | None:
    """What is asked of the news index: language and country as operators of the query, a span of time or else the window; None without a query."""
    asked = " ".join([query.strip(), *([f"sourcelang:{language}"] if language else []), *([f"sourcecountry:{country}"] if country else [])])
    if not query.strip():
        return None
    window = {"timespan": timespan} if timespan else {"startdatetime": f"{since:%Y%m%d%H%M%S}", "enddatetime": f"{now:%Y%m%d%H%M%S}"}
    return {"query": asked, "mode": mode, "format": "json", "maxrecords": str(max_records), "sort": "datedesc"} | window


def google_news(raw: DataFrame, since: dt.datetime, limit: int | None = None, query: str | None = None) -> DataFrame:
    """``raw(ord, body)``; only valid entries count towards the limit."""
    e = raw.select("ord", F.posexplode(feed_entries("body")).alias("pos", "e"))
    title, link = tx.strip(F.coalesce("e.title", F.lit(""))), tx.strip(F.coalesce("e.link", F.lit("")))
    who = F.nullif(tx.strip(F.col("e.source")), F.lit(""))
    made = e.where((title != "") & (link != "")).select(*item("google_news", "article", short_hash(F.coalesce("e.id", link), 16), title=title, url=link, content=F.coalesce("e.summary", "e.content"), author=who, published=times.feed_time(F.col("e.published"), F.col("e.updated"), F.col("e.created")), meta=metadata(gn_query=query, source_name=who), order=F.col("ord") * 1000 + F.col("pos")))
    made = made.where(F.col("published_at") >= F.lit(since))
    return made if limit is None else made.orderBy("ord").limit(limit)


def youtube(raw: DataFrame, since: dt.datetime, max_videos: int) -> DataFrame:
    """``raw(ord, channel, body)``: of each channel the first videos within the window."""
    e = raw.select("ord", "channel", F.posexplode(feed_entries("body")).alias("pos", "e")).withColumn("at", times.feed_time(F.col("e.published"))).where(F.col("at") >= F.lit(since))
    top = e.withColumn("r", F.row_number().over(Window.partitionBy("channel").orderBy("ord", "pos"))).where(F.col("r") <= max_videos)
    return top.select(*item("video", "youtube", F.col("e.video_id"), title=F.col("e.title"), url=F.col("e.link"), content=F.col("e.summary"), author=F.coalesce("e.author", "channel"), published=F.col("at"), meta=metadata(channel=F.col("channel"), content_source="description"), order=F.col("ord") * 1000 + F.col("pos")))
