"""Web pages: forum posts, channel messages and readable text, parsed by vectorized functions."""

from __future__ import annotations

import datetime as dt
import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times
from ..functions.udfs import vectorized
from .common import item, metadata

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element with its children; texts are strings among them."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def all(self, tag: str | None = None, cls: str | None = None, attr: str | None = None):
        for n in self.walk():
            if n is not self and (tag is None or n.tag == tag) and (cls is None or cls in (n.attrs.get("class") or "").split()) and (attr is None or n.attrs.get(attr) is not None):
                yield n

    def one(self, *a, **k):
        return next(self.all(*a, **k), None)

    def text(self, skip: tuple[str, ...] = (), skip_classes: tuple[str, ...] = ()) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "br":
                out.append("\n")
            elif n.tag not in skip and not set((n.attrs.get("class") or "").split()) & set(skip_classes):
                stack += reversed(n.children)
        return "".join(out)

    def release(self) -> None:
        """Takes the tree apart, so that its memory is free at once and not when cycles are next looked for."""
        for n in list(self.walk()):
            n.children, n.parent = [], None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):
        n = Node(tag, dict(attrs), self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(markup: str | None) -> Node:
    b = _Builder()
    b.feed(markup or "")
    b.close()
    return b.root


def _readable(markup: str | None) -> str | None:
    if markup is None:
        return None
    root = tree(markup)
    body = root.one("article") or root.one("main") or root.one("body") or root
    blocks = []
    for n in body.walk():
        if n.tag in ("p", "h1", "h2", "h3", "h4", "li", "blockquote", "pre", "td") and not any(isinstance(c, Node) and c.tag in ("p", "li") for c in n.children):
            up = n
            while up is not None and up.tag not in ("nav", "footer", "aside", "header", "script", "style", "noscript"):
                up = up.parent
            said = " ".join(n.text(skip=("script", "style", "noscript")).split())
            if up is None and said:
                blocks.append(said)
    said = "\n".join(blocks) or " ".join(body.text(skip=("script", "style", "noscript", "nav", "footer")).split())
    root.release()
    return said


@vectorized("string")
def readable(markup: pd.Series) -> pd.Series:
    """The text of a page's article: paragraphs, headings and lists without navigation and scripts."""
    return markup.map(_readable)


EXTRACTORS = {"readable": readable}


def extractor(name: str):
    """By name; null if there is none such."""
    return EXTRACTORS.get(name)


def _number(x, default=0) -> int:
    try:
        return int(str(x).replace(",", ""))
    except ValueError:
        return default


def _posts(markup: str | None) -> list[dict]:
    out = []
    for thing in tree(markup).all("div", "thing", "data-fullname"):
        classes = thing.attrs["class"].split()
        title = thing.one("a", "title")
        native = thing.attrs["data-fullname"].removeprefix("t3_")
        if "link" not in classes or not native or title is None:
            continue
        link = (thing.attrs.get("data-permalink") or "").removeprefix("https://www.reddit.com")
        link = link if link.startswith("/") else f"/r/{thing.attrs.get('data-subreddit') or ''}/comments/{native}/"
        url, when = thing.attrs.get("data-url") or "", thing.attrs.get("data-timestamp")
        at = _number(when, None) if when is not None else None
        if at is None:
            t = thing.one("time", attr="datetime")
            try:
                at = int(dt.datetime.fromisoformat(t.attrs["datetime"].replace("Z", "+00:00")).timestamp() * 1000) if t else 0
            except ValueError:
                at = 0
        n = thing.one("a", "comments")
        digits = "".join(c for c in n.text() if c.isdigit()) if n else ""
        body, flair = thing.one("div", "md"), thing.one("span", "linkflairlabel")
        out.append({"id": native, "title": " ".join(title.text().split()), "is_self": "self" in classes or not url, "subreddit": thing.attrs.get("data-subreddit"), "permalink": link, "author": thing.attrs.get("data-author") or "unknown", "created_utc": at // 1000, "score": _number(thing.attrs.get("data-score")), "num_comments": int(digits or 0), "selftext": body.text().strip() if body else "", "url": url or f"https://www.reddit.com{link}", "flair": flair.text().strip() or None if flair else None})
    return out


@vectorized("array<struct<id:string,title:string,is_self:boolean,subreddit:string,permalink:string,author:string,created_utc:bigint,score:bigint,num_comments:bigint,selftext:string,url:string,flair:string>>")
def listing_posts(markup: pd.Series) -> pd.Series:
    """Posts of an old-style listing page."""
    return markup.map(_posts)


def listing(raw: DataFrame, limit: int) -> DataFrame:
    """``raw(ord, body)`` -> posts as :func:`feeds.reddit` takes them; the first ``limit`` of a page."""
    return raw.select("ord", F.posexplode(F.slice(listing_posts("body"), 1, limit)).alias("pos", "p")).select((F.col("ord") * 1000 + F.col("pos")).alias("ord"), "p.*", F.lit(None).cast("double").alias("upvote_ratio"))


def _messages(markup: str | None) -> list[dict]:
    out = []
    for m in tree(markup).all("div", "tgme_widget_message", "data-post"):
        body, at = m.one("div", "tgme_widget_message_text"), m.one("time", attr="datetime")
        links = [a.attrs["href"] for a in body.all("a", attr="href")] if body else []
        out.append({"id": m.attrs["data-post"].rpartition("/")[2], "text": body.text().strip() if body else "", "at": at.attrs["datetime"] if at else None, "links": links})
    return out


@vectorized("array<struct<id:string,text:string,at:string,links:array<string>>>")
def channel_messages(markup: pd.Series) -> pd.Series:
    return markup.map(_messages)


def telegram(raw: DataFrame, since: dt.datetime, limit: int) -> DataFrame:
    """``raw(ord, channel, body)``, a channel's page a row: of the last ``limit`` messages those with a text, in the window."""
    all_ = channel_messages("body")
    e = raw.withColumn("m", all_).select("ord", "channel", F.posexplode(F.slice("m", F.greatest(F.size("m") - limit + 1, F.lit(1)), limit)).alias("pos", "m"))
    page = F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), "m.id")
    outside = F.try_element_at(F.filter("m.links", lambda x: x.startswith("http") & ~F.contains(x, F.lit("t.me"))), F.lit(1))
    title = tx.message_title(F.replace(F.split_part("m.text", F.lit("\n\n"), F.lit(1)), F.lit("\n"), F.lit(" ")))
    made = e.where("m.text <> '' and m.id <> ''").select(*item("telegram", F.col("channel"), F.col("m.id"), title=title, url=F.coalesce(outside, page), content=F.col("m.text"), author=F.col("channel"), published=times.iso(F.col("m.at")), meta=metadata(msg_url=page, channel=F.col("channel")), order=F.col("ord") * 1000 + F.col("pos")))
    return made.where(F.col("published_at") >= F.lit(since))


def _topic(data: bytes | None) -> list[dict]:
    root = tree((data or b"").decode("windows-1251", "replace"))
    out = []
    for p in root.all("div", attr="data-post"):
        body, at, nick = p.one("div", "post_body"), p.one("span", "post_date"), p.one(cls="post_nick")
        who = (nick.one("a") or nick).text(skip=("i",), skip_classes=("dropdown-menu",)).strip().rstrip("ᵥ? ") if nick else "4pda_user"
        out.append({"id": p.attrs["data-post"], "text": body.text(skip_classes=("quote_body", "quote_header", "post-edit-reason")).strip() if body else "", "at": at.text().strip() if at else "", "author": who})
    return out


@vectorized("array<struct<id:string,text:string,at:string,author:string>>")
def topic_posts(data: pd.Series) -> pd.Series:
    return data.map(_topic)


def forum(raw: DataFrame, since: dt.datetime, now: dt.datetime, limit: int, least: int = 15) -> DataFrame:
    """``raw(ord, topic_id, body binary)`` in windows-1251: each post once, the last ``limit`` of a topic. Posts without a date are from now."""
    from ..operators.dedup import keep_first
    from ..operators.select import tail

    e = raw.select("ord", "topic_id", F.posexplode(topic_posts("body")).alias("pos", "p")).select((F.col("ord") * 1000 + F.col("pos")).alias("ord"), "topic_id", "p.*").where("id <> ''")
    e = keep_first(e, "topic_id", "id").withColumn("__at", times.forum_time(F.col("at"), F.lit(now)))
    pinned = F.contains("text", F.lit("Правила темы")) & F.contains("text", F.lit("Обход блокировок")) & (F.length("text") > 1500)
    e = e.where((F.col("__at").isNull() | (F.col("__at") >= F.lit(since))) & (F.length("text") >= least) & ~pinned)
    first = tx.strip(F.split_part("text", F.lit("\n"), F.lit(1)))
    title = F.concat(F.lit("4PDA: "), F.when(F.length(first) > 80, F.concat(F.substring(first, 1, 80), F.lit("..."))).otherwise(first))
    url = F.concat(F.lit("https://4pda.to/forum/index.php?showtopic="), "topic_id", F.lit("&view=findpost&p="), "id")
    made = e.select("topic_id", *item("fourpda", "topic", F.concat("topic_id", F.lit(":"), "id"), title=title, url=url, content=F.col("text"), author=F.col("author"), published=F.coalesce("__at", F.lit(now)), meta=metadata(topic_id=F.col("topic_id"), post_id=F.col("id")), order=F.col("ord")))
    return tail(made, limit, per="topic_id").drop("topic_id")


def _nested(value, out: list) -> list:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if "rest_id" in v and isinstance(v.get("legacy"), dict):
                legacy = v["legacy"]
                out.append({"id": str(v["rest_id"]), "text": legacy.get("full_text"), "created_at": legacy.get("created_at"), "favorite_count": legacy.get("favorite_count"), "retweet_count": legacy.get("retweet_count"), "reply_count": legacy.get("reply_count")})
            stack += reversed(list(v.values()))
        elif isinstance(v, list):
            stack += reversed(v)
    return out


@vectorized("array<struct<id:string,text:string,created_at:string,favorite_count:bigint,retweet_count:bigint,reply_count:bigint>>")
def nested_tweets(body: pd.Series) -> pd.Series:
    """Tweets anywhere in a captured response, in order; what isn't JSON has none."""
    import json

    def one(b):
        try:
            return _nested(json.loads(b), [])
        except (TypeError, ValueError):
            return []

    return body.map(one)


@vectorized("string")
def _ordered_json(text: pd.Series) -> pd.Series:
    """JSON with sorted names, two blanks for each level; what isn't JSON as it is."""

    def one(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, indent=2)
        except (TypeError, ValueError):
            return t

    return text.map(one)


def document_text(text: Column, mime: Column) -> Column:
    """What a fetched document says, by its type: a page's readable text, JSON in order, else the text; without a byte order mark, in lines."""
    plain = F.regexp_replace(text, "^\ufeff", "")
    page = mime.isin("text/html", "application/xhtml+xml")
    said = F.when(page, readable(plain)).when(mime == "application/json", _ordered_json(plain)).otherwise(plain)
    return tx.normalized_lines(said)
