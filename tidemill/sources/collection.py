"""What a configuration collects: its enabled sources as rows that may be shown, and the page that lists them by profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls

#: Characters of a label, sites whose pages are named by their query, and words around names (a parameter).
LABEL_CHARS, KEEP_QUERY = 180, {"4pda.to": "showtopic="}
WORDS = {"releases": "releases", "events": "user's events", "stories": "top stories", "feed": "RSS feed", "trending": "trending repositories", "search": "search", "topic": "topic"}
_COMMON = "enabled:boolean,profile:string,category:string"
_LISTS = {
    "github": "type:string,owner:string,repo:string,username:string", "rss": "name:string,url:string", "gdelt": "query:string", "google_news": "query:string",
}
_SECTIONS = {
    "reddit": "subreddits:array<struct<subreddit:string,{0}>>,users:array<struct<username:string,{0}>>", "telegram": "channels:array<struct<channel:string,{0}>>", "twitter": "users:array<string>",
    "openbb": "watchlists:array<struct<name:string,symbols:array<string>,{0}>>", "video": "channels:array<struct<channel:string,name:string,{0}>>", "fourpda": "topics:array<struct<topic_id:string,name:string,{0}>>", "hackernews": "", "ossinsight": "",
}
SCHEMA = "struct<sources:struct<" + ",".join([*(f"{k}:array<struct<{v},{_COMMON}>>" for k, v in _LISTS.items()), *(f"{k}:struct<{','.join(filter(None, [v.format(_COMMON), _COMMON]))}>" for k, v in _SECTIONS.items())]) + ">>"
#: Sections that count only where they say so.
OPT_IN = ("video", "fourpda")
_ROW = "array<struct<source:string,label:string,url:string,profile:string,category:string>>"


def shown_text(value: Column, limit: int = LABEL_CHARS) -> Column:
    """A configured text for a page: no backticks, blanks as one, cut, escaped for HTML and Markdown links."""
    plain = tx.strip(F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("`"), F.lit("")), f"[{tx.GAP_CLASS}]+", " "))
    cut = F.when(F.length(plain) > limit, F.concat(F.rtrim(F.substring(plain, 1, limit - 1)), F.lit("…"))).otherwise(plain)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("[", "\\["), ("]", "\\]")):
        cut = F.replace(cut, F.lit(a), F.lit(b))
    return cut


def routes(profile: Column) -> Column:
    """The profiles of a source, from a name or a list of names as JSON; without any, ``auto``."""
    listed = F.filter(F.from_json(profile, "array<string>"), lambda x: x.isNotNull() & (tx.strip(x) != ""))
    auto = F.array(F.lit("auto"))
    return F.when(profile.isNull() | (tx.strip(profile) == ""), auto).when(F.ltrim(profile).startswith("["), F.coalesce(listed, auto)).otherwise(F.array(profile))


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def configured_sources(configs: DataFrame, *, id_col: str = "config_id", config_col: str = "config", words: dict[str, str] = WORDS) -> DataFrame:
    """``(config_id, ord, source, label, url, profiles, category)``: a row for each enabled source of ``configs``, JSON texts.

    Sources come by kind and then as configured. Only names, addresses without user and query (but for sites in ``KEEP_QUERY``),
    profiles and categories are taken, so nothing else of a configuration is shown. What isn't JSON has no source.
    """
    c = F.from_json(config_col, SCHEMA)["sources"]
    rows = configs.select(id_col, c.alias("s"))
    entry = lambda source, x, label, url=None, own=None: F.struct(F.lit(source).alias("source"), label.alias("label"), (F.lit(None).cast("string") if url is None else url).alias("url"), (x if own is None else own)["profile"].alias("profile"), (x if own is None else own)["category"].alias("category"))
    on = lambda x: F.coalesce(x["enabled"], F.lit(True))
    none = F.array().cast(_ROW)

    def each(items: Column, make, section: Column | None = None, name: str = "") -> Column:
        made = F.coalesce(F.transform(F.filter(items, on), make), none)
        if section is None:
            return made
        return F.when(section.isNotNull() & F.coalesce(section["enabled"], F.lit(name not in OPT_IN)), made).otherwise(none)

    def github(x: Column) -> Column:
        release = F.coalesce(x["type"] == "repo_releases", F.lit(False))
        name = F.when(release, F.concat(_text(x["owner"]), F.lit("/"), _text(x["repo"]))).otherwise(_text(x["username"]))
        label = F.when(release, F.concat(name, F.lit(f" — {words['releases']}"))).otherwise(F.concat(F.lit("@"), name, F.lit(f" — {words['events']}")))
        return entry("github", x, label, F.concat(F.lit("https://github.com/"), name, F.when(release, "/releases").otherwise("")))

    def place(x: Column) -> Column:
        at = _text(x["channel"])
        return F.when(at.rlike("^https?://"), at).otherwise(F.concat(F.lit("https://youtube.com/"), at))

    def named(x: Column, other: Column) -> Column:
        return F.coalesce(F.nullif(x["name"], F.lit("")), other)

    s = lambda k: F.col(f"s.{k}")
    alone = lambda k, word: F.when(F.coalesce(s(k)["enabled"], F.lit(True)), F.array(entry(k, s(k), F.lit(words[word])))).otherwise(none)
    under = lambda k, items, name, sign, to: each(s(k)[items], lambda x: entry(k, x, F.concat(F.lit(sign), _text(x[name])), F.concat(F.lit(to), _text(x[name]))), s(k), k)
    twitter = F.when(s("twitter").isNotNull() & on(s("twitter")), F.coalesce(F.transform(s("twitter")["users"], lambda u: entry("twitter", None, F.concat(F.lit("@"), u), F.concat(F.lit("https://x.com/"), u), s("twitter"))), none)).otherwise(none)
    every = F.concat(
        each(s("github"), github),
        alone("hackernews", "stories"),
        each(s("rss"), lambda x: entry("rss", x, named(x, F.lit(words["feed"])), x["url"])),
        under("reddit", "subreddits", "subreddit", "r/", "https://reddit.com/r/"),
        under("reddit", "users", "username", "u/", "https://reddit.com/u/"),
        under("telegram", "channels", "channel", "@", "https://t.me/"),
        twitter,
        each(s("openbb")["watchlists"], lambda x: entry("openbb", x, F.concat(_text(x["name"]), F.lit(": "), F.array_join(F.coalesce(x["symbols"], F.array().cast("array<string>")), ", "))), s("openbb"), "openbb"),
        alone("ossinsight", "trending"),
        each(s("gdelt"), lambda x: entry("gdelt", x, F.concat(F.lit(f"{words['search']}: "), _text(x["query"])))),
        each(s("google_news"), lambda x: entry("google_news", x, F.concat(F.lit(f"{words['search']}: "), _text(x["query"])))),
        each(s("video")["channels"], lambda x: entry("video", x, named(x, _text(x["channel"])), place(x)), s("video"), "video"),
        each(s("fourpda")["topics"], lambda x: entry("fourpda", x, named(x, F.concat(F.lit(f"{words['topic']} "), _text(x["topic_id"]))), F.concat(F.lit("https://4pda.to/forum/index.php?showtopic="), _text(x["topic_id"]))), s("fourpda"), "fourpda"),
    )
    flat = rows.where("s is not null").select(id_col, F.posexplode(every).alias("ord", "e"))
    return flat.select(id_col, "ord", "e.source", shown_text(F.col("e.label")).alias("label"), urls.public_link(F.col("e.url"), KEEP_QUERY).alias("url"), routes(F.col("e.profile")).alias("profiles"), F.when(F.coalesce("e.category", F.lit("")) != "", shown_text(F.col("e.category"))).alias("category"))


def sources_by_profile(sources: DataFrame, profiles: DataFrame, *, id_col: str = "config_id") -> DataFrame:
    """``profiles(config_id, rank, profile)`` with their ``sources``, in order; profiles without any stay, and ``auto`` comes last where a source has it.

    A source of several profiles is listed under each, and ``several`` says so.
    """
    each = sources.select(id_col, "ord", "source", "label", "url", "category", (F.size("profiles") > 1).alias("several"), F.explode(F.array_distinct("profiles")).alias("profile"))
    auto = each.where("profile = 'auto'").select(id_col).distinct().select(id_col, F.lit(1 << 30).alias("rank"), F.lit("auto").alias("profile"))
    wanted = profiles.select(id_col, F.col("rank").cast("int").alias("rank"), "profile").unionByName(auto)
    listed = each.groupBy(id_col, "profile").agg(F.array_sort(F.collect_list(F.struct("ord", "source", "label", "url", "category", "several"))).alias("sources"))  # one configuration's sources
    return wanted.join(listed, [id_col, "profile"], "left").select(id_col, "rank", "profile", F.coalesce("sources", F.array().cast("array<struct<ord:int,source:string,label:string,url:string,category:string,several:boolean>>")).alias("sources"))


def profile_sections(listed: DataFrame, *, names: dict[str, str] | None = None, empty: str = "No source is assigned.", tag: str = "tag", several: str = "chosen among several profiles", id_col: str = "config_id") -> DataFrame:
    """``(config_id, rank, markdown)``: a profile's heading and its sources, as links where they have an address."""
    known = names or {}
    table = F.create_map(*[F.lit(x) for p in known.items() for x in p]) if known else F.create_map().cast("map<string,string>")
    shown = lambda key: F.coalesce(F.try_element_at(table, key), shown_text(key))

    def line(x: Column) -> Column:
        name = F.when(x["url"].isNotNull(), F.concat(F.lit("["), x["label"], F.lit("]("), x["url"], F.lit(")"))).otherwise(x["label"])
        return F.concat(F.lit("- **"), shown(x["source"]), F.lit(":** "), name, F.when(x["category"].isNotNull(), F.concat(F.lit(f" · {tag} `"), x["category"], F.lit("`"))).otherwise(""), F.when(x["several"], f" · {several}").otherwise(""))

    body = F.when(F.size("sources") == 0, empty).otherwise(F.array_join(F.transform("sources", line), "\n"))
    return listed.select(id_col, "rank", F.concat(F.lit("### "), shown(F.col("profile")), F.lit("\n\n"), body).alias("markdown"))


def profile_order(listed: Column, loaded: Column) -> Column:
    """Profiles in the configured order, then the loaded ones that it leaves out."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(listed, none), F.coalesce(loaded, none)))
