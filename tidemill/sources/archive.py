"""Published issues, presets and profiles read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls

HEADING = '(?m)^#{2,3} (?:\\[(.+?)\\]\\((\\S+?)\\)|(.+?)) ⭐️ (\\S+)/10[ \\t]*$'


def issue_articles(issues: DataFrame, base: str) -> DataFrame:
    """``issues(date, language, markdown)`` -> articles by anchor; segments without a heading are skipped."""
    parts = F.split("markdown", '<a id="')
    e = issues.select("date", "language", F.posexplode(F.slice(parts, 2, F.size(parts))).alias("pos", "part")).where(F.col("part").rlike(HEADING))
    anchor = F.regexp_extract("part", '^item-([^"]*)"', 1)
    body = F.regexp_replace(F.regexp_replace("part", '^[^"]*"></a>\\s*', ""), HEADING, "")
    get = lambda i: F.nullif(F.regexp_extract("part", HEADING, i), F.lit(""))
    blocks = F.regexp_extract_all(body, F.lit("(?m)^\\*\\*「(.+?)」\\*\\* "), F.lit(1))
    tags = F.regexp_extract_all(F.regexp_extract(body, "(?m)^\\*\\*[^*]+\\*\\*: (`#.*)$", 1), F.lit("`#([^`]+)`"), F.lit(1))
    paragraphs = F.filter(F.split(F.split_part(body, F.lit("<details>"), F.lit(1)), "\\n\\s*\\n"), lambda p: (tx.strip(p) != "") & ~p.rlike("^\\s*(?:---|\\*\\*[^*]+\\*\\*: `#)"))
    name = F.concat_ws("-", "date", "language", anchor)
    return e.select(name.alias("id"), "date", "language", F.coalesce(get(1), get(3)).alias("title"), get(2).alias("source_url"), get(4).alias("score"), F.concat(F.lit(base.rstrip("/") + "/"), F.concat_ws("-", "date", "language"), F.lit("/"), urls.slug(anchor), F.lit("/")).alias("url"), F.array_join(F.transform(paragraphs, lambda p: unescaped_markdown(tx.strip(p))), "\n").alias("content"), blocks.alias("block_titles"), tags.alias("tags"))


def republished(issues: DataFrame, base: str) -> DataFrame:
    """``issues(date, language, markdown)`` as pages ``(issue, slug, title, markdown)`` for a site: one for each article as it was published, its heading the page's, and an ``index`` for each issue that has any."""
    parts = F.split("markdown", '<a id="')
    e = issues.select("date", "language", F.posexplode(F.slice(parts, 2, F.size(parts))).alias("pos", "part")).where(F.col("part").rlike(HEADING))
    slug = urls.slug(F.regexp_extract("part", '^item-([^"]*)"', 1))
    get = lambda i: F.nullif(F.regexp_extract("part", HEADING, i), F.lit(""))
    whole = F.concat(F.lit('<a id="'), F.regexp_replace("part", "(?m)^#{2,3} (?=.* ⭐️ )", "# "))
    text = F.concat(F.regexp_replace(whole, "\\s+(?:---\\s*)?$", ""), F.lit("\n"))
    rows = e.select(F.concat_ws("-", "date", "language").alias("issue"), "date", "pos", slug.alias("slug"), F.coalesce(get(1), get(3)).alias("shown"), get(4).alias("score"), text.alias("markdown"))
    place = F.concat(F.lit(base.rstrip("/") + "/"), "issue", F.lit("/"), "slug", F.lit("/"))
    line = F.concat(F.lit("- ["), "shown", F.lit("]("), place, F.lit(") ⭐️ "), "score", F.lit("/10"))
    listed = rows.groupBy("issue", "date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))  # one issue's articles
    index = listed.select("issue", F.lit("index").alias("slug"), F.col("date").cast("string").alias("title"), F.concat(F.lit("# "), "date", F.lit("\n\n"), "lines", F.lit("\n")).alias("markdown"))
    return rows.select("issue", "slug", unescaped_markdown(F.col("shown")).alias("title"), "markdown").unionByName(index)


def unescaped_markdown(text: Column) -> Column:
    plain = F.regexp_replace(text, "\\\\([\\\\`*_{}\\[\\]()#+!|~-])", "$1")
    return F.replace(F.replace(F.replace(plain, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


PRESETS = "domains array<struct<id:string,name:string,keywords:array<string>,sources:array<struct<type:string,description:string,tags:array<string>,config:map<string,string>>>>>"


def presets(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, domain, name, keywords, pos, type, description, tags, config)``, ids in kebab case."""
    d = spark.read.schema(PRESETS).option("multiLine", True).json(path).select(F.posexplode("domains").alias("ord", "d"))
    return d.select("ord", F.lower(F.replace("d.id", F.lit("_"), F.lit("-"))).alias("domain"), "d.name", "d.keywords", F.posexplode("d.sources").alias("pos", "s")).select("ord", "domain", "name", "keywords", "pos", "s.*")


def merged_config(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Configured sources, existing ones first and winning: ``(ord, type, config, ...)``; the same are those with one :func:`preset_key`, a feed's address without regard to the case of its scheme and host."""
    from ..operators.dedup import keep_first

    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    url = F.coalesce(F.try_element_at("config", F.lit("url")), F.lit(""))
    place = F.regexp_extract(url, "^[^/]*//[^/?#]*", 0)
    at = F.concat(F.lower(place), F.substring(url, F.length(place) + 1, F.length(url)))
    keyed = both.withColumn("__key", F.when(F.col("type") == "rss", F.concat(F.lit("rss:"), at)).otherwise(preset_key(F.col("type"), F.col("config")))).withColumn("__o", F.struct("__new", "ord"))
    return keep_first(keyed, "__key", order="__o").drop("__key", "__new", "__o")


def _said(low: Column, words: Column) -> Column:
    """How many of the words a lower-cased text holds, as a word or within one."""
    return F.size(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.contains(low, F.lower(w)))).cast("double")


def interest_scores(interests: DataFrame, domains: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``interests(id, text)`` against the preset ``domains(domain, keywords, sources)`` -> ``(id, domain, score)``.

    A keyword that the text holds gives 1, a tag of one of the domain's sources 0.3, over the number of keywords (at
    least 1) and at most 1; scores under ``threshold`` are left out. ``sources`` are structs with ``tags``. A null
    text scores nothing. Presets are a fixed table of a few rows, so the pairing is bounded by the interests; what
    is scored is a substring, which no equality join can find.
    """
    pairs = interests.select("id", "text").join(F.broadcast(domains.select("domain", "keywords", "sources")))
    low = F.lower("text")
    tags = F.flatten(F.transform("sources", lambda s: F.coalesce(s["tags"], F.array().cast("array<string>"))))
    score = (_said(low, F.col("keywords")) + 0.3 * _said(low, tags)) / F.greatest(F.size("keywords"), F.lit(1))
    return pairs.select("id", "domain", F.least(score, F.lit(1.0)).alias("score")).where((F.col("score") >= threshold) & F.col("text").isNotNull())


def source_scores(interests: DataFrame, domains: DataFrame, aliases: dict[str, list[str]] | None = None, threshold: float = 0.1) -> DataFrame:
    """``interests(id, text)`` against each preset source -> ``(id, source, score)``, a source by its key (``preset_key``), in its first domain.

    A keyword of the domain gives 1, a tag or one of its ``aliases`` 0.5, a word of at least three characters that is
    also one of the source's description 0.3, over the number of distinct words of the text (at least 1) and at most 1.
    ``domains(ord, keywords, sources)`` with structs of ``type``, ``description``, ``tags`` and ``config``.
    """
    each = domains.select("ord", "keywords", F.posexplode("sources").alias("at", "s")).withColumn("source", preset_key(F.col("s.type"), F.col("s.config")))
    first = each.groupBy("source").agg(F.min_by(F.struct("keywords", "s"), F.struct("ord", "at")).alias("x")).select("source", "x.keywords", "x.s.tags", "x.s.description")
    known = F.create_map([F.lit(x) for k, v in (aliases or {}).items() for x in (k.lower(), "\x1f".join(v))]) if aliases else None
    low = F.lower("text")
    words = F.array_distinct(F.array_remove(F.split(F.trim(F.regexp_replace(low, f"[{tx.GAP_CLASS}]+", " ")), " "), ""))
    forms = lambda t: F.array(t) if known is None else F.concat(F.array(t), F.coalesce(F.split(F.try_element_at(known, F.lower(t)), "\x1f"), F.array().cast("array<string>")))
    tagged = F.size(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: _said(low, forms(t)) > 0))
    shared = F.size(F.filter(F.array_intersect(words, F.split(F.lower(F.coalesce("description", F.lit(""))), f"[{tx.GAP_CLASS}]+")), lambda w: F.length(w) >= 3))
    score = (_said(low, F.col("keywords")) + 0.5 * tagged + 0.3 * shared) / F.greatest(F.size(words), F.lit(1))
    pairs = interests.select("id", "text").where("text is not null").join(F.broadcast(first))
    return pairs.select("id", "source", F.least(score, F.lit(1.0)).alias("score")).where(F.col("score") >= threshold)


def preset_key(kind: Column, config: Column) -> Column:
    """What makes a preset source the same as another: the type with its own name as it is written, else its whole configuration."""
    get = lambda k: F.coalesce(F.try_element_at(config, F.lit(k)), F.lit(""))
    named = F.when(kind == "rss", F.concat(F.lit("rss:"), get("url"))).when(kind == "reddit_subreddit", F.concat(F.lit("reddit:"), get("subreddit")))
    for one in ("reddit_user", "github_user"):
        named = named.when(kind == one, F.concat(F.lit(f"{one}:"), get("username")))
    named = named.when(kind == "github_repo", F.concat(F.lit("github_repo:"), get("owner"), F.lit("/"), get("repo"))).when(kind == "telegram", F.concat(F.lit("telegram:"), get("channel")))
    return named.otherwise(F.concat(F.coalesce(kind, F.lit("")), F.lit(":"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config))))))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """``folder/*/profile.json`` as ``(id, name, file)``; ids that repeat are an error."""
    rows = spark.read.option("multiLine", True).schema("id string, name string").json(f"{folder}/*/profile.json").withColumn("file", F.input_file_name())
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"profile {twice[0]['id']} is there twice")
    return rows


#: What a configured source of a kind has where a preset doesn't say.
DEFAULTS = {"sort": "hot", "subreddit_limit": 15, "subreddit_score": 50, "channel_limit": 20, "stories": 30, "story_score": 100, "comments": 10, "hours": 24}


def toggled(offers: DataFrame, requests: DataFrame, key: str = "request_id") -> DataFrame:
    """``offers(request_id, ord, ...)`` that a request takes: all but those whose number, from 1 in order, its ``toggles`` name; a number named again comes back.

    ``requests(request_id, toggles)``; numbers that no offer has count for nothing, and so does a null list.
    """
    numbered = offers.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("ord")))
    off = F.size(F.filter(F.coalesce("toggles", F.array().cast("array<int>")), lambda t: t == F.col("__n"))) % 2 == 1
    return numbered.join(requests.select(key, "toggles"), key, "left").where(~off).drop("__n", "toggles")


def routed_sources(selected: DataFrame, requests: DataFrame, key: str = "request_id") -> DataFrame:
    """``(request_id, config)``: for each request a configuration's JSON, with the ``selected(request_id, ord, type, config)`` sources in the lists of their kinds.

    Sections without a source are off; stories are on if they were selected, or if nothing was. Unknown types go nowhere.
    """
    get = lambda s, k, default="": F.coalesce(F.try_element_at(s["config"], F.lit(k)), F.lit(default))
    number = lambda s, k, default: F.coalesce(F.try_element_at(s["config"], F.lit(k)).try_cast("int"), F.lit(default))
    of = lambda kinds, make: F.transform(F.filter("__s", lambda s: s["type"].isin(*kinds)), make)
    named = lambda s, *names: [get(s, n).alias(n) for n in names]
    on = F.lit(True).alias("enabled")
    none = F.lit(None).cast("string")

    def github(s: Column) -> Column:
        user = s["type"] == "github_user"
        return F.struct(F.when(user, "user_events").otherwise("repo_releases").alias("type"), on, F.when(user, get(s, "username")).otherwise(none).alias("username"), F.when(user, none).otherwise(get(s, "owner")).alias("owner"), F.when(user, none).otherwise(get(s, "repo")).alias("repo"))

    each = selected.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "type", "config")), lambda a, b: F.sign(a["ord"] - b["ord"]).cast("int")).alias("__s"))  # what one request selected
    rows = requests.select(key).distinct().join(each, key, "left").withColumn("__s", F.coalesce("__s", F.array().cast("array<struct<ord:bigint,type:string,config:map<string,string>>>")))
    subreddits = of(("reddit_subreddit",), lambda s: F.struct(*named(s, "subreddit"), get(s, "sort", DEFAULTS["sort"]).alias("sort"), number(s, "fetch_limit", DEFAULTS["subreddit_limit"]).alias("fetch_limit"), number(s, "min_score", DEFAULTS["subreddit_score"]).alias("min_score")))
    users = of(("reddit_user",), lambda s: F.struct(*named(s, "username")))
    channels = of(("telegram",), lambda s: F.struct(*named(s, "channel"), number(s, "fetch_limit", DEFAULTS["channel_limit"]).alias("fetch_limit")))
    stories = (F.size("__s") == 0) | F.exists("__s", lambda s: s["type"] == "hackernews")
    sources = F.struct(
        of(("github_user", "github_repo"), github).alias("github"),
        F.struct(F.coalesce(stories, F.lit(False)).alias("enabled"), F.lit(DEFAULTS["stories"]).alias("fetch_top_stories"), F.lit(DEFAULTS["story_score"]).alias("min_score")).alias("hackernews"),
        of(("rss",), lambda s: F.struct(*named(s, "name", "url"), on, *named(s, "category"))).alias("rss"),
        F.struct((F.size(subreddits) + F.size(users) > 0).alias("enabled"), subreddits.alias("subreddits"), users.alias("users"), F.lit(DEFAULTS["comments"]).alias("fetch_comments")).alias("reddit"),
        F.struct((F.size(channels) > 0).alias("enabled"), channels.alias("channels")).alias("telegram"),
    )
    return rows.select(key, F.to_json(F.struct(sources.alias("sources"), F.struct(F.lit(DEFAULTS["hours"]).alias("time_window_hours")).alias("collection"))).alias("config"))


def with_definitions(items: DataFrame, known: DataFrame, key: str = "profile_id") -> DataFrame:
    """``items`` with the columns of their profile in ``known(id, ...)``; a profile that isn't known is an error, and so is one that is known twice."""
    twice = known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"profile {twice[0]['id']} is there twice")
    missed = items.join(known.select(F.col("id").alias(key)), key, "left_anti").select(key).limit(1).collect()
    if missed:
        raise ValueError(f"unknown profile: {missed[0][key]}")
    return items.join(known.withColumnRenamed("id", key), key)


def invalid_routes(routes: DataFrame, known: DataFrame) -> DataFrame:
    """``routes(ord, profile)`` that name nothing, a name twice, ``auto`` in a list, or an unknown profile."""
    clean = F.transform("profile", tx.strip)
    bad = (F.size("profile") == 0) | F.exists(clean, lambda x: x == "") | (F.size(F.array_distinct(clean)) != F.size("profile")) | ((F.size("profile") > 1) & F.array_contains(clean, "auto"))
    unknown = routes.select("ord", F.explode(clean).alias("id")).where("id <> 'auto'").join(known.select("id"), "id", "left_anti").select("ord").distinct().withColumn("__u", F.lit(True))
    return routes.join(unknown, "ord", "left").where(F.col("profile").isNotNull() & (bad | F.coalesce("__u", F.lit(False)))).drop("__u")
