"""Rendering: Markdown issues, overviews, article pages, search documents and their search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times, urls
from .select import view_ranks

#: What an issue says around its items.
LABELS = {
    "en": {"selected": "From {total} items, {selected} important content pieces were selected", "empty": "Analyzed {total} items, but none met the importance threshold.", "discussion": "Discussion", "references": "References", "tags": "Tags"},
    "ru": {"selected": "Из {total} материалов отобрано {selected}", "empty": "Проанализировано {total} материалов, ни один не прошёл порог.", "discussion": "Обсуждение", "references": "Источники", "tags": "Теги"},
}


def source_line(source: Column, metadata: Column, author: Column, published: Column) -> Column:
    get = lambda k: F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit(""))
    who = F.coalesce(get("feed_name"), F.nullif(author, F.lit("")), F.lit("unknown"))
    return F.concat_ws(" · ", tx.escaped_markdown(source), tx.escaped_markdown(F.concat(F.lit("r/"), get("subreddit"))), tx.escaped_markdown(who), times.byline(published))


def item_markdown(language: str = "en", level: int = 3) -> Column:
    """One item's Markdown from ``title url score summary tags metadata source_type author published_at artifact group_index anchor``.

    Everything that comes from outside is escaped; links that aren't safe stay texts.
    """
    labels = LABELS.get(language, LABELS["en"])
    title, link = tx.escaped_markdown(F.coalesce("artifact.title", "title")), urls.html_link(F.col("url"))
    head = F.when(link != "", F.concat(F.lit("["), title, F.lit("]("), link, F.lit(")"))).otherwise(title)
    talk = F.try_element_at("metadata", F.lit("discussion_url"))
    more = F.when(urls.is_safe_link(talk) & (talk != F.col("url")), F.concat(F.lit(f" · [{labels['discussion']}]("), urls.html_link(talk), F.lit(")"))).otherwise(F.lit(""))
    lead = F.try_element_at(F.filter("artifact.blocks", lambda b: b["primary"]), F.lit(1))["content"]
    said = F.when(F.col("artifact").isNull(), tx.escaped_markdown(F.col("summary"))).otherwise(tx.escaped_markdown(lead))
    blocks = F.transform(F.filter("artifact.blocks", lambda b: ~b["primary"]), lambda b: F.concat(F.lit("**「"), tx.escaped_markdown(b["title"]), F.lit("」** "), tx.escaped_markdown(b["content"])))

    def reference(r: Column) -> Column:
        name = F.replace(F.replace(F.replace(F.replace(r["title"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
        to = urls.html_link(r["url"])
        return F.when(to != "", F.concat(F.lit('<li><a href="'), to, F.lit('">'), name, F.lit("</a></li>"))).otherwise(F.concat(F.lit("<li>"), name, F.lit("</li>")))

    refs = F.when(F.size("artifact.sources") > 0, F.concat(F.lit(f"<details><summary>{labels['references']}</summary>\n<ul>\n"), F.array_join(F.transform("artifact.sources", reference), "\n"), F.lit("\n</ul>\n</details>")))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(f"**{labels['tags']}**: "), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("`#"), tx.escaped_markdown(t), F.lit("`"))), ", ")))
    heading = F.concat(F.lit('<a id="'), "anchor", F.lit(f'"></a>\n{"#" * level} '), head, F.lit(" ⭐️ "), F.coalesce(F.col("score").cast("string"), F.lit("?")), F.lit("/10"))
    parts = F.array(heading, said, F.concat(source_line(F.col("source_type"), F.col("metadata"), F.col("author"), F.col("published_at")), more))
    every = F.concat(parts, F.coalesce(blocks, F.array().cast("array<string>")), F.array(refs, tags, F.lit("---")))
    return F.array_join(F.filter(every, lambda x: x.isNotNull() & (F.btrim(x) != "")), "\n\n")


def view(items: DataFrame, language: str = "en", ranks: dict[str, int] | None = None) -> DataFrame:
    """Items with ranks and anchors; profiles in configured order, unlisted ones last, else by first appearance."""
    rank = None if ranks is None else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), F.col("profile_id")), F.lit(1 << 20)) if ranks else None
    seen = view_ranks(items.withColumn("profile_id", F.coalesce("profile_id", F.lit("unclassified"))), "profile_id", [F.col("ord").asc()], rank)
    return seen.withColumn("anchor", urls.anchor(F.col("profile_id"), F.col("group_index")))


def issue(items: DataFrame, date: str, total: int, *, brand: str = "Digest", language: str = "en", names: dict[str, str] | None = None) -> DataFrame:
    """One row ``(date, language, markdown)``: heading, contents, items. An issue is what people read, so it fits one row."""
    one = items.sparkSession.range(1).select(F.lit(date).alias("date"), F.lit(total).alias("total"))
    return issues(items.withColumn("date", F.lit(date)), one, brand=brand, language=language, names=names)


def issues(items: DataFrame, totals: DataFrame, *, brand: str = "Digest", language: str = "en", names: dict[str, str] | None = None) -> DataFrame:
    """An :func:`issue` for each row of ``totals(date, total)`` with the ``items`` of its ``date``, so rows are as large as one issue."""
    labels = LABELS.get(language, LABELS["en"])
    group = Window.partitionBy("date", "profile_id")
    shown = items.withColumn("profile_id", F.coalesce("profile_id", F.lit("unclassified"))).withColumn("group_index", F.row_number().over(group.orderBy("ord"))).withColumn("first", F.min("ord").over(group))
    shown = shown.withColumn("anchor", urls.anchor(F.col("profile_id"), F.col("group_index")))
    name = display_name(F.col("profile_id"), names or {})
    entry = F.concat(F.col("group_index").cast("string"), F.lit(". ["), tx.escaped_markdown(F.coalesce("artifact.title", "title")), F.lit("](#"), "anchor", F.lit(") ⭐️ "), F.coalesce(F.col("score").cast("string"), F.lit("?")), F.lit("/10"))
    rows = shown.select("date", "first", "profile_id", "group_index", tx.escaped_markdown(name).alias("name"), entry.alias("entry"), item_markdown(language).alias("md"))
    first = F.col("group_index") == 1
    toc = F.when(first, F.concat(F.lit("\n\n**"), "name", F.lit("**\n"), "entry")).otherwise(F.concat(F.lit("\n"), "entry"))
    body = F.when(first, F.concat(F.lit("## "), "name", F.lit("\n\n"), "md")).otherwise(F.col("md"))
    ordered = rows.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("first", "profile_id", "group_index", toc.alias("toc"), body.alias("body")))).alias("r"), F.count("*").alias("n"))
    every = totals.select("date", F.col("total").cast("string").alias("total")).join(ordered, "date", "left")
    cat = lambda k, by: F.array_join(F.transform("r", lambda x: x[k]), by)
    said = F.replace(F.replace(F.lit(labels["selected"]), F.lit("{total}"), F.col("total")), F.lit("{selected}"), F.col("n").cast("string"))
    head = F.concat(F.lit(f"# {brand} - "), "date", F.lit("\n\n> "))
    full = F.concat(head, said, F.lit("\n\n---"), cat("toc", ""), F.lit("\n\n---\n\n"), cat("body", "\n\n"), F.lit("\n"))
    empty = F.concat(head, F.replace(F.lit(labels["empty"]), F.lit("{total}"), F.col("total")), F.lit("\n"))
    return every.select("date", F.lit(language).alias("language"), F.when(F.col("n").isNull(), empty).otherwise(full).alias("markdown"))


def display_name(profile: Column, names: dict[str, str]) -> Column:
    """The configured name, else the id in title case."""
    title = F.initcap(F.regexp_replace(profile, "[-_]+", " "))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), profile), title) if names else title


def overview(items: DataFrame, language: str = "en") -> DataFrame:
    """``(global_index, line)`` of a message that lists the items."""
    link = urls.html_link(F.col("url"))
    title = tx.escaped_markdown(F.col("title"))
    line = F.concat(F.col("group_index").cast("string"), F.lit(". "), F.when(link != "", F.concat(F.lit("["), title, F.lit("]("), link, F.lit(")"))).otherwise(title), F.lit(" ⭐️ "), F.coalesce(F.col("score").cast("string"), F.lit("?")), F.lit("/10"))
    return view(items, language).select("global_index", line.alias("line"))


def article_pages(items: DataFrame, date: str, language: str, base: str) -> DataFrame:
    """A page an item with links to its neighbours, and the path it is at."""
    name = F.concat(urls.slug(F.col("profile_id")), F.lit("-"), F.col("group_index").cast("string"))
    w = Window.orderBy("global_index")  # one issue's items
    pages = view(items, language).withColumn("slug", name)
    to = lambda c: F.when(c.isNotNull(), F.concat(F.lit(f"{base.rstrip('/')}/{date}-{language}/"), c, F.lit("/")))
    return pages.select(F.lit(f"{date}-{language}").alias("issue"), "slug", to(F.col("slug")).alias("url"), to(F.lag("slug").over(w)).alias("previous"), to(F.lead("slug").over(w)).alias("next"), item_markdown(language, 1).alias("markdown"))


def search_documents(items: DataFrame, date: str, language: str, base: str) -> DataFrame:
    """``(id, date, language, title, content, tags, url)`` for the archive's search."""
    name = F.concat(urls.slug(F.col("profile_id")), F.lit("-"), F.col("group_index").cast("string"))
    content = F.coalesce(F.array_join(F.transform("artifact.blocks", lambda b: b["content"]), "\n"), "summary")
    return view(items, language).select(F.concat(F.lit(f"{date}-{language}-"), name).alias("id"), F.lit(date).alias("date"), F.lit(language).alias("language"), F.coalesce("artifact.title", "title").alias("title"), content.alias("content"), "tags", F.concat(F.lit(f"{base.rstrip('/')}/{date}-{language}/"), name, F.lit("/")).alias("url"))


def search_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "(?U)[^\\w]+"), lambda w: w != "")


def _count(terms: Column, word: str) -> Column:
    return F.size(F.filter(terms, lambda x: x == word))


def search(docs: DataFrame, query: str, *, limit: int = 30, title_weight: float = 3.0, k1: float = 1.2, b: float = 0.75, id_col: str = "id", title_col: str = "title", content_col: str = "content", tie: list[Column] | None = None) -> DataFrame:
    """BM25 over title and content, the best ``limit``; ties by ``tie``, then id.

    Only the query's terms are exploded, so what is shuffled is a row for each document and term found.
    """
    import re

    words = sorted({w for w in re.split(r"[^\w]+", query.lower()) if w})
    title, content = search_terms(F.coalesce(F.col(title_col), F.lit(""))), search_terms(F.coalesce(F.col(content_col), F.lit("")))
    rows = docs.select(id_col, (F.size(title) * title_weight + F.size(content)).alias("len"), *[(_count(title, w) * title_weight + _count(content, w)).alias(f"tf{i}") for i, w in enumerate(words)])
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    rows = rows.where(F.greatest(*[F.col(f"tf{i}") for i in range(len(words))], F.lit(0.0)) > 0).crossJoin(F.broadcast(stats)) if words else rows.where("false").crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return rows.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), *(tie or []), F.asc(id_col)).limit(limit)


def headline_messages(items: DataFrame, base: str, date: str, language: str = "en", limit: int = 3900) -> DataFrame:
    """Headlines packed into messages: ``(seq, text)``."""
    from .text_packing import packed_lines

    to = F.concat(F.lit(f"{base.rstrip('/')}/{date}-{language}/"), urls.slug(F.col("profile_id")), F.lit("-"), F.col("group_index").cast("string"), F.lit("/"))
    line = F.concat(F.col("global_index").cast("string"), F.lit(". ["), tx.escaped_markdown(F.col("title")), F.lit("]("), to, F.lit(")"))
    every = view(items, language).agg(F.transform(F.array_sort(F.collect_list(F.struct("global_index", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return every.select(F.posexplode(packed_lines(F.col("lines"), limit)).alias("seq", "text"))
