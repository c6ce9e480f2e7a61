"""Messages of an issue by delivery mode: one summary, an overview and an item each, or headlines in chunks; every row knows its issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from .evidence import in_languages
from .render import display_name, item_markdown
from .text_packing import HEADLINE_CHARS, packed_lines

#: Modes of delivery.
SUMMARY, ITEMS, HEADLINES = "summary", "summary_and_items", "headlines"
_COLUMNS = "date string, seq int, kind string, title string, summary string, item_index int, item_count long, profile_index int, profile_count long, profile_id string, item_title string, item_url string, item_score string"


def ranked(items: DataFrame) -> DataFrame:
    """Items with their places in the issue of their ``date`` and in their profile there; profiles as they first appear."""
    rows = items.withColumn("profile_id", F.coalesce("profile_id", F.lit("unclassified")))
    mine = Window.partitionBy("date", "profile_id")
    rows = rows.withColumn("group_index", F.row_number().over(mine.orderBy("ord"))).withColumn("group_count", F.count("*").over(mine)).withColumn("__first", F.min("ord").over(mine))
    issue = Window.partitionBy("date")
    rows = rows.withColumn("global_index", F.row_number().over(issue.orderBy("__first", "ord"))).withColumn("item_count", F.count("*").over(issue))
    return rows.drop("__first").withColumn("anchor", urls.anchor(F.col("profile_id"), F.col("group_index")))


def _score(score: Column) -> Column:
    return F.coalesce(score.cast("string"), F.lit("?"))


def daily_messages(items: DataFrame, issues: DataFrame, *, delivery: str = SUMMARY, overview_last: bool = False, language: str = "en", languages: list[str] | None = None, names: dict[str, str] | None = None, brand: str = "Digest", base: str | None = None, limit: int = HEADLINE_CHARS) -> DataFrame:
    """``(date, seq, kind, title, summary, ...)``: the messages of each issue, to be sent by ``seq``.

    ``issues(date, total, markdown)`` each have the ``items`` of their date. By ``delivery`` an issue is one message with its
    Markdown; or an overview and a message for each item, the overview first, or last after the items in reverse; or
    its headlines, packed into messages of at most ``limit`` characters, linked to pages below ``base`` if given. Nothing is sent in
    a language that isn't among ``languages`` (none or an empty list: all are).
    """
    if delivery not in (SUMMARY, ITEMS, HEADLINES):
        raise ValueError(f"unknown delivery: {delivery}")
    wanted = F.lit(None).cast("array<string>") if languages is None else F.array(*map(F.lit, languages)).cast("array<string>")
    issues = issues.where(in_languages(F.lit(language), wanted))

    def row(df: DataFrame, **made: Column) -> DataFrame:
        return df.select(*[made.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (c.split(" ") for c in _COLUMNS.split(", "))])

    day = lambda kind: F.concat(F.lit(f"{brand} "), "date", F.lit(f" {kind}"))
    if delivery == SUMMARY:
        return row(issues, date=F.col("date"), seq=F.lit(0), kind=F.lit("summary"), title=day("Daily"), summary=F.col("markdown"))
    seen = ranked(items.join(issues.select("date"), "date", "left_semi"))
    title = F.coalesce("artifact.title", "title")
    if delivery == HEADLINES:
        page = F.concat(F.lit(f"{(base or '').rstrip('/')}/"), "date", F.lit(f"-{language}/"), F.regexp_replace("anchor", "^item-", ""), F.lit("/")) if base else F.col("url")
        line = F.concat(F.col("global_index").cast("string"), F.lit(". "), F.when(urls.is_markdown_link(page), F.concat(F.lit("["), tx.escaped_markdown(title), F.lit("]("), page, F.lit(")"))).otherwise(tx.escaped_markdown(title)))
        lines = seen.groupBy("date").agg(F.transform(F.array_sort(F.collect_list(F.struct("global_index", line.alias("line")))), lambda x: x["line"]).alias("lines"))  # one issue's headlines
        chunks = lines.select("date", F.posexplode(packed_lines(F.col("lines"), limit)).alias("seq", "chunk"))
        return row(chunks, date=F.col("date"), seq=F.col("seq"), kind=F.lit("headlines"), title=F.concat(F.lit(f"{brand} "), "date"), summary=F.col("chunk"))
    name = display_name(F.col("profile_id"), names or {})
    n = F.col("global_index").cast("int")
    order = F.col("item_count").cast("int") - n if overview_last else n
    each = row(seen, date=F.col("date"), seq=order, kind=F.lit("item"), title=F.concat(name, F.lit(" "), F.col("group_index").cast("string"), F.lit("/"), F.col("group_count").cast("string"), F.lit(" "), title), summary=item_markdown(language), item_index=n, item_count=F.col("item_count"), profile_index=F.col("group_index"), profile_count=F.col("group_count"), profile_id=F.col("profile_id"), item_title=title, item_url=F.col("url"), item_score=F.when(F.col("score").isNotNull(), F.col("score").cast("string")).otherwise(""))
    link = urls.html_link(F.col("url"))
    said = tx.escaped_markdown(title)
    line = F.concat(F.col("group_index").cast("string"), F.lit(". "), F.when(link != "", F.concat(F.lit("["), said, F.lit("]("), link, F.lit(")"))).otherwise(said), F.lit(" ⭐️ "), _score(F.col("score")), F.lit("/10"))
    lead = F.when(F.col("group_index") == 1, F.concat(F.lit("**"), tx.escaped_markdown(name), F.lit("**\n"), line)).otherwise(line)
    listed = seen.groupBy("date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("global_index", lead.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n"))  # one issue's items
    heads = issues.join(listed, "date", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = row(heads, date=F.col("date"), seq=F.col("n").cast("int") if overview_last else F.lit(0), kind=F.lit("overview"), title=day("Overview"), summary=F.concat(F.lit(f"# {brand} - "), "date", F.lit("\n\n> "), F.col("n").cast("string"), F.lit("/"), F.col("total").cast("string"), F.when(F.col("n") > 0, F.concat(F.lit("\n\n"), "lines")).otherwise("")), item_count=F.col("n"))
    return first.unionByName(each)
