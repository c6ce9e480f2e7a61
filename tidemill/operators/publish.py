"""What is published of a verification: artifact audits, payloads, their markup, and cards for chats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times, urls
from . import verify
from .render import item_markdown, view

UNCHECKED = ("not_checkable", "verification_error")
#: States after which an article shows no summary of its check.
SILENT = ("not_checked", "check_error", "check_failed", "not_applicable")


def artifact_fields(items: DataFrame, artifacts: str = "artifacts") -> DataFrame:
    """``(item_id, field_id, language, source_kind, block_id, text)`` of every title and block, by language."""
    e = items.select("item_id", F.explode(F.map_entries(artifacts)).alias("a")).select("item_id", F.col("a.key").alias("language"), F.col("a.value").alias("v"))
    title = F.array(F.struct(F.concat("language", F.lit(":title")).alias("field_id"), F.lit("title").alias("source_kind"), F.lit(None).cast("string").alias("block_id"), F.col("v.title").alias("text")))
    blocks = F.transform("v.blocks", lambda b, i: F.struct(F.concat(F.col("language"), F.lit(":block:"), i.cast("string"), F.lit(":"), b["id"]).alias("field_id"), F.lit("block").alias("source_kind"), b["id"].alias("block_id"), b["content"].alias("text")))
    return e.select("item_id", "language", F.explode(F.concat(title, F.coalesce(blocks, F.array().cast("array<struct<field_id:string,source_kind:string,block_id:string,text:string>>")))).alias("f")).select("item_id", "language", "f.*")


def audited_spans(fields: DataFrame, proposals: DataFrame, claims: DataFrame) -> DataFrame:
    """``proposals(item_id, field_id, source_text, normalized_claim, mapped_claim_id)`` placed in their fields.

    ``error`` says why a proposal doesn't hold: blank, an unknown field or claim, a span that is missing or
    ambiguous, or one that is there twice. A claim matches only if it was checked.
    """
    known = claims.select("item_id", F.col("claim_id").alias("mapped_claim_id"), "status")
    rows = proposals.join(fields, ["item_id", "field_id"], "left").join(known, ["item_id", "mapped_claim_id"], "left")
    start = verify.span_start(F.col("text"), F.col("source_text"))
    rows = rows.withColumn("source_start", start).withColumn("source_end", F.col("source_start") + F.length("source_text"))
    twice = rows.where("source_start is not null").groupBy("item_id", "field_id", "source_start", "source_end").agg(F.count("*").alias("n")).where("n > 1").drop("n").withColumn("twice", F.lit(True))
    rows = rows.join(twice, ["item_id", "field_id", "source_start", "source_end"], "left")
    blank = (tx.strip(F.col("source_text")) == "") | (tx.strip(F.col("normalized_claim")) == "")
    error = F.when(blank, "blank").when(F.col("language").isNull(), "unknown_field").when(F.col("mapped_claim_id").isNotNull() & F.col("status").isNull(), "unknown_claim").when(~F.contains("text", F.col("source_text")), "not_exact").when(F.col("source_start").isNull(), "ambiguous").when(F.col("twice"), "duplicate")
    matched = F.when(~F.col("status").isin(*UNCHECKED), F.col("mapped_claim_id"))
    return rows.select("item_id", "field_id", "language", "source_kind", "block_id", "source_start", "source_end", "source_text", tx.strip(F.col("normalized_claim")).alias("normalized_claim"), F.col("mapped_claim_id").alias("suggested_claim_id"), matched.alias("matched_claim_id"), F.when(matched.isNotNull(), F.col("status")).alias("verification_status"), error.alias("error"))


def unchecked_by_language(spans: DataFrame) -> DataFrame:
    """Spans without a checked claim, listed by language."""
    return spans.where("error is null and matched_claim_id is null").groupBy("item_id", "language").agg(F.array_sort(F.collect_list(F.struct("field_id", "source_start", "source_text"))).alias("spans"))


def payloads(items: DataFrame, claims: DataFrame, sources: DataFrame, checked: dt.datetime) -> DataFrame:
    """``items(item_id, published_at, state, language)`` with the small payload that may be published.

    ``claims(item_id, claim_id, ord, text, kind, status)``, ``sources`` as :func:`verify.public_sources` gives them.
    """
    at = F.lit(checked)
    age = times.age_hours(F.col("published_at"), at)
    shown = sources.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url", "stance", "source_class"))), lambda s: F.struct(s["url"].alias("url"), s["stance"].alias("stance"), s["source_class"].alias("source_class"))).alias("sources"))
    rows = claims.join(items.select("item_id", "published_at"), "item_id").join(shown, "claim_id", "left")
    row = F.struct("ord", F.struct("text", "kind", "status", verify.public_status(F.col("kind"), F.col("status"), age).alias("public_status"), F.coalesce("sources", F.array().cast("array<struct<url:string,stance:string,source_class:string>>")).alias("sources")).alias("c"))
    said = rows.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["c"]).alias("claims"), F.min(times.next_check(F.col("kind"), F.col("status"), F.col("published_at"), at)).alias("next"))
    none = F.array().cast("array<struct<text:string,kind:string,status:string,public_status:string,sources:array<struct<url:string,stance:string,source_class:string>>>>")
    payload = F.struct(F.lit("public-verification/v1").alias("schema_version"), "state", F.coalesce("claims", none).alias("claims"), F.when(F.col("state") != "not_checked", times.stamp(at)).alias("checked_at"), times.stamp(F.col("published_at")).alias("published_at"), F.round(age, 1).alias("source_age_hours"), F.col("language"), times.stamp(F.col("next")).alias("next_check_at"))
    return items.join(said, "item_id", "left").select("item_id", payload.alias("payload"))


def _html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _root(language: Column) -> Column:
    return F.split_part(F.replace(F.lower(language), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))


def _label(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key) if table else F.lit(None).cast("string")
    return found if default is None else F.coalesce(found, F.lit(default))


def verification_markup(payload: str, language: str, copy: dict) -> Column:
    """Claims with their statuses and sources as HTML; empty in another language or without a claim to show.

    ``copy``: ``title``, ``source``, ``unknown`` and the tables ``statuses``, ``stances`` and ``source_classes``.
    """
    def source(s: Column, i: Column) -> Column:
        details = F.array_join(F.array_compact(F.array(_label(copy["stances"], s["stance"]), _label(copy["source_classes"], s["source_class"]))), " · ")
        name = F.coalesce(F.nullif(urls.site(s["url"]), F.lit("")), F.concat(F.lit(f"{copy['source']} "), (i + 1).cast("string")))
        return F.when(urls.is_safe_link(s["url"]), F.concat(F.lit('<li><a href="'), urls.html_link(s["url"]), F.lit('">'), _html(name), F.lit("</a>"), F.when(details != "", F.concat(F.lit(" · "), details)).otherwise(F.lit("")), F.lit("</li>")))

    def claim(c: Column) -> Column:
        lines = F.array_compact(F.transform(c["sources"], source))
        listed = F.when(F.size(lines) > 0, F.concat(F.lit('<ul class="sources">\n'), F.array_join(lines, "\n"), F.lit("\n</ul>\n"))).otherwise(F.lit(""))
        status = F.coalesce(c["public_status"], c["status"])
        return F.concat(F.lit('<li data-status="'), _html(status), F.lit('">\n<span>'), _label(copy["statuses"], status, copy["unknown"]), F.lit("</span>\n<p>"), _html(c["text"]), F.lit("</p>\n"), listed, F.lit("</li>"))

    real = F.filter(f"{payload}.claims", lambda c: ~c["status"].isin("verification_error", "check_error"))
    own = F.col(f"{payload}.language").isNull() | (_root(F.col(f"{payload}.language")) == language.lower().replace("_", "-").partition("-")[0])
    return F.when(own & (F.size(real) > 0), F.concat(F.lit(f'## {copy["title"]}\n\n<ol class="verification">\n'), F.array_join(F.transform(real, claim), "\n"), F.lit("\n</ol>"))).otherwise(F.lit(""))


def status_counts(payloads_: DataFrame) -> DataFrame:
    """Claims by public status of the items that show a summary."""
    c = payloads_.where(~F.col("payload.state").isin(*SILENT)).select("item_id", F.explode("payload.claims").alias("c"))
    status = F.coalesce("c.public_status", "c.status")
    return c.where(~status.isin("verification_error", "check_error")).groupBy("item_id", status.alias("public_status")).agg(F.count("*").alias("claims"))


def chat_card(items: DataFrame, heading: str, overview: str, language: str = "en") -> DataFrame:
    """One card as JSON: the overview, then a closed panel an item under its profile."""
    md = lambda x: F.struct(F.lit("markdown").alias("tag"), x.alias("content"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("boolean").alias("expanded"))
    title = F.concat(F.col("group_index").cast("string"), F.lit(". "), F.coalesce("artifact.title", "title"), F.when(F.col("score").isNotNull(), F.concat(F.lit(" ⭐️ "), F.col("score").cast("string"), F.lit("/10"))).otherwise(F.lit("")))
    panel = F.struct(F.lit("collapsible_panel").alias("tag"), item_markdown(language).alias("content"), title.alias("title"), F.lit(False).alias("expanded"))
    each = F.when(F.col("group_index") == 1, F.array(md(F.concat(F.lit("## "), "profile_id")), panel)).otherwise(F.array(panel))
    body = view(items, language).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("global_index", each.alias("e")))), lambda x: x["e"])).alias("e"))
    card = F.struct(F.lit("2.0").alias("schema"), F.struct(F.struct(F.struct(F.lit("plain_text").alias("tag"), F.lit(heading).alias("content")).alias("title")).alias("title")).alias("header"), F.struct(F.concat(F.array(md(F.lit(overview))), F.col("e")).alias("elements")).alias("body"))
    return body.select(F.to_json(F.struct(F.lit("interactive").alias("msg_type"), card.alias("card"))).alias("json"))
