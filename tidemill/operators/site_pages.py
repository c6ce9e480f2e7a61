"""The page of a verification run: reports, items, claims, cards and snapshots as one nested table, its Markdown, and HTML that strangers wrote made inert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times, urls
from ..functions.udfs import let
from . import verify

#: Stances that are shown, and tags that untrusted HTML may keep.
SHOWN = ("supports", "contradicts", "context")
TAGS = ("a", "b", "blockquote", "br", "code", "em", "i", "li", "ol", "p", "pre", "s", "strong", "u", "ul")
VOID = ("br",)
_SOURCES = "array<struct<url:string,stance:string,source_class:string>>"
_TOKENS = r"(?s)(<!--.*?-->|</?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<)"


def page_models(reports: DataFrame, items: DataFrame, claims: DataFrame, cards: DataFrame, snapshots: DataFrame) -> DataFrame:
    """A row for each report: its item, and its claims in order, each with its sources.

    ``reports(report_id, item_id, checked_at, status_by_claim, evidence_ids_by_claim)`` name their claims and cards; what they name
    and isn't there is left out. ``items(item_id, title, url, published_at)``, ``claims(claim_id, kind, source_text,
    normalized_claim)``, ``cards(evidence_id, snapshot_id, stance, source_class)``, ``snapshots(snapshot_id, final_url)``.
    A source is shown once for each stance, where it comes first. Rows are dealt out by claim and then by report; cards and snapshots are looked up where they are small.
    """
    said = reports.select("report_id", F.posexplode_outer(F.map_entries("status_by_claim")).alias("at", "s"), "evidence_ids_by_claim").where("s is not null")
    said = said.select("report_id", "at", F.col("s.key").alias("claim_id"), F.col("s.value").alias("status"), F.array_distinct(F.try_element_at("evidence_ids_by_claim", F.col("s.key"))).alias("ids"))
    kind = verify.conservative_kind(F.coalesce("kind", F.lit("other")), F.coalesce("source_text", F.lit("")), F.coalesce("normalized_claim", F.lit("")))
    words = claims.select("claim_id", tx_or("source_text", "normalized_claim").alias("text"), kind.alias("kind"))
    # what is joined once, in the order that costs least: a claim's words while it is one row, then its cards, which may be broadcast
    known = said.join(words, "claim_id").select("report_id", "at", F.monotonically_increasing_id().alias("row"), F.struct("text", "kind", "status").alias("claim"), "ids")
    named = known.select("report_id", "at", "row", "claim", F.posexplode_outer("ids").alias("n", "evidence_id"))
    shown = cards.where(F.col("stance").isin(*SHOWN)).select("evidence_id", "snapshot_id", "stance", "source_class")
    kept = snapshots.select("snapshot_id", F.col("final_url").alias("url"), F.lit(True).alias("there"))
    source = F.when(F.col("there"), F.struct(F.concat_ws("\0", "stance", "url").alias("pair"), F.struct("url", "stance", "source_class").alias("shown"))).alias("source")
    head_row = F.coalesce("n", F.lit(0)) == 0  # the row that holds the claim, whether or not its card is there
    rows = named.join(shown, "evidence_id", "left").join(kept, "snapshot_id", "left").where(head_row | F.col("there"))
    row = F.struct("at", "row", F.coalesce("n", F.lit(0)).alias("n"), F.when(head_row, F.col("claim")).alias("claim"), source)
    said_of = rows.select("report_id", row.alias("x")).repartition("report_id").groupBy("report_id").agg(F.sort_array(F.collect_list("x")).alias("rows"))  # of one report
    item = items.select("item_id", "title", F.col("url").alias("item_url"), "published_at")
    age = F.when(F.col("published_at").isNotNull() & F.col("checked_at").isNotNull(), F.greatest(F.lit(0.0), times.age_hours(F.col("published_at").cast("timestamp"), F.col("checked_at").cast("timestamp"))))
    head = reports.select("report_id", "item_id", "checked_at").join(item, "item_id", "left").withColumn("age_hours", age)
    none = F.array().cast(f"array<struct<text:string,kind:string,status:string,public_status:string,sources:{_SOURCES}>>")
    return head.join(said_of, "report_id", "left").select("report_id", "item_id", "title", F.col("item_url").alias("url"), "published_at", "checked_at", "age_hours", F.coalesce(_nested(F.col("rows"), F.col("age_hours")), none).alias("claims"))


def _nested(rows: Column, age_hours: Column) -> Column:
    """The claims of a report from its sorted ``rows(at, row, n, claim, source)``: those of one claim follow each other, its own first."""

    def sources(xs: Column) -> Column:
        there = F.filter(xs, lambda s: s.isNotNull())
        again = lambda all_, pairs: F.filter(all_, lambda s, i: F.array_position(pairs, s["pair"]) == i + 1)["shown"]
        return let(there, lambda all_: F.when(F.size(all_) < 2, all_["shown"]).otherwise(let(all_["pair"], lambda pairs: again(all_, pairs))))

    def claim(x: Column, xs: Column) -> Column:
        c = x["claim"]
        return F.struct(x["at"].alias("at"), F.struct(c["text"].alias("text"), c["kind"].alias("kind"), c["status"].alias("status"), verify.public_status(c["kind"], c["status"], age_hours).alias("public_status"), sources(xs).alias("sources")).alias("c"))

    def all_of(xs: Column) -> Column:
        begins = let(xs["row"], lambda of: F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda i: (i == 0) | (F.get(of, i) != F.get(of, i - 1))))
        part = lambda at, i, k: F.slice(xs["source"], i + 1, F.coalesce(F.get(at, k + 1), F.size(xs)) - i)
        return let(begins, lambda at: F.transform(at, lambda i, k: claim(F.get(xs, i), part(at, i, k))))

    return F.sort_array(let(rows, all_of))["c"]


#: Public statuses that leave a page provisional beside a provisional claim.
SETTLED = ("provisional", "official_announcement", "official_release", "attributed_quote", "corroborated_event", "source_documented_quantity", "source_supported")


def page_state(statuses: Column, public: Column, unchecked: Column, verification_error: Column, audit_status: Column) -> Column:
    """The state of a report on its page, from its claims' ``statuses`` and ``public`` statuses (of those that are there).

    A failed check comes first, then that there is nothing to show; spans without a claim make it partial, and it is provisional only
    if all other claims are settled.
    """
    within = lambda xs, allowed: F.forall(xs, lambda x: x.isin(*allowed))
    failed = F.coalesce(verification_error, F.lit(False)) | F.array_contains(statuses, "verification_error") | F.coalesce(audit_status == "error", F.lit(False))
    return (
        F.when(failed, "check_error")
        .when(F.size(public) == 0, "not_applicable")
        .when(F.coalesce(unchecked, F.lit(0)) > 0, "partial")
        .when(within(public, ("anecdotal", "not_applicable")), "not_applicable")
        .when(F.array_contains(public, "provisional") & within(public, SETTLED), "provisional")
        .when(F.arrays_overlap(statuses, F.array(F.lit("insufficient_evidence"), F.lit("not_checkable"))), "partial")
        .otherwise("complete")
    )


def tx_or(*names: str) -> Column:
    """The first of the columns that has a text."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def page_sections(models: DataFrame, *, statuses: dict[str, str], source: str = "Source", untitled: str = "Untitled") -> DataFrame:
    """``(report_id, markdown)``: a heading that links to the item, then each claim with its status and safe links to its sources.

    Titles, claims and names are untrusted: all that Markdown or HTML would read in them is escaped, and a link
    that isn't safe becomes its name.
    """
    label = F.create_map(*[F.lit(x) for p in statuses.items() for x in p]) if statuses else F.create_map().cast("map<string,string>")
    title = tx.escaped_markdown(F.coalesce(tx_or("title", "item_id"), F.lit(untitled)))
    heading = F.when(urls.is_markdown_link(F.col("url")), F.concat(F.lit("### ["), title, F.lit("]("), F.col("url"), F.lit(")"))).otherwise(F.concat(F.lit("### "), title))

    def link(s: Column, i: Column) -> Column:
        name = tx.escaped_markdown(F.coalesce(F.nullif(urls.site(s["url"]), F.lit("")), F.concat(F.lit(f"{source} "), (i + 1).cast("string"))))
        return F.concat(F.lit("  - "), F.when(urls.is_markdown_link(s["url"]), F.concat(F.lit("["), name, F.lit("]("), s["url"], F.lit(")"))).otherwise(name), F.lit(" · "), s["stance"])

    def claim(c: Column) -> Column:
        text = tx.escaped_markdown(F.regexp_replace(F.coalesce(c["text"], F.lit("")), "\\s+", " "))
        return F.array_join(F.concat(F.array(F.concat(F.lit("- **"), F.coalesce(F.try_element_at(label, c["public_status"]), c["public_status"]), F.lit("** "), text)), F.transform(c["sources"], link)), "\n")

    body = F.array_join(F.transform("claims", claim), "\n")
    return models.select("report_id", F.concat(heading, F.when(F.size("claims") > 0, F.concat(F.lit("\n\n"), body)).otherwise("")).alias("markdown"))


def _text(x: Column) -> Column:
    """A piece of text in which nothing opens a tag; entities stay what they are."""
    amp = F.regexp_replace(x, "&(?!(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});)", "&amp;")
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _href(tag: Column) -> Column:
    found = F.regexp_extract(tag, "(?is)^<a\\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?(?<=\\s)href\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')", 0)
    return F.regexp_extract(found, "(?is)href\\s*=\\s*[\"'](.*)[\"']$", 1)


def sanitized_html(text: Column, tags: tuple[str, ...] = TAGS) -> Column:
    """Untrusted HTML with the allowed tags only, made anew: an ``a`` has a safe web address or goes, others have no attributes.

    The text is read as tags, comments and text between them. Other tags and comments go and their text stays, escaped; the insides of
    scripts and styles go with them. An end without its beginning goes, and what is left open is closed at the end, so
    what comes out nests whatever came in. Of null, null.
    """
    state = lambda out, open_, skip: F.struct(out.alias("out"), open_.alias("open"), skip.alias("skip"))
    start = state(F.lit(""), F.array().cast("array<string>"), F.lit(""))
    closing = lambda names: F.array_join(F.transform(F.reverse(names), lambda n: F.concat(F.lit("</"), n, F.lit(">"))), "")

    def step(s: Column, t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
        comment, tag, end = t.startswith("<!--"), (name != "") & t.endswith(">"), t.startswith("</")
        allowed = name.isin(*tags)
        href = _href(t)
        made = F.when(name != "a", F.concat(F.lit("<"), name, F.lit(">"))).when(urls.is_safe_link(F.replace(href, F.lit("&amp;"), F.lit("&"))), F.concat(F.lit('<a href="'), urls.html_link(F.replace(href, F.lit("&amp;"), F.lit("&"))), F.lit('" rel="nofollow">')))
        at = F.array_position(F.reverse(s["open"]), name)  # the innermost, from 1
        rest = F.slice(s["open"], F.lit(1), F.size(s["open"]) - at.cast("int"))
        inner = F.slice(s["open"], F.size(s["open"]) - at.cast("int") + 1, at.cast("int"))
        none = F.lit("")
        return (
            F.when(s["skip"] != "", F.when(end & (name == s["skip"]), state(s["out"], s["open"], none)).otherwise(s))
            .when(comment, s)
            .when(tag & ~end & name.isin("script", "style"), state(s["out"], s["open"], name))
            .when(tag & ~end & allowed & made.isNotNull(), state(F.concat(s["out"], made), F.when(name.isin(*VOID), s["open"]).otherwise(F.concat(s["open"], F.array(name))), none))
            .when(tag & end & allowed & (at > 0), state(F.concat(s["out"], closing(inner)), rest, none))
            .when(tag, s)
            .otherwise(state(F.concat(s["out"], _text(t)), s["open"], none))
        )

    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(1))
    return let(tokens, lambda all_: F.aggregate(all_, start, step, lambda s: F.concat(s["out"], closing(s["open"]))))
