"""Video captures: captions, coverage, the sidecar inbox."""

from __future__ import annotations

import datetime as dt
import email

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import times
from ..functions.udfs import vectorized
from ..operators.text_packing import rolled_captions

#: Fixed values.
UNREADY = ("is_live", "is_upcoming", "post_live")
INBOX_VERSION = 1
CUE = "((?:[0-9]+:)?[0-9]{2}:[0-9]{2}\\.[0-9]{3})\\s+-->\\s+((?:[0-9]+:)?[0-9]{2}:[0-9]{2}\\.[0-9]{3})"


def _seconds(clock: Column) -> Column:
    parts = F.reverse(F.split(clock, ":"))
    return F.round(F.element_at(parts, 1).cast("double") + F.element_at(parts, 2).cast("int") * 60 + F.coalesce(F.try_element_at(parts, F.lit(3)).cast("int"), F.lit(0)) * 3600, 2)


def vtt_segments(text: Column) -> Column:
    """Cues of a WebVTT text with a text, tags stripped, lines joined; rolling repeats not yet removed."""
    blocks = F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n[ \\t]*\n")
    cues = F.filter(blocks, lambda b: b.rlike(CUE))

    def cue(b: Column) -> Column:
        said = F.regexp_replace(F.regexp_extract(b, f"(?s){CUE}[^\\n]*\\n(.*)$", 3), "<[^>]+>", "")
        lines = F.filter(F.transform(F.split(said, "\n"), tx.strip), lambda x: x != "")
        return F.struct(_seconds(F.regexp_extract(b, CUE, 1)).alias("start"), _seconds(F.regexp_extract(b, CUE, 2)).alias("end"), F.array_join(lines, " ").alias("text"))

    return F.filter(F.transform(cues, cue), lambda s: s["text"] != "")


def transcript(text: Column) -> Column:
    """Lines ``[mm:ss] text`` of a WebVTT text, repeats removed; minutes run on past an hour."""
    line = lambda s: F.concat(F.format_string("[%02d:%02d] ", F.floor(s["start"] / 60).cast("int"), (F.floor(s["start"]) % 60).cast("int")), s["text"])
    return F.array_join(F.transform(rolled_captions(vtt_segments(text)), line), "\n")


def coverage(text: Column, duration: Column) -> Column:
    """How far the last stamp reaches, at most 1; null if that can't be told."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit("\\[([0-9]+:[0-9]{2})\\]"), F.lit(1)), F.lit(-1))
    reached = F.split_part(last, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(last, F.lit(":"), F.lit(2)).cast("int")
    return F.when((duration > 0) & last.isNotNull(), F.least(reached / duration, F.lit(1.0)))


def skip_reason(live_status: Column, duration: Column, least_seconds: int = 0) -> Column:
    """Why a video isn't an item; null keeps it, and what is missing never skips."""
    short = F.when((duration > 0) & (duration < least_seconds), F.concat(F.lit("duration "), duration.cast("int").cast("string"), F.lit(f"s < min_duration_sec {least_seconds}"))) if least_seconds else F.lit(None).cast("string")
    return F.coalesce(F.when(live_status.isin(*UNREADY), F.concat(F.lit("live_status="), live_status)), short)


def is_bot_gate(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    return F.contains(low, F.lit("sign in to confirm")) | F.contains(low, F.lit("not a bot"))


def best_text(**by_source: Column) -> Column:
    """The first of the extractions that says something, and where it is from."""
    found = F.array(*[F.struct(F.lit(k).alias("content_source"), tx.strip(v).alias("content")) for k, v in by_source.items()])
    return F.try_element_at(F.filter(found, lambda x: F.coalesce(x["content"], F.lit("")) != ""), F.lit(1))


@vectorized("array<binary>")
def storyboard_frames(data: pd.Series) -> pd.Series:
    """Images of a captured MHTML storyboard, in order."""

    def one(b):
        message = email.message_from_bytes(b or b"")
        return [p.get_payload(decode=True) for p in message.walk() if p.get_content_maintype() == "image"]

    return data.map(one)


INBOX_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "url", "content", "author", "published_at")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
INBOX = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("generated_at", T.StringType()), T.StructField("items", T.ArrayType(INBOX_ITEM)), T.StructField("_corrupt", T.StringType())])


def read_inbox(spark, path: str) -> DataFrame:
    """Envelopes of sidecar files; broken ones have nulls and ``_corrupt``."""
    return spark.read.schema(INBOX).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def inbox_items(envelopes: DataFrame, since: dt.datetime) -> DataFrame:
    """Items of envelopes of this version, in the window; broken items are left out, the others stay."""
    from .common import COLUMNS

    e = envelopes.where(F.col("version") == INBOX_VERSION).select(F.posexplode("items").alias("pos", "i"))
    rows = e.select(F.col("i.id"), F.lit("video").alias("source_type"), "i.title", "i.url", "i.content", "i.author", times.iso(F.col("i.published_at")).alias("published_at"), "i.metadata", F.lit(None).cast("array<string>").alias("profile"), F.col("pos").cast("long").alias("ord"))
    return rows.where((F.col("published_at") >= F.lit(since)) & F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("url").isNotNull()).select(*COLUMNS)


def stale(envelopes: DataFrame, now: dt.datetime, hours: float) -> DataFrame:
    """Envelopes older than they may be, or without a readable time."""
    at = times.iso(F.col("generated_at"))
    return envelopes.where(at.isNull() | (at < F.lit(now - dt.timedelta(hours=hours))))


def write_inbox(items: DataFrame, path: str, now: dt.datetime) -> None:
    """One versioned envelope with all items: an inbox is a handful of videos."""
    rows = F.array_sort(F.collect_list(F.struct("id", "title", "url", "content", "author", times.stamp(F.col("published_at")).alias("published_at"), "metadata")), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    envelope = items.agg(rows.alias("items")).select(F.lit(INBOX_VERSION).alias("version"), F.lit(now.isoformat() + "Z").alias("generated_at"), "items")
    envelope.coalesce(1).write.mode("overwrite").json(path)
