"""Dates and times. Results are instants; the session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(text: Column, *, need_zone: bool = False) -> Column:
    """ISO 8601; ``need_zone``: without one, null."""
    dated = F.when(text.rlike("^\\s*[0-9]{4}-[0-9]"), text)  # Spark also reads words such as "yesterday"
    found = F.try_to_timestamp(F.regexp_replace(dated, "([+-][0-9]{2})([0-9]{2})$", "$1:$2"))
    return F.when(text.rlike("(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), found) if need_zone else found


def epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def rfc822(text: Column) -> Column:
    """``Tue, 06 Aug 2024 10:00:00 +0000`` and with ``GMT``; the day's name is dropped first."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(text), "^[A-Za-z]{3},\\s*", ""), "\\s+(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")))


def feed_time(*texts: Column) -> Column:
    """The first of the texts that is a date in either form."""
    return F.coalesce(*[x for t in texts for x in (iso(t), rfc822(t))])


def tweet_time(text: Column) -> Column:
    """``Tue Aug 06 10:00:00 +0000 2024``, or ISO."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}\\s+", ""), F.lit("MMM dd HH:mm:ss Z yyyy")), iso(text))


def compact(text: Column) -> Column:
    """``20240806T100000Z``."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmssX"))


def forum_time(text: Column, now: Column) -> Column:
    """Moscow time: ``сегодня, 10:05``, ``вчера, 10:05``, ``06.08.24, 10:05``; else null."""
    clock = F.regexp_extract(text, "([0-9]{1,2}:[0-9]{2})", 1)
    day = F.to_date(now + F.expr("INTERVAL 3 HOURS"))
    parts = [F.regexp_extract(text, "([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{2,4})", i) for i in (1, 2, 3)]
    year = F.when(F.length(parts[2]) == 2, F.concat(F.lit("20"), parts[2])).otherwise(parts[2])
    date = F.when(F.lower(text).contains("сегодня"), day).when(F.lower(text).contains("вчера"), F.date_sub(day, 1)).when(parts[0] != "", F.try_to_timestamp(F.concat_ws("-", year, F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))
    return F.when(clock != "", F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), F.lpad(clock, 5, "0")), F.lit("yyyy-MM-dd HH:mm")) - F.expr("INTERVAL 3 HOURS"))


def stamp(t: Column) -> Column:
    """``2024-08-06T10:00:00Z``, with microseconds only where there are any."""
    micros = F.date_format(t, "SSSSSS")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def age_hours(published: Column, now: Column) -> Column:
    """Hours, not below 0; null without a time."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(published)) / 3_600_000_000)


def next_check(kind: Column, status: Column, published: Column, checked: Column) -> Column:
    """24 hours after publication, then 72, for events still open; else null."""
    first, second = published + F.expr("INTERVAL 24 HOURS"), published + F.expr("INTERVAL 72 HOURS")
    open_ = kind.isin("event", "other") & ~status.isin("supported_by_evidence", "contradicted_by_evidence")
    return F.when(open_ & (checked < first), first).when(open_ & (checked < second), second)


def window_operator(hours: Column, since: Column) -> Column:
    """A news search's time operator: whole hours up to a hundred, else a date."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil(hours))
    return F.when(n <= 100, F.concat(F.lit("when:"), n.cast("string"), F.lit("h"))).otherwise(F.concat(F.lit("after:"), F.date_format(since, "yyyy-MM-dd")))


def byline(t: Column) -> Column:
    return F.date_format(t, "MMM d, HH:mm")


def issue_day(t: Column) -> Column:
    """The UTC day whose issue an item belongs to."""
    return F.to_date(t)
