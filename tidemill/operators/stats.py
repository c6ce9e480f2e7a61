"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score buckets by exclusive upper bound.
BUCKETS = (("0-2", 3), ("3-4", 5), ("5-6", 7), ("7-8", 9), ("9-10", None))


def label_of(m: Column, author: Column) -> Column:
    """A readable name of where an item comes from, by the first metadata key that says something."""
    have = lambda k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    tagged = lambda prefix, k: F.concat(F.lit(prefix), have(k))
    insight = F.when(have("period").isNotNull() & have("repo").isNotNull(), F.concat(F.lit("ossinsight:"), F.coalesce(F.try_element_at(m, F.lit("primary_language")), F.lit("all"))))
    return F.coalesce(tagged("r/", "subreddit"), have("feed_name"), tagged("@", "channel"), insight, have("repo"), have("watchlist"), have("source_name"), tagged("google_news:", "gn_query"), have("domain"), F.nullif(author, F.lit("")), F.lit("unknown"))


def source_counts(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.count("*").alias("count"))


def sub_source_counts(items: DataFrame, source: str, label: str) -> DataFrame:
    """Counts by label of the sources that have more than one."""
    counts = source_counts(items, source, label)
    several = counts.groupBy(source).agg(F.count("*").alias("labels")).where("labels > 1").select(source)
    return counts.join(several, source, "left_semi")


def score_bucket(score: Column) -> Column:
    out = F.when(score.isNull(), "unscored")
    for name, below in BUCKETS:
        out = out.when(score < below, name) if below is not None else out.otherwise(name)
    return out


def score_histogram(items: DataFrame, score: str = "score") -> DataFrame:
    """Every bucket, empty ones too, and ``unscored``."""
    names = items.sparkSession.createDataFrame([(n,) for n, _ in BUCKETS] + [("unscored",)], "bucket string")
    counts = items.groupBy(score_bucket(F.col(score)).alias("bucket")).agg(F.count("*").alias("count"))
    return names.join(counts, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def fetch_report(outcomes: DataFrame) -> DataFrame:
    """One row from ``outcomes(source, status, item_count, error)``."""
    failed, n = F.count_if(F.col("status") == "failure"), F.count("*")
    status = F.when(n == 0, "not_attempted").when(failed == n, "failure").when(failed > 0, "partial_failure").otherwise("success")
    return outcomes.agg(status.alias("status"), n.alias("attempted"), (n - failed).alias("successful"), F.count_if(F.col("status") == "empty").alias("empty"), failed.alias("failed"), F.coalesce(F.sum("item_count"), F.lit(0)).cast("long").alias("item_count"), ((n > 0) & (failed == n)).alias("all_failed"))


def enrichment_status(results: DataFrame) -> DataFrame:
    """One row from ``results(item_id, error)``: success, partial_failure or failure."""
    failed, n = F.count_if(F.col("error").isNotNull()), F.count("*")
    return results.agg(n.alias("attempted"), failed.alias("failed"), F.when(failed == 0, "success").when(failed == n, "failure").otherwise("partial_failure").alias("status"))


def citation_count(items: DataFrame, artifacts: str = "artifacts") -> DataFrame:
    """References over all languages of all items."""
    each = F.aggregate(F.map_values(artifacts), F.lit(0), lambda acc, a: acc + F.greatest(F.size(a["sources"]), F.lit(0)))
    return items.agg(F.coalesce(F.sum(F.coalesce(each, F.lit(0))), F.lit(0)).cast("long").alias("citations"))


def token_usage(calls: DataFrame) -> DataFrame:
    """``calls(provider, input_tokens, output_tokens, cached_input_tokens)`` by provider, and in all (null).

    Negative counts are 0, cached ones at most the input; calls without tokens don't count.
    """
    whole = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    rows = calls.select("provider", whole("input_tokens").alias("input_tokens"), whole("output_tokens").alias("output_tokens"), F.least(whole("cached_input_tokens"), whole("input_tokens")).alias("cached_input_tokens")).where("input_tokens > 0 or output_tokens > 0")
    return rows.rollup("provider").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cached_input_tokens")]).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def token_cost(input_tokens: Column, output_tokens: Column, cached: Column, input_price: Column, output_price: Column, cached_price: Column | None = None) -> Column:
    """Dollars at prices for a million tokens, to eight places; null without both prices."""
    lower = input_price if cached_price is None else F.coalesce(cached_price, input_price)
    return F.bround(((input_tokens - cached) * input_price + cached * lower + output_tokens * output_price) / F.lit(1_000_000), 8)


def usage_between(after: DataFrame, before: DataFrame) -> DataFrame:
    """What each provider used between two running totals."""
    keys = ("input_tokens", "output_tokens", "cached_input_tokens")
    old = before.select("provider", *[F.col(k).alias(f"__{k}") for k in keys])
    return after.join(old, "provider", "left").select("provider", *[(F.col(k) - F.coalesce(f"__{k}", F.lit(0))).alias(k) for k in keys])


def word_recall(pairs: DataFrame, id_col: str, source: str, heard: str) -> DataFrame:
    """``recall``: the share of the source's words, with their number, that were heard. No words: 1."""
    from ..functions.text import spoken_words

    def counts(col: str, name: str) -> DataFrame:
        return pairs.select(id_col, F.explode(spoken_words(F.col(col))).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias(name))

    both = counts(source, "n").join(counts(heard, "m"), [id_col, "word"], "left")
    found = both.groupBy(id_col).agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("recall"))
    return pairs.select(id_col).join(found, id_col, "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))


def tail_recall(source: Column, heard: Column, words: int = 10) -> Column:
    """The share of the source's last words that were heard, of those that occur once in it if any do. No words: 1."""
    from ..functions.text import spoken_words
    from .text_packing import let

    def rate(s: Column) -> Column:
        last = F.slice(s, F.greatest(F.size(s) - words + 1, F.lit(1)), words)
        once = F.filter(last, lambda w: F.size(F.filter(s, lambda x: x == w)) == 1)
        asked = F.when(F.size(once) > 0, once).otherwise(last)
        return F.when(F.size(s) == 0, F.lit(1.0)).otherwise(let(asked, lambda a: F.size(F.filter(a, lambda w: F.array_contains(spoken_words(heard), w))) / F.size(a)))

    return let(spoken_words(source), rate)


def speech_end(segments: Column, least_rate: float = 3.0) -> Column:
    """End of the last of ``segments(start, end, text)`` that has enough characters a second, at least a hundredth counted; 0 if none has."""
    from ..functions.text import strip

    real = F.filter(segments, lambda s: F.length(strip(s["text"])) / F.greatest(s["end"] - s["start"], F.lit(0.01)) > least_rate)
    return F.when(F.size(real) > 0, F.element_at(real, -1)["end"]).otherwise(F.lit(0.0))


def video_stats(rows: DataFrame) -> DataFrame:
    """Extraction counts from ``rows(content_source, graded, with_text)``; the rate is 1 if nothing was graded."""
    graded, text = F.count_if(F.col("graded")), F.count_if(F.col("graded") & F.col("with_text"))
    return rows.agg(F.count("*").alias("videos"), graded.alias("graded"), text.alias("with_text"), F.when(graded == 0, F.lit(1.0)).otherwise(text / graded).alias("rate"), *[F.count_if(F.col("content_source") == s).alias(s) for s in ("subtitles", "asr", "vision", "description")])


def call_metrics(calls: DataFrame) -> DataFrame:
    """Calls, errors and the last duration by tool, from ``calls(at, tool, error_code, ms)``."""
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count("error_code").alias("errors"), F.max_by("ms", "at").alias("last_ms"))


def evaluation_totals(cases: DataFrame) -> DataFrame:
    """From ``cases(expected, actual)``."""
    ok = F.col("expected") == F.col("actual")
    return cases.agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count_if((F.col("actual") == "supported_by_evidence") & ~ok).alias("false_supported"))


def latin_names(texts: DataFrame, text: str = "text", lexicon: dict[str, str] | None = None) -> DataFrame:
    """``(name, n)``: what a Russian voice would still read in Latin letters, counted over all texts, known readings put in first."""
    from ..functions.narration import latin_tokens, with_lexicon

    said = F.col(text) if not lexicon else with_lexicon(F.col(text), lexicon)
    return texts.select(F.explode(latin_tokens(said)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
