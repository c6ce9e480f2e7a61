from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.functions import urls
from tidemill.operators import stats, verify


def one(spark, *cols):
    row = spark.range(1).select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


def test_tool_references_go_with_the_blanks_before_them(spark):
    assert one(spark, tx.without_tool_tokens(F.lit("a [tool-2-1]\\[tool-10-3\\] b [tool-x] [tool-1-1]"))) == "a b [tool-x]"
    assert one(spark, tx.without_tool_tokens(F.lit("")), tx.without_tool_tokens(F.lit(None).cast("string"))) == ("", None)


def test_leaks_by_language(spark):
    assert one(spark, *[tx.has_cjk_leak(F.lit("a 豈"), x) for x in ("en", "zh-tw", "JA", "zh-hk")]) == (True, False, False, True)
    assert one(spark, tx.has_cjk_leak(F.lit(None).cast("string"), "en")) is False


def test_rare_han_is_spaced_too(spark):
    assert one(spark, tx.spaced_scripts(F.lit("a㐀b中1"))) == "a 㐀 b 中 1"


def test_urls_for_logs_and_pages(spark):
    shown = [urls.without_secrets(F.lit(u)) for u in ("https://api.example.org/bot12:A-b_c/send?x=1#f", "no url", "mailto:a@b")]
    assert one(spark, *shown) == ("https://api.example.org/bot<redacted>/send", "<redacted-url>", "<redacted-url>")
    public = [urls.public_link(F.lit(u), {"forum.example": "showtopic="}) for u in ("https://me:pw@A.Example:8443/p?key=1#f", "http://forum.example/i?showtopic=3#e", "http://forum.example/i?x=3", "ftp://a.b/c", None)]
    assert one(spark, *public) == ("https://a.example:8443/p", "http://forum.example/i?showtopic=3", "http://forum.example/i", None, None)


def test_video_ids_and_anchors(spark):
    ids = [urls.video_id(F.lit(u)) for u in ("https://a.b/watch?v=abcdefghijk&t=1", "https://a.b/live/ab_defghij-", "https://a.b/embed/abcdefghijk/", "https://a.b/c?d=e")]
    assert one(spark, *ids) == ("abcdefghijk", "ab_defghij-", "abcdefghijk", "c?d=e")
    assert one(spark, urls.anchor(F.lit(" новости "), F.lit(2)), urls.anchor(F.lit("AI & tools!"), F.lit(1))) == ("item-unclassified-2", "item-AI-tools-1")


def test_speech_that_never_comes_ends_at_zero(spark):
    seg = lambda *xs: F.array(*[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end"), F.lit(t).alias("text")) for a, b, t in xs])
    assert one(spark, stats.speech_end(seg((0, 20, "to be continued"))), stats.speech_end(seg((0, 1, "spoken words"), (5, 5, "at once"), (6, 30, "hm")))) == (0.0, 5.0)


def test_words_in_capitals_name_something(spark):
    assert one(spark, verify.search_queries(F.lit("the 中ABC chip"), F.lit("other"))[1]) == '"中ABC" other independent report'
