import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import phrases as ph

CHARACTERS = {"發": "发", "髮": "发", "乾": "干", "幹": "干", "裡": "里", "後": "后", "麵": "面"}
PHRASES = {"乾坤": "乾坤", "頭髮": "头发", "皇后": "皇后", "皇后們": "皇后们"}


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_phrases_win_over_characters(spark):
    assert one(spark, ph.normalized_script(F.lit("乾麵和乾坤，頭髮裡的皇后們，後"), "ZH", PHRASES, CHARACTERS)) == "干面和乾坤，头发里的皇后们，后"
    assert one(spark, ph.normalized_script(F.lit("乾麵"), "en", PHRASES, CHARACTERS)) == "乾麵"
    assert one(spark, ph.with_phrases(F.lit(None).cast("string"), PHRASES)) is None
    assert one(spark, ph.with_phrases(F.lit("a.b|c"), {})) == "a.b|c"
    with pytest.raises(ValueError):
        ph.with_phrases(F.lit("x"), {"": "y"})


def brute(text, table):
    out, at = [], 0
    while at < len(text):
        size = max((k for k in range(1, len(text) - at + 1) if text[at : at + k] in table), default=0)
        out.append(table[text[at : at + size]] if size else text[at])
        at += size or 1
    return "".join(out)


def test_the_longest_match_at_every_place():
    r = random.Random(1)
    word = lambda n: "".join(r.choice("ab.|]^-\\(é") for _ in range(r.randint(1, n)))
    for _ in range(300):
        table = {word(5): word(3) for _ in range(r.randint(1, 25))}
        text = word(80)
        assert ph.replaced(text, tuple(table.items())) == brute(text, table)
