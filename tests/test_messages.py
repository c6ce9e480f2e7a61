import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_texts import rows_for_issue
from tidemill.operators import messages as ms


@pytest.fixture(scope="module")
def issue(spark):
    items = rows_for_issue(spark).withColumn("date", F.lit("2024-08-06")).unionByName(rows_for_issue(spark).where("ord = 0").withColumn("date", F.lit("2024-08-07"))).cache()
    issues = spark.createDataFrame([("2024-08-06", 10, "whole text"), ("2024-08-07", 3, "second"), ("2024-08-08", 0, "nothing")], "date string, total int, markdown string")
    return items, issues


def sent(df, date="2024-08-06"):
    return df.where(F.col("date") == date).orderBy("seq").collect()


def test_one_summary(issue):
    got = ms.daily_messages(*issue).orderBy("date").collect()
    assert [(r.date, r.kind, r.title, r.summary) for r in got] == [("2024-08-06", "summary", "Digest 2024-08-06 Daily", "whole text"), ("2024-08-07", "summary", "Digest 2024-08-07 Daily", "second"), ("2024-08-08", "summary", "Digest 2024-08-08 Daily", "nothing")]


def test_overview_and_items(issue):
    rows = sent(ms.daily_messages(*issue, delivery=ms.ITEMS, names={"tech": "Technology"}))
    assert [r.kind for r in rows] == ["overview", "item", "item", "item"] and [r.seq for r in rows] == [0, 1, 2, 3]
    assert rows[0].title == "Digest 2024-08-06 Overview" and rows[0].summary.startswith("# Digest - 2024-08-06\n\n> 3/10\n\n**Technology**\n1. [Made &lt;title&gt;](https://a.b/1) ⭐️ 9.0/10\n2. [third]")
    assert "javascript" not in rows[0].summary.replace("\\(javascript", "")
    assert [(r.title, r.item_index, r.item_count, r.profile_index, r.profile_count, r.profile_id, r.item_score) for r in rows[1:]] == [("Technology 1/2 Made <title>", 1, 3, 1, 2, "tech", "9.0"), ("Technology 2/2 third", 2, 3, 2, 2, "tech", "7.0"), ("News 1/1 [t](javascript:1)", 3, 3, 1, 1, "news", "")]
    assert rows[1].summary.startswith('<a id="item-tech-1"></a>\n### [Made')
    last = sent(ms.daily_messages(*issue, delivery=ms.ITEMS, overview_last=True))
    assert [(r.kind, r.item_index) for r in last] == [("item", 3), ("item", 2), ("item", 1), ("overview", None)]
    assert [(r.kind, r.summary) for r in sent(ms.daily_messages(*issue, delivery=ms.ITEMS), "2024-08-08")] == [("overview", "# Digest - 2024-08-08\n\n> 0/0")]


def test_headlines(issue):
    rows = sent(ms.daily_messages(*issue, delivery=ms.HEADLINES, base="https://site/"))
    assert [r.summary for r in rows] == ["1. [Made &lt;title&gt;](https://site/2024-08-06-en/tech-1/)\n2. [third](https://site/2024-08-06-en/tech-2/)\n3. [\\[t\\]\\(javascript:1\\)](https://site/2024-08-06-en/news-1/)"]
    many = sent(ms.daily_messages(*issue, delivery=ms.HEADLINES, limit=60))
    assert len(many) == 2 and many[1].summary == "2. [third](https://a.b/3)\n3. \\[t\\]\\(javascript:1\\)" and many[0].summary == "1. [Made &lt;title&gt;](https://a.b/1)"
    assert sent(ms.daily_messages(*issue, delivery=ms.HEADLINES), "2024-08-08") == []


def test_languages_and_modes(issue):
    assert ms.daily_messages(*issue, languages=["ru"]).count() == 0
    assert ms.daily_messages(*issue, languages=["ru", "en"]).count() == ms.daily_messages(*issue, languages=[]).count() == 3
    with pytest.raises(ValueError):
        ms.daily_messages(*issue, delivery="pigeon")
    assert ms.daily_messages(issue[0].where("false"), issue[1].where("false"), delivery=ms.ITEMS).collect() == []
