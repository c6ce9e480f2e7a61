import datetime as dt
import json


from tests.test_texts import rows_for_issue
from tidemill.operators import publish

COPY = {"title": "Coverage", "source": "Source", "unknown": "?", "statuses": {"disputed": "Disputed", "provisional": "Provisional"}, "stances": {"supports": "supports"}, "source_classes": {"original": "original"}}


def test_audit(spark):
    art = "struct<title:string,blocks:array<struct<id:string,content:string>>>"
    items = spark.createDataFrame([("i", {"en": ("A title", [("b", "one two one"), ("c", "three")])})], f"item_id string, artifacts map<string,{art}>")
    fields = publish.artifact_fields(items)
    assert {r.field_id for r in fields.collect()} == {"en:title", "en:block:0:b", "en:block:1:c"}
    props = [("en:title", "title", "x", "k1"), ("en:block:0:b", "two", " y ", "k2"), ("en:block:0:b", "one", "z", None), ("en:block:1:c", "four", "z", None), ("zz", "a", "b", None), ("en:block:1:c", "three", "b", "k9"), ("en:title", " ", "b", None)]
    claims = spark.createDataFrame([("i", "k1", "supported_by_evidence"), ("i", "k2", "not_checkable")], "item_id string, claim_id string, status string")
    got = publish.audited_spans(fields, spark.createDataFrame([("i", *p) for p in props], "item_id string, field_id string, source_text string, normalized_claim string, mapped_claim_id string"), claims)
    by = {(r.field_id, r.source_text): r for r in got.collect()}
    assert [by[p[:2]].error for p in props] == [None, None, "ambiguous", "not_exact", "unknown_field", "unknown_claim", "blank"]
    assert by["en:title", "title"].verification_status == "supported_by_evidence" and by["en:title", "title"].source_start == 2
    assert by["en:block:0:b", "two"].matched_claim_id is None and by["en:block:0:b", "two"].normalized_claim == "y"
    assert [len(r.spans) for r in publish.unchecked_by_language(got).collect()] == [1]


def test_payload_and_markup(spark):
    now = dt.datetime(2024, 8, 7, 12)
    items = spark.createDataFrame([("i", dt.datetime(2024, 8, 6, 11), "provisional", "en"), ("j", None, "not_checked", None)], "item_id string, published_at timestamp, state string, language string")
    claims = spark.createDataFrame([("i", "c1", 1, "<second>", "other", "mixed_evidence"), ("i", "c0", 0, "first", "event", "insufficient_evidence"), ("i", "c2", 2, "err", "event", "verification_error")], "item_id string, claim_id string, ord int, text string, kind string, status string")
    sources = spark.createDataFrame([("c1", 0, "https://www.a.b/x?y=1&z", "supports", "original"), ("c1", 1, "javascript:x", "supports", "original")], "claim_id string, ord int, url string, stance string, source_class string")
    got = publish.payloads(items, claims, sources, now)
    p = {r.item_id: r.payload for r in got.collect()}
    assert [c.public_status for c in p["i"].claims] == ["provisional", "disputed", "check_error"]
    assert p["i"].next_check_at == "2024-08-09T11:00:00Z" and p["i"].source_age_hours == 25.0 and p["j"].claims == [] and p["j"].checked_at is None
    html = {r.item_id: r.h for r in got.select("item_id", publish.verification_markup("payload", "en-US", COPY).alias("h")).collect()}
    assert html["j"] == "" and "&lt;second&gt;" in html["i"] and "javascript" not in html["i"] and "err" not in html["i"]
    assert '<a href="https://www.a.b/x?y=1&amp;z">a.b</a> · supports · original' in html["i"]
    assert got.where("item_id = 'i'").select(publish.verification_markup("payload", "ru", COPY)).first()[0] == ""
    assert {r.public_status: r.claims for r in publish.status_counts(got).collect()} == {"provisional": 1, "disputed": 1}


def test_card(spark):
    card = json.loads(publish.chat_card(rows_for_issue(spark), "Daily", "top").first().json)
    tags = [e["tag"] for e in card["card"]["body"]["elements"]]
    assert tags == ["markdown", "markdown", "collapsible_panel", "collapsible_panel", "markdown", "collapsible_panel"]
    assert card["card"]["body"]["elements"][2]["title"].startswith("1. Made <title> ⭐️ 9.0/10")
    assert publish.chat_card(rows_for_issue(spark).where("false"), "D", "top").count() == 1
