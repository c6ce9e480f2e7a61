import pytest
from pyspark.sql import functions as F

from tidemill.operators import verify
from tidemill.streaming import incidents

CARD = "claim_id string, stance string, source_class string, interested_party boolean, entity_match string, temporal_match string, quantity_match string, origin_key string"


def card(stance="supports", cls="original", interested=False, entity="match", time="match", quantity="match", origin="o1"):
    return ("c", stance, cls, interested, entity, time, quantity, origin)


@pytest.mark.parametrize(
    ("kind", "checkability", "error", "cards", "status"),
    [
        ("other", "not_checkable", True, [card()], "not_checkable"),
        ("other", "checkable", True, [card()], "verification_error"),
        ("other", "checkable", False, [card()], "supported_by_evidence"),
        ("other", "checkable", False, [card(cls="independent_reporting")], "insufficient_evidence"),
        ("other", "checkable", False, [card(), card("contradicts")], "mixed_evidence"),
        ("other", "checkable", False, [card("contradicts")], "contradicted_by_evidence"),
        ("other", "checkable", False, [card("contradicts", "independent_reporting")], "insufficient_evidence"),
        ("event", "checkable", False, [card(cls="independent_reporting", origin="a"), card(cls="independent_reporting", origin="b")], "supported_by_evidence"),
        ("event", "checkable", False, [card(cls="independent_reporting", origin="a"), card(cls="independent_reporting", origin="a")], "insufficient_evidence"),
        ("event", "checkable", False, [card(cls="competent_record")], "supported_by_evidence"),
        ("quantity", "checkable", False, [card(quantity="unknown")], "insufficient_evidence"),
        ("quantity", "checkable", False, [card()], "supported_by_evidence"),
        ("event", "checkable", False, [card(cls="competent_record", interested=True)], "insufficient_evidence"),
        ("release", "checkable", False, [card(interested=True)], "supported_by_evidence"),
        ("other", "checkable", False, [card(entity="mismatch"), card(time="unknown"), card("context")], "insufficient_evidence"),
        ("other", "checkable", False, [], "insufficient_evidence"),
    ],
)
def test_adjudication(spark, kind, checkability, error, cards, status):
    claims = spark.createDataFrame([("c", kind, checkability, error)], "claim_id string, kind string, checkability string, stage_error boolean")
    r = verify.adjudicated(claims, spark.createDataFrame(cards, CARD)).first()
    assert r.status == status and (not r.satisfied or not r.missing)


@pytest.mark.parametrize(("kind", "status", "age", "want"), [("event", "insufficient_evidence", 71.0, "provisional"), ("event", "insufficient_evidence", 72.0, "insufficient"), ("event", "insufficient_evidence", None, "insufficient"), ("quantity", "insufficient_evidence", 1.0, "primary_report_only"), ("opinion", "not_checkable", None, "anecdotal"), ("event", "not_checkable", None, "not_applicable"), ("event", "mixed_evidence", None, "disputed"), ("new", "supported_by_evidence", None, "source_supported"), ("event", "verification_error", 1.0, "check_error")])
def test_public_status(spark, kind, status, age, want):
    row = spark.createDataFrame([(kind, status, age)], "k string, s string, a double")
    assert row.select(verify.public_status(F.col("k"), F.col("s"), F.col("a"))).first()[0] == want


def test_kinds_and_queries(spark):
    rows = spark.createDataFrame([("release", "It launched", ""), ("release", "Компания представила", ""), ("announcement", "about 5 things", ""), ("release", "nice", ""), ("quote", "launched", ""), ("odd", "x", "")], "k string, s string, c string")
    assert [r[0] for r in rows.select(verify.conservative_kind(F.col("k"), F.col("s"), F.col("c"))).collect()] == ["release", "announcement", "quantity", "other", "quote", "other"]
    q = spark.range(1).select(verify.search_queries(F.lit("OpenX shipped Model-2 to openx in 2024"), F.lit("release"))).first()[0]
    assert q == ['"OpenX shipped Model-2 to openx in 2024" official release changelog', '"OpenX Model-2 2024" release independent report', '"OpenX shipped Model-2 to openx in 2024" correction denied false']


def test_anchors(spark):
    text = "alpha beta gamma beta delta"
    rows = [("s", i, "content", text, span, claim, "event") for i, (span, claim) in enumerate([("beta", "A"), ("gamma", "B"), ("gamma", "C"), ("alpha", "b"), ("delta", "D"), ("missing", "E"), ("alpha", "F"), ("a b", "G")])]
    got = verify.anchored_claims(spark.createDataFrame(rows, "snapshot_id string, ord long, source_field string, source string, source_text string, normalized_claim string, kind string")).orderBy("ord").collect()
    assert [(r.source_text, r.source_start, r.source_end) for r in got] == [("gamma", 11, 16), ("delta", 22, 27), ("alpha", 0, 5)]
    assert len({r.claim_id for r in got}) == 3 and all(len(r.claim_id) == 64 for r in got)


def test_stop_reasons(spark):
    rows = spark.createDataFrame([("a", "not_checkable"), ("b", "sufficient"), ("b", "budget"), ("b", "no_novelty"), ("c", "sufficient"), ("c", "not_checkable")], "k string, stop_reason string")
    assert {r.k: r.stop_reason for r in verify.stop_reasons(rows, "k").collect()} == {"a": "not_checkable", "b": "budget", "c": "sufficient"}


def test_documents_and_sources(spark):
    hits = spark.createDataFrame([("c", 0, "https://a.b/x#1"), ("c", 1, "https://a.b/x"), ("c", 2, "https://a.b/y"), ("c", 3, "https://a.b/z")], "claim_id string, ord int, url string")
    assert [r.ord for r in verify.evidence_documents(hits, 2).orderBy("ord").collect()] == [0, 2]
    out = spark.createDataFrame([("u", "https://a.b/x", "ok", "text/plain", "a  b\r\n\n"), ("u", "https://a.b/x", "ok", "text/plain", "  "), ("u", None, "ok", "t", "x"), ("u", "https://a.b/", "timeout", "t", "x")], "requested_url string, final_url string, status string, mime_type string, text string")
    got = verify.evidence_snapshots(out).collect()
    assert len(got) == 1 and got[0].normalized_text == "a b"


def test_incidents(spark):
    def rec(*rows):
        return spark.createDataFrame([(i, "incident-1", "security", "claim", s, item, f"https://x/{item}", None, nxt) for i, (s, item, nxt) in enumerate(rows)], "ord long, incident_id string, profile string, claim string, state string, item_id string, url string, checked_at string, next_check_at string")

    empty = spark.createDataFrame([], incidents.SCHEMA)
    one = incidents.merged(empty, rec(("PROVISIONAL", "a", "t9"), ("PROVISIONAL", "a", "t9")), "t1")
    two = incidents.merged(one, rec(("DISPUTED", "b", None)), "t2")
    three = incidents.merged(two, rec().where("false"), "t3").collect()
    r = three[0]
    assert len(three) == 1 and (r.first_seen_at, r.last_seen_at, r.state, r.next_check_at) == ("t1", "t2", "DISPUTED", None)
    assert [(h.state, h.changed_at) for h in r.state_history] == [("PROVISIONAL", "t1"), ("DISPUTED", "t2")]
    assert r.source_item_ids == ["a", "b"]
    assert incidents.due(one, "t9").count() == 1 and incidents.latest(two).count() == 1
