import pytest
from pyspark.sql import functions as F

from tidemill.operators import evidence


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_contracts(spark):
    good = ("content", "A claim", "A claim", "event", "load_bearing", "checkable")
    cases = [(good, None), (("title", *good[1:4], "headline", "checkable"), None), ((*good[:4], "headline", "checkable"), "headline_outside_title"), (("body", *good[1:]), "value"), ((*good[:3], None, *good[4:]), "value"), (("content", "", *good[2:]), "length"), (("content", "x" * 1001, *good[2:]), "length"), (("content", "x" * 1000, *good[2:]), None), (("content", " \t", *good[2:]), "blank"), (("content", "a", "  ", *good[3:]), "blank")]
    df = rows(spark, [(i, *c) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{k} string" for k in evidence.CLAIM_KEYS))
    assert [r.e for r in df.select("i", evidence.claim_error().alias("e")).orderBy("i").collect()] == [e for _, e in cases]
    assert {r[0] for r in df.select(evidence.claim_error(F.array(F.lit("note")))).collect()} == {"extra_key"}
    plain = ("c", "", "original", False, "irrelevant", "match", "match", "unknown")
    cases = [(plain, None), ((*plain[:4], "supports", *plain[5:]), "no_excerpt"), (("c", None, *plain[2:4], "context", *plain[5:]), "no_excerpt"), (("c", "said", *plain[2:4], "supports", *plain[5:]), None), (("c", "x" * 2001, *plain[2:]), "length"), ((*plain[:7], "maybe"), "value"), ((None, *plain[1:]), "value")]
    df = rows(spark, [(i, *c) for i, (c, _) in enumerate(cases)], "i int, candidate_id string, excerpt string, source_class string, interested_party boolean, stance string, entity_match string, temporal_match string, quantity_match string")
    assert [r.e for r in df.select("i", evidence.assessment_error().alias("e")).orderBy("i").collect()] == [e for _, e in cases]


def test_coverage(spark):
    want = rows(spark, [(1,), (2,), (3,), (None,)], "k int")
    found = rows(spark, [(2,), (3,), (3,), (4,)], "k int")
    assert {(r.k, r.problem) for r in evidence.uncovered(want, found, "k").collect()} == {(1, "missing"), (None, "missing"), (3, "repeated"), (4, "unknown")}
    with pytest.raises(ValueError, match="missing|unknown|repeated"):
        evidence.covered(want, found, "k")
    assert evidence.covered(want, want, "k").count() == 4
    assert evidence.covered(want.where("false"), want.where("false"), "k").count() == 0


def test_anchoring(spark):
    snapshots = rows(spark, [("c", "s1", "one two one", "h", "https://A.b/x#f"), ("c", "s2", "one two one", "h", "https://c.d/"), ("c", "s3", "aaa", "g", "https://c.d/y"), ("d", "s1", "text", "h", "https://c.d/")], "claim_id string, snapshot_id string, normalized_text string, object_hash string, final_url string")
    proposals = rows(spark, [("c", "s1", "two", "supports", "unknown"), ("c", "s2", "one", "contradicts", "original"), ("c", "s3", "aa", "context", "original"), ("d", "s1", "ext", "supports", "original")], "claim_id string, candidate_id string, excerpt string, stance string, source_class string")
    got = {(r.claim_id, r.candidate_id): r for r in evidence.anchored_assessments(proposals, snapshots).collect()}
    assert [got[k].error for k in (("c", "s1"), ("c", "s2"), ("c", "s3"), ("d", "s1"))] == [None, "ambiguous", "ambiguous", None]
    assert (got["c", "s1"].excerpt_start, got["c", "s1"].excerpt_end, got["c", "s1"].origin_key) == (4, 7, "copy:h")
    assert got["d", "s1"].origin_key.startswith("url:") and len(got["d", "s1"].evidence_id) == 64
    moot = proposals.withColumn("stance", F.lit("unknown")).withColumn("excerpt", F.lit("nowhere"))
    assert {(r.error, r.evidence_id) for r in evidence.anchored_assessments(moot, snapshots).collect()} == {(None, None)}
    short = {(r.claim_id, r.error) for r in evidence.anchored_assessments(proposals.where("candidate_id <> 's3'"), snapshots).collect()}
    assert short == {("c", "coverage"), ("d", None)}
    assert evidence.anchored_assessments(proposals.where("false"), snapshots).collect() == []


def test_items_of_outcomes(spark):
    got = evidence.outcome_items(rows(spark, [("s1", 1), ("s2", 0)], "snapshot_id string, claims int"), rows(spark, [("s1", "i"), ("s2", "gone")], "snapshot_id string, item_id string"), rows(spark, [("i",), ("i",)], "item_id string"))
    assert {(r.snapshot_id, r.item_id, r.item_found) for r in got.collect()} == {("s1", "i", True), ("s2", "gone", False)}


def test_error_results(spark):
    claims = rows(spark, [("a", "checkable"), ("b", "not_checkable")], "claim_id string, checkability string")
    assert {(r.claim_id, r.status, tuple(r.missing), r.duration_seconds) for r in evidence.error_results(claims, duration=2).collect()} == {("a", "verification_error", ("required_stage_completed",), 2.0), ("b", "not_checkable", (), 2.0)}
    with pytest.raises(ValueError, match="sufficient"):
        evidence.error_results(claims, "sufficient")


def test_runs_and_totals_of_nothing(spark):
    runs = rows(spark, [("r1", "evidence", True), ("r2", "evidence", False), ("r3", "claims", True)], "run_id string, stage string, has_claims boolean")
    assert tuple(evidence.latest_runs(runs).first()) == ("r3", "claims", "r1")
    outcomes = rows(spark, [("i", "ok", None, 1.5)], "item_id string, status string, error_code string, duration_seconds double")
    results = rows(spark, [], "item_id string, claim_id string, status string, stop_reason string, search_calls int, documents_attempted int, documents_fetched int, cache_reuse int, duration_seconds double")
    r = evidence.report_totals(outcomes, results).first()
    assert (r.search_calls, r.status_by_claim, r.stop_reason, r.duration_seconds, r.verification_error) == (0, {}, "no_novelty", 1.5, None)
