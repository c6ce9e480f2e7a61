import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import evaluation as ev

FIELD = {"field_id": "en:title", "language": "en", "source_kind": "title", "text": "X was released. Y was not."}


def span(text, claim=None, said="said", field="en:title"):
    return {"field_id": field, "source_text": text, "normalized_claim": said, "mapped_claim_id": claim}


CASES = [
    ({"type": "adjudication", "expected_status": "supported_by_evidence", "cards": [{"stance": "supports"}]}, None),
    ({"type": "adjudication", "expected_status": "insufficient_evidence", "cards": [{"stance": "supports", "source_class": "independent_reporting"}]}, None),
    ({"type": "adjudication", "expected_status": "insufficient_evidence", "cards": [{"stance": "supports", "entity_match": "mismatch"}]}, None),
    ({"type": "adjudication", "expected_status": "mixed_evidence", "cards": [{"stance": "supports"}, {"stance": "contradicts"}]}, None),
    ({"type": "adjudication", "expected_status": "verification_error", "required_stage_error": True, "cards": [{"stance": "supports"}]}, None),
    ({"type": "adjudication", "expected_status": "not_checkable", "claim": {"kind": "opinion", "checkability": "not_checkable"}}, None),
    ({"type": "adjudication", "expected_status": "supported_by_evidence", "claim": {"kind": "event"}, "cards": [{"stance": "supports", "source_class": "independent_reporting", "origin_key": k} for k in "ab"]}, None),
    ({"type": "adjudication", "expected_status": "insufficient_evidence", "cards": [{"stance": "supports"}]}, ("supported_by_evidence", True)),
    ({"type": "adjudication", "expected_status": "supported_by_evidence"}, ("insufficient_evidence", False)),
    ({"type": "audit", "expected_unchecked": 1, "fields": [FIELD], "proposals": [span("X was released.", "c1"), span("Y was not.")], "claim_results": [{"claim_id": "c1", "status": "supported_by_evidence"}]}, None),
    ({"type": "audit", "expected_unchecked": 1, "fields": [FIELD], "proposals": [span("X was released.", "c1")], "claim_results": [{"claim_id": "c1", "status": "verification_error"}]}, None),
    ({"type": "audit", "expected_unchecked": 0, "fields": [FIELD], "proposals": []}, None),
    ({"type": "audit", "expected_unchecked": 0, "fields": [FIELD], "proposals": [span("was")]}, ("error", False)),
    ({"type": "audit", "expected_unchecked": 0, "fields": [FIELD], "proposals": [span("absent")]}, ("error", False)),
    ({"type": "audit", "expected_unchecked": 0, "fields": [FIELD], "proposals": [span("X", field="en:block:0:x")]}, ("error", False)),
    ({"type": "audit", "expected_unchecked": 0, "fields": [FIELD | {"text": "x" * 400}], "proposals": [span("x")] * 101}, ("error", False)),
    ({"type": "unheard_of", "expected": "y"}, ("unknown_case_type", False)),
]


def test_replay(spark):
    rows = [(f"k{i}", json.dumps({"id": f"k{i}"} | c)) for i, (c, _) in enumerate(CASES)]
    replay = ev.replayed(spark.createDataFrame(rows, "case_id string, case string")).cache()
    got = {r.case_id: r for r in replay.collect()}
    assert len(got) == len(CASES)
    for i, (case, miss) in enumerate(CASES):
        r = got[f"k{i}"]
        if miss is None:
            assert r.passed and not r.false_supported, (i, r)
        else:
            assert (r.passed, r.actual, r.false_supported) == (False, *miss), (i, r)
    assert ev.replay_totals(replay).first()[:] == (17, 10, 7, 1)
    assert ev.replay_totals(ev.replayed(spark.createDataFrame([], "case_id string, case string"))).first()[:] == (0, 0, 0, 0)


def test_span_contract(spark):
    long = [("f", "x", "y", None, None), (None, "x", "y", None, "value"), ("f", "", "y", None, "length"), ("f", "x" * 2001, "y", None, "length"), ("f", "x", "y" * 1001, None, "length"), ("f", " \n", "y", None, "blank"), ("f", "x", "\t", None, "blank"), ("f", "x", None, None, "length")]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(long)], "i int, field_id string, source_text string, normalized_claim string, mapped_claim_id string")
    assert [r.e for r in df.orderBy("i").select(ev.span_error().alias("e")).collect()] == [r[4] for r in long]
    assert df.where("i = 0").select(ev.span_error(F.array(F.lit("field_id"), F.lit("note"))).alias("e")).first().e == "extra_key"


def test_runs_over_one_capture(spark):
    capture = spark.createDataFrame([(k,) for k in "abcde"], "id string")
    run = lambda rows: spark.createDataFrame(rows, "id string, score double, tags array<string>, note string")
    one = run([("a", 1.0, ["x"], None), ("b", 2.0, [], "n"), ("c", 3.0, None, ""), ("z", 9.0, None, None)])
    assert ev.compared_runs(capture, one, one).collect() == []
    two = run([("a", 1.0, ["x", "y"], "new"), ("b", 2.5, [], "n"), ("d", 4.0, None, None)]).withColumn("extra", F.lit(1))
    got = sorted(map(tuple, ev.compared_runs(capture, one, two, ignored=("extra",)).collect()))
    assert got == [("a", "note", None, "new"), ("a", "tags", '["x"]', '["x","y"]'), ("b", "score", "2.0", "2.5"), ("c", "present", "true", "false"), ("d", "present", "false", "true")]
    assert ("a", "extra", None, "1") in set(map(tuple, ev.compared_runs(capture, one, two).collect()))
    costs = ev.run_costs(spark.createDataFrame([("m", "a", 5, 2, True), ("m", "b", 7, None, False), ("n", "a", 1, 1, None)], "model string, id string, input_tokens int, output_tokens int, ok boolean"))
    assert sorted(map(tuple, costs.collect())) == [("m", 2, 12, 2, 1, 1), ("n", 1, 1, 1, 0, 1)]


@pytest.mark.parametrize("empty", [True])
def test_empty_captures(spark, empty):
    none = spark.createDataFrame([], "id string, v int")
    assert ev.compared_runs(none, none, none).collect() == []
