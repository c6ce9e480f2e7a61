import pytest
from pyspark.sql import functions as F

from tidemill.operators import retrieval

URL = "https://vendor.example/release"
CLAIM = "claim_id string, item_id string, ord int, kind string, checkability string, url string"


def run(spark, claims, searches=(), hits=(), documents=(), answers=(), statuses=(), *, max_queries=3, max_documents=6, model_calls=5):
    df = spark.createDataFrame
    found = retrieval.retrieved(df(claims, CLAIM), df(list(searches), "claim_id string, round int, status string, error_code string"), df(list(hits), "claim_id string, round int, rank int, url string"), df(list(documents), "key string, status string, snapshot_id string"), max_queries=max_queries, max_documents=max_documents)
    done = retrieval.concluded(found, df(list(answers), "claim_id string, call int, outcome string"), df(list(statuses), "claim_id string, status string"), model_calls=model_calls)
    return {r.claim_id: r for r in done.collect()}


def empty(claim, n=3):
    return [(claim, k, "ok", None) for k in range(1, n + 1)]


def test_kinds_have_their_number_of_searches(spark):
    claims = [("e", "i", 0, "event", "checkable", URL), ("o", "j", 0, "other", "checkable", URL), ("r", "k", 0, "release", "checkable", URL), ("n", "l", 0, "event", "opinion", URL)]
    got = run(spark, claims, [x for c in "eorn" for x in empty(c)], documents=[(URL, "ok", "s")], answers=[(c, 1, "valid") for c in "eor"], statuses=[(c, "supported_by_evidence") for c in "eor"])
    assert {k: (r.search_calls, r.stop_reason, r.stage_error) for k, r in got.items()} == {"e": (3, "sufficient", False), "o": (3, "sufficient", False), "r": (1, "sufficient", False), "n": (0, "not_checkable", False)}
    assert got["n"].attempted == 0 and got["e"].snapshots == ["s"]


@pytest.mark.parametrize(("status", "error", "stop", "stage_error"), [("ok", None, "source_unavailable", False), ("error", "rate_limited", "backend_error", True), ("error", None, "backend_error", True)])
def test_a_sound_empty_search_is_no_failed_one(spark, status, error, stop, stage_error):
    got = run(spark, [("c", "i", 0, "release", "checkable", URL)], [("c", 1, status, error)], documents=[(URL, "not_found", None)])["c"]
    assert (got.stop_reason, got.stage_error, got.snapshots, got.search_calls) == (stop, stage_error, [], 1)
    assert got.search_errors == ([] if status == "ok" else [error or "unavailable"]) and got.fetch_errors == ["not_found"]


def test_a_timeout_leaves_the_check_open(spark):
    got = run(spark, [("c", "i", 0, "release", "checkable", URL)], empty("c"), documents=[(URL, "timeout", None)])["c"]
    assert (got.stop_reason, got.stage_error) == ("no_novelty", True)
    lost = run(spark, [("c", "i", 0, "release", "checkable", URL)], empty("c"))["c"]
    assert (lost.fetch_errors, lost.stage_error) == (["network_error"], True)


def test_documents_are_bounded_and_met_once(spark):
    hits = [("c", 1, 1, URL + "#again"), ("c", 1, 2, "HTTPS://B.example:443/1"), ("c", 1, 3, "https://b.example/1"), ("c", 2, 1, "https://bad..example/"), ("c", 2, 2, "https://d.example:70000/"), ("c", 2, 3, "https://d.example/2"), ("c", 3, 1, "https://e.example/3")]
    documents = [(URL, "ok", "s"), ("https://b.example/1", "ok", "s"), ("https://d.example/2", "ok", None), ("https://e.example/3", "ok", "t")]
    claim = [("c", "i", 0, "event", "checkable", URL)]
    every = run(spark, claim, empty("c"), hits, documents, [("c", 1, "valid")], [("c", "insufficient_evidence")], max_documents=9)["c"]
    assert (every.attempted, every.fetched, every.snapshots, every.stop_reason, every.search_calls) == (4, 3, ["s", "t"], "no_novelty", 3)
    assert sorted(every.fetch_errors) == ["invalid_url", "invalid_url", "normalization_empty"]
    # three documents: the first search may bring two hits, of which one is new; the second one, which is invalid
    few = run(spark, claim, empty("c"), hits, documents, [("c", 1, "valid")], [("c", "insufficient_evidence")], max_documents=3)["c"]
    assert (few.attempted, few.search_calls, few.stop_reason, few.fetch_errors) == (3, 3, "budget", ["invalid_url"])
    two = run(spark, claim, empty("c"), hits[1:], documents, [("c", 1, "valid")], [("c", "mixed_evidence")], max_documents=2)["c"]
    assert (two.attempted, two.search_calls, two.stop_reason) == (2, 1, "sufficient")
    one = run(spark, claim, empty("c"), hits, documents, [("c", 1, "valid")], [("c", "insufficient_evidence")], max_documents=1)["c"]
    assert (one.attempted, one.search_calls, one.stop_reason) == (1, 0, "budget")


def test_claims_of_an_item_share_documents_and_model_calls(spark):
    claims = [(f"c{k}", "i", k, "release", "checkable", URL) for k in range(4)] + [("x", "j", 0, "release", "checkable", URL)]
    answers = [("c0", 1, "invalid"), ("c0", 2, "valid"), ("c1", 1, "invalid"), ("c1", 2, "invalid"), ("c1", 3, "invalid"), ("c2", 1, "valid"), ("x", 1, "invalid"), ("x", 2, "failed")]
    got = run(spark, claims, [x for c in ("c0", "c1", "c2", "c3", "x") for x in empty(c)], documents=[(URL, "ok", "s")], answers=answers, statuses=[(c, "supported_by_evidence") for c in ("c0", "c1", "c2", "c3", "x")])
    assert [(got[c].model_calls, got[c].stop_reason, got[c].stage_error, got[c].cache_reuse, got[c].fetched) for c in ("c0", "c1", "c2", "c3", "x")] == [(2, "sufficient", False, 0, 1), (3, "backend_error", True, 1, 0), (0, "budget", True, 1, 0), (0, "budget", True, 1, 0), (2, "backend_error", True, 0, 1)]


def test_rows_without_anything(spark):
    got = run(spark, [("c", "i", 0, "event", "checkable", None), ("d", "i", 1, "event", "checkable", "https://a:b/")])
    assert (got["c"].attempted, got["c"].search_errors, got["c"].stop_reason) == (0, ["unavailable"], "backend_error")
    assert got["d"].fetch_errors == ["invalid_url"]
    assert run(spark, []) == {}


def test_identities(spark):
    urls = ["https://a.b/", "https://a.b:443", "http://[::1]:80/x", "x", "https://a..b/", "https://" + "a" * 64 + ".b/", "https://a:65536/", "https://a:x/", "http://[::1/", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r[0] for r in rows.orderBy("i").select(retrieval.has_identity(F.col("u"))).collect()] == [True, True, True, True, False, False, False, False, False, False]


def test_rounds_are_followed_once(spark):
    from tidemill.plans import registry

    plan = registry.QUERIES["retrieved_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
