import datetime as dt
import hashlib

import pytest

from tidemill import storage
from tidemill.streaming.ledger import CorruptLedger, Ledger

NOW = dt.datetime(2024, 8, 6, 10)
ITEMS, MEMBERS = "item_id string, source_type string, profile string, payload string", "survivor string, ord int, member string"
OUTCOMES, CLAIMS = "snapshot_id string, status string, error_code string, discarded int", "claim_id string, snapshot_id string, claim string"
RESULTS, SNAPSHOTS = "claim_id string, snapshot_ids array<string>", "evidence_snapshot_id string, final_url string, text string, text_hash string"
CARDS, REPORTS = "evidence_id string, claim_id string, evidence_snapshot_id string, excerpt string, excerpt_start int, excerpt_end int", "report_id string, snapshot_id string"
TEXT = "Product X was released on August 11."
HASH = hashlib.sha256(TEXT.encode()).hexdigest()


@pytest.fixture
def ledger(spark):
    return Ledger(spark, storage.scratch(spark, "test-ledger"))


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def fetched(spark, ledger, run="r1", ids="abc"):
    ledger.start(run, rows(spark, [(i, "rss", None, f'{{"i":"{i}"}}') for i in ids], ITEMS), NOW)


def selected(spark, ledger, run="r1", ids=("a",), urls=(("b", 0, "b"), ("b", 1, "c")), topics=(("a", 0, "a"), ("a", 1, "b"))):
    ledger.capture_selected(run, rows(spark, [(i, "rss", "tech", f'{{"s":"{i}"}}') for i in ids], ITEMS), rows(spark, list(urls), MEMBERS), rows(spark, list(topics), MEMBERS), NOW)
    return {r.item_id: r.snapshot_id for r in ledger.table(run, "selected").collect()}


def claims(spark, ledger, snapshot, run="r1"):
    ledger.capture_claims(run, rows(spark, [(snapshot, "ok", None, 2)], OUTCOMES), rows(spark, [("c1", snapshot, "X")], CLAIMS), NOW)


def evidence(spark, ledger, snapshot, run="r1", card=("e1", "c1", "s1", "released", 14, 22), report="0" * 64, text=(("s1", "https://x/", TEXT, HASH),), mine=("s1",)):
    ledger.capture_evidence(run, rows(spark, [("c1", list(mine))], RESULTS), rows(spark, list(text), SNAPSHOTS), rows(spark, [card], CARDS), rows(spark, [(report, snapshot)], REPORTS), NOW)


def test_a_run_stage_by_stage(spark, ledger):
    fetched(spark, ledger)
    assert ledger.manifest("r1")["stage"] == "fetched" and ledger.latest() == "r1" and ledger.latest("evidence") is None
    s = selected(spark, ledger)["a"]
    known = {r.item_id: r.snapshot_id for r in ledger.table("r1", "fetched").collect()}
    assert ledger.table("r1", "selected").first().fetched_snapshots == [known[i] for i in "abc"]
    claims(spark, ledger, s)
    evidence(spark, ledger, s)
    m = ledger.manifest("r1")
    assert m["stage"] == "evidence" and {k: v["rows"] for k, v in m["tables"].items()} == {"fetched": 3, "selected": 1, "outcomes": 1, "claims": 1, "results": 1, "evidence": 1, "cards": 1, "reports": 1}
    assert ledger.object(HASH) == TEXT and ledger.object(hashlib.sha256(b'{"i":"b"}').hexdigest()) == '{"i":"b"}'
    assert sorted(map(tuple, ledger.collection("r1").collect())) == [("fetched", "rss", 3), ("selected", "tech", 1)]
    assert dict(map(tuple, ledger.totals("r1").collect())) == {"selected_items": 1, "claims": 1, "reports": 1, "discarded_claims": 2}
    selected(spark, ledger, ids=("a", "b"))
    assert ledger.manifest("r1")["stage"] == "selected" and set(ledger.manifest("r1")["tables"]) == {"fetched", "selected"}
    with pytest.raises(FileNotFoundError):
        ledger.table("r1", "claims")


def test_what_breaks_off_between_stages_is_read_as_its_last_whole_one(spark, ledger, monkeypatch):
    fetched(spark, ledger)
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(storage, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        selected(spark, ledger)
    assert ledger.manifest("r1")["stage"] == "fetched"
    again = Ledger(spark, ledger.root)
    s = selected(spark, again)["a"]
    assert again.manifest("r1")["stage"] == "selected"
    claims(spark, again, s)
    folder = again.manifest("r1")["tables"]["claims"]["folder"]
    claims(spark, again, s)
    assert again.manifest("r1")["tables"]["claims"]["folder"] == folder


def test_readers_skip_what_is_corrupt(spark, ledger):
    for run in ("r1", "r2", "r3"):
        fetched(spark, ledger, run)
    spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.text(f"{ledger.root}/runs/r4/manifest/version=000000000")
    spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.text(f"{ledger.root}/runs/r2/manifest/version=000000001")
    storage.commit(spark, f"{ledger.root}/runs/r5/manifest", 0, {"run_id": "r5", "stage": "evidence", "updated_at": "never", "tables": {}})
    storage.commit(spark, f"{ledger.root}/runs/r3/manifest", 1, {"run_id": "r3", "stage": "selected", "updated_at": "2024-08-06T10:00:00Z", "tables": {"fetched": {"folder": "gone", "rows": 1}}})
    assert {r.run_id: r.stage for r in ledger.runs().collect()} == {"r1": "fetched", "r2": "fetched", "r3": "selected", "r5": "evidence"}
    assert (ledger.latest(), ledger.latest("evidence"), ledger.latest("fetched"), ledger.readable()) == ("r5", "r5", "r2", "r2")
    empty = Ledger(spark, storage.scratch(spark, "empty-ledger"))
    assert (empty.latest(), empty.readable(), empty.runs().collect()) == (None, None, [])


def test_contradictions_are_errors(spark, ledger):
    for bad in ("../x", "", "a/b"):
        with pytest.raises(ValueError):
            fetched(spark, ledger, bad)
    with pytest.raises(CorruptLedger, match="twice"):
        fetched(spark, ledger, "dup", "aab")
    fetched(spark, ledger)
    with pytest.raises(ValueError, match="is there"):
        fetched(spark, ledger)
    with pytest.raises(CorruptLedger, match="wasn't fetched"):
        selected(spark, ledger, topics=(("a", 0, "unknown"),))
    with pytest.raises(CorruptLedger, match="selected twice"):
        selected(spark, ledger, ids=("a", "a"))
    s = selected(spark, ledger)["a"]
    bad_outcomes = [([], []), ([(s, "ok", None, 0), (s, "ok", None, 0)], []), ([("z", "ok", None, 0)], []), ([(s, "ok", "timeout", 0)], []), ([(s, "error", None, 0)], []), ([(s, "error", "timeout", 0)], [("c1", s, "X")]), ([(s, "ok", None, 0)], [("c1", s, "X"), ("c1", s, "Y")]), ([(s, "ok", None, 0)], [("c1", "z", "X")])]
    for outcomes, made in bad_outcomes:
        with pytest.raises(CorruptLedger):
            ledger.capture_claims("r1", rows(spark, outcomes, OUTCOMES), rows(spark, made, CLAIMS), NOW)
    claims(spark, ledger, s)
    for more in ({"card": ("e1", "c1", "s1", "Released", 14, 22)}, {"card": ("e1", "c1", "s2", "x", 0, 1)}, {"card": ("e1", "c9", "s1", "released", 14, 22)}, {"report": "short"}, {"mine": ()}, {"text": (("s1", "https://x/", TEXT, "0" * 64),)}, {"text": (("s1", "https://x/", TEXT, HASH), ("s1", "https://y/", TEXT, HASH))}):
        with pytest.raises(CorruptLedger):
            evidence(spark, ledger, s, **more)
    with pytest.raises(CorruptLedger, match="cover"):
        evidence(spark, ledger, "another")
    assert ledger.manifest("r1")["stage"] == "claims"
