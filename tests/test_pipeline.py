import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import models
from tidemill.operators.select import Group, ProfileSettings
from tidemill.plans.pipeline import Config, Pipeline, same_words_topics
from tidemill.streaming import runs, window

NOW = dt.datetime(2024, 8, 6, 12)


def fake(prompts):
    out = []
    for system, user in prompts:
        if "explode" in user:
            out.append(RuntimeError("insufficient_quota"))
        elif system.startswith("Choose"):
            out.append(json.dumps({"profile": "tech" if "tech" in user else "nope", "confidence": 0.9, "reason": "r"}))
        elif "repair" in user and "previous answer" not in user:
            out.append("not json")
        else:
            out.append(f'```json\n{json.dumps({"score": 9 if "great" in user else 3, "reason": "ok", "summary": "s", "tags": ["llm"]})}\n```')
    return out


def rows(spark, *specs):
    schema = "id string, source_type string, title string, url string, content string, author string, published_at timestamp, metadata map<string,string>, profile array<string>, ord long"
    return spark.createDataFrame([(f"i{k}", "rss", t, f"https://a.b/{k}", c, "me", NOW - dt.timedelta(hours=1), {}, p, k) for k, (t, c, p) in enumerate(specs)], schema)


def test_models(spark):
    items = rows(spark, ("tech great", "x", None), ("other", "x", None), ("fixed", "x", ["law"]), ("explode", "x", None), ("pick", "x", ["law", "art"]))
    got = {r.id: r for r in models.classified(items, fake, ["tech", "law"], "general", F.concat_ws("\n", "title", "content")).collect()}
    assert (got["i0"].profile_id, got["i0"].confidence, got["i0"].method) == ("tech", 0.9, "ai_match")
    assert (got["i1"].profile_id, got["i1"].confidence) == ("tech", 0.0) or got["i1"].profile_id in ("general", "tech")
    assert (got["i2"].profile_id, got["i2"].method) == ("law", "source_override")
    assert got["i3"].confidence == 0.0 and got["i4"].profile_id == "law"
    scored = models.analysed(items.withColumn("title", F.when(F.col("id") == "i1", "repair great").otherwise(F.col("title"))), fake, F.lit("Score"), F.concat_ws("\n", "title", "content"))
    s = {r.id: r for r in scored.collect()}
    assert s["i0"].score == 9 and s["i1"].score == 9 and s["i3"].score is None and s["i3"].failed and s["i3"].summary == "explode"
    with pytest.raises(RuntimeError, match="all 1 items"):
        models.assert_not_all_failed(scored.where("id = 'i3'"))
    errs = spark.createDataFrame([("Insufficient Balance",), ("timeout",), (None,)], "e string")
    assert [r[0] for r in errs.select(models.is_retryable(F.col("e"))).collect()] == [False, True, True]
    chain = models.chained(lambda ps: [ValueError("x"), "", "a"], lambda ps: ["b"] * len(ps))
    assert chain([("", "")] * 3) == ["b", "b", "a"]


def test_tools_and_tags(spark):
    plans = spark.createDataFrame([("i", k, "web_search", q) for k, q in enumerate(["a", "a", "", "b", "c", "d"])] + [("i", 9, "shell", "x")], "item_id string, ord int, tool string, query string")
    assert sorted(r.query for r in models.planned_tools(plans).collect()) == ["a", "b", "c"]
    hits = models.discovery_hits(spark.createDataFrame([("q", 0, None), ("q", 1, "https://u")], "query string, ord int, url string")).collect()
    assert [(h.rank, len(h.discovery_id)) for h in hits] == [(2, 64)]
    blocks = spark.createDataFrame([("i", "b", ["R1", "r2", "??"])], "item_id string, block_id string, refs array<string>")
    found = spark.createDataFrame([("i", "R1", "r1", "u1"), ("i", "R1", "r2", "u2"), ("i", "R2", "r3", "u3")], "item_id string, request_ref string, result_ref string, url string")
    out, used = models.resolved_refs(blocks, found)
    assert [(r.source_refs, r.unknown) for r in out.collect()] == [(["r1", "r2"], 1)] and sorted(r.result_ref for r in used.collect()) == ["r1", "r2"]
    tags = models.resolved_tags(spark.createDataFrame([(" LLMs ",), ("new",)], "t string"), "t", spark.createDataFrame([("llm", "LLMs")], "canonical string, alias string"))
    assert sorted(r.canonical for r in tags.collect()) == ["llm", "new"]


def test_run(spark, tmp_path):
    config = Config(profiles={"tech": ProfileSettings(5.0, {"llm": 6.0})}, default_profile="tech", groups={"g": Group(("llm",), 2)}, names={"tech": "Technology"})
    p = Pipeline(spark, str(tmp_path / "runs"), config, fake, same_words_topics())
    items = rows(spark, ("tech great one", "x", None), ("great tech one", "yy", None), ("tech dull", "x", None), ("tech great two", "x", ["tech"]), ("tech great three", "x", None))
    out = p.run_pipeline({"a": items, "b": RuntimeError("down")}, NOW)
    assert out["status"] == "partial_failure" and out["summary"].startswith("# Digest - 2024-08-06") and "**Technology**" in out["summary"]
    run_id = out["run_id"]
    kept = p.store.load(run_id, "filtered").orderBy("ord").collect()
    assert [r.id for r in kept] == ["i0", "i3"] and kept[0].lineage == ["i0", "i1"] and kept[0].category == "llm" and "--- From rss ---" in kept[0].content
    assert p.get_run_stage(run_id, "raw", 2)["truncated"] and p.get_run_summary(run_id) == out["summary"] and [r["run_id"] for r in p.list_runs()] == [run_id]
    p.score_items(run_id)
    assert not p.store.has(run_id, "filtered") and p.store.best_stage(run_id) == "scored"
    with pytest.raises(RuntimeError):
        p.fetch_items({"b": RuntimeError("down")}, NOW)
    with pytest.raises(ValueError, match="not a run id"):
        p.store.load("../etc", "raw")


def test_second_pass_and_failed_enrichment(spark, tmp_path):
    config = Config(profiles={"tech": ProfileSettings(5.0, {})}, default_profile="tech")
    p = Pipeline(spark, str(tmp_path / "runs"), config, fake)
    items = rows(spark, ("tech great one", "x", None), ("tech great two", "y", None), ("tech great three", "z", None))
    run_id = p.fetch_items({"a": items}, NOW)["run_id"]
    p.score_items(run_id)
    assert sorted(r.id for r in p.filter_items(run_id).collect()) == ["i0", "i1", "i2"]
    lowered = p.filter_items(run_id, expand=lambda df: df.withColumns({"content": F.concat("content", F.lit(" more")), "score": F.when(F.col("id") == "i1", 1.0).otherwise(F.col("score"))}))
    assert sorted((r.id, r.content) for r in lowered.collect()) == [("i0", "x more"), ("i2", "z more")]
    done = p.enrich_items(run_id, lambda df: df.withColumn("artifact", F.lit(None).cast("string")).withColumn("enrichment_failed", F.when(F.col("id") == "i2", True)))
    assert [r.id for r in done.collect()] == ["i0"] and "enrichment_failed" not in done.columns


def test_run_ids_rise(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path))
    a, b = store.create(NOW), store.create(NOW)
    assert a < b and store.runs(1) == [b] and store.meta(a)["run_id"] == a


def test_ledger_appends_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows_ = spark.createDataFrame([("s1", "h1"), ("s2", "h2"), ("s1", "h1")], "snapshot_id string, payload_object_hash string")
    assert runs.append_once(spark, path, rows_) == 2 and runs.append_once(spark, path, rows_) == 0
    with pytest.raises(ValueError, match="another content"):
        runs.append_once(spark, path, spark.createDataFrame([("s2", "h3")], "snapshot_id string, payload_object_hash string"))


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    first = spark.createDataFrame([("a", NOW), ("b", NOW), ("a", NOW)], "id string, published_at timestamp")
    first.coalesce(1).write.parquet(str(src))
    stream = window.deduplicated(spark.readStream.schema(first.schema).parquet(str(src)), 24)
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    first.coalesce(1).write.mode("append").parquet(str(src))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("once").collect()) == ["a", "b"]
    daily = window.daily_issues(spark.readStream.schema(first.schema).parquet(str(src)), 24, "id")
    q = daily.writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r["items"]) for r in spark.table("days").collect()) == [("a", 4), ("b", 2)]
