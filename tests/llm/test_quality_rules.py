from collections import Counter

from pyspark.sql import functions as F

from tidemill.llm import quality_rules as q

SCHEMA = "doc_id long, text string, n_words string, failed_rule string"
TEXTS = [None, "", "   \n\t", "one", "a b c d e f g h " * 5, " ".join(f"w{i}" for i in range(40)), "x\n" * 3 + "y\n\ny\n z", "€uro # & |mark| 😀", "word " * 30000, "nb\u00a0sp stays\u2003one", " ".join(f"w{i % 9}" for i in range(50)), "\n".join(["same line here"] * 9 + ["other"]), "A" * 200, " ".join(["LOUD"] * 3 + [f"U{i}X" for i in range(30)])]


def brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_features_match_brute_force(spark):
    rows = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: r for r in q.judge(rows).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
        assert r.kept == (r.failed_rule is None and not r.base_failed)


def test_order_is_by_rejections_per_cost_and_never_changes_verdicts(spark):
    rows = spark.createDataFrame([(i, "w " * (i % 40)) for i in range(200)], "doc_id long, text string")
    rules = [q.Rule("dear", F.col("n_words") < 30, F.lit(100.0)), q.Rule("cheap", F.col("n_words") < 20, F.lit(1.0)), q.Rule("never", F.lit(False), F.lit(0.1)), q.Rule("null", F.lit(None).cast("boolean"), F.lit(1.0))]
    featured = q.with_features(rows)
    assert [r.name for r, _, _ in q.estimated_order(featured, rules)][:2] == ["cheap", "dear"]
    kept = [sorted(r.doc_id for r in q.cascade(featured, order).where("failed_rule is null").collect()) for order in (rules, rules[::-1])]
    assert kept[0] == kept[1] == [i for i in range(200) if i % 40 >= 30]


def test_costs_are_measured_on_a_bounded_random_sample(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("A b "), F.repeat(F.lit("word and "), F.when(F.col("id") % 2 == 0, 200).otherwise(300))).alias("text"))
    sample = q.sampled(rows, 500)
    ids = [r.doc_id for r in sample.collect()]
    assert 400 < len(ids) < 600 and min(ids) < 100 and max(ids) > 2900
    assert q.sampled(rows.limit(40), 500).count() == 40
    featured = q.with_features(rows)
    dear = q.Rule("dear", F.size(F.filter(q.words_of(F.col("text")), lambda w: F.regexp_count(w, F.lit("[a-z]")) > 99)) + F.col("n_words") < 500)
    order = q.estimated_order(q.with_features(sample), [dear, q.Rule("cheap", F.col("n_words") < 500)])
    assert [r.name for r, _, _ in order] == ["cheap", "dear"]
    assert order[0][1] == order[1][1] > 0.4 and order[1][2] > 2 * order[0][2] >= 2 * q.COST_FLOOR
    assert q.cascade(featured, [dear]).where("failed_rule is null").count() == 1500


def test_repeated_rows_each_get_their_verdict(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.kept) for r in q.judge(rows).collect()) == [(0, False), (3, False), (3, False)]


def test_empty_table_and_no_rules(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert q.judge(empty).collect() == []
    assert q.cascade(q.with_features(empty), []).columns[-1] == "failed_rule"


def test_native_plan(spark):
    plan = q.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
