"""Quality rules as a short-circuit cascade of native column expressions.

A rule's selectivity and cost are measured on a bounded random sample; rules then run in the order of
rejections per cost, and a row that one rule rejects never evaluates the later ones.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SEPARATORS, Workspace, let, words_of

#: Words in a window that repeats.
WINDOW = 8
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: About how many rows the order of rules is estimated on. The order changes costs, never verdicts.
SAMPLE_ROWS = 2000
#: Nanoseconds a row below which measured costs aren't told apart, and runs of each rule, of which the quickest counts.
COST_FLOOR, RUNS = 1000.0, 2


@dataclass(frozen=True)
class Rule:
    """``fails``: true where the rule rejects. ``cost``: nanoseconds for a row, as a column; null: measured."""

    name: str
    fails: Column
    cost: Column | None = None


def _repeated(hashes: Column, n_words: Column) -> Column:
    """Words covered by the windows whose hash occurs again; work is a sort, never a square."""

    def count(marks: Column) -> Column:
        def again(x, i):
            return (F.coalesce(F.get(marks, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(marks, i + 1)["h"] == x["h"], F.lit(False)))

        at = F.sort_array(F.transform(F.filter(marks, again), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")), lambda acc: acc["n"])

    marks = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(marks, count)).otherwise(F.lit(0).cast("long"))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words word_chars n_symbols n_dup_lines n_lines n_repeat_words`` of the whole text.

    Null and empty texts have zeros. Windows are compared by a 64-bit hash of their words. Columns
    of ``docs`` by these names are replaced; the others stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c not in made]
    words = docs.select(*kept, words_of(text).alias("__words"), F.filter(F.split(text, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "").alias("__lines"))
    n = F.size("__words").cast("long")

    def windows(word: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(word) - WINDOW + 1), lambda i: F.xxhash64(F.slice(word, i, WINDOW)))

    repeat = F.when(n > WINDOW, let(let(F.transform("__words", lambda w: F.xxhash64(w)), windows), lambda h: _repeated(h, n))).otherwise(F.lit(0).cast("long"))
    return words.select(
        *kept,
        n.alias("n_words"),
        F.length(F.translate(text, SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        repeat.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """Too few words, or too many of them in windows that repeat."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules(text_col: str = "text") -> list[Rule]:
    """The rules over :func:`with_features`; the last two read the text again."""
    col, text = F.col, F.coalesce(F.col(text_col), F.lit(""))
    return [
        Rule("few_words", col("n_words") < 20),
        Rule("repeats", 100 * col("n_repeat_words") > 30 * col("n_words")),
        Rule("symbols", 10 * col("n_symbols") > col("n_words")),
        Rule("word_length", (col("word_chars") < 3 * col("n_words")) | (col("word_chars") > 15 * col("n_words"))),
        Rule("same_lines", 100 * col("n_dup_lines") > 30 * col("n_lines")),
        Rule("capitals", 2 * F.regexp_count(text, F.lit("\\p{Lu}")) > col("word_chars")),
        Rule("no_letters", 10 * F.size(F.filter(words_of(text), lambda w: ~w.rlike("\\p{L}"))) > 3 * col("n_words")),
    ]


def sampled(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """About ``sample_rows`` random rows of the whole table, all of a smaller one.

    The count reads no column. Drawing reads the table once, where it is, and only what is drawn goes on: a limit
    would move that many rows of every partition into one task.
    """
    return rows.sample(min(1.0, sample_rows / max(1, rows.count())), seed)


def _seconds(rows: DataFrame, value: Column) -> float:
    """The quickest of some runs of an aggregate over ``rows``."""
    took = []
    for _ in range(RUNS):
        began = time.perf_counter()
        rows.agg(F.sum(value)).collect()
        took.append(time.perf_counter() - began)
    return min(took)


def estimated_order(sample: DataFrame, rules: list[Rule], text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, rejection rate, nanoseconds a row) in the order of rejections per cost, from a ``sample`` with features.

    The sample is written once. A rule's cost is what a job that evaluates it takes beyond one that only reads the
    columns, not below ``COST_FLOOR``. Ties and an empty table keep the given order.
    """
    work = Workspace(sample.sparkSession, "rule-costs")
    rows = work.small(sample, "sample", 1)
    failed = [F.coalesce(r.fails, F.lit(False)).cast("long") for r in rules]
    declared = [F.avg(r.cost.cast("double")) if r.cost is not None else F.lit(None).cast("double") for r in rules]
    seen = rows.agg(F.count("*").alias("n"), *[F.sum(f).alias(f"f{i}") for i, f in enumerate(failed)], *[c.alias(f"c{i}") for i, c in enumerate(declared)]).first()
    n = max(1, seen["n"])
    read = F.length(F.coalesce(F.col(text_col), F.lit(""))) if text_col in rows.columns else F.lit(0)
    idle = _seconds(rows, read) if seen["n"] and any(r.cost is None for r in rules) else 0.0

    def cost(i: int) -> float:
        if rules[i].cost is not None or not seen["n"]:
            return seen[f"c{i}"] or 0.0
        return max(COST_FLOOR, (_seconds(rows, failed[i] + F.least(read, F.lit(0))) - idle) * 1e9 / n)

    known = [(r, (seen[f"f{i}"] or 0) / n, cost(i)) for i, r in enumerate(rules)]
    work.drop("sample")
    return sorted(known, key=lambda x: -x[1] / max(x[2], 1e-9))


def cascade(df: DataFrame, rules: list[Rule], sample: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with ``failed_rule``: the first rule in the estimated order that rejects the row, null if none does.

    ``sample``: rows of ``df`` to estimate on; if null, they are drawn from it.
    """
    if not rules:
        return df.withColumn("failed_rule", F.lit(None).cast("string"))
    chain = F
    for rule, _, _ in estimated_order(sampled(df) if sample is None else sample, rules, text_col):
        chain = chain.when(F.coalesce(rule.fails, F.lit(False)), F.lit(rule.name))
    return df.withColumn("failed_rule", chain)


def judge(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Features, ``base_failed``, ``failed_rule`` and ``kept`` of every row; none is dropped.

    Which rule of several is named depends on measured costs; ``kept`` doesn't. Columns of ``docs`` by these
    names are replaced.
    """
    sample = with_features(sampled(docs, sample_rows), text_col)
    judged = cascade(with_features(docs, text_col), default_rules(text_col) if rules is None else rules, sample, text_col)
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
