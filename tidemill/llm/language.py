"""Language identification by bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of the n-grams that are typical of it. The filters are stored
slot by slot as bitmasks over the languages, so one lookup returns all the languages that contain an
n-gram. A text's hits by language, corrected for the filter's false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Workspace, in_share, lean, small_batches, training_share
from ._hashing import U64, mix

#: About how many documents the filters are fitted on, chosen by a hash of the id.
TRAIN_DOCS = 20_000
#: An n-gram is a language's if it is there at least this often, and at this share of its highest rate in any.
LEAST_COUNT, LEAST_SHARE = 3, 0.5
SLOTS, HASHES = 1 << 20, 3
#: Characters that are looked at together; n-grams that a task holds.
PIECE, HELD = 1 << 16, 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str):
    """Hashes of three characters in a row whose middle one is a letter; other characters are one mark. In bounded pieces."""
    for at in range(0, len(text), PIECE):
        piece = text[max(0, at - 1) : at + PIECE + 1].lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.zeros(len(codes) + 2, U64)
        x[1:-1] = np.where(_letters()[codes], codes, 0)
        if at:
            x = x[1:]
        if at + PIECE < len(text):
            x = x[:-1]
        middle = x[1:-1] != 0
        yield mix((x[:-2] * U64(1 << 42) + x[1:-1] * U64(1 << 21) + x[2:])[middle])


@dataclass
class Filters:
    """``masks``: by slot, bits of the languages in words of 64; ``wrong``: each language's false-positive rate."""

    langs: list[str]
    masks: np.ndarray
    wrong: np.ndarray

    @classmethod
    def build(cls, of: dict[str, np.ndarray], slots: int = SLOTS) -> Filters:
        langs = sorted(of)
        masks = np.zeros((slots, max(1, -(-len(langs) // 64))), U64)
        wrong = np.zeros(len(langs))
        for i, lang in enumerate(langs):
            at = np.unique(np.concatenate(list(_places(of[lang], slots))))
            masks[at, i // 64] |= U64(1) << U64(i % 64)
            wrong[i] = (len(at) / slots) ** HASHES
        return cls(langs, masks, wrong)

    def decide(self, text: str | None) -> tuple[str, float]:
        """(language, score): ``und`` and 0 for null or without a letter; ties go to the first by name."""
        hits, total = np.zeros(len(self.langs)), 0
        for g in grams(text or ""):
            total += len(g)
            found = None
            for at in _places(g, len(self.masks)):
                found = self.masks[at] if found is None else found & self.masks[at]
            for i in range(len(self.langs)) if len(g) else ():
                hits[i] += np.count_nonzero(found[:, i // 64] & (U64(1) << U64(i % 64)))
        if not total or not self.langs:
            return "und", 0.0
        share = np.clip((hits / total - self.wrong) / np.maximum(1e-9, 1 - self.wrong), 0, 1)
        best = int(np.argmax(share))
        return self.langs[best], float(share[best])


def _places(g: np.ndarray, slots: int):
    for i in range(HASHES):
        yield (((g >> U64(20 * i)) ^ (g << U64(7 * i + 1))) % U64(slots)).astype(np.int64)


def _counts(batches):
    """Counts by (lang, n-gram), in several rows where there are many.

    N-grams are counted whenever ``HELD`` have come, and the counts are told when so many distinct ones are held.
    """
    raw: dict[str, list[np.ndarray]] = {}
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting = 0

    def fold():
        for lang, parts in raw.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in known:
                old, m = known[lang]
                g, at = np.unique(np.concatenate([old, g]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([m, n]), minlength=len(g)).astype(np.int64)
            known[lang] = g, n
        raw.clear()

    def told():
        for lang, (g, n) in known.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])
        known.clear()

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            for g in grams(text.as_py()):
                raw.setdefault(lang.as_py(), []).append(g)
                waiting += len(g)
            if waiting > HELD:
                fold()
                waiting = 0
                if sum(len(g) for g, _ in known.values()) > HELD:
                    yield from told()
    fold()
    yield from told()


def fit(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", max_docs: int = TRAIN_DOCS, max_grams: int | None = None) -> Filters:
    """Filters from rows with a text, a language and an id: about ``max_docs`` of them, by a hash of the id.

    All typical n-grams of those rows come to the driver, so their number is bounded by the rows; ``max_grams`` keeps the most
    frequent ones of each language only. Rows with a null are not learned from; of an empty table nothing is learned and
    every text is ``und``. A table with rows to learn from of which none is chosen is an error, not an empty model.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "languages")
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("id is not null and lang is not null and text is not null")
    chosen = rows.where(in_share(F.col("id"), training_share(max_docs, rows.count())))
    counts = work.save(chosen.select("lang", "text").mapInArrow(lambda batches: lean(_counts(batches)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    if not counts.limit(1).count() and rows.limit(1).count() and not chosen.limit(1).count():
        raise RuntimeError("no labelled row was chosen to learn from, though there are some")
    # both sides hold a row for each language
    total = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    rate = counts.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("all"))
    typical = rate.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where((F.col("n") >= LEAST_COUNT) & (F.col("rate") >= LEAST_SHARE * F.col("top")))
    if max_grams is not None:
        typical = typical.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= max_grams)
    found = typical.select("lang", "gram").toArrow()
    work.drop("counts")
    langs, gram = found.column("lang"), found.column("gram")
    return Filters.build({lang.as_py(): gram.filter(pc.equal(langs, lang)).to_numpy().view(U64) for lang in pc.unique(langs)})


def predictions(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1), from the whole text alone; other columns stay.

    The filters are of a fixed size (``SLOTS`` masks), so their broadcast doesn't grow with the data.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    return docs.withColumn("__lang", _predict(sent)(F.col(text_col).cast("string"))).withColumns({"lang_pred": F.col("__lang.lang_pred"), "lang_score": F.col("__lang.lang_score")}).drop("__lang")


def _predict(sent):
    @F.arrow_udf("lang_pred string, lang_score double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def found():
            for text in texts:
                made = [sent.value.decide(t.as_py()) for t in text]
                yield pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], ["lang_pred", "lang_score"])

        yield from lean(found())

    return predict
