"""Quality classifier: document evidence with hierarchical empirical-Bayes site posteriors.

A logistic model of byte statistics gives each document's evidence. Labelled documents are counted by
host and by path within the host; a path's rate is shrunk to its host's and that to the overall one,
by beta priors fitted over all groups. The posterior log-odds are the evidence plus what the site adds
over the overall rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, in_share, lean, small_batches, training_share
from ._hashing import SEPARATOR
from .url_filter import _posterior

#: About how many labelled documents the evidence model is fitted on, chosen by a hash of the id.
TRAIN_DOCS = 20_000
#: Site groups up to this number (under 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SITES = 100_000
FEATURES = 256 + 4
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def features(text: str | None) -> np.ndarray:
    """Roots of byte frequencies, length, mean word length, share of repeated lines, share of upper case."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(FEATURES, np.float32)
    if not data:
        return out
    count = np.zeros(256, np.int64)
    for at in range(0, len(data), 1 << 20):
        count += np.bincount(np.frombuffer(data, np.uint8, min(1 << 20, len(data) - at), at), minlength=256)
    n = len(data)
    out[:256] = np.sqrt(count / n)
    gaps = int(count[SEPARATOR].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    cased = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    out[256:] = np.log1p(n) / 10, min(50.0, n / (gaps + 1)) / 10, 1 - len(set(lines)) / max(1, len(lines)), count[_UPPER].sum() / cased
    return out


@dataclass
class Evidence:
    """Log-odds of good quality from a document alone."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 25) -> Evidence:
        """Ridge logistic regression by Newton steps; with one class or none the evidence is the smoothed overall log-odds."""
        y = y.astype(np.float64)
        prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        if len(np.unique(y)) < 2:
            return cls(np.zeros(FEATURES), np.zeros(FEATURES), np.ones(FEATURES), prior)
        mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
        w = np.zeros(FEATURES + 1)
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            slope, curve = -penalty * w, np.diag(penalty)
            for at in range(0, len(x), 1000):  # the normal equations are summed slice by slice: only the floats of x are held
                z = np.column_stack([(x[at : at + 1000] - mean) / scale, np.ones(len(x[at : at + 1000]))])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                slope += z.T @ (y[at : at + 1000] - p)
                curve += (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
            step = np.linalg.solve(curve, slope)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(w[:-1], mean, scale, float(w[-1]))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)


def _matrix(text: pa.Array) -> np.ndarray:
    return np.stack([features(t.as_py()) for t in text]) if len(text) else np.empty((0, FEATURES), np.float32)


def _features():
    @F.arrow_udf("array<float>")
    def vectors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def found():
            for text in texts:
                x = _matrix(text)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel(), pa.float32()))

        yield from lean(found())

    return vectors


def _evidence(model: Evidence):
    @F.arrow_udf("double")
    def log_odds(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(pa.array(np.round(model.log_odds(_matrix(text)), 9), pa.float64()) for text in texts)

    return log_odds


def fit_evidence(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS) -> Evidence:
    """The model from about ``max_docs`` labelled documents; ``labels(id, good)``, with nulls left out.

    Rows that repeat an id count as one, with the greatest text and the label that at least half of them have.
    """
    small_batches(docs.sparkSession)
    real = labels.where("id is not null and good is not null")
    n = real.count()
    chosen = real.where(in_share(F.col("id"), training_share(max_docs, n))).groupBy("id").agg(F.avg(F.col("good").cast("double")).alias("good"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # at most about max_docs rows
    rows = rows.groupBy("id").agg(F.max("text").alias("text"), F.avg("good").alias("good"))  # repeated ids are one row
    found = rows.select("id", _features()("text").alias("x"), (F.col("good") >= 0.5).cast("int").alias("y")).toArrow().sort_by("id")
    if not found.num_rows and n and not chosen.limit(1).count():
        raise RuntimeError("no labelled document was chosen to learn from, though there are some")
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    return Evidence.fit(x, found.column("y").to_numpy())


def scored(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", max_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` with ``quality_score`` (posterior probability of good quality, 0 to 1) and ``quality_kept`` (at least a half).

    ``labels(id, good)`` are joined by id; all of them count towards the sites. Sites are host and path;
    tables without urls give the columns that stand for them. A null or unseen path takes its host's
    rate, a null or unseen host the overall one. Null and empty texts have the evidence of no bytes.
    Without labels every row scores a half and is kept. Rows that repeat are scored alike; other
    columns stay, and columns by the two names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("quality_score", "quality_kept")
    work = Workspace(spark, "quality")
    model = fit_evidence(docs, labels, id_col=id_col, text_col=text_col, max_docs=max_docs)
    host, path = F.col(host_col).cast("string"), F.col(path_col).cast("string")
    outcomes = docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).join(labels.where("id is not null and good is not null"), "id")
    counted = work.save(outcomes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(1 - F.col("good").cast("long")).alias("bad")), "sites")
    bad, n = counted.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    overall = (bad + 1) / (n + 2)
    base = float(np.log((1 - overall) / overall))
    hosts = _posterior(counted.where("host is not null").groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), F.lit(overall)).select("host", F.col("mean").alias("of_host"))
    paths = _posterior(counted.where("host is not null and path is not null").join(hosts, "host"), F.col("of_host")).select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("mean").alias("__of_path"))
    hosts, paths = work.save(hosts.select(F.col("host").alias("__host1"), F.col("of_host").alias("__of_host")), "hosts"), work.save(paths, "paths")
    few = paths.count() + hosts.count() <= BROADCAST_SITES
    sent = F.broadcast if few else (lambda x: x)
    known = docs.withColumn("__evidence", _evidence(model)(F.col(text_col).cast("string")))
    known = known.join(sent(paths), (host == F.col("__host")) & (path == F.col("__path")), "left").join(sent(hosts), host == F.col("__host1"), "left")
    rate = F.coalesce("__of_path", "__of_host", F.lit(overall))
    odds = F.col("__evidence") + F.log((1 - rate) / rate) - F.lit(base)
    score = F.round(1 / (1 + F.exp(-odds)), 9)
    return known.withColumn("quality_score", score).withColumn("quality_kept", F.col("quality_score") >= 0.5).drop("__evidence", "__host", "__path", "__of_path", "__host1", "__of_host")
