"""Runs and their stages: tables by run and stage, where a stage written again takes what followed from it away."""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages in order, and the prefixes of what each one notes about a run.
STAGES = ("raw", "scored", "filtered", "enriched")
META = {"raw": "fetch", "scored": "score", "filtered": "filter", "enriched": "enrich"}
_ID = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")


class RunStore:
    """Stages of runs as Parquet below ``root``, any folder that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._last = dt.datetime.min

    def _path(self, run_id: str, *more: str) -> str:
        if not _ID.match(run_id) or ".." in run_id:
            raise ValueError(f"not a run id: {run_id!r}")
        return "/".join([self.root, run_id, *more])

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def create(self, now: dt.datetime | None = None) -> str:
        """A new run; ids rise even within a microsecond."""
        at = max(now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), self._last + dt.timedelta(microseconds=1))
        self._last = at
        run_id = f"run-{at:%Y%m%d-%H%M%S-%f}"
        self._put_meta(run_id, {"run_id": run_id, "created_at": at.isoformat() + "Z"})
        return run_id

    def _put_meta(self, run_id: str, meta: dict) -> None:
        self.spark.createDataFrame([(json.dumps(meta, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(self._path(run_id, "meta"))

    def meta(self, run_id: str) -> dict:
        if not self._exists(self._path(run_id, "meta")):
            return {}
        return json.loads("\n".join(r.value for r in self.spark.read.text(self._path(run_id, "meta")).collect()))

    def update_meta(self, run_id: str, **values) -> None:
        self._put_meta(run_id, self.meta(run_id) | values)

    def has(self, run_id: str, stage: str) -> bool:
        return self._exists(self._path(run_id, stage, "_SUCCESS"))

    def save(self, run_id: str, stage: str, items: DataFrame) -> None:
        """Writes a stage; later stages, all summaries and what was noted of them go."""
        at = STAGES.index(stage)
        for later in (*STAGES[at + 1 :], "summaries"):
            self._delete(self._path(run_id, later))
        items.write.mode("overwrite").parquet(self._path(run_id, stage))
        gone = tuple(META[s] for s in STAGES[at + 1 :]) + ("summary",)
        self._put_meta(run_id, {k: v for k, v in self.meta(run_id).items() if not k.startswith(gone)})

    def load(self, run_id: str, stage: str) -> DataFrame:
        if not self.has(run_id, stage):
            raise FileNotFoundError(f"{run_id} has no stage {stage}")
        return self.spark.read.parquet(self._path(run_id, stage))

    def best_stage(self, run_id: str) -> str | None:
        """The furthest stage there is."""
        return next((s for s in reversed(STAGES) if self.has(run_id, s)), None)

    def save_summary(self, run_id: str, language: str, text: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").parquet(self._path(run_id, "summaries", f"language={language}"))

    def summary(self, run_id: str, language: str) -> str:
        return self.spark.read.parquet(self._path(run_id, "summaries", f"language={language}")).first().value

    def runs(self, limit: int | None = None) -> list[str]:
        """Run ids, newest first."""
        fs, p = self._fs(self.root)
        names = sorted((s.getPath().getName() for s in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
        names = [n for n in names if _ID.match(n)]
        return names if limit is None else names[: max(0, limit)]


def append_once(spark: SparkSession, path: str, rows: DataFrame, key: str = "snapshot_id", content: str = "payload_object_hash") -> int:
    """Appends content-addressed rows whose key isn't there yet; the same key with another content is an error."""
    try:
        old = spark.read.parquet(path).select(key, F.col(content).alias("__old"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], f"{key} string, __old string")
    rows = rows.dropDuplicates([key, content])
    clash = rows.join(old, key).where(F.col(content) != F.col("__old")).unionByName(rows.groupBy(key).agg(F.count_distinct(content).alias("n")).where("n > 1").select(key), allowMissingColumns=True).limit(1).collect()
    if clash:
        raise ValueError(f"{key} {clash[0][key]} has another content")
    new = rows.join(old, key, "left_anti").persist()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n
