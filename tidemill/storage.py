"""Folders that queries share, and small JSON files that commit what was written beside them."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own = ""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one in ``spark.checkpoint.dir``, which the driver and all executors share; local sessions without one get their own."""
    global _own
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = _own = _own or "file://" + tempfile.mkdtemp(prefix="tidemill-", dir=os.environ.get("TMPDIR"))
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str | list[str], kind: str = "parquet", **options) -> DataFrame | None:
    """What is at a path, or None where nothing is."""
    try:
        return spark.read.format(kind).options(**options).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def commit(spark: SparkSession, folder: str, version: int, value: dict) -> None:
    """Writes ``value`` as ``folder/version``; an error if somebody else has written that version."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{folder}/version={version:09}")


def committed(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The last committed version and its value. Files that a writer left unfinished aren't seen, and what isn't JSON is passed over."""
    found = read(spark, folder, "text", wholetext=True)
    if found is None:
        return None
    rows = found.select(F.col("version").cast("int"), "value").where(F.try_parse_json("value").isNotNull())
    last = rows.orderBy(F.desc("version")).limit(1).collect()
    return (last[0].version, json.loads(last[0].value)) if last else None
