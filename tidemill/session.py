"""Session settings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: What results depend on; everything else is the cluster's.
SEMANTICS = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.ansi.enabled": "true"}
#: Upper bounds on a batch that goes to Python; pages and feeds are long, and every running task holds batches on both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def configured(spark: SparkSession) -> SparkSession:
    """``spark`` with the settings that results depend on, and with its batches for Python lowered to what memory allows."""
    for k, v in SEMANTICS.items():
        spark.conf.set(k, v)
    for k, most in BATCHES.items():
        now = str(spark.conf.get(k)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(k, str(most))
    return spark


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores, for costly work on narrow rows: a small file is read by one task, however many rows it packs."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def local_session(name: str = "tidemill", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = SparkSession.builder.appName(name).master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("TIDEMILL_DRIVER_MEMORY", "6g")).config("spark.sql.adaptive.enabled", "true")
    for k, v in SEMANTICS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
