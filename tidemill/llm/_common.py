"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words: the bytes 0x20 and 0x09 to 0x0D.
SEPARATORS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once (a lambda's argument is never inlined again)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of the whole text; of null, an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")


#: Values of the hash that a training share is cut from: so many that no table is large enough for a share of none of them.
SHARE = 1 << 62


def training_share(most: int, n: int) -> int:
    """How many of ``SHARE`` values choose about ``most`` of ``n`` rows, at least one."""
    return SHARE if n <= most else max(1, SHARE * most // n)


def in_share(key: Column, share: int) -> Column:
    """Whether a row is among those chosen by the hash of its ``key``."""
    return F.shiftrightunsigned(F.xxhash64(key), 2) < F.lit(share)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one is set only where there is none, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import os
    import tempfile

    global _own
    _own = _own or "file://" + tempfile.mkdtemp(prefix="tidemill-", dir=os.environ.get("TMPDIR"))
    return _own


_own = ""


#: Rows and bytes in a batch that goes to Python: texts and sets are long, and batches of each running task are held on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows in a file of a table whose size is known to be small.
FILE_ROWS = 250_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds on batches for Python, where they are higher. What is returned is lazy, so they stay so."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def lean(batches: Iterator) -> Iterator:
    """``batches`` as they are; then the worker, which is used again, gives freed memory back to the machine."""
    yield from batches
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Workspace:
    """Where an operator keeps what it reads more than once.

    ``save`` writes a table to the shared folder, which cuts lineage and frees its shuffles; ``small``
    does so for few or narrow rows of wide stages.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df``, written and read again; with a bound on its ``rows``, in no more files than they need."""
        schema = df.schema
        out = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
        out.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def small(self, df: DataFrame, name: str, rows: int) -> DataFrame:
        """Like ``save`` for narrow rows of a wide stage, which are moved so that its tasks don't write a file each."""
        return self.save(df.repartition(max(1, -(-rows // FILE_ROWS))), name)

    def drop(self, *names: str) -> None:
        """Frees written tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def freed(self, *names: str) -> None:
        """``drop``, and lets Spark remove the shuffles of finished jobs from executors' disks: it does so when the driver collects garbage."""
        self.drop(*names)
        self.spark.sparkContext._jvm.System.gc()


def first_in_groups(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each group and their place from 1 in ``rank``. A group of any size is first thinned out by task, then in parts."""
    part = F.pmod(F.spark_partition_id(), F.lit(64))
    thin = rows.withColumn("__part", part).withColumn(rank, F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))).where(F.col(rank) <= k)
    return thin.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k).drop("__part")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
