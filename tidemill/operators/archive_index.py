"""An inverted index of the archive: postings in files by term, upserted in segments, searched by a query's terms only.

A folder holds segments and the versions that commit them. Each upsert writes its documents' postings as one more segment,
dealt to folders by a hash of the term, and the earlier copies of these documents as dead; then a version lists the segments
that count, with the number and length of the live documents. What an upsert leaves unfinished is in no version and isn't
read. A search reads the folders of its terms in those segments, nothing else. ``compacted`` writes all live postings
as one segment.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.udfs import let
from .render import search_terms

#: Folders of a segment; fixed for an index, since a term's folder follows from it.
BUCKETS = 64
#: Pairs of dead documents up to this number (some 50 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_DEAD = 500_000


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _frequencies(title: Column, content: Column, weight: float) -> Column:
    """Each term of a document once, with its weighed number: ``array<struct<term, tf>>``.

    Terms are sorted within the row and runs of equal ones counted, so a document's terms need no shuffle. Terms of the title
    are marked by a character that no term has, which sorts them right behind the same terms of the content.
    """
    mark = F.lit("\0")
    nothing = F.array().cast("array<struct<term:string,tf:double>>")

    def runs(terms: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(terms, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(terms)) - i).cast("double").alias("n"))))

    def merged(found: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            after = F.get(found, k + 1)
            titled = F.when(x["term"].endswith(mark), F.struct(F.replace(x["term"], mark, F.lit("")).alias("term"), (x["n"] * weight).alias("tf")))
            both = F.when(after["term"] == F.concat(x["term"], mark), x["n"] + after["n"] * weight).otherwise(x["n"])
            return F.when(~x["term"].endswith(mark), F.struct(x["term"].alias("term"), both.alias("tf"))).when((k == 0) | (F.concat(F.coalesce(F.get(found, k - 1)["term"], F.lit("")), mark) != x["term"]), titled)

        return F.filter(F.transform(found, one), lambda x: x.isNotNull())

    every = F.sort_array(F.concat(content, F.transform(title, lambda x: F.concat(x, mark))))
    return F.when(F.size(title) + F.size(content) > 0, let(every, lambda terms: let(runs(terms), merged))).otherwise(nothing)


def _written(postings: DataFrame, path: str, buckets: int) -> None:
    """By folders of terms, sorted by term so that files tell which terms they hold; a folder of frequent terms is several tasks'."""
    postings.withColumn("bucket", _bucket(F.col("term"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def _dead(spark: SparkSession, path: str, state: dict) -> DataFrame | None:
    found = [f"{path}/dead/{s}" for s in state["dead"]]
    return spark.read.parquet(*found) if found else None


def _live(rows: DataFrame, dead: DataFrame | None, n_dead: int) -> DataFrame:
    if dead is None:
        return rows
    return rows.join(F.broadcast(dead) if n_dead <= BROADCAST_DEAD else dead, ["id", "segment"], "left_anti")


def _segments(spark: SparkSession, path: str, kind: str, state: dict) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/segment={s}" for s in state["segments"]])


def upsert(docs: DataFrame, path: str, *, title_weight: float = 3.0, buckets: int = BUCKETS, id_col: str = "id", title_col: str = "title", content_col: str = "content", date_col: str | None = None) -> int:
    """Adds ``docs`` to the index at ``path``, in place of those with their ids, and returns the new version.

    Null titles and contents are empty. Documents with a null id are left out; an id that ``docs`` repeats is an error. Of two
    upserts at one time one fails, and its segment isn't read.
    """
    spark = docs.sparkSession
    version, state = storage.committed(spark, f"{path}/versions") or (0, {"segments": [], "dead": [], "n_dead": 0, "n": 0, "length": 0.0, "buckets": buckets, "title_weight": title_weight, "id": docs.schema[id_col].dataType.simpleString()})
    if (state["buckets"], state["title_weight"], state["id"]) != (buckets, title_weight, docs.schema[id_col].dataType.simpleString()):
        raise ValueError("the index was made with other folders, weights or ids")
    segment = uuid.uuid4().hex
    date = F.lit(None).cast("string") if date_col is None else F.col(date_col).cast("string")
    title, content = (search_terms(F.coalesce(F.col(c), F.lit(""))) for c in (title_col, content_col))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), date.alias("date"), title.alias("t"), content.alias("c"))
    rows = rows.select("id", "date", (F.size("t") * title_weight + F.size("c")).alias("len"), "t", "c")
    rows.select("id", "date", "len").write.parquet(f"{path}/documents/segment={segment}")
    own = spark.read.parquet(f"{path}/documents/segment={segment}")
    n, distinct, length = own.agg(F.count("*"), F.count_distinct("id"), F.coalesce(F.sum("len"), F.lit(0.0))).first()
    if n != distinct:
        raise ValueError("an id is repeated")
    each = rows.select("id", "date", "len", F.explode(_frequencies(F.col("t"), F.col("c"), title_weight)).alias("x")).select("id", "date", "len", "x.term", "x.tf")
    _written(each, f"{path}/postings/segment={segment}", buckets)
    gone, lost, dead = 0, 0.0, state["dead"]
    if state["segments"]:
        before = _live(_segments(spark, path, "documents", state), _dead(spark, path, state), state["n_dead"])
        before.join(own.select("id"), "id", "left_semi").select("id", "segment", "len").write.parquet(f"{path}/dead/{segment}")
        gone, lost = spark.read.parquet(f"{path}/dead/{segment}").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0.0))).first()
        dead = dead + [segment]
    state = state | {"segments": state["segments"] + [segment], "dead": dead, "n_dead": state["n_dead"] + gone, "n": state["n"] + n - gone, "length": state["length"] + length - lost}
    storage.commit(spark, f"{path}/versions", version + 1, state)
    return version + 1


def compacted(spark: SparkSession, path: str) -> int:
    """All live postings as one segment, and the new version; what was written before stays for readers of older versions."""
    version, state = storage.committed(spark, f"{path}/versions")
    segment, dead = uuid.uuid4().hex, _dead(spark, path, state)
    _live(_segments(spark, path, "documents", state), dead, state["n_dead"]).drop("segment").write.parquet(f"{path}/documents/segment={segment}")
    _written(_live(_segments(spark, path, "postings", state), dead, state["n_dead"]).drop("segment", "bucket"), f"{path}/postings/segment={segment}", state["buckets"])
    storage.commit(spark, f"{path}/versions", version + 1, state | {"segments": [segment], "dead": [], "n_dead": 0})
    return version + 1


def search(spark: SparkSession, path: str, query: str, *, limit: int = 30, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(id, date, score)``: BM25 over title and content, the best ``limit``; ties by date, the newest first, then id."""
    found = storage.committed(spark, f"{path}/versions")
    if found is None:
        raise ValueError("no index there")
    state = found[1]
    empty = spark.createDataFrame([], f"id {state['id']}, date string, score double")
    if not state["n"]:
        return empty
    asked = spark.range(1).select(F.explode(F.array_sort(F.array_distinct(search_terms(F.lit(query))))).alias("term"))
    terms = asked.select("term", _bucket(F.col("term"), state["buckets"]).alias("bucket")).orderBy("term").collect()
    if not terms:
        return empty
    words = [t.term for t in terms]
    postings = _segments(spark, path, "postings", state).where(F.col("bucket").isin(sorted({t.bucket for t in terms})) & F.col("term").isin(words))
    postings = _live(postings, _dead(spark, path, state), state["n_dead"])
    rows = postings.groupBy("id", "date", "len").agg(*[F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0.0)).alias(f"tf{i}") for i, w in enumerate(words)])
    # a row for all terms
    df = postings.agg(*[F.count_if(F.col("term") == w).alias(f"df{i}") for i, w in enumerate(words)])
    score, mean = F.lit(0.0), state["length"] / state["n"]
    for i in range(len(words)):
        tf, n = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (state["n"] - n + 0.5) / (n + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / mean))
    return rows.crossJoin(F.broadcast(df)).select("id", "date", F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.desc("date"), F.asc("id")).limit(limit)
