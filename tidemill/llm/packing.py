"""Best-fit packing under conflicts.

Documents are cut into pieces that fit a bin; pieces are dealt to blocks of bounded size by hash and
each block is packed by itself. Open bins are ordered by what they have left and carry bitmaps of the
sources and duplicate clusters in them; a piece goes to the tightest bin that has room and shares
neither, found by searching on from the first bin with room.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SEPARATORS, Workspace, lean, words_of

#: Pieces in a block on average: all that a task holds of its input at once.
BLOCK_PIECES = 4096


def cluster_of(text: Column) -> Column:
    """Duplicate cluster: equal texts but for the case of A-Z and the length of gaps. Null: none."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.translate(text, SEPARATORS, "") != "", F.md5(F.array_join(words_of(plain), " ")))


def best_fit(pieces: list[tuple], capacity: int) -> list[int]:
    """Bin of each piece ``(size, source, cluster)``, taken in the given order; None conflicts with nothing."""
    bits: dict = {}
    open_bins: list[tuple[int, int]] = []  # (left, bin), ascending
    sources, clusters, out = [], [], []
    for size, source, cluster in pieces:
        s = 0 if source is None else 1 << bits.setdefault(("source", source), len(bits))
        c = 0 if cluster is None else 1 << bits.setdefault(("cluster", cluster), len(bits))
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (sources[open_bins[at][1]] & s or clusters[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            left, b = open_bins.pop(at)
            sources[b] |= s
            clusters[b] |= c
        else:
            left, b = capacity, len(sources)
            sources.append(s)
            clusters.append(c)
        if left > size:
            insort(open_bins, (left - size, b))
        out.append(b)
    return out


def _pack(batches, *, capacity, most):
    """Rows sorted by (block, size downwards, id, piece): packed block by block, a block of over ``most`` rows in parts."""
    held, block, used = [], None, 0

    def flush():
        nonlocal used
        if held:
            bins = [used + b for b in best_fit([(r["size"], r["source"], r["cluster"]) for r in held], capacity)]
            used = max(bins) + 1
            cols = [[r[k] for r in held] for k in ("id", "piece", "start", "size", "block")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*cols, bins)], ["id", "piece", "start", "size", "block", "bin"])
            held.clear()

    for b in batches:
        for r in b.to_pylist():
            if r["block"] != block or len(held) >= most:
                yield from flush()
                if r["block"] != block:
                    block, used = r["block"], 0
            held.append(r)
    yield from flush()


def packed(docs: DataFrame, *, capacity: int = 2048, id_col: str = "doc_id", source_col: str | None = "source", size: Column | None = None, cluster: Column | None = None, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``(id, piece, start, size, block, bin)`` of every piece of every document.

    ``size`` is by default the number of words of ``text``, ``cluster`` :func:`cluster_of` it. A
    document over ``capacity`` is cut into whole bins, which no other piece can join, and a rest. A
    bin never holds two pieces of one source or one duplicate cluster; nulls conflict with nothing.
    Documents of size 0 or null take no room: they have one piece of size 0 in a bin like any other.
    Bins are numbered within a block; (block, bin) names one. Ties are packed by id, then piece.
    Null and repeated ids are packed row by row; an empty table gives an empty result.

    Pieces are dealt to blocks of about ``block_pieces`` by id, piece, source and cluster, those without an id
    by a number of the row too. Rows that are equal in all of these meet in one block; it is packed in parts
    of four times ``block_pieces``, so that no more is held. The tightest bin is that of the block or part.
    """
    size = F.size(words_of(F.col("text"))) if size is None else size
    cluster = cluster_of(F.col("text")) if cluster is None else cluster
    source = F.lit(None).cast("string") if source_col is None else F.col(source_col).cast("string")
    work = Workspace(docs.sparkSession, "packing")
    total = F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")
    rows = work.save(docs.select(F.col(id_col).cast("long").alias("id"), source.alias("source"), total.alias("total"), cluster.alias("cluster"), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("row")), "rows")
    count = F.greatest(F.ceil(F.col("total") / capacity), F.lit(1).cast("long"))
    blocks = max(1, -(-(rows.agg(F.sum(count)).first()[0] or 0) // block_pieces))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).withColumn("start", F.col("piece") * capacity)
    dealt = pieces.withColumn("size", F.least(F.lit(capacity), F.col("total") - F.col("start"))).withColumn("block", F.pmod(F.xxhash64("id", "piece", "source", "cluster", "row"), F.lit(blocks)))
    dealt = dealt.select("id", "piece", "start", "size", "source", "cluster", "block").repartition("block").sortWithinPartitions("block", F.desc("size"), "id", "piece", "source", "cluster")
    return dealt.mapInArrow(lambda batches: lean(_pack(batches, capacity=capacity, most=4 * block_pieces)), "id long, piece long, start long, size long, block long, bin long")
