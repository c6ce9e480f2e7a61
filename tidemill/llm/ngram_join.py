"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Sets are put into size bands. For two sets of a band and the next one, the threshold bounds the
Hamming distance by some ``k``; the shingle domain is hashed into first-level parts, each cut into
``n2`` second-level parts, and for every subset that leaves out ``k2`` of them the set's projection
is a signature. At most ``k // (k2 + 1)`` first-level parts differ by more than ``k2``, so two sets
that link agree on a whole signature in every other one. Some parts are added, and a set in which no
more than those have a thin projection leaves thin ones out: one signature at least is still shared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, first_in_groups, lean
from ._hashing import EXACT, LOWER, U64, mix, shingles, word_hashes
from .graph import components

#: Projections of at most so many shingles say nothing; a set with few of them leaves them out.
THIN = 0
#: Counters of the sketch that bounds an intersection from above.
SKETCH = 128
#: Most members of one signature that a task compares at once; larger ones go block by block.
BLOCK = 1024
#: So many of a document's smallest signatures go with it, so that a pair is named by the first one that it shares.
LEAST = 16
#: Ids up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


@lru_cache(maxsize=64)
def bands(percent: int, up_to: int) -> tuple[tuple[int, int], ...]:
    """(smallest, largest) sizes of the bands up to a size: sets that link lie in one band or in two adjacent ones."""
    out, low = [], 1
    while low <= up_to:
        high = 100 * low // percent
        out.append((low, high))
        low = high + 1
    return tuple(out)


@lru_cache(maxsize=4096)
def plan(percent: int, low: int, high: int, n2: int, k2: int) -> tuple[int, int]:
    """(first-level parts, how many of them may lose a thin projection) of a band; no parts: only equal sets link."""
    k = (high + 100 * high // percent) * (100 - percent) // (100 + percent)
    if not k:
        return 0, 0
    n1, spare = k // (k2 + 1) + 1, 0
    for _ in range(8):  # more parts make smaller ones
        mean = low / (n1 + spare) * (n2 - k2) / n2
        thin = (n1 + spare) * math.comb(n2, k2) * math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(THIN + 1))
        spare = min(n1 // 2, math.ceil(thin + 3 * math.sqrt(thin)) if thin > 1e-3 else 0)
    return n1 + spare, spare


def signatures(found: np.ndarray, percent: int, n2: int, k2: int) -> np.ndarray:
    """Signatures of one set of distinct shingle hashes."""
    out = []
    layout = bands(percent, max(1, len(found)))
    for band in (len(layout) - 1, len(layout) - 2):
        if band < 0 or not len(found):
            continue
        n1, spare = plan(percent, *layout[band], n2, k2)
        if not n1:
            continue
        m = mix(found + U64(band * 2 + 1))
        part = ((m >> U64(32)) % U64(n1)).astype(np.int64) * n2 + ((m & U64(0xFFFFFFFF)) % U64(n2)).astype(np.int64)
        size = n1 * n2
        count = np.bincount(part, minlength=size).reshape(n1, n2)
        # halves are summed apart: doubles hold such sums exactly
        low = np.bincount(part, weights=(m & U64(0xFFFFFFFF)).astype(np.float64), minlength=size)
        high = np.bincount(part, weights=(m >> U64(32)).astype(np.float64), minlength=size)
        sums = mix(low.astype(U64) + (high.astype(U64) << U64(32))).reshape(n1, n2)
        of_part = mix(np.arange(n1, dtype=U64) * U64(1 << 20) + U64(band))
        made, bare = [], np.zeros(n1, bool)
        for i, kept in enumerate(combinations(range(n2), n2 - k2)):
            total = of_part + U64(i)
            for j in kept:
                total = mix(total + sums[:, j])
            none = count[:, list(kept)].sum(1) <= THIN
            bare |= none
            made.append((total, none))
        drop = int(bare.sum()) <= spare
        out += [total[~none] if drop else total for total, none in made]
    return np.concatenate(out) if out else np.empty(0, U64)


def sketch(found: np.ndarray) -> bytes:
    """Counts of the shingles by hash: the sum of the smaller counts of two sketches bounds the intersection.

    Counts take half a byte each where all fit, else a byte; a set too large for that has no sketch.
    """
    count = np.bincount((found & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    if count.max() >= 256:
        return b""
    count = count.astype(np.uint8)
    return (count if count.max() >= 16 else count[::2] | (count[1::2] << 4)).tobytes()


def _counts(made: list[bytes]) -> np.ndarray:
    """Counts of sketches, a row each; zeros where there is none."""
    size, out = np.fromiter(map(len, made), np.int64, len(made)), np.zeros((len(made), SKETCH), np.uint8)
    half, full = np.flatnonzero(size == SKETCH // 2), np.flatnonzero(size == SKETCH)
    if half.size:
        b = np.frombuffer(b"".join([made[i] for i in half]), np.uint8).reshape(-1, SKETCH // 2)
        out[np.ix_(half, range(0, SKETCH, 2))] = b & 15
        out[np.ix_(half, range(1, SKETCH, 2))] = b >> 4
    if full.size:
        out[full] = np.frombuffer(b"".join([made[i] for i in full]), np.uint8).reshape(-1, SKETCH)
    return out


def _sets(text: pa.Array, n: int, lower: bool) -> Iterator[np.ndarray]:
    for t in text:
        t = t.as_buffer() if hasattr(t, "as_buffer") else None
        yield shingles(word_hashes(t, LOWER if lower else EXACT), n) if t is not None and t.size else np.empty(0, U64)


def _run(work, **how):
    """``work`` over batches with ``how``; its worker gives memory back at the end of a task."""
    return lambda batches: lean(work(batches, **how))


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x, U64).view(np.int64))


def _fingerprints(batches, *, n, lower):
    for b in batches:
        rows = [(len(s), mix(s ^ U64(0x5555555555555555)).sum(dtype=U64), mix(s).sum(dtype=U64)) for s in _sets(b.column(1), n, lower)]
        size, f1, f2 = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), _long(f1), _long(f2)], ["id", "size", "f1", "f2"])


def _emit(batches, *, n, lower, percent, n2, k2):
    for b in batches:
        ids, sigs, held = [], [], 0
        for i, s in zip(b.column(0).to_numpy(zero_copy_only=False), _sets(b.column(1), n, lower), strict=True):
            made = signatures(s, percent, n2, k2)
            ids.append(np.full(len(made), i, np.int64))
            sigs.append(made)
            held += len(made)
            if held > 500_000:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(sigs)), pa.array(np.concatenate(ids))], ["sig", "id"])
                ids, sigs, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(sigs)), pa.array(np.concatenate(ids))], ["sig", "id"])


def _stars(batches, *, block):
    """Rows sorted by (sig, id): the members of each signature that has several, with the first of them. ``n`` counts members so far.

    A first member is told with its second, and every ``block`` members a row with a null id says that there are so many.
    """
    last, head, seen = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        sig, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.empty(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        new[0] = last is None or sig[0] != last
        at = np.flatnonzero(new)
        run = np.cumsum(new)
        starts = np.concatenate([[0], at])[run]
        nth = np.arange(len(sig)) - starts + np.where(run == 0, seen, 0) + 1
        lo = np.where(run == 0, head, ids[starts])
        last, head, seen = sig[-1], lo[-1], nth[-1]
        member, second, full = nth > 1, nth == 2, nth % block == 0
        out = [np.concatenate(x) for x in ((sig[second], sig[member], sig[full]), (lo[second], ids[member], ids[full]), (lo[second], lo[member], lo[full]), (nth[second], nth[member], nth[full]))]
        if len(out[0]):
            large = np.arange(len(out[0])) >= len(out[0]) - np.count_nonzero(full)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], mask=large), pa.array(out[2]), pa.array(out[3])], ["sig", "id", "lo", "n"])


def wide_sketch(found: np.ndarray) -> bytes:
    """Like ``sketch``, with more counters for larger sets: at most four shingles a counter on average."""
    counters = SKETCH
    while counters * 4 < len(found):
        counters *= 4
    count = np.bincount((found & U64(counters - 1)).astype(np.int64), minlength=counters)
    if count.max() >= 256:
        return b""
    count = count.astype(np.uint8)
    return (count if count.max() >= 16 else count[::2] | (count[1::2] << 4)).tobytes()


def _unpacked(made: bytes) -> np.ndarray:
    """Counts of a wide sketch: by its length, in bytes or in halves of bytes."""
    b = np.frombuffer(made, np.uint8)
    if (len(b) // SKETCH).bit_length() % 2:  # SKETCH times a power of four
        return b
    out = np.empty(2 * len(b), np.uint8)
    out[::2], out[1::2] = b & 15, b >> 4
    return out


def _may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether two sets of ``n`` and ``m`` shingles may link, by their wide sketches."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    if not x or not y:
        return True
    x, y = _unpacked(x).astype(np.int64), _unpacked(y).astype(np.int64)
    counters = min(len(x), len(y))
    both = int(np.minimum(x.reshape(-1, counters).sum(0), y.reshape(-1, counters).sum(0)).sum())
    return 100 * both >= percent * (n + m - both)


def _sketches(batches, *, n, lower):
    for b in batches:
        sets = list(_sets(b.column(1), n, lower))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([wide_sketch(s) for s in sets], pa.binary())], ["id", "size", "sketch", "wide"])


def _bounded(batches, *, percent):
    """Pairs ``(a, b)`` with sizes and wide sketches: those that may link."""
    for b in batches:
        keep = pa.array([_may_link(x.as_py(), y.as_py(), n, m, percent) for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def _arrays(batches, *, n, lower):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in _sets(b.column(1), n, lower)], pa.binary())], ["id", "found"])


def _verified(batches, *, percent):
    for b in batches:
        keep = np.zeros(b.num_rows, bool)
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def _padded(lists: pa.Array) -> np.ndarray:
    """Lists of at most ``LEAST`` signatures, a row each, filled up with a value below which nothing counts."""
    size = np.asarray(lists.value_lengths().fill_null(0))
    out = np.full((len(size), LEAST), np.iinfo(np.int64).max)
    out[np.arange(LEAST) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _close(sig: int, rows: list, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one (signature, block, block) that lie in different components and that sketches don't rule out.

    A pair that meets at a smaller signature too, by the lists of both, is left to that one: the smallest that it shares always names it.
    """
    ids, comps, blocks, size, counts, known, least = (np.concatenate(x) for x in zip(*rows, strict=True))
    for i in range(len(ids) - 1):
        rest = np.flatnonzero((comps[i + 1 :] != comps[i]) & ((blocks[i + 1 :] != blocks[i]) | (blocks[-1] == blocks[0]))) + i + 1
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        if len(rest):
            both = np.minimum(counts[rest], counts[i]).sum(1, dtype=np.int64)
            rest = rest[(100 * both >= percent * (size[rest] + size[i] - both)) | ~known[rest] | ~known[i]]
            before = least[i][least[i] < sig]
            if len(rest) and len(before):
                rest = rest[~(least[rest][:, :, None] == before).any((1, 2))]
            if len(rest):
                yield np.minimum(ids[rest], ids[i]), np.maximum(ids[rest], ids[i])


def _pairs(batches, *, percent):
    """Rows sorted by (sig, one, two, block): candidate pairs."""
    key, held = None, []

    def flush():
        found = list(_close(key[0], held, percent)) if len({c for h in held for c in (h[1][0], h[1].min(), h[1].max())}) > 1 else []
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(7)]
        made = b.column(7).to_pylist()
        known = np.array([bool(x) for x in made])
        counts, least = _counts(made), _padded(b.column(8))
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
        for s, t in zip([0, *new], [*new, b.num_rows], strict=True):
            now = tuple(c[s] for c in cols[:3])
            if now != key:
                yield from flush()
                key, held = now, []
            held.append((cols[4][s:t], cols[5][s:t], cols[3][s:t], cols[6][s:t], counts[s:t], known[s:t], least[s:t]))
    yield from flush()


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, lower: bool = True, parts: int = 2, left_out: int = 1) -> DataFrame:
    """Groups of documents that chains of links join; links hold when ``100 * |A & B| >= percent * |A | B|``.

    Returns one row ``(id, size, component_id)`` for each row of ``docs``: the number of distinct
    shingles of ``shingle`` words, and the smallest id reachable by links, itself included. A-Z count
    as a-z when ``lower``. A text of fewer words is one shingle; null or without words it has size 0
    and no links. Rows whose id is null have no links either and a null component; rows that repeat
    an id stand for one vertex. Equal sets are one class: copies never meet as pairs. Ties go to the
    smallest id. Other columns of ``docs`` are not read.

    ``parts`` and ``left_out`` are the second-level parts and how many of them a signature omits.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ngram")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    how = {"n": shingle, "lower": lower}
    sets = work.small(docs.mapInArrow(_run(_fingerprints, **how), "id long, size long, f1 long, f2 long"), "sets", docs.count())
    real = sets.where("id is not null and size > 0")
    n = real.count()
    classes = work.save(real.groupBy("f1", "f2", "size").agg(F.min("id").alias("rep")), "classes", n)
    members = real.join(classes, ["f1", "f2", "size"]).select("id", "rep")

    def only(ids: DataFrame, kind: str) -> DataFrame:
        few = ids.count() <= BROADCAST_IDS
        return docs.where("id is not null").join(F.broadcast(ids) if few else ids, "id", kind)

    # an id on several rows may be a class of its own and a copy elsewhere: it stays
    copies = members.where("id <> rep").select("id").distinct().join(classes.select(F.col("rep").alias("id")), "id", "left_anti")
    copies = work.save(copies, "copies", n)
    sigs = only(copies, "left_anti").mapInArrow(_run(_emit, percent=percent, n2=parts, k2=left_out, **how), "sig long, id long")
    stars = work.save(sigs.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(_run(_stars, block=BLOCK), "sig long, id long, lo long, n long"), "stars")
    inside = stars.where("id is not null").select("sig", "id", "lo")
    best = inside.where("id <> lo").groupBy("id", "lo").agg(F.count("*").alias("n")).groupBy("id").agg(F.max(F.struct("n", (-F.col("lo")).alias("lo"))).alias("m"))
    best = work.save(best.select(F.col("id").alias("a"), (-F.col("m.lo")).alias("b")), "best", n)
    met = work.save(inside.select("id").distinct(), "met", n)
    work.freed("copies")
    arrays = work.save(only(met, "left_semi").mapInArrow(_run(_sketches, **how), "id long, size long, sketch binary, wide binary"), "arrays")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that link. Sketches rule most others out first, so that only sets of likely pairs are made and moved."""
        one, two = (arrays.select(F.col("id").alias(x), F.col("size").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "ab")
        likely = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(_run(_bounded, percent=percent), "a long, b long")
        likely = work.small(likely, f"{name}-likely", n)
        compared = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        found = work.save(only(work.save(compared, f"{name}-ids", n), "left_semi").mapInArrow(_run(_arrays, **how), "id long, found binary"), f"{name}-sets")
        both = likely.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return both.mapInArrow(_run(_verified, percent=percent), "a long, b long")

    # first each document with the one that it shares most signatures with; then only what is still apart
    links = work.small(verify(best, "first").unionByName(members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))), "links", 2 * n)
    work.freed("best", "met", "first-likely", "first-ids", "first-sets")
    first = work.save(components(links, work, "first"), "comps1", n)
    placed = work.save(inside.select("sig", "id").join(first, "id", "left").select("sig", "id", F.coalesce("comp", "id").alias("comp")), "placed")
    work.freed("links")
    large = stars.where("id is null").groupBy("sig").agg(F.max("n").alias("n")).select("sig", (F.col("n") / BLOCK + 1).cast("int").alias("blocks"))
    large = work.save(large, "large")
    work.freed("stars")
    live = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig").join(large, "sig", "left").select("sig", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    living = work.save(placed.join(live, "sig"), "living")
    work.freed("placed", "large")
    least = first_in_groups(living.select("id", "sig"), ["id"], [F.col("sig")], LEAST, "nth").groupBy("id").agg(F.array_sort(F.collect_list("sig")).alias("least"))
    told = work.save(arrays.select("id", "size", "sketch").join(least, "id"), "told", n)
    apart = living.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    apart = apart.select("sig", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "comp").join(told, "id").select("sig", "one", "two", "block", "id", "comp", "size", "sketch", "least")
    pairs = work.small(apart.repartition("sig", "one", "two").sortWithinPartitions("sig", "one", "two", "block").mapInArrow(_run(_pairs, percent=percent), "a long, b long").distinct(), "pairs", 2 * n)
    work.freed("living", "told")
    second = work.small(verify(pairs, "second").unionByName(first.select(F.col("id").alias("a"), F.col("comp").alias("b"))), "links2", 2 * n)
    final = work.save(components(second, work, "final"), "comps2", n)
    work.freed("classes", "arrays", "comps1", "pairs", "second-likely", "second-ids", "second-sets", "links2")
    return sets.join(final, "id", "left").select("id", "size", F.coalesce("comp", "id").alias("component_id"))
