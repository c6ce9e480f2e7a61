"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length 1 and rotated, and the rotated vector is cut into low-dimensional blocks.
A cosine of at least ``c`` is a squared distance of at most ``2 - 2c``; so in some block the squared
distance is at most the block's share of it, in proportion to its dimensions. Each block is range-joined
on cells: a row visits a cell only while the squared distance to it, summed over the dimensions in which
it lies beside the cell, is within the block's share. What the blocks find is verified on the whole
vectors. A pair counts in the first block that finds it, so the union needs no de-duplication.
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, lean
from .graph import components

#: Dimensions of a block, and of labels with more than ``MANY_ROWS`` vectors: wider blocks find fewer pairs by chance.
BLOCK_DIMS, WIDE_DIMS, MANY_ROWS = 8, 16, 131_072
#: Rows that a task compares at once; labels and cells with more are split, cells that can't be split go tile by tile.
TILE = 8192
#: Candidate pairs that are looked at together.
CHUNK = 1 << 17
#: Intervals into which a task cuts each dimension of a block; so few rows aren't cut.
PARTS, FEW = 2, 32
SLACK = 1e-9


@lru_cache(maxsize=16)
def rotation(dim: int, seed: int = 20_24) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, dims: int = BLOCK_DIMS) -> list[slice]:
    return [slice(i, min(dim, i + dims)) for i in range(0, dim, dims)]


def shares(dim: int, cosine: float, dims: int = BLOCK_DIMS) -> list[float]:
    """The squared distance that each block may have, in proportion to its dimensions."""
    return [(2 - 2 * cosine) * (s.stop - s.start) / dim + SLACK for s in blocks(dim, dims)]


def _unit(lists: pa.Array) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large and very small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def visits(u: np.ndarray, cuts: list[np.ndarray], budget: float, one_sided: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, cell, side, spent)``: the cells within the budget of each row of ``u`` and the squared distance to them; side 0 is its own cell.

    ``cuts`` are the ascending bounds in each dimension. Side tells whether the first dimension in which
    the cell differs has a lower (-1) or higher (1) interval; ``one_sided`` leaves the higher ones out, and
    still one of two rows within the budget visits the other's cell.
    """
    row, cell = np.arange(len(u)), np.zeros(len(u), np.int64)
    spent, side = np.zeros(len(u)), np.zeros(len(u), np.int8)
    for i, c in enumerate(cuts):
        if not len(c):
            continue
        home = np.searchsorted(c, u[:, i], side="right")
        x, own, parts = u[row, i], home[row], []
        for j in range(len(c) + 1):
            gap = np.maximum(0, np.maximum(c[j - 1] - x if j else 0, x - c[j] if j < len(c) else 0))
            total = spent + gap * gap
            step = np.where(side == 0, np.sign(j - own), side).astype(np.int8)
            at = np.flatnonzero((total <= budget) & (step <= 0) if one_sided else total <= budget)
            parts.append((row[at], cell[at] * (len(c) + 1) + j, total[at], step[at]))
        row, cell, spent, side = (np.concatenate(p) for p in zip(*parts, strict=True))
    return row, cell, side, spent


def candidates(u: np.ndarray, budget: float):
    """Pairs of rows, in pieces, that may lie within the budget: all that do, each once.

    Every dimension is cut into intervals of equal shares. Rows of two cells are paired only if each of them
    visits the other's cell and both distances together are within the budget: beside a bound that lies
    between them, two rows are at least as far apart as both are from it.
    """
    if len(u) <= FEW:
        yield np.triu_indices(len(u), 1)
        return
    share = [j / PARTS for j in range(1, PARTS)]
    row, cell, side, spent = visits(u, list(np.quantile(u, share, axis=0).T), budget, one_sided=False)
    own = np.empty(len(u), np.int64)
    own[row[side == 0]] = cell[side == 0]
    mine = own[row]
    key = np.minimum(mine, cell) * PARTS ** u.shape[1] + np.maximum(mine, cell)
    order = np.lexsort((mine > cell, key))
    row, key, upper, spent, inner = row[order], key[order], (mine > cell)[order], spent[order], (mine == cell)[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    stop = np.append(start[1:], len(key))
    split = start + np.bincount(group, weights=~upper, minlength=len(start)).astype(np.int64)  # where the upper cell's rows begin
    first = np.where(inner, np.arange(len(key)) + 1, split[group])
    many = np.where(upper, 0, stop[group] - first)
    at = np.flatnonzero(many > 0)
    total = np.cumsum(many[at])
    done = 0
    while done < len(at):
        base = total[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(total, base + CHUNK, side="right")))
        some, n = at[done:upto], many[at[done:upto]]
        one, two = np.repeat(some, n), np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = spent[one] + spent[two] <= budget
        yield row[one[near]], row[two[near]]
        done = upto


def _joined_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest row known to be linked with each row) after linking ``a`` with ``b``."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        np.minimum.at(root, a, b)
        while (root[root] != root).any():
            root = root[root]


def _tile(ids, home, tiles, weight, x, block, dims, cosine, same):
    """Links of a tile: for each vector, how many others it links with and one that stands for its group. Block -1: all blocks."""
    order = np.argsort(ids, kind="stable")
    ids, home, tiles, weight, x = (v[order] for v in (ids, home, tiles, weight, x))
    dim, n = x.shape[1], len(ids)
    y, cuts, limit = x @ rotation(dim), blocks(dim, dims), shares(dim, cosine, dims)
    part = [np.ascontiguousarray(y[:, s]) for s in cuts]
    count, root = np.zeros(n, np.int64), np.arange(n)
    plain = same and bool(home.all())
    for k in range(len(cuts)) if block < 0 else (block,):
        for a, b in candidates(part[k], limit[k]):
            if not plain:
                keep = home[a] | home[b]
                if not same:
                    keep &= tiles[a] != tiles[b]
                a, b = a[keep], b[keep]
            for j in (k, *range(k)):
                d = part[j][a] - part[j][b]
                d = np.einsum("ij,ij->i", d, d)
                keep = d <= limit[j] if j == k else d > limit[j]
                a, b = a[keep], b[keep]
            link = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            a, b = a[link], b[link]
            if len(a):
                np.add.at(count, a, weight[b])
                np.add.at(count, b, weight[a])
                root = _joined_roots(root, a, b)
    at = np.flatnonzero(count)
    return ids[at], count[at], ids[root[at]]


def _moments(batches):
    """Sums over rotated vectors by (label, length, dimension)."""
    for b in batches:
        label, dims = b.column(0).to_numpy(), b.column(2).to_numpy()
        for dim in np.unique(dims):
            for one in np.unique(label[dims == dim]):
                rows = np.flatnonzero((dims == dim) & (label == one))
                y = _unit(b.column(1).take(pa.array(rows))) @ rotation(int(dim))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, one)), pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, len(rows), np.int64)), pa.array(y.sum(0)), pa.array((y * y).sum(0))], ["label", "dim", "at", "n", "s", "q"])


def _cuts(center: np.ndarray, spread: np.ndarray, levels: int) -> list[np.ndarray]:
    """Bounds that halve a block's cells ``levels`` times, dimension after dimension."""
    out = []
    for i in range(len(center)):
        cells = 1 << (levels // len(center) + (i < levels % len(center)))
        out.append(center[i] + spread[i] * np.array([NormalDist().inv_cdf(j / cells) for j in range(1, cells)]))
    return out


def _cells(batches, *, cosine):
    """A row for the cell that a vector is in, and one for each cell on its lower side that its range reaches; by block."""
    for b in batches:
        label, dims, wide = (b.column(i).to_numpy() for i in (2, 3, 7))
        for dim, one in sorted(set(zip(dims.tolist(), label.tolist(), strict=True))):
            rows = np.flatnonzero((dims == dim) & (label == one))
            first = int(rows[0])
            center, spread = (np.array(b.column(i)[first].as_py()) for i in (4, 5))
            levels, size = b.column(6)[first].as_py(), int(wide[first])
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                y = _unit(b.column(1).take(pa.array(some))) @ rotation(dim)
                for k, (s, budget) in enumerate(zip(blocks(dim, size), shares(dim, cosine, size), strict=True)):
                    row, cell, side, _ = visits(y[:, s], _cuts(center[s], spread[s], levels), budget, one_sided=True)
                    m = len(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, one)), pa.array(np.full(m, dim, np.int32)), pa.array(np.full(m, size, np.int32)), pa.array(np.full(m, k, np.int32)), pa.array(cell), pa.array(side == 0), b.column(0).take(pa.array(some[row]))], ["label", "dim", "dims", "block", "cell", "home", "id"])


def _joined(batches, *, cosine):
    """Rows sorted by (label, dim, dims, block, cell, one, two)."""
    key, held = None, []

    def flush():
        if held and sum(len(h[0]) for h in held) > 1:
            ids, home, tiles, weight, x = (np.concatenate([h[i] for h in held]) for i in range(5))
            found = _tile(ids, home, tiles, weight, x, key[3], key[2], cosine, key[5] == key[6])
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], ["id", "n", "root"])

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(7)])
        new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for s, t in zip([0, *new], [*new, b.num_rows], strict=True):
            now = tuple(keys[:, s].tolist())
            if now != key:
                yield from flush()
                key, held = now, []
            part = b.slice(s, t - s)
            held.append((part.column(7).to_numpy(), part.column(8).to_numpy(zero_copy_only=False), part.column(9).to_numpy(), part.column(10).to_numpy(), _unit(part.column(11))))
    yield from flush()


def near_vectors(rows: DataFrame, *, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cell_rows: int | None = None, many_rows: int = MANY_ROWS) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row.

    Two vectors link when their labels are equal and not null, their lengths agree and their cosine in
    double precision is at least ``cosine``. Vectors that are null, empty, zero or hold a null, NaN or
    infinity link with nothing, and neither do rows with a null id, whose component is null and which
    are kept. ``n_links`` counts other rows; equal vectors are one class in the join (by two 64-bit hashes)
    and count with their number. Rows that repeat an id stand for one vertex. Without ``label_col`` all
    vectors are compared. Other columns aren't read.

    A label of up to ``cell_rows`` (``TILE``) vectors is one task's, which cuts the blocks into cells in memory. The
    blocks of a larger one are cut into about as many cells as it has ``cell_rows``, at its own mean and
    spread, and the cells are dealt out; a cell that still has more (near copies) is joined tile by tile.
    Labels of more than ``many_rows`` have wider blocks.
    """
    spark, cell_rows = rows.sparkSession, cell_rows or TILE
    work = Workspace(spark, "vectors")
    v = F.col(vector_col)
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = v.cast(kind)
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    label = F.lit(0).cast("long") if label_col is None else F.xxhash64(F.col(label_col).cast("string"))
    good = ~F.coalesce(bad, F.lit(True)) & F.col(id_col).isNotNull() & (F.lit(True) if label_col is None else F.col(label_col).isNotNull())
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.when(good, v).alias("v"), F.when(good, label).alias("label"))
    hashed = [F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(i), "v", "label")).alias(f"h{i}") for i in (1, 2)]
    every = work.save(every.select("id", "v", "label", *hashed), "every")
    same = ["h1", "h2"]
    classes = every.where("v is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = work.save(classes.select(*same, F.col("rep").alias("id"), "weight", "v", "label", F.size("v").alias("dim")), "classes")
    levels = F.when(F.col("n") > cell_rows, F.ceil(F.log2(F.col("n") / cell_rows)).cast("int")).otherwise(0)
    sizes = work.save(classes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", levels.alias("levels"), F.when(F.col("n") > many_rows, WIDE_DIMS).otherwise(BLOCK_DIMS).alias("dims")), "sizes")
    key = ["label", "dim", "dims", "block", "cell"]
    sized = classes.select("id", "v", "label", "dim").join(sizes, ["label", "dim"])
    placed = sized.where("levels = 0").select("label", "dim", "dims", F.lit(-1).alias("block"), F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "id")
    if sizes.where("levels > 0").limit(1).count():
        large = sized.where("levels > 0")
        sums = large.select("label", "v", "dim").mapInArrow(_moments, "label long, dim int, at int, n long, s double, q double").groupBy("label", "dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        mean = F.col("s") / F.col("n")
        spread = F.sqrt(F.greatest(F.lit(1e-12), F.col("q") / F.col("n") - mean * mean))
        shape = sums.groupBy("label", "dim").agg(F.array_sort(F.collect_list(F.struct("at", mean.alias("mean"), spread.alias("spread")))).alias("x")).select("label", "dim", F.col("x.mean").alias("center"), F.col("x.spread").alias("spread"))
        spots = large.join(work.save(shape, "shape"), ["label", "dim"]).select("id", "v", "label", "dim", "center", "spread", "levels", "dims")
        placed = placed.unionByName(spots.mapInArrow(lambda batches: lean(_cells(batches, cosine=cosine)), "label long, dim int, dims int, block int, cell long, home boolean, id long"))
    placed = work.save(placed, "placed")
    tiles = F.when(F.col("n") > cell_rows, F.ceil(F.col("n") * 2 / cell_rows)).otherwise(1).cast("int")
    full = placed.groupBy(*key).agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any").select(*key, tiles.alias("tiles"))
    cut = placed.join(full, key).withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cut = cut.select(*key, F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "id", "home", "tile").join(classes.select("id", "weight", "v"), "id")
    order = [*key, "one", "two"]
    cut = cut.select(*order, "id", "home", F.col("tile").cast("long").alias("tile"), "weight", "v").repartition(*order).sortWithinPartitions(*order)
    found = work.save(cut.mapInArrow(lambda batches: lean(_joined(batches, cosine=cosine)), "id long, n long, root long"), "found")
    links = found.groupBy("id").agg(F.sum("n").alias("more")).withColumnRenamed("id", "rep")
    reps = classes.select(*same, F.col("id").alias("rep"), "weight")
    own = every.where("v is not null").select("id", *same).join(reps, same)
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(own.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comps = work.save(components(edges, work), "comps")
    out = every.select("id", *same).join(reps, same, "left").join(links, "rep", "left").join(comps, "id", "left")
    component = F.coalesce("comp", "id")
    return out.select("id", (F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
