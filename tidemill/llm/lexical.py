"""Ranked lexical search: a dual-sorted wavelet tree per shard, and best-first intersection of its nodes.

A shard is some thousand documents. Its postings stand term by term, each term's by impact, the greatest first;
that sequence of documents is kept as a wavelet tree over the documents in ascending order of ids. A node of the
tree is a range of documents and holds, for each term, a run of its postings, still by impact: so the first of
the run is the greatest impact that the term has in this range of documents, and the sum over a query's terms bounds every
score in the node. Nodes are opened best first; what arrives at single documents arrives with its exact score, and the
search ends when no open node can bring anything better than the ``k`` found. What a task has found in one shard bounds
its search of the next.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, first_in_groups, lean

#: A term is a run of ASCII letters, digits and characters beyond ASCII, whose UTF-8 bytes are all above 0x7F.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Levels of a shard's tree: a shard has up to this power of two of documents.
LEVELS = 13
#: Nodes that are opened at once, and at most; bytes of queries that are searched together.
NODES, MOST_NODES, BLOCK_BYTES = 16, 256, 16 << 20
U64 = np.uint64
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    """Terms of the whole text in order, A-Z as a-z."""
    return TERM.findall(text.lower())


@dataclass
class Query:
    item: int | None
    terms: np.ndarray  # places of its distinct terms among the vocabulary
    times: np.ndarray  # how often each is in the query


@dataclass
class Block:
    """Queries that are searched together, and their vocabulary."""

    queries: list[Query]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        queries = []
        for item, text in rows:
            count = Counter(terms_of((text or "").encode()))
            at = [vocabulary.setdefault(t, len(vocabulary)) for t in count]
            queries.append(Query(item, np.array(at, np.int64), np.array(list(count.values()), np.int64)))
        return cls(queries, vocabulary)


class DualTree:
    """Postings of a shard by (term, impact) and by document."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int):
        """``ids`` ascend; posting ``i`` says that document ``docs[i]`` (a place in ``ids``) holds ``terms[i]`` with an impact."""
        self.ids, n = ids, len(docs)
        self.levels = max(1, int(len(ids) - 1).bit_length())
        order = np.lexsort((docs, -impacts, terms))
        docs, impacts = docs[order], impacts[order]
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))
        words = (n >> 6) + 2
        self.bits, self.ranks = np.zeros((self.levels, words), U64), np.zeros((self.levels, words + 1), np.int64)
        self.impacts = np.zeros((self.levels + 1, n + 1), np.int32)  # an impact is below a million
        for level in range(self.levels + 1):
            if level:  # nodes stay where they are; within each, postings of the lower half come first, in their order
                at = np.argsort((docs >> (self.levels - level)).astype(np.uint16), kind="stable")
                docs, impacts = docs[at], impacts[at]
            self.impacts[level, :n] = impacts
            if level < self.levels:
                up = np.zeros(words << 6, np.uint8)
                up[:n] = (docs >> (self.levels - level - 1)) & 1
                self.bits[level] = np.packbits(up, bitorder="little").view(U64)
                np.cumsum(np.bitwise_count(self.bits[level]), out=self.ranks[level, 1:])
        self._bits, self._ranks, self._impacts = self.bits.ravel(), self.ranks.ravel(), self.impacts.ravel()

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Postings before a place that go to upper halves."""
        word = at >> 6
        mask = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self._ranks[level * self.ranks.shape[1] + word] + np.bitwise_count(self._bits[level * self.bits.shape[1] + word] & mask)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best of ``best`` and this shard, ``(scores, ids)``, the best first and the smaller id at ties; scores are above 0."""
        scores, ids = best
        here = np.flatnonzero(self.first[terms + 1] > self.first[terms])
        terms, weights = terms[here], weights[here]
        if not len(terms):
            return best
        n = self.impacts.shape[1]
        level, prefix, begin = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        run, stop, end = self.first[terms][None, :], self.first[terms + 1][None, :], np.array([self.first[-1]])
        bound = np.array([int(weights @ self._impacts[run[0]].astype(np.int64))])
        width = NODES
        while len(level):
            if len(scores) == k:  # only what is better than the last one found stays open
                least = self.ids[np.minimum(prefix << (self.levels - level), len(self.ids) - 1)]
                keep = (bound > scores[-1]) | (bound == scores[-1]) & (least < ids[-1])
                level, prefix, begin, end, run, stop, bound = (x[keep] for x in (level, prefix, begin, end, run, stop, bound))
                if not len(level):
                    break
            if len(level) > width:
                front = np.argpartition(-bound, width - 1)
                front, rest = front[:width], front[width:]
            else:
                front, rest = np.arange(len(level)), np.empty(0, np.int64)
            width = min(MOST_NODES, width * 2)
            lv, pf, bg, ed, rn, sp = level[front], prefix[front], begin[front], end[front], run[front], stop[front]
            before = self.ones(lv, bg)
            inside = self.ones(lv, ed) - before
            up1, up2 = self.ones(lv[:, None], rn) - before[:, None], self.ones(lv[:, None], sp) - before[:, None]
            low1, low2 = rn - up1, sp - up2  # the lower half begins where the node does
            half = (ed - inside)[:, None]
            made = [(lv + 1, 2 * pf, bg, ed - inside, low1, low2), (lv + 1, 2 * pf + 1, ed - inside, ed, half + up1, half + up2)]
            nlv, npf, nbg, ned, nrn, nsp = (np.concatenate(x) for x in zip(*made, strict=True))
            value = np.where(nsp > nrn, self._impacts[nlv[:, None] * n + nrn], 0) @ weights
            live = value > 0
            nlv, npf, nbg, ned, nrn, nsp, value = (x[live] for x in (nlv, npf, nbg, ned, nrn, nsp, value))
            leaf = nlv == self.levels
            if leaf.any():
                scores, ids = np.concatenate([scores, value[leaf]]), np.concatenate([ids, self.ids[npf[leaf]]])
                top = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[top], ids[top]
            more = ~leaf
            level, prefix, begin, end, run, stop, bound = (np.concatenate([old[rest], new[more]]) for old, new in ((level, nlv), (prefix, npf), (begin, nbg), (end, ned), (run, nrn), (stop, nsp), (bound, value)))
        return scores, ids


def _postings(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """``(id, n, terms, times)`` of each document: how many terms it has, and those of the vocabulary."""
    vocabulary = sent.value.vocabulary
    for b in batches:
        sizes, terms, times = [], [], []
        for text in b.column(1):
            found = terms_of(text.as_py().encode()) if text.is_valid else []
            count = Counter(found)
            known = [t for t in count if t in vocabulary]
            sizes.append(len(found))
            terms.append([vocabulary[t] for t in known])
            times.append([count[t] for t in known])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["id", "n", "terms", "times"])


def _counts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents by term, and under the term -1 the documents with a term and, as ``terms``, all their terms."""
    df, n, total = np.zeros(size, np.int64), 0, 0
    for b in batches:
        df += np.bincount(b.column(1).flatten().to_numpy(), minlength=size)
        sizes = b.column(0).to_numpy()
        n, total = n + np.count_nonzero(sizes), total + int(sizes.sum())
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64()), pa.array(np.append(np.zeros(len(at), np.int64), total), pa.int64())], ["term", "df", "terms"])


def impact(times: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """A posting's share of the score, per unit of its term's weight."""
    m = 100 - 25 + (25 * size * n) // total
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def _searched(batches: Iterator[pa.RecordBatch], sent, n: int, total: int, weights: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of each query among a task's documents."""
    queries = sent.value.queries
    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries]
    held: list[tuple[np.ndarray, ...]] = []

    def searched():
        ids, sizes, many, terms, times = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        tree = DualTree(ids[order], terms, np.repeat(place, many), impact(times, np.repeat(sizes, many), n, total), len(weights))
        for i, q in enumerate(queries):
            best[i] = tree.search(q.terms, weights[q.terms] * q.times, k, best[i])

    docs = 0
    for b in batches:
        for at in range(0, b.num_rows, 1 << (LEVELS - 2)):
            part = b.slice(at, 1 << (LEVELS - 2))
            part = part.filter(pa.array(part.column(1).to_numpy() > 0))
            if docs + part.num_rows > 1 << LEVELS:
                searched()
                docs = 0
            if part.num_rows:
                docs += part.num_rows
                held.append((part.column(0).fill_null(NO_ID).to_numpy(), part.column(1).to_numpy(), part.column(2).value_lengths().to_numpy().astype(np.int64), part.column(2).flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy()))
    if held:
        searched()
    size = [len(s) for s, _ in best]
    if sum(size):
        ids = np.concatenate([i for _, i in best])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(size), dtype=np.int32), size)), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([s for s, _ in best]))], ["query", "doc_id", "score"])


def ranked(docs: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents with the highest scores above 0 for each row of ``queries``.

    A score sums, over the query's terms with their repeats, the term's weight times :func:`impact`; equal scores go by
    ascending id, a null id last. A null or empty text has no term: such a document is never found and such a query finds nothing.
    Rows of ``docs`` that repeat are documents of their own, and so are rows of ``queries``: of those with one id, or without,
    each gives its rows. Other columns aren't read. All counts are over all documents.

    Queries come to the driver in blocks of about ``block_bytes`` of text by a hash of the row, however many there are; every
    block passes all documents, and of these only postings of the block's terms are kept.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lexical")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = queries.select(F.col(item_col).cast("long").alias("item"), F.col(query_col).cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = 1 + size // block_bytes
    out = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i) if blocks > 1 else asked
        found = _block(rows, sorted(map(tuple, part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), k, work, i)
        out = found if out is None else out.unionByName(found)
    return out


def _block(rows: DataFrame, asked: list[tuple], k: int, work: Workspace, number: int) -> DataFrame:
    spark = rows.sparkSession
    block = Block.of(asked)
    sent = spark.sparkContext.broadcast(block)
    postings = work.save(rows.mapInArrow(lambda batches: lean(_postings(batches, sent)), "id long, n long, terms array<int>, times array<long>"), f"postings-{number}")
    size = len(block.vocabulary)
    # one row for each of the block's terms
    counts = postings.select("n", "terms").mapInArrow(lambda batches: _counts(batches, size), "term long, df long, terms long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms")).toPandas()
    every = counts[counts.term == -1]
    n, total = int(every.df.sum()), max(1, int(every.terms.sum()))
    weights = np.zeros(size, np.int64)
    for term, df in counts[counts.term >= 0][["term", "df"]].itertuples(index=False):
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    found = postings.mapInArrow(lambda batches: lean(_searched(batches, sent, n, total, weights, k)), "query int, doc_id long, score long")
    items = spark.createDataFrame([(i, q.item) for i, q in enumerate(block.queries)], "query int, item_id long")
    best = work.save(first_in_groups(found, ["query"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank"), f"best-{number}")
    work.drop(f"postings-{number}")
    return best.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score")
