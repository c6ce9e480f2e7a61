"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds every ordinary piece and reports at each position, along its output links, all pieces that
end there; each relaxes the best score of a path up to that position. For a unigram model, whose scores are
log-probabilities, these are the library's ids. A BPE model's scores are ranks of its merges: there the path of
the best sum is another segmentation than the library's, which ``by_type`` gives by merge order instead. Characters
that no piece covers go by byte pieces, so every text comes back as it was either way.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import CHUNK
from ._words import WordTable

SPACE = "▁"
#: The model type of the format that merges.
BPE = 2
_FIRST = re.compile(f"[^{SPACE}]{SPACE}")


def _fields(data: bytes):
    """(field, value) of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Pieces(WordTable):
    """A model file's pieces. ``types`` of the format: 1 ordinary, 4 user-defined, 6 byte; the others don't occur in texts.

    ``by_type``: ids by the rule of the model's type, so a BPE model merges; else by Viterbi for any.
    """

    def __init__(self, path: str, by_type: bool = False):
        with open(path, "rb") as f:
            model = f.read()
        self.pieces, self.scores, self.types = [], [], []
        self.prefix, kind = True, 1
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.types.append(own.get(3, 1))
            elif field == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif field == 3:
                self.prefix = bool(dict(_fields(value)).get(3, 1))
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == 6}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces, so it can't give every text back")
        if by_type and (kind not in (1, BPE) or kind == BPE and {4, 5} & set(self.types)):
            raise ValueError("the model's own rule isn't known: its type is neither unigram nor BPE, or pieces are user-defined or unused")
        self._ids = self.merged if by_type and kind == BPE else self.viterbi
        self._rank = {p: (-s, i) for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types, strict=True)) if t == 1}
        self.automaton = ahocorasick.Automaton()
        for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)):
            if t in (1, 4) and p:
                self.automaton.add_word(p, (i, len(p), self.scores[i]))
        self.automaton.make_automaton()
        #: Below any path of pieces, so that bytes are taken only where nothing covers a character.
        self.missing = min(self.scores) - 10.0
        #: No piece goes on over a space after another character, so texts fall apart there.
        self.by_words = not any(t in (1, 4) and _FIRST.search(p) for p, t in zip(self.pieces, self.types, strict=True))
        self._is_byte = np.array([t == 6 for t in self.types])
        self._plain = [p.replace(SPACE, " ") if t in (1, 4) else "" for p, t in zip(self.pieces, self.types, strict=True)]
        super().__init__()

    def viterbi(self, text: str, literal: frozenset[int] = frozenset()) -> list[int]:
        """Ids of the best path over characters; ties take the earlier start. ``literal``: places that only bytes may cover."""
        n = len(text)
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        matches = self.automaton.iter(text)
        ended = next(matches, None)
        for end in range(1, n + 1):
            score, via = best[end - 1] + self.missing, None
            while ended is not None and ended[0] == end - 1:
                piece, size, own = ended[1]
                if best[end - size] + own > score or (via is None and best[end - size] + own >= score):
                    if not literal or literal.isdisjoint(range(end - size, end)):
                        score, via = best[end - size] + own, (piece, size)
                ended = next(matches, None)
            best[end], back[end] = score, via
        out, at = [], n
        while at:
            if back[at] is None:
                out += [self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
                at -= 1
            else:
                out.append(back[at][0])
                at -= back[at][1]
        return out[::-1]

    def merged(self, text: str, literal: frozenset[int] = frozenset()) -> list[int]:
        """Ids by merge order; ties take the leftmost pair. ``literal``: places that only bytes may cover."""
        rank, n = self._rank, len(text)
        part = [None if i in literal else c for i, c in enumerate(text)] if literal else list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i, j):
            if part[i] is not None and part[j] is not None and (known := rank.get(both := part[i] + part[j])):
                heapq.heappush(heap, (known[0], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = bytearray(n)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] != j or len(part[i]) + len(part[j]) != len(both):
                continue  # a neighbour has been merged since
            part[i], gone[j], after[i] = both, 1, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        out, at = [], 0
        while at < n:
            known = rank.get(part[at]) if part[at] is not None else None
            out += [known[1]] if known else [self.bytes[b] for b in text[at].encode("utf-8", "surrogatepass")]
            at = after[at]
        return out

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        ids = [self._ids(w.replace(" ", SPACE)) for w in words]
        self._register(hashes, np.fromiter(map(len, ids), np.int64, len(ids)), np.array([i for x in ids for i in x], np.uint32))

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; of null or empty, none. Texts are taken together up to ``CHUNK`` bytes; longer ones are cut before spaces."""
        out: list = [np.empty(0, np.int32)] * len(texts)
        held, size = [], 0

        def flush():
            for (i, _), ids in zip(held, self.together([d for _, d in held]) if held else [], strict=True):
                out[i] = ids.astype(np.int32)
            held.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            plain = (" " if self.prefix else "") + text
            if SPACE in text:  # the mark itself in a text: only bytes tell it from a space
                out[i] = np.array(self._ids(plain.replace(" ", SPACE), frozenset(j for j, c in enumerate(plain) if c == SPACE)), np.int32)
            elif not self.by_words:
                out[i] = np.array(self._ids(plain.replace(" ", SPACE)), np.int32)
            elif "  " in plain:  # spaces in a row stay with the word that they lead
                parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", plain.replace(" ", SPACE))
                out[i] = np.array([x for p in parts for x in self._ids(p)], np.int32)
            else:
                data = plain.encode("utf-8", "surrogatepass")
                if len(data) > CHUNK:
                    made, at = [], 0
                    while at < len(data):
                        end = data.find(b" ", at + CHUNK)
                        end = len(data) if end < 0 else end
                        made += self.together([data[at:end]])
                        at = end
                    out[i] = np.concatenate(made).astype(np.int32)
                    continue
                if size + len(data) > CHUNK:
                    flush()
                    size = 0
                held.append((i, data))
                size += len(data)
        flush()
        return out

    def decode(self, ids) -> str:
        """The text of ids that :meth:`encode` gave."""
        ids = np.asarray(ids, np.int64)
        if not self._is_byte[ids].any():
            text = "".join(map(self._plain.__getitem__, ids.tolist()))
            return text[1:] if self.prefix and text.startswith(" ") else text
        out, pending = [], bytearray()
        for i in ids.tolist():
            if self.types[i] == 6:
                pending.append(int(self.pieces[i][3:5], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "surrogatepass"))
                pending.clear()
            out.append(self._plain[i])
        if pending:
            out.append(pending.decode("utf-8", "surrogatepass"))
        text = "".join(out)
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def load(path: str, by_type: bool = False) -> Pieces:
    """One per process, path and rule."""
    return Pieces(path, by_type)


def encoded(docs: DataFrame, path: str, text_col: str = "text", by_type: bool = False) -> DataFrame:
    """``docs`` with ``piece_ids`` (array of int) of the best path, or by the rule of the model's type; null and empty texts have none. Other columns stay."""
    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        model = load(path, by_type)
        return pd.Series(model.encode_all(text.tolist()))

    return docs.withColumn("piece_ids", ids(F.col(text_col).cast("string")))


def decoded(rows: DataFrame, path: str, ids_col: str = "piece_ids") -> DataFrame:
    """``rows`` with ``piece_text``; null ids give null."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = load(path)
        return pd.Series([None if x is None else model.decode(x) for x in ids])

    return rows.withColumn("piece_text", text(F.col(ids_col)))


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", by_type: bool = False) -> DataFrame:
    """``(id, n_pieces, ids_crc32, text_crc32)``: encoded (see :func:`encoded`) and decoded in one pass; ``text_crc32`` is of what decoding gave.

    CRCs are unsigned, of the ids as little-endian 32-bit integers and of UTF-8; null and empty texts have zeros.
    """
    @F.pandas_udf("n_pieces long, ids_crc32 long, text_crc32 long")
    def digest(text: pd.Series) -> pd.DataFrame:
        model = load(path, by_type)
        rows = []
        for i in range(0, len(text), 256):
            for ids in model.encode_all(text.iloc[i : i + 256].tolist()):
                rows.append((len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(model.decode(ids).encode("utf-8", "surrogatepass"))))
        return pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "text_crc32"])

    return docs.select(F.col(id_col), digest(F.col(text_col).cast("string")).alias("d")).select(id_col, "d.*")
