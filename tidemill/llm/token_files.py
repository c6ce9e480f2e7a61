"""Token-id files: fixed-size blocks of ids, transposed into bit or byte planes and compressed plane by plane.

A file holds documents in ascending order: ``MAGIC``; the compressed planes of each block; a JSON index of
the blocks (offset, ids, length of each plane) and of the documents (id, length);
the index's length as eight bytes. Any block can be read by itself.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Workspace, shuffle_partitions
from ._hashing import CHUNK
from ._words import WordTable

MAGIC = b"TMTOK1\n\0"
#: Ids in a block; zstandard's level; new words encoded as one text.
BLOCK_IDS, LEVEL, JOINED = 1 << 16, 3, 32
#: Bytes of text that a file is cut for.
FILE_TEXT = 64 << 20

_INSIDE = re.compile(r"\s (?:\s|\Z)")


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first; planes that are all zero at the top are left out."""
    by_byte = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    used = max(1, -(-int(ids.max() if len(ids) else 0).bit_length() // 8))
    if not bits:
        return [by_byte[:, i].tobytes() for i in range(used)]
    each = np.unpackbits(np.ascontiguousarray(by_byte[:, :used]), axis=1, bitorder="little")
    return [np.packbits(each[:, i], bitorder="little").tobytes() for i in range(max(1, int(ids.max() if len(ids) else 0).bit_length()))]


def merged(parts: list[bytes], n: int, bits: bool) -> np.ndarray:
    """Ids from their planes."""
    out = np.zeros((n, 4), np.uint8)
    if not bits:
        for i, p in enumerate(parts):
            out[:, i] = np.frombuffer(p, np.uint8)
    else:
        each = np.zeros((n, 32), np.uint8)
        for i, p in enumerate(parts):
            each[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        out[:] = np.packbits(each, axis=1, bitorder="little")
    return out.view("<u4").reshape(-1)


class Writer:
    """Streams ids to an open binary file; holds one block at a time."""

    def __init__(self, out, bits: bool = False, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.at, self.held, self.parts = len(MAGIC), 0, []
        self.blocks, self.lengths, self.docs = [], [], []
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        out.write(MAGIC)

    def add(self, ids: np.ndarray, doc: int | None) -> None:
        """One document's ids, and its own id."""
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            every = np.concatenate(self.parts)
            for i in range(0, len(every) - self.block_ids + 1, self.block_ids):
                self._block(every[i : i + self.block_ids])
            rest = every[len(every) // self.block_ids * self.block_ids :]
            self.parts, self.held = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        made = [self.pack.compress(p) for p in planes(ids, self.bits)]
        self.blocks.append([self.at, len(ids), [len(p) for p in made]])
        for p in made:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.parts))
        index = zlib.compress(json.dumps({"bits": self.bits, "blocks": self.blocks, "lengths": self.lengths, "docs": self.docs}).encode())
        self.out.write(index)
        self.out.write(len(index).to_bytes(8, "little"))


class Reader:
    """Reads blocks of an open, seekable binary file by its index."""

    def __init__(self, file):
        self.file = file
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token-id file")
        file.seek(0, os.SEEK_END)
        end = file.tell()
        file.seek(end - 8)
        size = int.from_bytes(file.read(8), "little")
        file.seek(end - 8 - size)
        index = json.loads(zlib.decompress(file.read(size)))
        self.bits, self.blocks, self.lengths, self.docs = index["bits"], index["blocks"], index["lengths"], index["docs"]
        self.unpack = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        self.file.seek(at)
        return merged([self.unpack.decompress(self.file.read(s)) for s in sizes], n, self.bits)

    def documents(self):
        """(its id, token ids) of every document in order; a block is held at a time, and a document that spans some."""
        k, held = 0, np.empty(0, "<u4")
        for doc, n in zip(self.docs, self.lengths, strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, held[:n]
            held = held[n:]


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism


class WordEncoder(WordTable):
    """A tokenizers file with what it gave for each word kept.

    Byte-level pre-tokenization never joins a character with a space after it, so a text may be cut
    before spaces, but for a space inside a gap: texts with one are encoded whole. Words are known by
    64-bit hashes; when the table is full it starts anew.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        plain = not spec.get("normalizer") and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not (spec["pre_tokenizer"].get("add_prefix_space"))
        self.marks = [t["content"] for t in spec.get("added_tokens") or []]
        self.by_words = plain and not any(" " in m for m in self.marks)
        gap = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.gap = gap[0] if plain and len(gap) == 1 else None
        super().__init__()

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        plain = np.array([self.gap is not None and w.split() == [w.removeprefix(" ")] for w in words])
        if plain.any():
            # words without white space but for a space before them: texts with a line break, a token of its own, before each
            some = [w for w, p in zip(words, plain, strict=True) if p]
            joined = ["\n" + "\n".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)]
            ids = np.array([i for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.uint32)
            at = np.flatnonzero(ids == self.gap)
            if len(at) == np.count_nonzero(plain):
                self._register(hashes[plain], np.diff(at, append=len(ids)) - 1, ids[ids != self.gap])
            else:
                plain[:] = False
        if not plain.all():
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False)]
            self._register(hashes[~plain], np.fromiter(map(len, ids), np.int64, len(ids)), np.array([i for x in ids for i in x], np.uint32))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Texts are taken together up to ``CHUNK`` bytes; longer ones are cut before spaces."""
        out: list = [np.empty(0, np.uint32)] * len(texts)
        held, size = [], 0

        def flush():
            for (i, _), ids in zip(held, self.together([d for _, d in held]) if held else [], strict=True):
                out[i] = ids
            held.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_words or _INSIDE.search(text) or any(m in text for m in self.marks):
                out[i] = self._whole(text)
                continue
            data = text.encode("utf-8")
            if len(data) > CHUNK:
                parts, at = [], 0
                while at < len(data):
                    end = data.find(b" ", at + CHUNK)
                    end = len(data) if end < 0 else end
                    parts += self.together([data[at:end]])
                    at = end
                out[i] = np.concatenate(parts)
                continue
            if size + len(data) > CHUNK:
                flush()
                size = 0
            held.append((i, data))
            size += len(data)
        flush()
        return out

@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _open(uri: str):
    # a plain path or any URI that the file-system layer knows (file, hdfs, s3, gs)
    return pa.fs.FileSystem.from_uri(uri)


def _write(batches, *, path, folder, bits, end_id, block_ids):
    """Rows of one part sorted by (id, text): one file; yields (part, file, documents, ids)."""
    from pyspark import TaskContext

    encoder, end = _encoder(path), np.array([end_id], np.uint32)
    part, name, writer = TaskContext.get().partitionId(), uuid.uuid4().hex, None
    fs, root = _open(folder)
    for b in batches:
        for i in range(0, b.num_rows, 256):
            some = b.slice(i, 256)
            if writer is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.tmp", buffer_size=1 << 20)
                writer = Writer(out, bits, block_ids)
            for doc, ids in zip(some.column(0).to_pylist(), encoder.encode_all(some.column(1).to_pylist()), strict=True):
                writer.add(np.concatenate([ids, end]), doc)
    if writer is not None:
        writer.close()
        out.close()
        fs.move(f"{root}/{name}.tmp", f"{root}/part-{part:06d}-{name}.tok")  # whole files only; a repeated task's is a file of its own
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:06d}-{name}.tok"]), pa.array([len(writer.lengths)], pa.int64()), pa.array([sum(writer.lengths)], pa.int64())], ["part", "file", "n_docs", "n_ids"])


def written(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, bits: bool = False, block_ids: int = BLOCK_IDS, file_text: int = FILE_TEXT) -> DataFrame:
    """Encodes every whole text and writes token-id files to ``folder``, which all machines share.

    Returns the manifest ``(part, file, n_docs, n_ids, first_id)``. Documents are in ascending order of
    id, null ids first, rows that repeat an id by text; ``end_id`` follows each, so null and empty texts
    have that one id. Files are ranges of ids, as many as shuffle partitions or as ``file_text`` bytes of
    text ask for; equal ids share a file. An empty table gives no files. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = F.col("id").asc_nulls_first()
    parts = max(shuffle_partitions(spark), -(-total // file_text))
    dealt = rows.repartitionByRange(parts, order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    made = dealt.mapInArrow(partial(_write, path=tokenizer, folder=folder, bits=bits, end_id=end_id, block_ids=block_ids), "part int, file string, n_docs long, n_ids long")
    manifest = Workspace(spark, "tokens").save(made, "manifest")  # runs once; it names a file only if its task succeeded
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches):
    for b in batches:
        for uri, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fs, path = _open(uri)
            with fs.open_input_file(path) as f:
                reader, at, rows = Reader(f), first, []
                for doc, ids in reader.documents():
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["id", "start", "n_tokens", "ids_crc32"])


def read_back(manifest: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, from the files that the manifest names."""
    return manifest.select("file", "first_id").repartition(max(1, manifest.count())).mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long")
