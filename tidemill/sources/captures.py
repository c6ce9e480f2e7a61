"""Captured payloads as a data source, by batch and as a stream, and the dispatch of configured sources to their transforms.

A folder has a folder for each source, in which every capture is a file of lines, or a folder of such files that ends with
``_SUCCESS``; names ascend with time, and what begins with ``_`` or ``.`` isn't there yet. A line is a payload. As a stream, offsets are
the last capture of each source, so a restarted query goes on after the captures that its checkpoint tells of.
"""

from __future__ import annotations

import datetime as dt
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import feeds
from .common import all_sources

SCHEMA = "source string, capture string, file string, at long, body string"
#: Bytes of a file that a task reads, and of lines in a batch.
SPLIT, BATCH = 64 << 20, 4 << 20


@dataclass
class Split(InputPartition):
    """Lines of a file that begin in [start, stop)."""

    source: str
    capture: str
    path: str
    file: str
    start: int
    stop: int


class _Captures:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path = options["path"]
        self.wanted = {s.strip() for s in options["sources"].split(",")} if options.get("sources") else None
        self.split = int(options.get("splitbytes", SPLIT))

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    @staticmethod
    def _inside(files: fs.FileSystem, at: str) -> list[fs.FileInfo]:
        return sorted((x for x in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.base_name[:1] not in "_."), key=lambda x: x.base_name)

    def captures(self) -> dict[tuple[str, str], list[fs.FileInfo]]:
        """Complete captures and their files."""
        files, root = self._files()
        out = {}
        for source in self._inside(files, root):
            if source.type != fs.FileType.Directory or self.wanted is not None and source.base_name not in self.wanted:
                continue
            for capture in self._inside(files, source.path):
                if capture.type == fs.FileType.File:
                    out[source.base_name, capture.base_name] = [capture]
                elif files.get_file_info(f"{capture.path}/_SUCCESS").type == fs.FileType.File:
                    out[source.base_name, capture.base_name] = [x for x in self._inside(files, capture.path) if x.type == fs.FileType.File]
        return out

    def splits(self, after: dict[str, str], upto: dict[str, str] | None) -> list[Split]:
        out = []
        for (source, capture), files in self.captures().items():
            if capture <= after.get(source, "") or upto is not None and capture > upto.get(source, ""):
                continue
            for f in files:
                out += [Split(source, capture, f.path, f.base_name, at, min(f.size, at + self.split)) for at in range(0, f.size, self.split)]
        return out

    def lines(self, s: Split) -> Iterator[pa.RecordBatch]:
        files, _ = self._files()
        at, body, size = [], [], 0

        def batch():
            n = len(at)
            made = pa.RecordBatch.from_arrays([pa.array([s.source] * n), pa.array([s.capture] * n), pa.array([s.file] * n), pa.array(at, pa.int64()), pa.array(body, pa.string())], ["source", "capture", "file", "at", "body"])
            at.clear()
            body.clear()
            return made

        with io.BufferedReader(files.open_input_file(s.path), 1 << 20) as f:
            f.seek(max(0, s.start - 1))
            if s.start and f.read(1) != b"\n":
                f.readline()  # the line that another task has begun
            while (here := f.tell()) < s.stop:
                line = f.readline()
                if not line:
                    break
                text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if text:
                    at.append(here)
                    body.append(text)
                    size += len(text)
                if size > BATCH:
                    size = 0
                    yield batch()
        if at:
            yield batch()


class _Batch(_Captures, DataSourceReader):
    def partitions(self) -> list[Split]:
        return self.splits({}, None) or [Split("", "", "", "", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from self.lines(partition)


class _Stream(_Captures, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last: dict[str, str] = {}
        for source, capture in self.captures():
            last[source] = max(capture, last.get(source, ""))
        return last

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return self.splits(start, end)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from self.lines(partition)

    def commit(self, end: dict) -> None:
        """Captures stay."""


class CaptureSource(DataSource):
    """``spark.read.format("captures")``; options ``path``, ``sources`` (names with commas; all if left out) and ``splitBytes``.

    ``at`` is where a line begins in its file, so (capture, file, at) is the order in which payloads came.
    """

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


def captured(spark: SparkSession, path: str, *sources: str, stream: bool = False) -> DataFrame:
    """Payloads under a folder: ``(source, capture, file, at, body)``."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("captures").option("path", path)
    return (reader.option("sources", ",".join(sources)) if sources else reader).load()


@dataclass(frozen=True)
class Plugin:
    """A kind of source: what a configuration of it must name, and the transform of its payloads.

    ``items(raw, since)`` gets payloads with ``ord`` (their place in the file) and a column for each of ``needs``; it must work row by row to
    be of use to streams.
    """

    kind: str
    needs: tuple[str, ...]
    items: Callable[[DataFrame, dt.datetime], DataFrame]


PLUGINS: dict[str, Plugin] = {}


def plugin(kind: str, *needs: str):
    """Registers a transform as a kind of source; a kind can be registered once."""

    def add(items: Callable[[DataFrame, dt.datetime], DataFrame]):
        if kind in PLUGINS:
            raise ValueError(f"{kind} is registered")
        PLUGINS[kind] = Plugin(kind, needs, items)
        return items

    return add


plugin("user_events", "username")(feeds.github_events)
plugin("repo_releases", "owner", "repo")(feeds.github_releases)


@dataclass(frozen=True)
class Configured:
    """A configured source: the folder of its captures, its kind, and what the kind needs."""

    source: str
    type: str
    enabled: bool = True
    names: dict[str, str] = field(default_factory=dict)


def dispatched(raw: DataFrame, sources: list[Configured], since: dt.datetime) -> DataFrame | None:
    """Items of all enabled sources, each by the plug-in of its type; in the order of configuration.

    A source of an unknown type, or without one of the names that its type needs, is passed over. Of no source that
    counts, None. ``raw`` may be a stream, where plug-ins work row by row.
    """
    out = {}
    for k, s in enumerate(sources):
        known = PLUGINS.get(s.type)
        if not s.enabled or known is None or not all(s.names.get(n) for n in known.needs):
            continue
        rows = raw.where(F.col("source") == s.source).select(F.col("at").alias("ord"), "body", *[F.lit(s.names[n]).alias(n) for n in known.needs])
        out[f"{k}-{s.source}"] = known.items(rows, since)
    return all_sources(out) if out else None
