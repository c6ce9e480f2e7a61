"""A content-addressed ledger of verification runs: immutable objects, tables named by their content, manifests that commit stages.

Below ``root`` are ``objects``, texts by their SHA-256, and a folder for each run. A stage writes tables of its run, each in a folder
that its content names, and then a manifest that lists them with counts and digests; the manifest with the highest number is
what the run is. A stage that breaks off has written tables that no manifest lists, so the run is read as its last
whole stage, and writing the stage again finds what is there already. A stage written again takes those after it away.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions.jsons import canonical

#: Stages in order, schemas that ids are made with, and what a run and a report may be named.
STAGES = ("fetched", "selected", "claims", "evidence")
FETCHED_SCHEMA, SELECTED_SCHEMA = "fetched-input/v1", "selected-input/v1"
_RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")
REPORT_ID = "^[0-9a-f]{64}$"
_MANIFEST = "run_id string, stage string, updated_at string, tables map<string,struct<folder:string,rows:bigint>>"


class CorruptLedger(ValueError):
    """What is to be written contradicts itself or what is there."""


def _none(bad: DataFrame, what: str) -> None:
    row = bad.limit(1).collect()
    if row:
        raise CorruptLedger(f"{what}: {row[0].asDict()}")


def _once(rows: DataFrame, key: str, what: str) -> None:
    _none(rows.groupBy(key).count().where("count > 1 or " + key + " is null"), what)


def _covers(left: DataFrame, right: DataFrame, what: str) -> None:
    """Both sides have the same ids, in the one column that they have."""
    key = left.columns[0]
    _none(left.join(right, key, "left_anti").unionByName(right.join(left, key, "left_anti")), what)


def snapshot_id(schema: str, payload: Column) -> Column:
    return F.sha2(F.concat(F.lit(schema + "\0"), payload), 256)


def fetched_payload(*columns: str) -> Column:
    """An item as canonical JSON: its columns by name, nulls too."""
    return canonical(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def selected_payload(*columns: str, artifacts: str = "artifacts", languages: tuple[str, ...]) -> Column:
    """What readers see of an item: title and text of its first artifact, in the order of ``languages``, and its language; without one the item as it is.

    ``artifacts`` is a map by language of ``(title, blocks)``, which isn't part of the payload.
    """
    ranked = F.filter(F.array(*[F.struct(F.lit(k).alias("language"), F.try_element_at(artifacts, F.lit(k)).alias("a")) for k in languages]), lambda x: x["a"].isNotNull())
    first = F.try_element_at(ranked, F.lit(1))
    said = F.array_join(F.transform(first["a"]["blocks"], lambda b: F.concat(b["title"], F.lit("\n"), b["content"])), "\n\n")
    put = {"title": first["a"]["title"], "content": said}
    shown = F.struct(*[F.when(first.isNotNull(), put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in columns], first["language"].alias("verification_language"))
    return F.when(first.isNotNull(), canonical(F.to_json(shown, {"ignoreNullFields": "false"}))).otherwise(fetched_payload(*columns))


class Ledger:
    """Runs below ``root``, any folder that Spark can write to. Payloads are canonical JSON texts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _run(self, run_id: str, *more: str) -> str:
        if not _RUN_ID.fullmatch(run_id) or ".." in run_id:
            raise ValueError(f"not a run id: {run_id!r}")
        return "/".join([self.root, "runs", run_id, *more])

    def manifest(self, run_id: str) -> dict:
        found = storage.committed(self.spark, self._run(run_id, "manifest"))
        if found is None:
            raise FileNotFoundError(f"no run {run_id}")
        return found[1]

    def table(self, run_id: str, name: str) -> DataFrame:
        """A table of a run's last whole stage."""
        tables = self.manifest(run_id)["tables"]
        if name not in tables:
            raise FileNotFoundError(f"{run_id} has no {name}")
        return self.spark.read.parquet(self._run(run_id, tables[name]["folder"]))

    def _objects(self, texts: DataFrame) -> None:
        """Adds ``texts(hash, text)`` to the objects; one that is there must be the same."""
        _none(texts.where(F.sha2("text", 256) != F.col("hash")), "an object isn't what its hash says")
        new = texts.dropDuplicates(["hash"]).withColumn("prefix", F.substring("hash", 1, 2))
        old = storage.read(self.spark, f"{self.root}/objects")
        if old is not None:
            # hashes are even, so a folder holds a 256th of all objects; only those of new prefixes are read
            here = old.join(new.select("prefix", "hash"), ["prefix", "hash"], "left_semi")
            _none(here.where(F.sha2("text", 256) != F.col("hash")), "an object is corrupt")
            new = new.join(old.select("prefix", "hash"), ["prefix", "hash"], "left_anti")
        new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(f"{self.root}/objects")

    def object(self, hash_: str) -> str:
        found = storage.read(self.spark, f"{self.root}/objects/prefix={hash_[:2]}")
        row = None if found is None else found.where(F.col("hash") == hash_).first()
        if row is None:
            raise FileNotFoundError(hash_)
        return row.text

    def _written(self, run_id: str, name: str, rows: DataFrame) -> dict:
        """Writes a table into the folder that its rows name, unless it is there as a whole."""
        h = [F.xxhash64(F.lit(k), F.struct(*rows.columns)).cast("decimal(38,0)") for k in (1, 2)]
        n, a, b = rows.agg(F.count("*"), *[F.coalesce(F.sum(x), F.lit(0)) for x in h]).first()
        folder = f"{name}-{n}-{int(a) % (1 << 64):016x}{int(b) % (1 << 64):016x}"
        if storage.read(self.spark, self._run(run_id, folder)) is None:
            rows.write.mode("overwrite").parquet(self._run(run_id, folder))
        return {"folder": folder, "rows": n}

    def _commit(self, run_id: str, stage: str, tables: dict[str, DataFrame], now: dt.datetime) -> None:
        before = storage.committed(self.spark, self._run(run_id, "manifest"))
        kept = {}
        if before is not None:
            kept = {k: v for k, v in before[1]["tables"].items() if STAGES.index(v["stage"]) < STAGES.index(stage)}
        made = {k: self._written(run_id, k, df) | {"stage": stage} for k, df in tables.items()}
        value = {"run_id": run_id, "stage": stage, "updated_at": now.isoformat(timespec="seconds") + "Z", "tables": kept | made}
        storage.commit(self.spark, self._run(run_id, "manifest"), 0 if before is None else before[0] + 1, value)

    def start(self, run_id: str, items: DataFrame, now: dt.datetime) -> None:
        """``items(item_id, source_type, payload)`` as fetched; an item comes once."""
        if storage.read(self.spark, self._run(run_id, "manifest"), "text") is not None:
            raise ValueError(f"{run_id} is there")
        rows = items.select(snapshot_id(FETCHED_SCHEMA, F.col("payload")).alias("snapshot_id"), "item_id", "source_type", F.sha2("payload", 256).alias("payload_hash"), "payload")
        _once(rows, "item_id", "an item is fetched twice")
        self._objects(rows.select(F.col("payload_hash").alias("hash"), F.col("payload").alias("text")))
        self._commit(run_id, "fetched", {"fetched": rows.drop("payload")}, now)

    def capture_selected(self, run_id: str, items: DataFrame, url_members: DataFrame, topic_members: DataFrame, now: dt.datetime) -> None:
        """``items(item_id, source_type, profile, payload)`` with the snapshots that each came from.

        ``..._members(survivor, ord, member)`` say what merging put together, in order; what isn't named is its own only member.
        An item's snapshots are those of the fetched items that its topic's members were merged from by URL, each once.
        """
        _once(items, "item_id", "an item is selected twice")
        ids = items.select(F.col("item_id").alias("top"))
        topic = ids.join(topic_members.select(F.col("survivor").alias("top"), F.col("ord").alias("i"), F.col("member").alias("middle")), "top", "left").select("top", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("middle", "top").alias("middle"))
        both = topic.join(url_members.select(F.col("survivor").alias("middle"), F.col("ord").alias("j"), F.col("member").alias("leaf")), "middle", "left").select("top", "i", F.coalesce("j", F.lit(0)).alias("j"), F.coalesce("leaf", "middle").alias("leaf"))
        fetched = self.table(run_id, "fetched").select(F.col("item_id").alias("leaf"), "snapshot_id")
        first = both.groupBy("top", "leaf").agg(F.min(F.struct("i", "j")).alias("at"))
        found = first.join(fetched, "leaf", "left")
        _none(found.where("snapshot_id is null").select("top", "leaf"), "a selected item comes from one that wasn't fetched")
        lineage = found.groupBy("top").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "snapshot_id"))), lambda x: x["snapshot_id"]).alias("fetched_snapshots"))  # the members of one item
        rows = items.join(lineage, items["item_id"] == lineage["top"]).select(snapshot_id(SELECTED_SCHEMA, F.col("payload")).alias("snapshot_id"), "item_id", "source_type", "profile", F.sha2("payload", 256).alias("payload_hash"), F.array_distinct("fetched_snapshots").alias("fetched_snapshots"), "payload")
        self._objects(rows.select(F.col("payload_hash").alias("hash"), F.col("payload").alias("text")))
        self._commit(run_id, "selected", {"selected": rows.drop("payload")}, now)

    def capture_claims(self, run_id: str, outcomes: DataFrame, claims: DataFrame, now: dt.datetime) -> None:
        """``outcomes(snapshot_id, status, error_code, discarded)`` cover every selected snapshot once; ``claims(claim_id, snapshot_id, ...)`` are theirs."""
        _once(outcomes, "snapshot_id", "a snapshot has two outcomes")
        _covers(outcomes.select("snapshot_id"), self.table(run_id, "selected").select("snapshot_id").distinct(), "outcomes don't cover the selected snapshots")
        _none(outcomes.where((F.col("status") == "error") != F.col("error_code").isNotNull()).select("snapshot_id"), "status and error code disagree")
        _once(claims, "claim_id", "a claim comes twice")
        mine = claims.select("claim_id", "snapshot_id").join(outcomes.select("snapshot_id", "status"), "snapshot_id", "left")
        _none(mine.where("status is null").select("claim_id"), "a claim is of no outcome")
        _none(mine.where("status = 'error'").select("claim_id"), "a failed outcome has claims")
        self._commit(run_id, "claims", {"outcomes": outcomes, "claims": claims}, now)

    def capture_evidence(self, run_id: str, results: DataFrame, snapshots: DataFrame, cards: DataFrame, reports: DataFrame, now: dt.datetime) -> None:
        """``results(claim_id, snapshot_ids, ...)`` cover every claim once, ``reports(report_id, snapshot_id, ...)`` every selected snapshot.

        ``snapshots(evidence_snapshot_id, final_url, text, text_hash)`` may repeat, but not differ; ``cards(evidence_id, claim_id,
        evidence_snapshot_id, excerpt, excerpt_start, excerpt_end)`` quote a snapshot of their claim's result exactly.
        """
        _once(results, "claim_id", "a claim has two results")
        _covers(results.select("claim_id"), self.table(run_id, "claims").select("claim_id"), "results don't cover the claims")
        _none(snapshots.groupBy("evidence_snapshot_id").agg(F.count_distinct("text_hash", "final_url").alias("n")).where("n <> 1"), "a snapshot's id stands for two")
        once = snapshots.dropDuplicates(["evidence_snapshot_id"])
        self._objects(once.select(F.col("text_hash").alias("hash"), "text"))
        _none(cards.groupBy("evidence_id").agg(F.count_distinct(F.struct(*cards.columns)).alias("n")).where("n > 1"), "a card's id stands for two")
        quoted = cards.dropDuplicates(["evidence_id"]).join(results.select("claim_id", "snapshot_ids"), "claim_id", "left").join(once.select("evidence_snapshot_id", "text"), "evidence_snapshot_id", "left")
        _none(quoted.where(~F.coalesce(F.array_contains("snapshot_ids", F.col("evidence_snapshot_id")), F.lit(False))).select("evidence_id"), "a card's snapshot isn't its claim's")
        exact = F.substring(F.col("text"), F.col("excerpt_start") + 1, F.col("excerpt_end") - F.col("excerpt_start")) == F.col("excerpt")
        _none(quoted.where(~F.coalesce(exact, F.lit(False))).select("evidence_id"), "an excerpt isn't in its snapshot")
        _once(reports, "snapshot_id", "a snapshot has two reports")
        _covers(reports.select("snapshot_id"), self.table(run_id, "selected").select("snapshot_id").distinct(), "reports don't cover the selected snapshots")
        _none(reports.where(~F.coalesce(F.col("report_id").rlike(REPORT_ID), F.lit(False))).select("report_id"), "not a report's id")
        self._commit(run_id, "evidence", {"results": results, "evidence": once.drop("text"), "cards": cards.dropDuplicates(["evidence_id"]), "reports": reports}, now)

    def runs(self) -> DataFrame:
        """``(run_id, stage, updated_at, tables)`` of every run, by its last manifest that can be parsed; runs without one are passed over."""
        found = storage.read(self.spark, f"{self.root}/runs/*/manifest", "text", wholetext=True, recursiveFileLookup=True)
        if found is None:
            return self.spark.createDataFrame([], _MANIFEST)
        part = lambda k: F.regexp_extract(F.input_file_name(), "/runs/([^/]+)/manifest/version=([0-9]+)/", k)
        rows = found.select(part(1).alias("folder"), part(2).cast("int").alias("version"), F.from_json("value", _MANIFEST).alias("m")).where("m.stage is not null")
        last = rows.withColumn("n", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("version")))).where("n = 1")
        return last.select(F.coalesce("m.run_id", "folder").alias("run_id"), "m.stage", "m.updated_at", "m.tables")

    def latest(self, stage: str | None = None) -> str | None:
        """The newest run by id, or the newest that got to ``stage``."""
        rows = self.runs() if stage is None else self.runs().where(F.col("stage") == stage)
        return rows.agg(F.max("run_id")).first()[0]

    def readable(self) -> str | None:
        """The newest run whose tables can all be read and whose time is one."""
        for r in self.runs().where(F.col("updated_at").try_cast("timestamp").isNotNull()).orderBy(F.desc("run_id")).toLocalIterator():
            if all(storage.read(self.spark, self._run(r.run_id, t.folder)) is not None for t in r.tables.values()):
                return r.run_id
        return None

    def collection(self, run_id: str) -> DataFrame:
        """``(measure, name, n)``: fetched items by source, selected ones by profile."""
        out = self.table(run_id, "fetched").groupBy(F.lit("fetched").alias("measure"), F.coalesce("source_type", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))
        if "selected" not in self.manifest(run_id)["tables"]:
            return out
        return out.unionByName(self.table(run_id, "selected").groupBy(F.lit("selected").alias("measure"), F.coalesce("profile", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")))

    def totals(self, run_id: str) -> DataFrame:
        """``(measure, n)`` from the manifest and the outcomes of a run that got to its claims: selected items, claims, discarded claims, reports."""
        tables = self.manifest(run_id)["tables"]
        known = [(name, tables[t]["rows"]) for name, t in (("selected_items", "selected"), ("claims", "claims"), ("reports", "reports")) if t in tables]
        out = self.spark.createDataFrame(known, "measure string, n long")
        if "outcomes" not in tables:
            return out
        return out.unionByName(self.table(run_id, "outcomes").agg(F.lit("discarded_claims").alias("measure"), F.coalesce(F.sum("discarded"), F.lit(0)).cast("long").alias("n")).select("measure", "n"))
