"""The staged pipeline: fetch, score, filter, enrich, summarise; every stage is a table of a run."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, models, render, select, stats
from ..sources.common import all_sources, fetch_outcomes
from ..streaming.runs import RunStore


@dataclass
class Config:
    """What a run goes by."""

    profiles: dict[str, select.ProfileSettings] = field(default_factory=dict)
    default_profile: str = "general"
    groups: dict[str, select.Group] = field(default_factory=dict)
    default_group: str = "other"
    default_group_limit: int | None = None
    max_items: int | None = None
    hours: float = 24
    names: dict[str, str] = field(default_factory=dict)


class Pipeline:
    """Stages over a run store. ``model`` classifies and scores; 

    ``topics`` maps scored items with ``profile_id`` and ``pos``, their place in the profile, to proposed ``(profile_id, group_id, members)``.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config, model: models.ModelFn | None = None, topics=None):
        self.spark, self.store, self.config, self.model, self.topics = spark, RunStore(spark, root), config, model, topics

    def fetch_items(self, sources: dict[str, DataFrame | Exception], now: dt.datetime, run_id: str | None = None) -> dict:
        run_id = run_id or self.store.create(now)
        report = stats.fetch_report(fetch_outcomes(self.spark, sources)).first().asDict()
        good = {k: v for k, v in sources.items() if not isinstance(v, Exception)}
        if report["all_failed"] or not good:
            raise RuntimeError("all sources failed")
        items = dedup.merged_across_sources(select.since(all_sources(good), now, self.config.hours))
        self.store.save(run_id, "raw", items)
        self.store.update_meta(run_id, fetch=report)
        return {"run_id": run_id, **report}

    def score_items(self, run_id: str) -> DataFrame:
        items = self.store.load(run_id, "raw")
        c = self.config
        prompt = F.concat_ws("\n", "title", "content")
        classed = models.classified(items, self.model, list(c.profiles) or [c.default_profile], c.default_profile, prompt)
        scored = models.analysed(classed, self.model, F.concat(F.lit("Score for profile "), "profile_id"), prompt)
        self.store.save(run_id, "scored", scored)
        return models.assert_not_all_failed(self.store.load(run_id, "scored"))

    def _passing(self, rows: DataFrame, threshold: float | None) -> DataFrame:
        rows = rows.withColumn("analysed", F.lit(True)).withColumn("category", F.get_json_object(F.to_json("metadata"), "$.category"))
        return select.passes(rows, self.config.profiles, threshold).where("passed").drop("passed", "analysed", "applied_threshold")

    def filter_items(self, run_id: str, threshold: float | None = None, topic_dedup: bool = True, expand=None) -> DataFrame:
        """``expand`` maps the items that pass to the same with more content and new scores; what it lowers below its profile's threshold goes."""
        c = self.config
        kept = self._passing(self.store.load(run_id, "scored"), threshold)
        if topic_dedup and self.topics is not None:
            kept = self._without_topic_copies(kept)
        if expand is not None:
            kept = self._passing(expand(kept).drop("category"), threshold)
        final = select.balanced(kept, c.groups, default=c.default_group, default_limit=c.default_group_limit, max_items=c.max_items)
        self.store.save(run_id, "filtered", final)
        return self.store.load(run_id, "filtered")

    def _without_topic_copies(self, kept: DataFrame) -> DataFrame:
        """Copies of a topic are merged within each profile; profiles that don't want it keep all."""
        from pyspark.sql import Window

        apart = [p for p, s in self.config.profiles.items() if not s.topic_dedup]
        merges = ~F.coalesce(F.col("profile_id").isin(*apart), F.lit(False)) if apart else F.lit(True)
        mine = kept.where(merges).withColumn("profile_id", F.coalesce("profile_id", F.lit("")))
        mine = mine.withColumn("pos", F.row_number().over(Window.partitionBy("profile_id").orderBy(*select.by_score())) - 1)
        merged = dedup.merged_topics(mine, self.topics(mine), "profile_id").drop("pos").withColumn("profile_id", F.nullif("profile_id", F.lit("")))
        return merged.unionByName(kept.where(~merges).withColumn("lineage", F.array("id")))

    def enrich_items(self, run_id: str, enrich=None) -> DataFrame:
        """``enrich`` maps items to the same with ``artifact``; without it they have none. Items for which it sets ``enrichment_failed`` go."""
        rows = self.store.load(run_id, "filtered")
        empty = F.lit(None).cast("struct<language:string,title:string,blocks:array<struct<id:string,type:string,title:string,content:string,source_refs:array<string>,primary:boolean>>,sources:array<struct<id:string,title:string,url:string>>>")
        made = enrich(rows) if enrich else rows.withColumn("artifact", empty)
        if "enrichment_failed" in made.columns:
            made = made.where(~F.coalesce("enrichment_failed", F.lit(False))).drop("enrichment_failed")
        self.store.save(run_id, "enriched", made)
        return self.store.load(run_id, "enriched")

    def generate_summary(self, run_id: str, date: str, language: str = "en") -> str:
        stage = self.store.best_stage(run_id)
        items = self.store.load(run_id, stage)
        if "artifact" not in items.columns:
            items = self.enrich_items(run_id)
        total = self.store.load(run_id, "raw").count()
        text = render.issue(items, date, total, language=language, names=self.config.names).first().markdown
        self.store.save_summary(run_id, language, text)
        return text

    def run_pipeline(self, sources: dict[str, DataFrame | Exception], now: dt.datetime, language: str = "en") -> dict:
        report = self.fetch_items(sources, now)
        run_id = report["run_id"]
        self.score_items(run_id)
        self.filter_items(run_id)
        self.enrich_items(run_id)
        return report | {"summary": self.generate_summary(run_id, now.date().isoformat(), language)}

    def list_runs(self, limit: int | None = None) -> list[dict]:
        return [self.store.meta(r) for r in self.store.runs(limit)]

    def get_run_stage(self, run_id: str, stage: str, max_items: int) -> dict:
        rows = self.store.load(run_id, stage)
        n = rows.count()
        return {"items": [r.asDict(True) for r in rows.orderBy("ord").limit(max_items).collect()], "count": n, "truncated": n > max_items}

    def get_run_summary(self, run_id: str, language: str = "en") -> str:
        return self.store.summary(run_id, language)


def same_words_topics():
    """A stand-in for a model that proposes topic groups: items of equal words in title, in any order."""

    def propose(items: DataFrame) -> DataFrame:
        words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("title"), "(?U)[^\\w]+"), lambda w: w != "")))
        groups = items.groupBy("profile_id", words.alias("w")).agg(F.array_sort(F.collect_list("pos")).alias("members")).where("size(members) > 1")
        return groups.select("profile_id", F.element_at("members", 1).cast("long").alias("group_id"), "members")

    return propose
