"""The incident ledger: one row an incident, merged run by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY = T.ArrayType(T.StructType([T.StructField("state", T.StringType()), T.StructField("changed_at", T.StringType())]))
SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("incident_id", "profile", "claim", "first_seen_at", "state")]
    + [T.StructField("state_history", HISTORY), T.StructField("source_item_ids", T.ArrayType(T.StringType())), T.StructField("source_urls", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("last_seen_at", "last_checked_at", "next_check_at")]
)


def state_of(resolved: Column, public_status: Column) -> Column:
    return F.when(F.coalesce(resolved, F.lit(False)), "RESOLVED").when(public_status == "disputed", "DISPUTED").when(public_status == "corroborated_event", "CORROBORATED").otherwise("PROVISIONAL")


def merged(ledger: DataFrame, records: DataFrame, now: str) -> DataFrame:
    """``ledger`` after a run's ``records(ord, incident_id, profile, claim, state, item_id, url, checked_at, next_check_at)``.

    Records of one incident are folded in order: the state's history grows only when it changes, ids and
    URLs are added once, the last record's times stand, and what was first seen stays. Incidents without
    a record stay as they are.
    """
    row = F.struct("ord", "profile", "claim", "state", "item_id", "url", "checked_at", "next_check_at")
    new = records.groupBy("incident_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    both = ledger.join(new, "incident_id", "full_outer")
    first, last = F.element_at("r", 1), F.element_at("r", -1)
    none = F.array().cast(HISTORY)
    entry = F.struct(F.coalesce("state_history", none).alias("h"), F.col("state").alias("s"))

    def step(acc: Column, x: Column) -> Column:
        change = (F.size(acc["h"]) == 0) | ~acc["s"].eqNullSafe(x["state"])
        return F.struct(F.when(change, F.concat(acc["h"], F.array(F.struct(x["state"].alias("state"), F.lit(now).alias("changed_at"))))).otherwise(acc["h"]).alias("h"), x["state"].alias("s"))

    strings = F.array().cast("array<string>")
    add = lambda old, key: F.array_distinct(F.concat(F.coalesce(old, strings), F.transform("r", lambda x: x[key])))
    seen = F.col("r").isNotNull()
    pick = lambda fresh, old: F.when(seen, fresh).otherwise(F.col(old)).alias(old)
    return both.select(
        "incident_id",
        F.coalesce("profile", first["profile"]).alias("profile"),
        F.coalesce("claim", first["claim"]).alias("claim"),
        F.coalesce("first_seen_at", F.lit(now)).alias("first_seen_at"),
        pick(last["state"], "state"),
        pick(F.aggregate("r", entry, step, lambda acc: acc["h"]), "state_history"),
        pick(add(F.col("source_item_ids"), "item_id"), "source_item_ids"),
        pick(add(F.col("source_urls"), "url"), "source_urls"),
        pick(F.lit(now), "last_seen_at"),
        pick(F.coalesce(last["checked_at"], F.lit(now)), "last_checked_at"),
        pick(last["next_check_at"], "next_check_at"),
    )


def due(ledger: DataFrame, now: str) -> DataFrame:
    """Incidents whose next check has come."""
    return ledger.where(F.col("next_check_at") <= F.lit(now))


def latest(ledger: DataFrame, n: int = 20) -> DataFrame:
    """The page's incidents: last seen first."""
    return ledger.orderBy(F.col("last_seen_at").desc(), "incident_id").limit(n)
