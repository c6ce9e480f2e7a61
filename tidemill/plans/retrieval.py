"""Bounded retrieval over claims that Spark derives from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval
from .registry import query

_KIND = "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'event' WHEN 'MACHINERY' THEN 'other' ELSE 'release' END"
_CHECK = "CASE WHEN c_acctbal > 0 THEN 'checkable' ELSE 'not_checkable' END"
_STATUS = "CASE c_nationkey % 3 WHEN 0 THEN 'supported_by_evidence' WHEN 1 THEN 'insufficient_evidence' ELSE 'mixed_evidence' END"
_SAID = "CASE (c_custkey + call) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'valid' ELSE 'invalid' END"
_FETCHED = "CASE WHEN p_partkey % 40 % 3 > 0 THEN 'ok' WHEN p_partkey % 2 = 0 THEN 'not_found' ELSE 'timeout' END"


def _round(n: int) -> str:
    """State after a round in SQL: seen keys, calls, errors, invalid links and why it stopped."""
    s = n - 1
    goes = f"stop{s} IS NULL AND {n} <= most"
    left = f"(6 - len(seen{s}))"
    failed = f"coalesce(status{n}, 'error') = 'error'"
    asks = f"({goes} AND {left} > 0)"
    looked = f"coalesce(h{n}, [])[1:{left}]"
    return f"""
r{n} AS (SELECT *, CASE WHEN {asks} AND NOT {failed} THEN list_concat(seen{s}, list_filter(list_distinct(list_filter({looked}, lambda x: x <> '')), lambda x: NOT list_contains(seen{s}, x))) ELSE seen{s} END AS seen{n},
  calls{s} + CASE WHEN {asks} THEN 1 ELSE 0 END AS calls{n}, errors{s} + CASE WHEN {asks} AND {failed} THEN 1 ELSE 0 END AS errors{n},
  invalid{s} + CASE WHEN {asks} AND NOT {failed} THEN len(list_filter({looked}, lambda x: x = '')) ELSE 0 END AS invalid{n},
  CASE WHEN {goes} AND {left} <= 0 THEN 'budget' WHEN {asks} AND {failed} THEN 'backend_error' ELSE stop{s} END AS stop{n} FROM r{s})"""


_SQL = f"""
WITH c AS (SELECT c_custkey AS claim_id, c_custkey // 4 AS item_id, {_KIND} AS kind, {_CHECK} AS checkability, {_STATUS} AS status,
  CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN '' ELSE 'https://site' || c_custkey % 7 || '.example/a' || c_custkey % 40 END AS own FROM customer),
h AS (SELECT o_custkey AS claim_id, o_orderkey % 3 + 1 AS round, o_orderkey AS rank, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'https://site' || o_orderkey % 7 || '.example/a' || o_orderkey % 40 END AS key FROM orders),
n AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY claim_id, round ORDER BY rank) <= 6),
l AS (SELECT claim_id, list(key ORDER BY rank) FILTER (round = 1) AS h1, list(key ORDER BY rank) FILTER (round = 2) AS h2, list(key ORDER BY rank) FILTER (round = 3) AS h3 FROM n GROUP BY claim_id),
r0 AS (SELECT c.*, h1, h2, h3, CASE WHEN kind = 'release' THEN 1 ELSE 3 END AS most, CASE WHEN coalesce(own, '') = '' THEN []::VARCHAR[] ELSE [own] END AS seen0, 0 AS calls0, 0 AS errors0,
  CASE WHEN own = '' THEN 1 ELSE 0 END AS invalid0, CASE WHEN checkability <> 'checkable' THEN 'not_checkable' END AS stop0,
  {", ".join(f"CASE WHEN claim_id * {n} % 17 = 0 THEN NULL WHEN (claim_id + {n}) % 13 = 0 THEN 'error' ELSE 'ok' END AS status{n}" for n in (1, 2, 3))}
  FROM c LEFT JOIN l USING (claim_id)),{_round(1)},{_round(2)},{_round(3)},
s AS (SELECT *, CASE WHEN stop3 IS NULL AND len(seen3) >= 6 AND calls3 > 0 THEN 'budget' ELSE coalesce(stop3, 'no_novelty') END AS stopped, CASE WHEN stop0 IS NULL THEN seen3 ELSE [] END AS seen FROM r3),
d AS (SELECT DISTINCT 'https://site' || p_partkey % 7 || '.example/a' || p_partkey % 40 AS key, {_FETCHED} AS got, CASE WHEN p_partkey % 40 % 11 > 0 THEN 's' || p_partkey % 7 || '-' || p_partkey % 20 END AS snapshot FROM part),
m AS (SELECT claim_id, item_id, unnest(seen) AS key FROM s),
a AS (SELECT m.*, claim_id > min(claim_id) OVER (PARTITION BY item_id, key) AS again, got, snapshot FROM m LEFT JOIN d USING (key)),
g AS (SELECT claim_id, count(*) FILTER (got = 'ok' AND snapshot IS NOT NULL AND NOT again) AS fetched, count(*) FILTER (again) AS reuse, count(*) FILTER (coalesce(got, 'network_error') <> 'ok' OR snapshot IS NULL) AS errors,
  bool_or(coalesce(got, 'network_error') IN ('timeout', 'network_error')) AS open, count(DISTINCT snapshot) FILTER (got = 'ok') AS snapshots FROM a GROUP BY claim_id),
k AS (SELECT claim_id, min(call) FILTER (said <> 'invalid') AS ends FROM (SELECT c_custkey AS claim_id, call, {_SAID} AS said FROM customer, range(1, 4) x(call)) GROUP BY claim_id),
f AS (SELECT s.*, coalesce(g.fetched, 0) AS fetched, coalesce(reuse, 0) AS reuse, coalesce(g.errors, 0) + CASE WHEN stop0 IS NULL THEN invalid3 ELSE 0 END AS n_errors, errors3 > 0 OR coalesce(open, false) AS open, coalesce(snapshots, 0) AS snapshots,
  CASE WHEN coalesce(snapshots, 0) > 0 THEN coalesce(ends, 3) ELSE 0 END AS needs, CASE WHEN ends IS NULL THEN 'invalid' WHEN (claim_id + ends) % 5 = 1 THEN 'valid' ELSE 'failed' END AS said
  FROM s LEFT JOIN g USING (claim_id) LEFT JOIN k USING (claim_id)),
b AS (SELECT *, greatest(0, 5 - coalesce(sum(needs) OVER (PARTITION BY item_id ORDER BY claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS remaining FROM f)
SELECT claim_id, CAST(calls3 AS INTEGER) AS search_calls, CAST(len(seen) AS INTEGER) AS attempted, CAST(fetched AS INTEGER) AS fetched, CAST(reuse AS INTEGER) AS cache_reuse, CAST(n_errors AS INTEGER) AS fetch_errors, CAST(snapshots AS INTEGER) AS snapshots,
  CAST(least(needs, remaining) AS INTEGER) AS model_calls, CASE WHEN stop0 IS NOT NULL THEN false WHEN snapshots = 0 THEN open ELSE needs > remaining OR said <> 'valid' END AS stage_error,
  CASE WHEN stop0 IS NOT NULL THEN stop0 WHEN snapshots = 0 AND NOT open AND len(seen) > 0 THEN 'source_unavailable' WHEN snapshots = 0 THEN stopped WHEN needs > remaining THEN 'budget' WHEN said <> 'valid' THEN 'backend_error'
    WHEN status <> 'insufficient_evidence' THEN 'sufficient' WHEN stopped IN ('budget', 'backend_error') THEN stopped ELSE 'no_novelty' END AS stop_reason
FROM b"""


@query(_SQL)
def retrieved_evidence(t):
    """Claims by customer, four an item; what searches bring by order, fetched pages by part."""
    customer = t("customer")
    own = F.expr("CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 'https://a..b/x' ELSE 'https://Site' || c_custkey % 7 || '.example:443/a' || c_custkey % 40 || '#top' END")
    claims = customer.select(F.col("c_custkey").alias("claim_id"), F.expr("c_custkey div 4").alias("item_id"), F.col("c_custkey").alias("ord"), F.expr(_KIND).alias("kind"), F.expr(_CHECK).alias("checkability"), own.alias("url"))
    rounds = customer.select(F.col("c_custkey").alias("claim_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("round")).where("claim_id * round % 17 <> 0")
    searches = rounds.select("claim_id", "round", F.expr("CASE WHEN (claim_id + round) % 13 = 0 THEN 'error' ELSE 'ok' END").alias("status"), F.lit("rate_limited").alias("error_code"))
    url = F.expr("CASE WHEN o_orderkey % 23 = 0 THEN 'https://x.example:99999/' ELSE 'HTTPS://site' || o_orderkey % 7 || '.example/a' || o_orderkey % 40 END")
    hits = t("orders").select(F.col("o_custkey").alias("claim_id"), F.expr("cast(o_orderkey % 3 + 1 as int)").alias("round"), F.col("o_orderkey").alias("rank"), url.alias("url"))
    documents = t("part").selectExpr("'https://site' || p_partkey % 7 || '.example/a' || p_partkey % 40 AS key", f"{_FETCHED} AS status", "CASE WHEN p_partkey % 40 % 11 > 0 THEN 's' || p_partkey % 7 || '-' || p_partkey % 20 END AS snapshot_id").distinct()
    answers = customer.select(F.col("c_custkey"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("call")).selectExpr("c_custkey AS claim_id", "call", f"{_SAID} AS outcome")
    statuses = customer.selectExpr("c_custkey AS claim_id", f"{_STATUS} AS status")
    found = retrieval.concluded(retrieval.retrieved(claims, searches, hits, documents, ascii_hosts=True), answers, statuses, model_calls=5)
    return found.select("claim_id", "search_calls", "attempted", "fetched", "cache_reuse", F.size("fetch_errors").alias("fetch_errors"), F.size("snapshots").alias("snapshots"), "model_calls", "stage_error", "stop_reason")
