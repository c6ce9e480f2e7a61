"""URL filter by empirical-Bayes host reputation.

Labelled outcomes of pages are counted by host, registered domain and suffix. Each level's rate has
a beta prior whose mean is its parent's posterior and whose strength is fitted over all groups of
the level by the method of moments; a host is blocked when the posterior lies above the limit by its bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Workspace

#: Under a country's code these labels are part of the suffix, as in ``co.uk`` or ``gov.au``.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Names under which others register, beside that rule.
SHARED_SUFFIXES = ("blogspot.com", "firebaseapp.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com")
#: A host is blocked when its posterior bad rate less so many standard deviations is over LIMIT.
DEVIATIONS = 1.0
LIMIT = 0.5
#: Bounds of a fitted prior's strength, in observations.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


@dataclass(frozen=True)
class PathRule:
    """``rule``: host, then path; fits the host and its subdomains where the url's path starts with the rule's."""

    action: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or without ``://``: empty."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def document_of(url: Column) -> Column:
    """The document's number that the whole path names, as in ``/en/4828``, ``/en/4828/`` or ``/en/4828.html``; else null."""
    return F.regexp_extract(path_of(url), "^/(?:de|en|es|fr)/([0-9]+)(?:[.]html)?/?$", 1).try_cast("long")


def site_of(host: Column) -> Column:
    """``host`` without user information and port: what it is known by. Rules and results keep the host as it is."""
    return F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), ":[0-9]*$", "")


def _is_address(site: Column) -> Column:
    return site.rlike("^[0-9.]+$") | site.startswith("[")


def _long_suffix(site: Column, shared: tuple[str, ...]) -> Column:
    """Whether the last two labels are a suffix: a label of SECOND_LEVEL under two letters, or one of ``shared``."""
    return F.substring_index(site, ".", -2).rlike(f"^({'|'.join(SECOND_LEVEL)})[.][a-z][a-z]$") | F.substring_index(site, ".", -2).isin(*shared)


def suffix_of(site: Column, shared: tuple[str, ...] = SHARED_SUFFIXES) -> Column:
    """The suffix of a site (``site_of``); an address is its own."""
    return F.when(_is_address(site), site).when(_long_suffix(site, shared), F.substring_index(site, ".", -2)).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column, shared: tuple[str, ...] = SHARED_SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix; an address is its own."""
    return F.when(_is_address(site), site).when(_long_suffix(site, shared), F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))


def rule_of(host: Column, path: Column, rules: list[PathRule]) -> tuple[Column, Column]:
    """(action, rule) of the longest rule that fits, else nulls."""
    action = rule = F
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        action, rule = action.when(fits, F.lit(r.action)), rule.when(fits, F.lit(r.rule))
    return (action, rule) if rules else (F.lit(None).cast("string"),) * 2


def _posterior(groups: DataFrame, parent: Column) -> DataFrame:
    """``groups(n, bad, ...)`` with ``mean`` and ``weight``: a beta posterior around ``parent``.

    The strength is the method of moments' for overdispersed binomials: one number from sums over all groups.
    """
    groups = groups.withColumn("parent", parent)
    p = F.col("parent")
    over = F.sum(F.pow(F.col("bad") - F.col("n") * p, 2) - F.col("n") * p * (1 - p))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p))
    rho = over / F.when(pairs > 0, pairs)
    fitted = groups.agg(F.round(F.coalesce(F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(MOST_STRENGTH)))), F.lit(MOST_STRENGTH)), 6)).first()[0]
    weight = F.col("n") + F.lit(fitted)
    return groups.withColumn("mean", F.round((F.col("bad") + fitted * p) / weight, 9)).withColumn("weight", weight).drop("parent")


def reputations(outcomes: DataFrame, shared: tuple[str, ...] = SHARED_SUFFIXES) -> DataFrame:
    """``outcomes(host, bad)`` with bad 0 or 1 -> ``(host, mean, weight)``; rows with a null are not counted.

    ``host`` is a site as ``site_of`` gives it. Counts are partial aggregates, so a hot host costs one row a
    task; levels are joined by their key.
    """
    work = Workspace(outcomes.sparkSession, "urls")
    seen = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = work.save(seen.withColumn("domain", domain_of(F.col("host"), shared)).withColumn("suffix", suffix_of(F.col("host"), shared)), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # with one observation of either kind added, the overall rate is never 0 or 1
    overall = hosts.agg(F.round((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2), 9)).first()[0]
    top = _posterior(suffixes, F.lit(overall)).select("suffix", F.col("mean").alias("of_suffix"))
    middle = _posterior(domains.join(top, "suffix"), F.col("of_suffix")).select("domain", "suffix", F.col("mean").alias("of_domain"))
    return _posterior(hosts.join(middle, ["domain", "suffix"]), F.col("of_domain")).select("host", "mean", "weight")


def filtered(pages: DataFrame, outcomes: DataFrame, rules: list[PathRule], *, id_col: str = "page_id", url_col: str = "url", label: Column | None = None, limit: float = LIMIT, deviations: float = DEVIATIONS, shared: tuple[str, ...] = SHARED_SUFFIXES) -> DataFrame:
    """Every row of ``pages`` as ``(id, host, path, rule, bad_rate, bad_bound, verdict)``.

    ``outcomes(id, bad)`` holds labels by the value of ``label`` over ``pages``: the page's id, unless given. A
    rule decides where one fits. Otherwise the page is blocked when ``bad_bound``, its site's posterior bad rate
    less ``deviations`` standard deviations, is over ``limit``; sites without an outcome, and urls without a
    host, have null figures and are allowed. A site is the host without user information and port; ``shared``
    are suffixes beside those of countries. Null urls have an empty host and path. Ids that repeat are judged
    row by row; each of their labels counts once per row. Other columns aren't read.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("__site", site_of(F.col("host")))
    labelled = pages.select((F.col(id_col) if label is None else label).alias("id"), site_of(host_of(url)).alias("host")).where("host <> ''").join(outcomes.select("id", "bad"), "id")
    known = reputations(labelled.select("host", "bad"), shared).withColumnRenamed("host", "__site")
    action, rule = rule_of(F.col("host"), F.col("path"), rules)
    mean = F.col("mean")
    bound = F.round(mean - F.lit(float(deviations)) * F.sqrt(mean * (1 - mean) / (F.col("weight") + 1)), 6)
    own = F.when(F.coalesce(bound > limit, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(known, "__site", "left").select(F.col(id_col), "host", "path", rule.alias("rule"), F.round("mean", 6).alias("bad_rate"), bound.alias("bad_bound"), F.coalesce(action, own).alias("verdict"))
