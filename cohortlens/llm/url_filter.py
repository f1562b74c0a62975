"""URL filter: allow/block rules and empirical-Bayes host reputation (native DataFrame functions only).

Labelled page outcomes are counted by host. Their good rate is shrunk through beta-binomial priors from suffix to
registered domain to host: the prior of a host is its domain's posterior mean, that of a domain its suffix's, that
of a suffix the overall rate. How strongly each level pulls (the prior's pseudo-count) is fitted by moments from
how much the groups of that level differ beyond binomial noise. A host passes if the lower bound of its posterior
(mean - z standard deviations) is at least ``min_rate``.

Work at scale: two partial aggregations by host (a hot host is one row for each map task), then tables with a row
for each host, domain and suffix; the host table is written once. Three rows of level statistics go to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.layout import cut_lineage

#: Second labels under which country suffixes register names (``name.co.uk``).
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of the intra-group correlation, and its value where the labels cannot tell.
RHO_LOW, RHO_HIGH, RHO_UNKNOWN = 0.001, 0.5, 0.1


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host, all its subdomains, and urls whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` and host, path, suffix and registered domain of the url."""
    second = "|".join(SECOND_LEVEL)
    tail = rf"(?:(?:{second})\.[a-z]{{2}}|[^.]*)$"
    host = F.col("host")
    return pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumns({
        "suffix": F.regexp_extract(host, rf"(?:^|\.)({tail})", 1),
        "domain": F.regexp_extract(host, rf"(?:^|\.)([^.]+\.{tail})", 1)}).withColumn(
        "domain", F.when(F.col("domain") == "", host).otherwise(F.col("domain")))


def rule_match(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(rule, rule_verdict) of the longest fitting rule; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,rule_verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("rule_verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame, prior: Column) -> float:
    """Pseudo-count of the beta prior, by moments: sum n(p-m)^2 against what binomial noise alone would give."""
    p, var = F.col("good") / F.col("n"), prior * (1 - prior)
    s = groups.where(F.col("n") > 0).agg(
        F.sum(F.col("n") * (p - prior) * (p - prior)).alias("s"), F.sum(var).alias("v"),
        F.sum(var * (F.col("n") - 1)).alias("w")).first()
    rho = RHO_UNKNOWN if not s["w"] else min(max((s["s"] - s["v"]) / s["w"], RHO_LOW), RHO_HIGH)
    return 1 / rho - 1


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior good rate of each host.

    ``outcomes``: host, domain, suffix and ``good`` (1, 0 or null: not labelled), a row for each page. Returns a row
    for each host: host, n_labelled, rate (posterior mean) and lower (mean - z standard deviations, at least 0).
    With no label at all, every rate is 0.5.
    """
    hosts = cut_lineage(outcomes.groupBy("host", "domain", "suffix").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = total["good"] / total["n"] if total["n"] else 0.5

    def shrunk(groups: DataFrame, prior: Column) -> tuple[DataFrame, float]:
        m = _strength(groups, prior)
        return groups.withColumn("rate", (F.col("good") + m * prior) / (F.col("n") + m)), m

    suffixes, _ = shrunk(suffixes, F.lit(overall))
    domains, _ = shrunk(domains.join(suffixes.select("suffix", F.col("rate").alias("prior")), "suffix"), F.col("prior"))
    hosts, m = shrunk(hosts.join(domains.select("domain", "suffix", F.col("rate").alias("prior")),
                                 ["domain", "suffix"]), F.col("prior"))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + m + 1))
    return hosts.select("host", F.col("n").alias("n_labelled"), "rate",
                        F.greatest(F.col("rate") - z * sd, F.lit(0.0)).alias("lower"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], label_key: Column, key: str = "page_id",
               url: str = "url", min_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """Verdict for each row of ``pages``: the longest fitting rule's, else the host reputation's.

    ``labels`` holds ``label_id`` and ``good`` (0/1, at most one row is used for each id: the smallest good);
    ``label_key`` is the column expression over ``pages`` (with host, path) that names a page's label. Returns key,
    host, path, rule, verdict, n_labelled, host_rate, host_lower (both rounded to 6 places).

    A null url, or one without ``://``, has an empty host and path and is judged as that (empty) host. Repeated rows
    are judged alike and all stay. Empty tables give no rows; columns beyond those named are not read.
    """
    p = with_host(pages.select(F.col(key).alias("key"), F.col(url).alias("url"))).select(
        "key", "host", "path", "domain", "suffix", label_key.alias("label_id"))
    good = labels.where(F.col("label_id").isNotNull()).groupBy("label_id").agg(F.min("good").alias("good"))
    rep = host_reputation(p.join(good, "label_id", "left"), z)
    m = p.select("key", "host", "path", rule_match(rules, F.col("host"), F.col("path")).alias("m"))
    by_method = F.when(F.col("lower") >= min_rate, "allow").otherwise("block")
    return m.join(rep, "host").select(
        F.col("key").alias(key), "host", "path", F.col("m.rule").alias("rule"),
        F.coalesce(F.col("m.rule_verdict"), by_method).alias("verdict"), "n_labelled",
        F.round("rate", 6).alias("host_rate"), F.round("lower", 6).alias("host_lower"))
