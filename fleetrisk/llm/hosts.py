"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Outcomes of labelled pages are counted by host, registered domain and suffix. Each level is a beta-binomial whose
prior mean is its parent's posterior mean and whose prior strength is fitted by moments from how far the level's rates
scatter about their parents: little seen hosts lean on their domain, little seen domains on their suffix. A host is
blocked where the lower bound of its posterior is above the cut: the rate of all pages, unless the caller states one, so
that a host is blocked which is worse than the others beyond doubt, whatever outcome is counted.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

# fixed values: public suffixes of two labels that are in wide use
TWO_LABELS = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk"]
NOISE = r"(?:[%#*$!|]{2,}|(?:&amp;){2,}| \| )"
BOUND_Z = 1.645  # one-sided 95 %
ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])(:\d*)?$"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``(rule, action)`` of the longest of ``rules`` (action, host, path) that fits a host or a subdomain of it, else null."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(a).alias("action"))) for a, h, p in order]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,action:string>")


def noisy(html: Column) -> Column:
    """Whether marks that no prose has follow on a twentieth of a page's words or more."""
    text = F.coalesce(html, F.lit(""))
    return (F.regexp_count(text, F.lit(NOISE)) * 20 >= F.regexp_count(text, F.lit(r"\S+")) + 1).cast("int")


def _named(host: Column) -> Column:
    """The host without a port and a final dot."""
    return F.regexp_replace(host, r"\.?(:\d*)?$", "")


def suffix_of(host: Column, two_labels: list[str] = TWO_LABELS) -> Column:
    """The public suffix; addresses have one in common."""
    name = _named(host)
    two = F.substring_index(name, ".", -2)
    return F.when(host.rlike(ADDRESS), "address").when(two.isin(two_labels), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, two_labels: list[str] = TWO_LABELS) -> Column:
    """The registered domain: a label more than the suffix; an address is its own."""
    name = _named(host)
    two = F.substring_index(name, ".", -2)
    return F.when(host.rlike(ADDRESS), name).when(two.isin(two_labels), F.substring_index(name, ".", -3)).otherwise(two)


def strength(groups: DataFrame) -> float:
    """Prior strength of ``groups(n, k, parent_rate)`` by the method of moments, between 0.5 and 1000."""
    p = F.col("parent_rate")
    s = groups.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2)).alias("scatter"), F.sum(p * (1 - p)).alias("one"), F.sum(F.col("n") * p * (1 - p)).alias("all")).first()
    if not s["all"] or s["all"] <= s["one"]:
        return 1000.0
    rho = (s["scatter"] - s["one"]) / (s["all"] - s["one"])
    return float(min(1000.0, max(0.5, 1 / rho - 1))) if rho > 0 else 1000.0


def reputations(outcomes: DataFrame, z: float = BOUND_Z) -> DataFrame:
    """``host, n, k, rate, low, base``: posterior mean and lower bound of the bad share, from ``outcomes(host, bad)``, and
    the rate of all outcomes.

    Outcomes are summed by host before anything is shuffled twice, so a host with a third of all pages is one sum for
    each task. Parents are sums of their children. Only the strengths of the three priors reach the driver. Null
    outcomes and empty hosts do not count.
    """
    hosts = outcomes.where("host <> '' and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    hosts = checkpointed(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(F.sum("n"), F.sum("k")).first()
    top = (float(whole[1]) + 0.5) / (float(whole[0]) + 1) if whole[0] else 0.5

    def settled(groups: DataFrame, *keep: str) -> DataFrame:
        s = strength(groups)
        rate = (F.col("k") + s * F.col("parent_rate")) / (F.col("n") + s)
        return groups.select(*keep, "n", "k", rate.alias("rate"), (F.col("n") + s).alias("weight"))

    of_suffix = settled(suffixes.withColumn("parent_rate", F.lit(top)), "suffix").select("suffix", F.col("rate").alias("parent_rate"))
    of_domain = settled(domains.join(of_suffix, "suffix"), "domain").select("domain", F.col("rate").alias("parent_rate"))
    of_host = settled(hosts.join(of_domain, "domain"), "host")
    low = F.greatest(F.lit(0.0), F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1)))
    return of_host.select("host", "n", "k", "rate", low.alias("low"), F.lit(top).alias("base"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], cut: float | None = None, z: float = BOUND_Z, outcomes: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bad_low`` for every row of ``pages``.

    A rule's action holds; without one a page is blocked if its host's bound is above ``cut`` (default: the rate of all
    pages). ``outcomes(host, bad)`` come from the caller, else from marks in the pages themselves. Urls that are null or
    lack ``://`` have empty host and path, fit no rule and are allowed; repeated rows count as often as they come, other
    columns of ``pages`` are not read. Empty tables give empty results.
    """
    if outcomes is None:
        outcomes = pages.select(host_of(F.col("url")).alias("host"), noisy(F.col("html")).alias("bad"))
    known = reputations(outcomes, z).select("host", F.col("rate").alias("bad_rate"), F.col("low").alias("bad_low"), "base")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = urls.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).join(known, "host", "left")
    verdict = F.coalesce(F.col("fit.action"), F.when(F.col("bad_low") > (F.col("base") if cut is None else F.lit(cut)), "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "bad_rate", "bad_low")
