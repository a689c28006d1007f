"""Which marketplace a URL belongs to, and whether it may be used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import ALLOWED_DOMAINS, SITE_DOMAINS, authority, host
from .skew import join_facts


def host_suffixes(h):
    """``a.b.com`` as ``[a.b.com, b.com, com]``: a domain owns the host exactly if it is one of these."""
    parts = F.split(h, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def site_table(spark) -> DataFrame:
    rows = [(i, site, domain) for i, (site, domain) in enumerate(SITE_DOMAINS)]
    return spark.createDataFrame(rows, "priority int, site string, domain string")


def assign_site(df: DataFrame, sites: DataFrame, url: str = "url", key: str = "url_id") -> DataFrame:
    """Add ``site`` from ``sites(priority, site, domain)``; of several domains the one with lowest priority wins.

    A host has few suffixes, so suffixes are joined with domains by equality instead of comparing every pair.
    """
    suffixes = df.select(key, F.explode(host_suffixes(authority(F.col(url)))).alias("domain"))
    first = suffixes.join(sites, "domain").groupBy(key).agg(F.min_by("site", "priority").alias("site"))
    return df.join(first, key, "left")


def allowed_domains(
    df: DataFrame, domains: tuple[str, ...] = ALLOWED_DOMAINS, keep: bool = True, url: str = "url"
) -> DataFrame:
    """Rows whose host is, or lies below, one of the domains; with ``keep=False`` the others."""
    owned = F.arrays_overlap(host_suffixes(host(F.col(url))), F.array(*[F.lit(d) for d in domains]))
    return df.filter(owned if keep else ~owned)


def rules_for(rules: DataFrame, agent: str) -> DataFrame:
    """The rules of each host that hold for ``agent``: those of the groups that name it, else those for ``*``.

    A group names an agent when its name, whatever the case, is part of the agent's name before the version. Rules
    without an ``agent`` hold for all.
    """
    name = F.lit(agent.split("/")[0].lower())
    listed = F.coalesce(F.col("agent"), F.lit("*"))
    rank = F.when(listed == "*", 0).when(F.contains(name, F.lower(listed)), 1)
    ranked = rules.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    best = ranked.groupBy("host").agg(F.max("_rank").alias("_best"))
    return ranked.join(best, "host").filter(F.col("_rank") == F.col("_best")).drop("_rank", "_best", "agent")


def robots_filter(
    urls: DataFrame, rules: DataFrame, status: DataFrame, key: str = "url_id", url: str = "url", agent: str = "*"
) -> DataFrame:
    """Add ``allowed`` by each host's crawl rules.

    ``rules(host, rule_no, prefix, allow)`` apply first match first; an empty prefix that disallows nothing must be
    given as ``allow``. With a column ``agent``, those of ``agent`` are used (:func:`rules_for`).
    ``status(host, fetch_status)`` says how reading them went: 200 applies the rules, 4xx allows all, anything else or
    no answer denies all.

    A URL is not compared with the rules of its host: for each length that prefixes of the host have, its own beginning
    of that length is looked up, so the work follows the URLs and the few lengths in use, however many rules there are.
    """
    if "agent" in rules.columns:
        rules = rules_for(rules, agent)
    path = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    located = urls.withColumn("host", authority(F.col(url))).withColumn(
        "_path", F.when(path == "", "/").otherwise(path)
    )
    first = rules.groupBy("host", "prefix").agg(F.min_by(F.struct("rule_no", "allow"), "rule_no").alias("_rule"))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    asked = join_facts(located.select(key, "host", "_path"), lengths, ["host"], key)
    fitting = F.filter("_lengths", lambda n: n <= F.length("_path"))
    begun = asked.select(key, "host", "_path", F.explode(fitting).alias("_length")).select(
        key, "host", F.expr("substring(_path, 1, _length)").alias("prefix")
    )
    matched = (
        join_facts(begun, first, ["host", "prefix"], key)
        .groupBy(key)
        .agg(F.min_by("_rule.allow", "_rule.rule_no").alias("_allow"))
    )
    code = F.col("fetch_status")
    return (
        join_facts(located, status, ["host"], key, "left")
        .join(matched, key, "left")
        .withColumn(
            "allowed",
            F.when(code == 200, F.coalesce("_allow", F.lit(True)))
            .when(code.between(400, 499), True)
            .otherwise(False),
        )
        .drop("_path", "_allow", "fetch_status", "host")
    )
