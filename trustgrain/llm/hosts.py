"""URL filter: block rules, and the reputation of hosts shrunk towards their domain and suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import fresh

#: (host, path, verdict). A rule fits its host and all subdomains where the path of the url starts with its path.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: A host is blocked when its share of bad pages is above ``MOST_BAD`` with a confidence of 95 % (one-sided), which is
#: this quantile of the normal distribution.
MOST_BAD = 0.5
Z = 1.645

# Suffixes of two labels below which sites are registered by different owners. A suffix that is not listed
# is the last label.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph",
    "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.br", "edu.cn", "edu.hk",
    "edu.tw", "gen.tr", "go.jp", "go.kr", "go.th", "gob.ar", "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk",
    "gov.za", "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.nz", "net.uk", "nhs.uk", "or.jp", "or.kr", "org.ar",
    "org.au", "org.br", "org.cn", "org.hk", "org.in", "org.mx", "org.nz", "org.tr", "org.tw", "org.uk", "org.za", "sch.uk",
    "blogspot.com", "fandom.com", "github.io", "gitlab.io", "herokuapp.com", "livejournal.com", "myshopify.com",
    "netlify.app", "pages.dev", "substack.com", "tumblr.com", "vercel.app", "web.app", "weebly.com", "wixsite.com",
    "wordpress.com",
)
#: Stands for the suffix of numeric addresses, each of which is a domain of its own.
ADDRESS = "address"
#: Bounds of the within-group correlation of outcomes; the concentration of a prior is ``1 / rho - 1``.
LEAST_RHO, MOST_RHO = 0.001, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def registered_domain(host: Column) -> tuple[Column, Column]:
    """The registered domain of a host without its port, and its suffix.

    The suffix is the last two labels where they are one of ``SUFFIXES``, else the last label; the domain has one label
    more, or is the suffix itself where the host has no more. A numeric address (four numbers, or anything in brackets)
    is its own domain, with the suffix ``ADDRESS``.
    """
    bare = F.when(host.startswith("["), F.substring_index(host, "]", 1)).otherwise(F.substring_index(host, ":", 1))
    address = host.startswith("[") | bare.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    two = F.substring_index(bare, ".", -2)
    listed = two.isin(*SUFFIXES)
    domain = F.when(address, bare).when(listed, F.substring_index(bare, ".", -3)).otherwise(two)
    suffix = F.when(address, F.lit(ADDRESS)).when(listed, two).otherwise(F.substring_index(bare, ".", -1))
    return domain, suffix


def certainty(alpha: Column, beta: Column, most: float) -> Column:
    """How many standard deviations surely a share with this beta posterior is above ``most``.

    The cube-root normal approximation of the beta distribution (Abramowitz and Stegun, 26.5.21): the probability of a
    share of at most ``most`` is that of a normal value below minus the result. For ``most`` of one half it is off by at
    most 0.006 where alpha and beta add up to 2, 0.001 at 4 and 0.0004 from 8 on.
    """
    third = F.lit(1.0) / 3
    x, y = F.pow(beta * F.lit(float(most)), third), F.pow(alpha * F.lit(1.0 - most), third)
    mean = x * (1 - 1 / (9 * beta)) - y * (1 - 1 / (9 * alpha))
    return F.lit(-3.0) * mean / F.sqrt(x * x / beta + y * y / alpha)


def _concentration(units: DataFrame, parent_mean: Column, least_rho: float, most_rho: float) -> float:
    """Concentration of the beta prior that the units of one level share, by the method of moments.

    ``units`` has ``n`` and ``bad``; the squared deviations of their rates from the parent's rate exceed what chance
    gives by as much as outcomes inside a unit are correlated. One row of sums comes to the driver.
    """
    p = parent_mean
    rate = F.col("bad") / F.col("n")
    sums = (
        units.filter((F.col("n") > 0) & (p > 0) & (p < 1))
        .agg(
            F.sum(F.col("n") * F.pow(rate - p, F.lit(2)) / (p * (1 - p))).alias("q"),
            F.count("*").alias("k"),
            F.sum("n").alias("total"),
            F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        )
        .first()
    )
    rho = least_rho
    if sums["k"] > 1:
        room = sums["total"] - sums["squares"] / sums["total"] - (sums["k"] - 1)
        if room > 0:
            rho = (sums["q"] - (sums["k"] - 1)) / room
    rho = min(max(rho, least_rho), most_rho)
    return 1 / rho - 1


def host_reputation(
    outcomes: DataFrame,
    most_bad: float = MOST_BAD,
    z: float = Z,
    least_rho: float = LEAST_RHO,
    most_rho: float = MOST_RHO,
) -> DataFrame:
    """Posterior of the share of bad pages for every host of ``outcomes(host, bad)``.

    ``bad`` is 1, 0 or null (page without a label). The rate of a suffix is shrunk towards the rate of all pages, that
    of a registered domain towards its suffix, that of a host towards its domain; each level has a beta prior whose
    concentration is estimated from the spread between the units of that level. Returns ``(host, n, bad, mean, sure,
    blocked)``: ``sure`` tells how many standard deviations the share of bad pages is surely above ``most_bad`` (see
    ``certainty``), and a host is blocked where that is more than ``z``. Without any label every mean is 0 and nothing is
    blocked; without good or without bad labels every mean is 1 or 0, and all hosts are blocked or none.

    Pages are summed per host before anything is joined; the tables of hosts, domains and suffixes are sums.
    """
    hosts = written(
        outcomes.groupBy(F.coalesce("host", F.lit("")).alias("host"))
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
        .withColumn("domain", registered_domain(F.col("host"))[0])
        .withColumn("suffix", registered_domain(F.col("host"))[1]),
        "hosts",
    )
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = whole["bad"] / whole["n"] if whole["n"] else 0.0

    def level(units: DataFrame, parent: Column) -> DataFrame:
        k = F.lit(_concentration(units, parent, least_rho, most_rho))
        alpha = k * parent + F.col("bad")
        beta = k * (1 - parent) + F.col("n") - F.col("bad")
        return units.withColumn("alpha", alpha).withColumn("beta", beta).withColumn("mean", alpha / (alpha + beta))

    def summed(key: str, *more: str) -> DataFrame:
        return hosts.groupBy(key, *more).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def means(units: DataFrame, key: str) -> DataFrame:
        return units.select(key, F.col("mean").alias("parent_mean"))

    suffixes = level(summed("suffix"), F.lit(overall))
    domains = level(summed("domain", "suffix").join(means(suffixes, "suffix"), "suffix"), F.col("parent_mean"))
    judged = level(hosts.join(means(domains, "domain"), "domain"), F.col("parent_mean"))
    sure = (
        F.when(F.col("alpha") <= 0, F.lit(float("-inf")))
        .when(F.col("beta") <= 0, F.lit(float("inf")))
        .otherwise(certainty(F.col("alpha"), F.col("beta"), most_bad))
    )
    return (
        judged.withColumn("sure", sure)
        .withColumn("blocked", F.col("sure") > F.lit(float(z)))
        .select("host", "n", "bad", "mean", "sure", "blocked")
    )


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    label_id: str = "doc_id",
    quality: str = "quality",
    rules=RULES,
    most_bad: float = MOST_BAD,
    z: float = Z,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` (allow or block).

    The longest fitting rule decides; elsewhere the reputation of the host does, learnt from ``labels``: a page is bad
    where ``quality`` is 0, good where it is anything else, unlabelled where it is null. Of several labels of one id
    the worst counts. Pages without a host share one reputation. Repeated rows count as often as they occur; columns
    of these four names that ``pages`` may have are replaced, and all rows stay.
    """
    key, bad, name = fresh(pages, "label_key"), fresh(pages, "label_bad"), fresh(pages, "judged_host")
    marks = (
        labels.filter(F.col(label_id).isNotNull() & F.col(quality).isNotNull())
        .groupBy(F.col(label_id).alias(key))
        .agg(F.max(F.when(F.col(quality) == 0, 1).otherwise(0)).alias(bad))
    )
    outcomes = (
        pages.select(F.col(page_id).alias(key), url_host(F.col(url)).alias("host"))
        .join(marks, key, "left")
        .select("host", F.col(bad).alias("bad"))
    )
    judged = host_reputation(outcomes, most_bad, z).select(F.col("host").alias(name), "blocked").filter("blocked")
    host, path = url_host(F.col(url)), url_path(F.col(url))
    ruled, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    keep = pages.withColumn("host", host).withColumn("path", path)
    flag = fresh(keep, "bad_host")
    out = keep.join(judged.withColumnRenamed("blocked", flag), F.col("host") == F.col(name), "left")
    by_host = F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*rest, "host", "path", ruled.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"))
