"""Host reputation by empirical Bayes.

Labelled page outcomes (bad or not) are counted per host, registered domain and
suffix. Each level is shrunk to the one above by a beta-binomial prior whose strength
is estimated from the spread of the rates at that level (method of moments):
all -> suffix -> registered domain -> host. A host is blocked where the lower
posterior bound of its bad rate (mean - Z standard deviations) exceeds LIMIT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LIMIT = 0.5
Z = 1.645
STRENGTH = (2.0, 1000.0)    # bounds of a prior's strength, in pseudo-outcomes
# The named allow and block rules, as (rule, verdict).
RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
# Suffixes of two labels; any other suffix is the last label.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.mx", "gov.uk", "org.uk")

_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. Both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, _ASCII_UPPER, _ASCII_LOWER), path


def suffix_of(host: Column) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*LONG_SUFFIXES), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(last_two)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent domain and starts the path, and
    its verdict; NULL if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = text.partition("/")
        fits = (host == domain) | F.endswith(host, F.lit("." + domain))
        if slash + rest not in ("", "/"):
            fits = fits & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _prior(rates: DataFrame, parent: str) -> DataFrame:
    """Strength of the prior for the children below each value of ``parent``, from
    columns n, bad: moments of the beta-binomial over the children's rates."""
    n, bad = F.col("n"), F.col("bad")
    sums = rates.groupBy(parent).agg(F.sum(n).alias("pn"), F.sum(bad).alias("pbad"), F.count(F.lit(1)).alias("k"),
                                     F.sum(n * n).alias("nn"), F.sum(bad * bad / n).alias("bb"))
    mean = F.col("pbad") / F.col("pn")
    noise = mean * (1 - mean)
    # Weighted variance of the rates, less what sampling alone gives.
    spread = F.col("bb") - F.col("pn") * mean * mean
    room = F.col("pn") - F.col("nn") / F.col("pn")
    between = F.when(room > 0, (spread - (F.col("k") - 1) * noise) / room)
    strength = F.when(between > 0, noise / between - 1).otherwise(F.lit(STRENGTH[1]))
    strength = F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.coalesce(strength, F.lit(STRENGTH[1]))))
    return sums.select(parent, "pn", "pbad", strength.alias("strength"))


def host_reputation(hosts: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """host, posterior (mean bad rate), bound and method verdict of each host, from one
    row per host with its n labelled and bad outcomes. Hosts without outcomes rest on
    the levels above."""
    levels = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    domains = levels.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = suffixes.where("n > 0").withColumn("all", F.lit(0))
    # One row: the rate of all outcomes and the strength for suffixes; 0.5 without any.
    top = _prior(every, "all").first()
    rate, strength = (top["pbad"] / top["pn"], top["strength"]) if top else (0.5, STRENGTH[0])
    suffix_rate = (F.col("bad") + strength * rate) / (F.col("n") + strength)
    suffixes = suffixes.select("suffix", suffix_rate.alias("suffix_rate"))
    weak = F.lit(STRENGTH[1])
    domains = (
        domains.join(suffixes, "suffix").join(_prior(domains.where("n > 0"), "suffix").select("suffix", "strength"), "suffix", "left")
        .withColumn("strength", F.coalesce("strength", weak))
        .select("domain", ((F.col("bad") + F.col("strength") * F.col("suffix_rate")) / (F.col("n") + F.col("strength"))).alias("domain_rate"))
    )
    below = _prior(levels.where("n > 0"), "domain").select("domain", "strength")
    alpha = F.col("bad") + F.col("strength") * F.col("domain_rate")
    total = F.col("n") + F.col("strength")
    mean = alpha / total
    scored = (
        levels.join(domains, "domain").join(below, "domain", "left").withColumn("strength", F.coalesce("strength", weak))
        .select("host", mean.alias("posterior"), F.sqrt(mean * (1 - mean) / (total + 1)).alias("sd"))
    )
    bound = F.greatest(F.lit(0.0), F.col("posterior") - z * F.col("sd"))
    return scored.select("host", F.round("posterior", 9).alias("posterior"), F.round(bound, 9).alias("bound"),
                         F.when(bound > limit, "block").otherwise("allow").alias("method_verdict"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, posterior and bound of each row of ``pages``
    (page_id, url). ``outcomes`` has page_id and bad (boolean), any number per page.

    Outcomes are counted per page before they meet the pages, and per host before the
    shuffle by host, so a host with a third of all pages is no hot key there; the join
    back is one Spark can split. NULL url or one without ``://``: empty host and path;
    such pages share one reputation. NULL bad: not an outcome. NULL page_id meets no
    outcome. Repeated pages are judged each, and their outcomes count each time.
    No pages, no rows; without outcomes all follow the weakest prior. Urls are read whole.
    Other columns are ignored.
    """
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    counted = (
        outcomes.where("bad IS NOT NULL").groupBy("page_id")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
    )
    hosts = (
        rows.select("page_id", "host").join(counted, "page_id", "left").groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    )
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return (
        rows.join(host_reputation(hosts, limit, z), "host")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("method_verdict")).alias("verdict"), "posterior", "bound")
    )
