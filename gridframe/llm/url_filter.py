"""URL filters: rules, and the reputation of hosts by empirical Bayes.

A rule is an action and a host with a path; it fits the host and all its
subdomains where the url's path starts with the rule's; the longest rule wins.
Pages no rule decides are judged by their host.  Each level, host, registered
domain and public suffix, is a beta-binomial whose prior mean is the posterior
mean of the level above and whose strength is fitted by moments (at least
``LEAST_STRENGTH`` pages).  Suffix and domain give the base rate: known bad pages
among all their pages.  A host itself is judged by its labelled pages alone, as
a page without an outcome says nothing of it.  It is blocked if the lower bound of its
posterior rate of bad pages is at least ``BLOCK_AT``: some labelled pages, nearly all
of them bad, against the base rate around it.

Only DataFrame operations run.  Null urls and urls without ``://`` have an
empty host and path; they are a host like others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import materialise

Z = 1.645          # one-sided 95 % bound
BLOCK_AT = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 4.0, 1000.0
# fixed values: public suffixes of two labels
TWO_LABEL_SUFFIXES = ["ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.au", "org.uk"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    return F.when(F.substring_index(host, ".", -2).isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _rule_column(rules: list[tuple[str, str]], host: Column, path: Column, value) -> Column:
    """``value(action, rule)`` of the longest rule that fits, else null."""
    chosen = None
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        chosen = F.when(fits, value(action, rule)) if chosen is None else chosen.when(fits, value(action, rule))
    return F.lit(None).cast("string") if chosen is None else chosen


def _shrunk(level: DataFrame, above: DataFrame, up: str) -> DataFrame:
    """Posterior mean of each row of ``level`` (pages, bad) under the beta prior
    that the row of ``above`` (mean) is the centre of.

    The prior's strength m is fitted by moments over the level: the excess of
    the squared deviations over binomial noise, for rates of variance p(1-p)/(m+1)."""
    rows = level.join(above.select(up, F.col("mean").alias("prior")), up)
    noise = F.col("prior") * (1 - F.col("prior"))
    square = F.pow(F.col("bad") - F.col("pages") * F.col("prior"), 2)
    got, binomial, spread = rows.agg(
        F.sum(square), F.sum(F.col("pages") * noise), F.sum(F.col("pages") * (F.col("pages") - 1) * noise)).first()
    # E[square] = n p(1-p) + n(n-1) p(1-p) rho, rho = 1 / (m + 1)
    rho = (got - binomial) / spread if spread else 0.0
    m = min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / rho - 1)) if rho > 0 else MOST_STRENGTH
    return rows.withColumns({
        "a": F.col("bad") + m * F.col("prior"), "b": F.col("pages") - F.col("bad") + m * (1 - F.col("prior"))
    }).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def host_reputation(pages: DataFrame) -> DataFrame:
    """``pages``: host, and bad (1, 0, or null: no outcome).  Per host: pages
    with an outcome, bad ones, posterior mean, its lower bound."""
    hosts = (pages.groupBy("host").agg(F.count("bad").cast("double").alias("pages"), F.count("*").cast("double").alias("every"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
             .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    hosts = materialise(hosts, "hosts")
    sums = [F.sum("pages").alias("pages"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("every").alias("pages"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("all", F.lit(1))
    whole = suffixes.groupBy("all").agg(*sums).select("all", ((F.col("bad") + 0.5) / (F.col("pages") + 1)).alias("mean"))
    by_suffix = _shrunk(suffixes, whole, "all")
    by_domain = _shrunk(domains, by_suffix, "suffix")
    by_host = _shrunk(hosts.drop("suffix", "every"), by_domain, "domain")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1))
    return by_host.select("host", "pages", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - Z * deviation).alias("lower"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
          outcome_col: str | None = None) -> DataFrame:
    """Per row: id, host, path, rule, verdict and the host's reputation.

    Labelled outcomes are the column ``outcome_col`` (1 bad, 0 good, null) or,
    without one, what the rules say of the page: 1 blocked, 0 allowed, and null
    where none fits, so that undecided pages neither speak for their host nor
    against it.  ``rules`` is a short fixed list.  Repeated rows each get a
    verdict and count as often; an empty table gives no row; other columns may have any names."""
    outcome = F.col(outcome_col).cast("int") if outcome_col else F.lit(None).cast("int")
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
                        outcome.alias("outcome"))
    rows = rows.withColumns({
        "rule": _rule_column(rules, F.col("host"), F.col("path"), lambda action, rule: F.lit(rule)),
        "action": _rule_column(rules, F.col("host"), F.col("path"), lambda action, rule: F.lit(action))})
    bad = F.col("outcome") if outcome_col else F.when(F.col("action").isNotNull(), (F.col("action") == "block").cast("int"))
    known = host_reputation(rows.select("host", bad.alias("bad")))
    return (rows.join(known, "host")
            .select(F.col("id").alias(id_col), "host", "path", "rule",
                    F.coalesce("action", F.when(F.col("lower") >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"),
                    F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_rate_lower")))
