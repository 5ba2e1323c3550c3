"""URL filters: path rules first, then an empirical-Bayes host reputation.

A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest
fitting rule decides.  The pages that rules decide are labelled outcomes.  They feed a beta-binomial
hierarchy: the rate of good pages of a suffix shrinks towards the overall rate, that of a registered
domain towards its suffix, that of a host towards its domain; how strongly is estimated at each
level from the data by moments.  A page without a rule is blocked if even the upper bound of its
host's posterior rate stays below one half.

Defined results: a null url or one without ``://`` has empty host and path, belongs to the empty
host and is allowed unless that host is blocked; repeated rows are judged alike; an empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, small, table

#: (rule, verdict) of the registered query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Domains are registered under one of these labels and a country's two letters, or else under the last label.
TWO_LABEL_SUFFIX = r"^(ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org)\.[a-z][a-z]$"
#: Standard deviations from the posterior mean to its upper bound.
Z = 1.645
#: A host is bad if its rate of good pages is surely below this.
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(pages: DataFrame) -> DataFrame:
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return pages.withColumn("rest", rest).select(
        "*",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), _UPPER, _LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    ).drop("rest")


def rule_columns(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits. ``rules`` is a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones override
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def with_domain(hosts: DataFrame) -> DataFrame:
    """Adds suffix and registered domain: the suffix and one label more."""
    two = F.substring_index("host", ".", -2)
    long = two.rlike(TWO_LABEL_SUFFIX)
    return hosts.withColumn("suffix", F.when(long, two).otherwise(F.substring_index("host", ".", -1))).withColumn("domain", F.when(long, F.substring_index("host", ".", -3)).otherwise(two))


def _strength(units: DataFrame, good: str, n: str, parent: str) -> float:
    """The prior's weight in pages, from the spread of the units' rates about their parents'.

    Beta-binomial moments: sum (good - n m)^2 / (n m (1 - m)) is U + rho (N - U) in expectation.
    """
    m = F.col(parent)
    dev = F.col(good) - F.col(n) * m
    sums = units.filter(F.col(n) > 0).agg(F.sum(dev * dev / (F.col(n) * m * (F.lit(1.0) - m))).alias("s"), F.count(F.lit(1)).alias("u"), F.sum(n).alias("t"))
    rho = F.when(F.col("t") > F.col("u"), (F.col("s") - F.col("u")) / (F.col("t") - F.col("u"))).otherwise(F.lit(0.5))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(0.02)), F.lit(0.98))
    return sums.select(F.lit(1.0) / rho - 1.0).first()[0]


def host_reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """hosts: host, good, n (labelled pages; may be 0). Adds mean and upper of the posterior rate.

    One row per host goes through the levels; each level is a partial aggregation and a join on the
    level's key, written, as the next level reads it twice.  The strengths and the overall rate are numbers.
    """
    hosts = with_domain(hosts)
    first = domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("good").alias("dg"), F.sum("n").alias("dn")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("dg").alias("sg"), F.sum("dn").alias("sn")), "suffixes")
    m0 = F.lit(suffixes.select((F.coalesce(F.sum("sg"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("sn"), F.lit(0)) + 2.0)).first()[0])
    ks = F.lit(_strength(suffixes.withColumn("m0", m0), "sg", "sn", "m0"))
    rates = small(materialize(suffixes.select("suffix", ((F.col("sg") + ks * m0) / (F.col("sn") + ks)).alias("ms")), "suffix-rates"))
    domains = materialize(domains.join(rates, "suffix"), "domains-suffixes")
    kd = F.lit(_strength(domains, "dg", "dn", "ms"))
    rates = small(materialize(domains.select("domain", ((F.col("dg") + kd * F.col("ms")) / (F.col("dn") + kd)).alias("md")), "domain-rates"))
    hosts = materialize(hosts.join(rates, "domain"), "hosts-domains")
    forget(first, suffixes, domains)
    kh = F.lit(_strength(hosts, "good", "n", "md"))
    a, k = F.col("good") + kh * F.col("md"), F.col("n") + kh
    mean = a / k
    return hosts.withColumn("mean", mean).withColumn("upper", F.col("mean") + F.lit(z) * F.sqrt(F.col("mean") * (F.lit(1.0) - F.col("mean")) / (k + 1.0)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation (the posterior mean) per page."""
    rule, verdict = rule_columns(rules)
    rows = with_host_path(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("ruled", verdict)
    hosts = materialize(rows.groupBy("host").agg(F.sum((F.col("ruled") == "allow").cast("long")).alias("good"), F.count("ruled").alias("n")).withColumn("good", F.coalesce("good", F.lit(0))), "hosts")
    said = host_reputation(hosts, z).select("host", F.when(F.col("upper") < threshold, "block").otherwise("allow").alias("method"), F.round("mean", 6).alias("reputation"))
    said = small(materialize(said, "reputation"))
    forget(hosts)
    return rows.join(said, "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict"), "reputation")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _strength_sql(source: str, good: str, n: str, m: str) -> str:
    return (
        f"(SELECT 1.0::DOUBLE / least(greatest(coalesce(CASE WHEN t > u THEN (s - u) / (t - u) ELSE 0.5 END, 0.5), 0.02::DOUBLE), 0.98::DOUBLE) - 1.0::DOUBLE AS k FROM "
        f"(SELECT sum(({good} - {n} * {m}) * ({good} - {n} * {m}) / ({n} * {m} * (1.0::DOUBLE - {m}))) AS s, count(*)::DOUBLE AS u, sum({n})::DOUBLE AS t FROM {source} WHERE {n} > 0))"
    )


OP7_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(r, v) AS (VALUES {', '.join(f"('{r}', '{v}')" for r, v in RULES)}),
fits AS (
  SELECT s.host, s.path, arg_max(r, (length(r), r)) AS rule, arg_max(v, (length(r), r)) AS ruled
  FROM (SELECT DISTINCT host, path FROM split) s JOIN rules
    ON (s.host = split_part(r, '/', 1) OR ends_with(s.host, '.' || split_part(r, '/', 1)))
   AND starts_with(s.path, substr(r, strpos(r, '/')))
  GROUP BY ALL),
rows AS (SELECT s.*, rule, ruled FROM split s LEFT JOIN fits f ON s.host = f.host AND s.path = f.path),
h AS (
  SELECT host, count(*) FILTER (ruled = 'allow')::DOUBLE AS good, count(ruled)::DOUBLE AS n,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two FROM rows GROUP BY host),
hosts AS (
  SELECT *, CASE WHEN regexp_matches(two, '{TWO_LABEL_SUFFIX}') THEN two ELSE string_split(host, '.')[-1] END AS suffix,
         CASE WHEN regexp_matches(two, '{TWO_LABEL_SUFFIX}') THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE two END AS domain FROM h),
d AS (SELECT domain, suffix, sum(good) AS dg, sum(n) AS dn FROM hosts GROUP BY ALL),
s0 AS (SELECT suffix, sum(dg) AS sg, sum(dn) AS sn FROM d GROUP BY suffix),
s1 AS (SELECT *, (SELECT (coalesce(sum(sg), 0) + 1.0::DOUBLE) / (coalesce(sum(sn), 0) + 2.0::DOUBLE) FROM s0) AS m0 FROM s0),
s2 AS (SELECT suffix, (sg + k * m0) / (sn + k) AS ms FROM s1, {_strength_sql('s1', 'sg', 'sn', 'm0')}),
d1 AS (SELECT d.*, ms FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT domain, (dg + k * ms) / (dn + k) AS md FROM d1, {_strength_sql('d1', 'dg', 'dn', 'ms')}),
h1 AS (SELECT hosts.*, md FROM hosts JOIN d2 USING (domain)),
h2 AS (SELECT host, (good + k * md) / (n + k) AS mean, n + k AS w FROM h1, {_strength_sql('h1', 'good', 'n', 'md')}),
said AS (
  SELECT host, mean, CASE WHEN mean + {Z}::DOUBLE * sqrt(mean * (1.0::DOUBLE - mean) / (w + 1.0::DOUBLE)) < {THRESHOLD} THEN 'block' ELSE 'allow' END AS method FROM h2)
SELECT page_id, host, path, rule, coalesce(ruled, method) AS verdict, round(mean, 6) AS reputation FROM rows JOIN said USING (host)
"""
