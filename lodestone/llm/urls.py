"""URL filter by empirical-Bayes host reputation.

Labelled pages give each host a number of outcomes and of bad ones. A beta-binomial prior passes from the whole
table to the public suffix, from there to the registered domain, and from there to the host: each level's
posterior mean is the centre of the next level's prior, and the prior's strength at a level is estimated by
moments from how much the groups of that level differ beyond binomial noise. A host is blocked if the lower
bound of its posterior bad rate is above ``MAX_BAD``. Explicit rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of the contract: (rule, verdict); a rule is host/path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Public suffixes of two labels that are looked for; all others have one label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "ne.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx")
MAX_BAD = 0.3
Z = 1.645
MIN_STRENGTH, MAX_STRENGTH = 2.0, 200.0


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is ``host`` or a parent domain of it and whose path starts ``path``, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        of, _, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def public_suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    """The public suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _shrunk(groups: DataFrame, level: str, prior: str) -> DataFrame:
    """``groups`` (n, k, ``prior`` mean) with ``level``_a and ``level``_b, the posterior's parameters, and its mean.

    Strength by moments: with p the pooled rate, S = sum n (k/n - p)^2 and M = sum n over G groups, the groups'
    correlation is rho = (S - (G-1) p (1-p)) / ((M - sum n^2 / M - (G-1)) p (1-p)), the strength 1/rho - 1.
    """
    used = F.when(F.col("n") > 0, F.col("n"))
    sums = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("M"),
        F.coalesce(F.sum("k"), F.lit(0)).cast("double").alias("K"),
        F.count(used).cast("double").alias("G"),
        F.coalesce(F.sum(F.col("k") * F.col("k") / used), F.lit(0.0)).alias("Q"),
        F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("double").alias("N2"),
    )
    p = F.col("K") / F.nullif(F.col("M"), F.lit(0.0))
    spread = F.col("Q") - F.col("K") * p
    noise = (F.col("G") - 1) * p * (1 - p)
    room = (F.col("M") - F.col("N2") / F.nullif(F.col("M"), F.lit(0.0)) - (F.col("G") - 1)) * p * (1 - p)
    rho = (spread - noise) / F.when(room > 0, room)
    strength = F.when(rho > 0, F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), 1 / rho - 1))).otherwise(F.lit(MAX_STRENGTH))
    one = sums.select(F.round(strength, 6).alias("_strength"))
    out = groups.crossJoin(F.broadcast(one))  # one row
    a = F.col("_strength") * F.col(prior) + F.col("k")
    b = F.col("_strength") * (1 - F.col(prior)) + F.col("n") - F.col("k")
    out = out.withColumn(f"{level}_a", a).withColumn(f"{level}_b", b)
    return out.withColumn(f"{level}_rate", F.round(F.col(f"{level}_a") / (F.col(f"{level}_a") + F.col(f"{level}_b")), 9)).drop("_strength")


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """``host, n, k`` of all hosts (n labelled pages, k bad ones; both may be 0) -> also ``suffix, domain,
    suffix_rate, domain_rate, host_rate, bad_bound``. Sums only: a host with a third of all pages is summed
    on the map side. Everything here is one row a host or less."""
    hosts = outcomes.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("host")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(F.round((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0), 9).alias("rate"))
    suffixes = _shrunk(suffixes.crossJoin(F.broadcast(overall)), "suffix", "rate").select("suffix", "suffix_rate")
    domains = _shrunk(domains.join(suffixes, "suffix"), "domain", "suffix_rate").select("suffix", "domain", "suffix_rate", "domain_rate")
    out = _shrunk(hosts.join(domains, ["suffix", "domain"]), "host", "domain_rate")
    total = F.col("host_a") + F.col("host_b")
    spread = F.sqrt(F.col("host_a") * F.col("host_b") / (total * total * (total + 1)))
    bound = F.greatest(F.lit(0.0), F.round(F.col("host_a") / total - z * spread, 9))
    return out.withColumn("bad_bound", bound).drop("host_a", "host_b")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """``pages`` (page_id, url) with ``host, path, rule, verdict, n_labelled, n_bad, bad_rate, bad_bound``.

    ``labels`` (page_id, bad: boolean) are the outcomes; several labels of a page all count, labels of unknown
    pages and null ones don't. Null and malformed urls share the host ``''``. Repeated page rows each get a row;
    with no labels all hosts get the same prior and none is blocked by it. Other columns of ``pages`` are dropped.
    """
    seen = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    votes = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    per_host = (
        seen.join(votes, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    )
    reputation = host_reputation(per_host, z)
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.create_map(*[F.lit(x) for r in rules for x in r])
    return (
        seen.join(reputation, "host")
        .withColumn("rule", rule)
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce(F.element_at(verdict, F.coalesce(F.col("rule"), F.lit(""))), F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")).alias("verdict"),
            F.col("n").cast("long").alias("n_labelled"), F.col("k").cast("long").alias("n_bad"), F.col("host_rate").alias("bad_rate"), "bad_bound",
        )
    )


def op7_urls(spark, sf_dir: str) -> DataFrame:
    """Every url of ``pages``; an outcome is the quality label with the page's number, 0 being bad."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return filter_urls(pages, labels)


def _sql_level(level: str, source: str, prior: str) -> str:
    return f"""
{level}_m AS (SELECT coalesce(sum(n), 0)::DOUBLE AS M, coalesce(sum(k), 0)::DOUBLE AS K, count(CASE WHEN n > 0 THEN 1 END)::DOUBLE AS G,
  coalesce(sum(CASE WHEN n > 0 THEN (k * k)::DOUBLE / n END), 0) AS Q, coalesce(sum(n * n), 0)::DOUBLE AS N2 FROM {source}),
{level}_r AS (SELECT *, K / nullif(M, 0) AS p FROM {level}_m),
{level}_o AS (SELECT (Q - K * p - (G - 1) * p * (1 - p)) / CASE WHEN (M - N2 / nullif(M, 0) - (G - 1)) * p * (1 - p) > 0
  THEN (M - N2 / nullif(M, 0) - (G - 1)) * p * (1 - p) END AS rho FROM {level}_r),
{level}_s AS (SELECT round(CASE WHEN rho > 0 THEN greatest({MIN_STRENGTH}, least({MAX_STRENGTH}, 1 / rho - 1)) ELSE {MAX_STRENGTH} END, 6) AS st FROM {level}_o),
{level}_p AS (SELECT *, round(a / (a + b), 9) AS {level}_rate FROM (SELECT s.*, st * {prior} + k AS a, st * (1 - {prior}) + n - k AS b FROM {source} s, {level}_s))"""


_LISTED = ", ".join(f"'{s}'" for s in SUFFIXES)
ORACLE = f"""
WITH seen0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*', 0)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM seen0),
votes AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS k FROM labels
  WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
hosts0 AS (SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(k), 0)::BIGINT AS k FROM seen LEFT JOIN votes USING (page_id) GROUP BY 1),
hosts1 AS (SELECT *, string_split(host, '.') AS parts FROM hosts0),
hosts2 AS (SELECT host, n, k, parts, array_to_string(parts[-2:], '.') IN ({_LISTED}) AS two FROM hosts1),
hosts AS (SELECT host, n, k, array_to_string(CASE WHEN two THEN parts[-3:] ELSE parts[-2:] END, '.') AS domain,
  array_to_string(CASE WHEN two THEN parts[-2:] ELSE parts[-1:] END, '.') AS suffix FROM hosts2),
domains AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY ALL),
suffixes0 AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY ALL),
overall AS (SELECT round((coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0), 9) AS rate FROM suffixes0),
suffixes AS (SELECT * FROM suffixes0, overall),
{_sql_level("suffix", "suffixes", "rate")},
domains1 AS (SELECT d.*, suffix_rate FROM domains d JOIN suffix_p USING (suffix)),
{_sql_level("domain", "domains1", "suffix_rate")},
hosts3 AS (SELECT h.*, domain_rate FROM hosts h JOIN (SELECT suffix, domain, domain_rate FROM domain_p) USING (suffix, domain)),
{_sql_level("host", "hosts3", "domain_rate")},
judged AS (SELECT host, n, k, host_rate, greatest(0.0, round(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9)) AS bad_bound FROM host_p),
ruled AS (SELECT page_id, host, path,
  CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
       WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM seen)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad_bound > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict,
  n AS n_labelled, k AS n_bad, host_rate AS bad_rate, bad_bound
FROM ruled JOIN judged USING (host)
"""
