"""Exclusion rules of sites over tables of urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGENT = "lodestone-ingestion"
_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"


def origin(url: Column) -> Column:
    """Scheme, host and port in small letters; empty without a scheme."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _ORIGIN, 1))


def path(url: Column) -> Column:
    """The path without the parameters of its last part; ``/`` where there is none."""
    p = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), _ORIGIN + r"([^?#]*)", 2), r";[^/]*$", "")
    return F.when(p == "", "/").otherwise(p)


def rules(robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """``origin, rule``: the path prefixes that ``agent`` must not read, from ``robots`` (origin, content).

    A Disallow line belongs to the User-agent line last before it. Those of the agent count, or, where it has none, those
    of ``*``; empty ones forbid nothing. An origin that occurs again adds its rules. Lines by built-in functions.
    """
    files = robots.where("content IS NOT NULL").select(F.lower("origin").alias("origin"), F.xxhash64("content").alias("_file"), "content").dropDuplicates(["origin", "_file"])
    lines = files.select("origin", "_file", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("_at", "_line")).withColumn("_line", F.trim("_line"))
    field = lambda name: F.when(F.col("_line").rlike(f"(?i)^{name}:"), F.trim(F.regexp_extract("_line", f"(?i)^{name}:\\s*(.*)", 1)))
    lines = lines.select("origin", "_file", "_at", field("User-agent").alias("_agent"), field("Disallow").alias("rule")).where("_agent IS NOT NULL OR rule <> ''")
    above = Window.partitionBy("origin", "_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_who", F.last("_agent", ignorenulls=True).over(above)).where("rule <> ''")
    found = lines.where((F.col("_who") == "*") | (F.lower("_who") == agent.lower())).select("origin", "rule", (F.col("_who") != "*").alias("_own")).distinct()
    return found.withColumn("_any", F.max("_own").over(Window.partitionBy("origin"))).where("_own = _any").select("origin", "rule")


def judge(pages: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """``pages`` with ``robots_allowed`` and ``robots_rule``, the longest prefix that forbids the page.

    Null where the origin has no file (no row, or a null content). No page meets the rules of its site one by one: each
    path is cut to the lengths that the rules of its origin have, and the cuts are looked up. Needs a ``url``; a page's
    other columns pass, those named as the two new ones are replaced.
    """
    pages = pages.drop("robots_allowed", "robots_rule")
    found = rules(robots, agent)
    known = robots.groupBy(F.lower("origin").alias("_origin")).agg(F.count("content").alias("_files")).where("_files > 0")
    lengths = found.groupBy(F.col("origin").alias("_origin")).agg(F.sort_array(F.collect_set(F.length("rule"))).alias("_lengths"))
    sites = known.join(lengths, "_origin", "left").select("_origin", F.coalesce("_lengths", F.array().cast("array<int>")).alias("_lengths"))
    rows = pages.withColumn("_origin", origin(F.col("url"))).withColumn("_path", path(F.col("url")))
    paths = rows.select("_origin", "_path").distinct().join(sites, "_origin")
    fits = F.filter("_lengths", lambda n: n <= F.length("_path"))
    cuts = paths.select("_origin", "_path", F.explode_outer(fits).alias("_n")).withColumn("_cut", F.substring(F.col("_path"), F.lit(1), F.col("_n")))
    hits = cuts.join(found.select(F.col("origin").alias("_origin"), F.col("rule").alias("_cut"), F.lit(True).alias("_hit")), ["_origin", "_cut"], "left")
    verdict = hits.groupBy("_origin", "_path").agg(F.max_by("_cut", F.when(F.col("_hit"), F.col("_n"))).alias("robots_rule"), F.count("_hit").alias("_hits"))
    verdict = verdict.select("_origin", "_path", (F.col("_hits") == 0).alias("robots_allowed"), F.when(F.col("_hits") > 0, F.col("robots_rule")).alias("robots_rule"))
    return rows.join(verdict, ["_origin", "_path"], "left").select(*pages.columns, "robots_allowed", "robots_rule")
