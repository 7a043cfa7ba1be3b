"""Request logs: error rates, latencies, alerts, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Exact paths, then prefixes in this order: (limit, window seconds, burst); else DEFAULT_TIER.
TIERS = {
    "/qa": (10, 60, 3), "/qa/stream": (10, 60, 3), "/qa/presets": (15, 60, 5), "/qa/crm/presets": (15, 60, 5), "/documents/upload": (20, 60, 5),
    "/documents": (30, 60, 8), "/wiki": (30, 60, 8), "/memory": (30, 60, 8), "/crm": (30, 60, 8), "/connectors": (20, 60, 5), "/search": (60, 60, 15),
    "/pipeline/status": (120, 60, 20),
}
PREFIX_TIERS = (
    ("/qa", 10, 60, 3), ("/documents", 30, 60, 8), ("/wiki", 30, 60, 8), ("/memory", 30, 60, 8), ("/crm", 30, 60, 8), ("/connectors", 20, 60, 5),
    ("/search", 60, 60, 15), ("/monitoring", 120, 60, 20),
)
DEFAULT_TIER = (60, 60, 0)
SKIP = ("/metrics", "/health", "/health/live", "/health/ready")
SKIP_PREFIXES = ("/docs", "/openapi", "/redoc")
# Upper bounds of a latency histogram's buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def tier(path: Column) -> Column:
    """``{skipped, limit, window, burst}`` of a path."""
    value = lambda t: F.struct(F.lit(False).alias("skipped"), *(F.lit(x).alias(n) for x, n in zip(t, ("limit", "window", "burst"))))
    skipped = path.isin(*SKIP)
    for p in SKIP_PREFIXES:
        skipped = skipped | path.startswith(p)
    out = F.when(skipped, F.struct(F.lit(True).alias("skipped"), F.lit(0).alias("limit"), F.lit(0).alias("window"), F.lit(0).alias("burst")))
    for p, t in TIERS.items():
        out = out.when(path == p, value(t))
    for p, *t in PREFIX_TIERS:
        out = out.when(path.startswith(p), value(t))
    return out.otherwise(value(DEFAULT_TIER))


def error_rates(log: DataFrame) -> DataFrame:
    """Requests and errors by endpoint and, in the row without one, overall: one pass with grouping sets."""
    between = lambda a, b: F.count_if((F.col("status") >= a) & (F.col("status") < b))
    client, server = between(400, 500), between(500, 600)
    return (
        log.withColumnRenamed("path", "endpoint")
        .rollup("endpoint")
        .agg(F.count("*").alias("total_requests"), client.alias("client_errors_4xx"), server.alias("server_errors_5xx"), F.round((client + server) / F.count("*") * 100, 2).alias("error_rate_percent"))
    )


def latency_percentiles(log: DataFrame) -> DataFrame:
    """Interpolated p50, p95, p99, minimum, maximum and mean by endpoint. Exact percentiles keep a count of each
    distinct value; for logs of billions of distinct values use ``histogram_quantile``."""
    p = F.percentile("latency", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    each = log.groupBy("path").agg(p.alias("p"), F.min("latency").alias("min"), F.max("latency").alias("max"), F.round(F.avg("latency"), 4).alias("mean"))
    return each.select("path", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p50", "p95", "p99"))), "min", "max", "mean")


def histogram_quantile(log: DataFrame, q: float, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Quantile of latency by endpoint from cumulative bucket counts, linear within the bucket; beyond the last bound
    it is that bound. Counts only: any volume."""
    bound = F.lit(None).cast("double")
    for b in reversed(buckets):
        bound = F.when(F.col("latency") <= b, b).otherwise(bound)
    counts = log.groupBy("path", F.coalesce(bound, F.lit(float("inf"))).alias("le")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("path").orderBy("le")
    all_ = Window.partitionBy("path")
    cum = counts.withColumn("cum", F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.sum("n").over(all_) * q)
    prev = [F.coalesce(F.lag("cum").over(up), F.lit(0)), *[F.lit(0.0)]]
    lower = F.lit(0.0)
    for a, b in zip(buckets, [*buckets[1:], float("inf")]):
        lower = F.when(F.col("le") == b, a).otherwise(lower)
    cum = cum.withColumn("below", prev[0]).withColumn("lower", lower)
    hit = cum.where((F.col("cum") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    value = F.when(F.col("le") == float("inf"), F.lit(buckets[-1])).otherwise(F.col("lower") + (F.col("le") - F.col("lower")) * (F.col("rank") - F.col("below")) / F.col("n"))
    return hit.select("path", F.round(value, 6).alias("value"))


def windowed_error_ratio(log: DataFrame, width: str = "5 minutes", slide: str = "1 minute", least: float = 0.05) -> DataFrame:
    """Share of 5xx in each sliding window, where it is above ``least``."""
    return status_alerts(log, 500, 600, width, slide, least)


def status_alerts(log: DataFrame, low: int, high: int, width: str, slide: str, least: float, by: tuple[str, ...] = (), hold: int = 1) -> DataFrame:
    """``start`` of each sliding window, for each ``by``, in which more than the share ``least`` of the requests have a
    status from ``low`` to below ``high``, and in the ``hold`` - 1 windows before it too. With ``total``, ``errors``."""
    w = log.groupBy(F.window(F.col("ts").cast("timestamp"), width, slide).alias("w"), *by).agg(F.count("*").alias("total"), F.count_if((F.col("status") >= low) & (F.col("status") < high)).alias("errors"))
    hit = w.where(F.col("errors") > least * F.col("total")).select(*by, F.col("w.start").alias("start"), "total", "errors")
    if hold > 1:
        # Windows in a row: the hold-th one back is as many slides earlier.
        before = F.lag("start", hold - 1).over(Window.partitionBy(*by).orderBy("start"))
        step = F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {slide}"))
        hit = hit.withColumn("_before", before).where(F.unix_seconds("start") - F.unix_seconds("_before") == step * (hold - 1)).drop("_before")
    return hit


def active_buckets(log: DataFrame) -> DataFrame:
    return log.agg(F.count_distinct("ip", "path").alias("active"))
