"""Display formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_time(ts: Column, now: Column) -> Column:
    """``just now``, minutes, hours or days before ``now``, which is passed in."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    s = F.floor(micros / 1_000_000.0)
    ago = lambda unit, letter: F.concat(F.floor(s / unit).cast("string"), F.lit(f"{letter} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


def human_size(n: Column) -> Column:
    return F.when(n < 1 << 20, F.format_string("%.1f KB", F.round(n / 1024.0, 1))).otherwise(F.format_string("%.1f MB", F.round(n / 1048576.0, 1)))


def relevance_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def page_count(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(size))).cast("long")
