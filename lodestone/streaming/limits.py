"""Streaming twins: the sliding-window rate limiter, windowed rates, the message ring buffer, periodic upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(times: list[float], kept: list[float], limit: int, window: float) -> tuple[list[bool], list[int], list[float]]:
    """Decisions for requests at ``times`` (ascending) given the admitted ones in ``kept``: a request is refused when
    ``limit`` are within ``window`` before it, and a refused request isn't counted. Also seconds to wait."""
    allowed, wait = [], []
    for t in times:
        kept = [k for k in kept if k > t - window]
        ok = len(kept) < limit
        allowed.append(ok)
        wait.append(0 if ok else max(1, int(kept[0] + window - t)))
        if ok:
            kept = [*kept, t]
    return allowed, wait, kept


_OUT = "ip string, path string, request_id bigint, at double, allowed boolean, retry_after int"


def rate_limit(log: DataFrame, limit: int = 10, window: float = 60.0, burst: int = 3) -> DataFrame:
    """Batch form: ``log`` (ip, path, request_id, at) with ``allowed`` and ``retry_after``.

    Sorted by key and time, the rows stream through; one key's state is at most ``limit + burst`` times, so a key
    with most of the rows needs no memory, though its decisions are sequential by nature.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, []
        for b in batches:
            allowed: list[bool] = []
            wait: list[int] = []
            for k, at in zip(zip(b["ip"], b["path"]), b["at"]):
                if k != key:
                    key, kept = k, []
                a, w, kept = admit([at], kept, limit + burst, window)
                allowed += a
                wait += w
            yield b.assign(allowed=allowed, retry_after=wait)

    rows = log.select("ip", "path", "request_id", "at").repartition("ip", "path").sortWithinPartitions("ip", "path", "at", "request_id")
    return rows.mapInPandas(run, _OUT)


def rate_limit_stream(log: DataFrame, limit: int = 10, window: float = 60.0, burst: int = 3, late: str = "1 minute") -> DataFrame:
    """The same over a stream; state is the admitted times of each key and goes when the watermark, ``late`` behind
    the newest request, is a window past the last of them. Time is that of the requests, so a replay decides alike
    at any speed; requests that come later than ``late`` are dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])
        kept = list(state.get[0]) if state.exists else []
        allowed, wait, kept = admit(rows["at"].tolist(), kept, limit + burst, window)
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((rows["at"].iloc[-1] + window) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield rows[["ip", "path", "request_id", "at"]].assign(allowed=allowed, retry_after=wait)

    # The time that counts is when a request leaves the window, so that even one at the epoch is after the first watermark.
    timed = log.withColumn("_leaves", F.timestamp_micros(((F.col("at") + window) * 1e6).cast("long"))).withWatermark("_leaves", late)
    return timed.groupBy("ip", "path").applyInPandasWithState(run, _OUT, "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Requests and server errors by event-time window; rows later than ``late`` are dropped, windows come when closed."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("status") >= 500).alias("errors")).select(F.col("w.start").alias("start"), "total", "errors")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: activity sessions of each ip."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "ip").agg(F.count("*").alias("n")).select("ip", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def recent_messages_stream(messages: DataFrame, keep: int = 10) -> DataFrame:
    """The ``keep`` newest messages of each session after every batch, from a ring buffer in state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = [tuple(x) for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches))
        new = sorted({*old, *zip(rows["turn"].tolist(), rows["role"], rows["content"])})[-keep:]
        state.update((new,))
        yield pd.DataFrame([(key[0], *x) for x in new], columns=["session_id", "turn", "role", "content"])

    schema = "session_id bigint, turn bigint, role string, content string"
    return messages.groupBy("session_id").applyInPandasWithState(run, schema, "m array<struct<turn:bigint,role:string,content:string>>", "update", GroupStateTimeout.NoTimeout)


def sync_stream(landing: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 minute"):
    """Apply ``upsert`` to each micro-batch that lands; it must be idempotent, since a batch can come twice."""
    return landing.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
