"""Counter samples to alerts that wait, fire and end: the batch form with windows, the stream with state and timers.

A sample is ``service, instance, status, at, value``: a counter that only grows, but starts over when its process does.
The series is ``service, instance, status``. A window of an evaluation at ``t`` covers the times from ``t`` - width to
before ``t``; evaluations come at whole minutes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SERIES = ("service", "instance", "status")
#: Seconds between evaluations.
STEP = 60
#: Samples of a series are compared within blocks of this many seconds, so that a long series is many tasks' work.
BLOCK = 3600


@dataclass(frozen=True)
class Rule:
    """Fires where statuses from ``low`` to below ``high`` are more than the share ``least`` of the requests of
    ``width`` seconds, at every evaluation for ``hold`` seconds."""

    alert: str
    low: int
    high: int
    width: int
    least: float
    hold: int


# The three ratios, their windows, thresholds and holds.
RULES = (
    Rule("High5xxRate", 500, 600, 300, 0.05, 120),
    Rule("Elevated4xxRate", 400, 500, 600, 0.25, 300),
    Rule("HighRateLimitHitRate", 429, 430, 300, 0.10, 180),
)


def _grown(before: Column, value: Column) -> Column:
    return F.when(value >= before, value - before).otherwise(value)


def increases(samples: DataFrame) -> DataFrame:
    """``service, instance, status, at, increase``: growth since the series' sample before; a smaller value means that
    the counter started over, and counts whole. A series' first sample only tells where it starts. Of samples of one
    time the largest counts; samples without time or value are left out; a missing part of the name is a name.

    Within blocks of an hour by window; between blocks by the first and last sample of each, a row a block.
    """
    s = samples.where("at IS NOT NULL AND value IS NOT NULL").select(*SERIES, "at", "value", F.floor(F.unix_seconds("at") / BLOCK).alias("_block"))
    inside = Window.partitionBy(*SERIES, "_block").orderBy("at", F.desc("value"))
    s = s.withColumn("_same", F.lag("at").over(inside) == F.col("at")).where("_same IS NULL OR NOT _same")
    within = s.withColumn("_before", F.lag("value").over(inside)).where("_before IS NOT NULL")
    ends = s.groupBy(*SERIES, "_block").agg(F.min_by(F.struct("at", "value"), "at").alias("first"), F.max_by("value", "at").alias("last"))
    ends = ends.withColumn("_before", F.lag("last").over(Window.partitionBy(*SERIES).orderBy("_block"))).where("_before IS NOT NULL")
    rows = within.select(*SERIES, "at", "value", "_before").unionByName(ends.select(*SERIES, "first.at", "first.value", "_before"))
    return rows.select(*SERIES, "at", _grown(F.col("_before"), F.col("value")).alias("increase"))


def _sums(rules: tuple[Rule, ...]) -> list[Column]:
    """All requests of a minute, and those that each rule counts."""
    hits = [F.sum(F.when((F.col("status") >= r.low) & (F.col("status") < r.high), F.col("increase")).otherwise(0)) for r in rules]
    return [F.sum("increase").alias("total"), F.array(*hits).alias("hits")]


def _by_rule(minutes: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    each = [F.struct(F.lit(r.alert).alias("alert"), F.lit(i).alias("rule"), F.col("hits")[i].alias("hits")) for i, r in enumerate(rules)]
    return minutes.withColumn("r", F.explode(F.array(*each))).select("r.alert", "r.rule", "service", "tick", "total", F.col("r.hits").alias("hits"))


def transitions(samples: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``alert, service, at (seconds), state, ratio``: ``pending`` when a rule's condition begins to hold, ``firing`` once
    it held for the rule's time, then ``resolved``, or ``inactive`` if it never fired, at the first evaluation where it
    no longer holds (without a ratio). A rule without hold fires at once.

    Samples are summed by service and minute before anything else; what follows grows with services and time only.
    """
    tick = ((F.floor(F.unix_seconds("at") / STEP) + 1) * STEP).alias("tick")
    minutes = increases(samples).groupBy("service", tick).agg(*_sums(rules))
    pick = lambda f: F.element_at(F.array(*(F.lit(f(r)) for r in rules)), F.col("rule") + 1)
    seen = F.sequence(F.col("tick"), F.col("tick") + pick(lambda r: r.width) - STEP, F.lit(STEP).cast("long"))
    at = _by_rule(minutes, rules).select("alert", "rule", "service", F.explode(seen).alias("at"), "total", "hits")
    at = at.groupBy("alert", "rule", "service", "at").agg(F.sum("total").alias("total"), F.sum("hits").alias("hits"))
    held = at.where(F.col("hits") > pick(lambda r: r.least) * F.col("total")).withColumn("ratio", F.col("hits") / F.col("total"))
    line = Window.partitionBy("alert", "service").orderBy("at")
    run = Window.partitionBy("alert", "service", "_run").orderBy("at")
    held = held.withColumn("_run", F.col("at") - STEP * F.row_number().over(line))
    held = held.withColumn("_for", (F.row_number().over(run) - 1) * STEP).withColumn("_last", F.lead("at").over(run).isNull())
    hold = pick(lambda r: r.hold)
    state = lambda when, at, name, ratio: F.when(when, F.struct(at.alias("at"), F.lit(name).alias("state"), ratio.alias("ratio")))
    none, after = F.lit(None).cast("double"), F.col("at") + STEP
    steps = F.array(
        state((F.col("_for") == 0) & (hold > 0), F.col("at"), "pending", F.col("ratio")),
        state(F.col("_for") == hold, F.col("at"), "firing", F.col("ratio")),
        state(F.col("_last") & (F.col("_for") >= hold), after, "resolved", none),
        state(F.col("_last") & (F.col("_for") < hold), after, "inactive", none),
    )
    return held.withColumn("s", F.explode(F.filter(steps, lambda x: x.isNotNull()))).select("alert", "service", "s.*")


class _Increases(StatefulProcessor):
    """A series' samples wait until the watermark passes them, then follow each other in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value bigint")
        self.waiting = handle.getListState("waiting", "at bigint, value bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(v)) for b in rows for a, v in zip(b["micros"], b["value"])]
        self.waiting.appendList(new)
        self.handle.registerTimer(-(-min(new)[0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], -r[1])) if self.waiting.exists() else []
        due, later = [r for r in waiting if r[0] <= passed], [r for r in waiting if r[0] > passed]
        before = self.last.get()[0] if self.last.exists() else None
        out, time = [], None
        for at, value in due:
            if at == time:
                continue
            if before is not None:
                out.append((at, value - before if value >= before else value))
            time, before = at, value
        if due:
            self.last.update((before,))
            if later:
                self.waiting.put([tuple(r) for r in later])
            else:
                self.waiting.clear()
        if later:
            self.handle.registerTimer(-(-later[0][0] // 1000))
        if out:
            at = pd.to_datetime([a for a, _ in out], unit="us")
            yield pd.DataFrame({"service": key[0], "instance": key[1], "status": key[2], "at": at, "increase": [v for _, v in out]})

    def close(self) -> None:
        pass


def evaluate(rule: Rule, kept: dict[int, tuple[int, int]], since: int | None, at: int) -> tuple[list[tuple], int | None]:
    """One evaluation: the transitions ``(at, state, ratio)`` and since when the condition holds. ``kept`` has a total and
    the hits of each minute; minutes that left the window are removed from it."""
    for t in [t for t in kept if t <= at - rule.width]:
        del kept[t]
    total, hits = sum(t for t, _ in kept.values()), sum(h for _, h in kept.values())
    if not hits > rule.least * total:
        return ([] if since is None else [(at, "resolved" if at - STEP - since >= rule.hold else "inactive", None)]), None
    out = [(at, "pending", hits / total)] if since is None and rule.hold else []
    since = at if since is None else since
    return (out + [(at, "firing", hits / total)] if at - since == rule.hold else out), since


class _Machine(StatefulProcessor):
    """The state of one alert of one service: the minutes of its window and since when its condition holds."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "ticks array<bigint>, totals array<bigint>, hits array<bigint>, since bigint, done bigint")

    def _load(self) -> tuple[dict, int | None, int | None]:
        if not self.state.exists():
            return {}, None, None
        ticks, totals, hits, since, done = self.state.get()
        return dict(zip(ticks, zip(totals, hits))), since, done

    def _save(self, kept: dict, since: int | None, done: int) -> None:
        if not kept and since is None:
            self.state.clear()
            return
        ticks = sorted(kept)
        self.state.update((ticks, [kept[t][0] for t in ticks], [kept[t][1] for t in ticks], since, done))
        self.handle.registerTimer((done + STEP) * 1000)

    def _until(self, rule: Rule, kept: dict, since: int | None, done: int | None, at: int) -> tuple[list[tuple], int | None, int | None]:
        """Evaluations after ``done`` up to ``at``; an empty window without an alert needs none."""
        out: list[tuple] = []
        while done is not None and done + STEP <= at and (kept or since is not None):
            done += STEP
            new, since = evaluate(rule, kept, since, done)
            out += new
        return out, since, done

    def _frame(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            at, state, ratio = zip(*out)
            yield pd.DataFrame({"alert": self.rules[key[0]].alert, "service": key[1], "at": at, "state": state, "ratio": pd.Series(ratio, dtype="float64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rule = self.rules[key[0]]
        kept, since, done = self._load()
        out: list[tuple] = []
        for tick, total, hits in sorted((int(t), int(n), int(h)) for b in rows for t, n, h in zip(b["tick"], b["total"], b["hits"])):
            new, since, done = self._until(rule, kept, since, done, tick - STEP)
            kept[tick] = (total, hits)
            more, since = evaluate(rule, kept, since, tick)
            out += new + more
            done = tick
        self._save(kept, since, done)
        return self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, since, done = self._load()
        if done is None:
            return iter(())
        out, since, done = self._until(self.rules[key[0]], kept, since, done, timerValues.getCurrentWatermarkInMs() // 1000 // STEP * STEP)
        self._save(kept, since, done)
        return self._frame(key, out)

    def close(self) -> None:
        pass


def transitions_stream(samples: DataFrame, rules: tuple[Rule, ...] = RULES, late: str = "1 minute") -> DataFrame:
    """``transitions`` of a stream of samples, each as soon as the watermark, ``late`` behind the newest sample, has passed
    its evaluation; later samples are dropped. Ends come by timer, so a service that falls silent is resolved too.

    Three steps of state: a row a series and the samples that wait; sums of the minutes that are open; a window of minutes
    an alert and service. Needs the RocksDB state store and append mode.
    """
    s = samples.where("at IS NOT NULL AND value IS NOT NULL").withWatermark("at", late)
    s = s.select(*SERIES, "at", F.unix_micros("at").alias("micros"), "value")
    schema = ", ".join(f"{n} {samples.schema[n].dataType.simpleString()}" for n in SERIES) + ", at timestamp, increase bigint"
    grown = s.groupBy(*SERIES).transformWithStateInPandas(_Increases(), schema, "append", "eventTime", eventTimeColumnName="at")
    minutes = grown.groupBy("service", F.window("at", f"{STEP} seconds").alias("w")).agg(*_sums(rules))
    each = _by_rule(minutes.withColumn("tick", F.unix_seconds("w.end")), rules)
    out = f"alert string, service {samples.schema['service'].dataType.simpleString()}, at bigint, state string, ratio double"
    return each.groupBy("rule", "service").transformWithStateInPandas(_Machine(rules), out, "append", "eventTime")
