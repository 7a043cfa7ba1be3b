"""Alerts over counters: increases, transitions, and the stream against the batch form."""

import datetime as dt
import random

import pytest

from lodestone.sources import store
from lodestone.streaming import alerts as L

SCHEMA = "service string, instance string, status int, at timestamp, value bigint"
START = dt.datetime(2024, 1, 1, 12)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def traffic(seed, minutes=90):
    """Counters of two services and three processes; one starts over, one is silent for half an hour, errors come in bursts."""
    r = random.Random(seed)
    value, rows = {}, []
    for second in range(0, minutes * 60, 20):
        for service in ("a", "b"):
            if service == "b" and 1800 <= second < 3600:
                continue
            for instance in ("x", "y", "z"):
                bad = r.random() < (0.5 if second // 600 % 3 == 1 else 0.02)
                key = (service, instance, r.choice((404, 429, 500)) if bad else 200)
                if instance == "y" and r.random() < 0.02:
                    value = {k: 0 if k[:2] == key[:2] else v for k, v in value.items()}
                value[key] = value.get(key, 0) + r.randint(0, 4)
                rows.append((*key, at(second + r.random()), value[key]))
    return rows


def model(rows):
    """The transitions by plain loops over every minute."""
    series, grown = {}, []
    for service, instance, status, t, v in sorted(rows, key=lambda x: x[3]):
        before = series.get((service, instance, status))
        if before is not None:
            grown.append((service, status, t.timestamp(), v - before if v >= before else v))
        series[service, instance, status] = v
    first = int(min(r[3] for r in rows).timestamp()) // 60 * 60
    last = int(max(r[3] for r in rows).timestamp()) // 60 * 60
    out = set()
    for rule in L.RULES:
        for service in {r[0] for r in rows}:
            since = None
            for t in range(first, last + rule.width + 120, 60):
                inside = [(st, n) for s, st, when, n in grown if s == service and t - rule.width <= when < t]
                total, hits = sum(n for _, n in inside), sum(n for st, n in inside if rule.low <= st < rule.high)
                if total and hits > rule.least * total:
                    if since is None:
                        since = t
                        out.add((rule.alert, service, t, "pending", round(hits / total, 9)))
                    if t - since == rule.hold:
                        out.add((rule.alert, service, t, "firing", round(hits / total, 9)))
                elif since is not None:
                    out.add((rule.alert, service, t, "resolved" if t - 60 - since >= rule.hold else "inactive", None))
                    since = None
    return out


def plain(df):
    rows = df.select("alert", "service", "at", "state", "ratio").collect()
    out = [(a, s, t, st, None if r is None else round(r, 9)) for a, s, t, st, r in rows]
    assert len(out) == len(set(out))
    return set(out)


def test_increases_start_over_and_cross_blocks(spark):
    rows = [("s", "i", 200, at(0), 5), ("s", "i", 200, at(10), 9), ("s", "i", 200, at(20), 2), ("s", "i", 200, at(7300), 3), ("s", "i", 200, at(20), 1), (None, "i", 200, at(0), 1), (None, "i", 200, at(1), 4)]
    rows += [("s", "i", 200, None, 7), ("s", "i", 200, at(30), None)]
    got = {(r["service"], r["at"], r["increase"]) for r in L.increases(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("s", at(10), 4), ("s", at(20), 2), ("s", at(7300), 1), (None, at(1), 3)}


def test_transitions_of_nothing(spark):
    assert L.transitions(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_transitions_equal_plain_loops(spark, seed):
    rows = traffic(seed)
    want = model(rows)
    assert {s for _, _, _, s, _ in want} == {"pending", "firing", "resolved", "inactive"}
    assert plain(L.transitions(spark.createDataFrame(rows, SCHEMA))) == want


def test_stream_equals_batch(spark, tmp_path):
    """Batches in order of time, rows within ``late`` shuffled across their borders; a last sample moves the watermark on."""
    rows = traffic(3, 60)
    r = random.Random(5)
    order = sorted(rows, key=lambda x: x[3].timestamp() + r.uniform(0, 50))
    end = ("end", "x", 200, at(4 * 3600), 1)
    provider, parts = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k, None) for k in (provider, parts)}
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(parts, "2")
    try:
        landing = str(tmp_path / "in")
        third = len(order) // 3 + 1
        batches = [order[i : i + third] for i in range(0, len(order), third)] + [[end]]
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landing) if spark.createDataFrame(batches[0], SCHEMA).coalesce(1).write.parquet(landing) is None else None
        out, check = str(tmp_path / "out"), str(tmp_path / "check")
        for b in [None, *batches[1:]]:
            if b:
                spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
            # Each run is a restart from the checkpoint: state and timers come back.
            q = L.transitions_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(300)
            assert q.exception() is None
        assert plain(spark.read.parquet(out)) == plain(L.transitions(spark.createDataFrame(rows, SCHEMA)))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
