"""Conversations turn by turn: what a turn sees, the stream against the batch form, defined results for odd rows."""

from lodestone.operators import answers as A
from lodestone.streaming import sessions as S

SCHEMA = "session_id bigint, turn bigint, query string, context string, history string"


def models():
    """``echo`` answers with the number of answers it was shown, as JSON; ``silent`` gives none."""

    def echo():
        return lambda prompts: ['{"answer_text": "seen %d of %s"}' % (p.count("**A:** "), p.split("\n\nQuestion: ")[0] or "nothing") for p in prompts]

    def silent():
        return lambda prompts: [None for _ in prompts]

    return echo, silent


#: Made inside a function, so that they travel to the workers by value.
echo, silent = models()


def rows(spark, data):
    return spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)


def asked(sessions=7, turns=9):
    return [(s, t, f"explain Ledger{t} of harbour{s} please", f"chunk {s}") for t in range(turns) for s in range(sessions) if (s + t) % 5]


def loop(data, answer):
    """The same by plain dictionaries."""
    said, out = {}, {}
    for s, t, q, c in sorted(data, key=lambda r: (r[0], r[1])):
        old = said.setdefault(s, [])
        shown = old[-6:]
        history = "\n---\n**Recent conversation:**\n" + "\n".join(f"**{'Q' if r == 'u' else 'A'}:** {x}" for r, x in shown) if shown else ""
        response = f"seen {sum(r == 'a' for r, _ in shown)} of {c}"
        old += [("u", q), ("a", response)]
        words = {w.capitalize() for r, x in old if r == "u" for w in x.lower().split() if 4 <= len(w) <= 20}
        first = next(x for r, x in old if r == "u")
        out[s, t] = ("semantic", history, len(old), f"Conversation about: {first}", sorted(words)[:10], response)
    return out


def found(df):
    got = df.collect()
    out = {(r.session_id, r.turn): (r.query_type, r.history, r.message_count, r.summary, r.topics, r.response) for r in got}
    assert len(out) == len(got)
    return out


def test_turns_equal_a_plain_loop(spark):
    data = asked()
    assert found(S.converse(rows(spark, data), echo)) == loop(data, echo)


def test_batches_of_two_rows_change_nothing(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        data = asked(3, 8)
        assert found(S.converse(rows(spark, data), echo)) == loop(data, echo)
    finally:
        spark.conf.set(name, old)


def test_odd_turns(spark):
    data = [(None, 1, "hello there", None), (None, 2, "x" * 300_000, None), (5, None, None, None), (5, 0, "explain tides", "c"), (5, 0, "explain tides", "c")]
    got = sorted(S.converse(rows(spark, data), silent).collect(), key=lambda r: (r.session_id or 0, r.message_count))
    assert [(r.session_id, r.turn, r.query_type, r.message_count) for r in got] == [(None, 1, "greeting", 2), (None, 2, "hybrid", 4), (5, None, "greeting", 2), (5, 0, "semantic", 4), (5, 0, "semantic", 6)]
    assert got[0].response == A.GREETING and got[1].history.endswith("**Q:** hello there\n**A:** " + A.GREETING) and got[4].response == S.NOTHING_FOUND
    assert S.converse(rows(spark, []), silent).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Three runs from one checkpoint: memory comes back, and turn n sees what turn n - 1 wrote."""
    data = asked(4, 9)
    provider, parts = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k, None) for k in (provider, parts)}
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(parts, "2")
    try:
        landing, out = str(tmp_path / "in"), str(tmp_path / "out")
        for low in (0, 3, 6):
            rows(spark, [r for r in data if low <= r[1] < low + 3]).coalesce(1).write.mode("append").parquet(landing)
            s = S.converse_stream(spark.readStream.schema(SCHEMA).parquet(landing), echo)
            q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            q.awaitTermination(300)
            assert q.exception() is None
        assert found(spark.read.parquet(out)) == loop(data, echo)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
