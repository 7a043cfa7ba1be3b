"""A sync of contacts, deals and activities: the new tables, and a record of the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .upsert import upsert

RUNS = "run_id long, status string, started_at timestamp, completed_at timestamp, contacts_synced long, deals_synced long, activities_synced long, error_message string"
#: Entity and its key, parents first.
ENTITIES = {"contacts": "contact_id", "deals": "deal_id", "activities": "activity_id"}


def merge(base: dict[str, DataFrame], delta: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after a sync. A row whose contact isn't known keeps the contact it had; a new one has none."""
    out = {"contacts": upsert(base["contacts"], delta["contacts"], "contact_id")}
    known = out["contacts"].select(F.col("contact_id"), F.col("contact_id").alias("_new"))
    for name in ("deals", "activities"):
        key = ENTITIES[name]
        old = base[name].select(key, F.col("contact_id").alias("_old"))
        rows = delta[name].join(known, "contact_id", "left").join(old, key, "left").withColumn("contact_id", F.coalesce("_new", "_old"))
        out[name] = upsert(base[name], rows.select(*base[name].columns), key)
    return out


def start_run(runs: DataFrame, run_id: int, at) -> DataFrame:
    """``runs`` with a new one that is running."""
    new = runs.sparkSession.createDataFrame([(run_id, "running", at, None, None, None, None, None)], RUNS)
    return runs.unionByName(new)


def finish_run(runs: DataFrame, run_id: int, at, delta: dict[str, DataFrame] | None = None, error: str | None = None) -> DataFrame:
    """``runs`` with the running ``run_id`` at its end: ``error`` with its message, else ``success`` and the rows synced."""
    mine = (F.col("run_id") == run_id) & (F.col("status") == "running")
    runs = runs.withColumn("completed_at", F.when(mine, F.lit(at)).otherwise(F.col("completed_at"))).withColumn("error_message", F.when(mine, F.lit(error)).otherwise(F.col("error_message")))
    if delta is not None and error is None:
        for name in ENTITIES:
            n = delta[name].agg(F.count("*").alias("_n"))
            runs = runs.join(F.broadcast(n)).withColumn(f"{name}_synced", F.when(mine, F.col("_n")).otherwise(F.col(f"{name}_synced"))).drop("_n")  # one row
    return runs.withColumn("status", F.when(mine, "error" if error is not None else "success").otherwise(F.col("status")))


def sync(read: Callable[[str], DataFrame], base: dict[str, DataFrame], write: Callable[[str, DataFrame], None], runs: DataFrame, run_id: int, clock: Callable) -> DataFrame:
    """Reads every entity from a source, writes the merged tables and returns ``runs`` with this run's record.

    A failure of the source or of a write ends in an ``error`` record; it isn't raised. A sync is idempotent, so a failed
    one is simply run again."""
    runs = start_run(runs, run_id, clock())
    try:
        delta = {name: read(name) for name in ENTITIES}
        for name, table in merge(base, delta).items():
            write(name, table)
    except Exception as e:  # noqa: BLE001 - the record is where a failure goes
        return finish_run(runs, run_id, clock(), error=str(e)[:500])
    return finish_run(runs, run_id, clock(), delta)
