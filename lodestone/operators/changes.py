"""Change detection between snapshots of a source, and a sync that writes every batch exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = ("insert", "update", "delete", "unchanged")


def row_hash(columns: list[str]) -> Column:
    """A digest of the values: nulls differ from empty texts, and values don't run into each other."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new``'s rows, and ``old``'s that are gone, with ``change``: insert, update, delete or unchanged.

    Snapshots are compared by key and row hash in one join; a key that comes twice in a snapshot counts once, as its
    row of largest hash. Rows without a key are left out. Both have the same columns.
    """
    columns = [c for c in new.columns if c != key]

    def side(rows: DataFrame, name: str) -> DataFrame:
        hashed = rows.where(F.col(key).isNotNull()).select(key, F.struct(row_hash(columns).alias("hash"), *columns).alias("row"))
        return hashed.groupBy(key).agg(F.max("row").alias(name))

    both = side(old, "_old").join(side(new.select(*old.columns), "_new"), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old.hash") != F.col("_new.hash"), "update").otherwise("unchanged")
    row = F.coalesce("_new", "_old")
    return both.select(key, *(row[c].alias(c) for c in columns), change.alias("change"))


class SyncedTable:
    """Versions of a table in a folder and a record of each run, for batches that may be delivered again.

    A batch writes the next version and its run's record under its own number, the record last. A batch whose record
    is there changes nothing; what one left that failed halfway is written over.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def runs(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(p.getName().split("=")[1]) for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def current(self, before: int | None = None) -> DataFrame:
        """The table after the last complete run, or after the last one before ``before``."""
        done = [r for r in self.runs() if before is None or r < before]
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/table/batch={done[-1]}")

    def record(self) -> DataFrame:
        """``batch`` and the number of each change, a row a run."""
        schema = "batch bigint, " + ", ".join(f"{c} bigint" for c in CHANGES)
        out = self.spark.createDataFrame([], schema)
        for r in self.runs():
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/runs/batch={r}").withColumn("batch", F.lit(r).cast("bigint")))
        return out

    def sync(self, snapshot: DataFrame, batch: int) -> None:
        """Makes the table equal to a full ``snapshot`` of the source; usable in ``foreachBatch``."""
        if batch in self.runs():
            return
        changes = diff(self.current(batch), snapshot, self.key)
        names = [f.name for f in self.current(batch).schema]
        changes.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")
        changes = self.spark.read.schema(changes.schema).parquet(f"{self.path}/changes/batch={batch}")
        changes.where("change <> 'delete'").select(*names).write.mode("overwrite").parquet(f"{self.path}/table/batch={batch}")
        counts = changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in CHANGES))
        counts.select(F.lit(batch).cast("bigint").alias("batch"), *CHANGES).write.mode("overwrite").parquet(f"{self.path}/runs/batch={batch}")

    def stream(self, snapshots: DataFrame, checkpoint: str):
        """A writer of a stream whose every micro-batch is a full snapshot of the source."""
        return snapshots.writeStream.foreachBatch(lambda rows, batch: self.sync(rows, batch)).option("checkpointLocation", checkpoint)
