"""Mutations as functions of a base and a delta: tables are immutable files, so each returns the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` with the same key; applying it twice changes nothing."""
    return base.join(delta, key, "left_anti").unionByName(delta)


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, the one of largest ``order``."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(rows: DataFrame, key: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_key(delta: DataFrame, parents: DataFrame, external: str, internal: str, out: str) -> DataFrame:
    """``delta`` with ``out``: the internal key of the parent that ``external`` names, null if there is none."""
    ids = parents.select(F.col(external), F.col(internal).alias(out))
    return delta.join(ids, external, "left")


def delete_where_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of the deleted ``parents`` go too."""
    return children.join(parents.select(key), key, "left_anti")


def clear_column(rows: DataFrame, gone: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with a null ``column`` where ``gone`` has the key; ``cleared`` tells which rows lost a value by that."""
    marked = rows.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    hit = F.col("_gone").isNotNull()
    return marked.withColumn("cleared", hit & F.col(column).isNotNull()).withColumn(column, F.when(~hit, F.col(column))).drop("_gone")


def exact_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``content_hash`` and ``is_duplicate``: an earlier id has the same text."""
    hashed = docs.withColumn("content_hash", F.sha2(F.col(text_col), 256))
    first = hashed.groupBy("content_hash").agg(F.min(id_col).alias("_first"))
    return hashed.join(first, "content_hash").withColumn("is_duplicate", F.col(id_col) > F.col("_first")).drop("_first")
