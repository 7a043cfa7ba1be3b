"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is dealt to random blocks of rows. A source's target fixes its block quota: whole passes over the
source plus, for the rest, a random sample of its blocks drawn without replacement; one block is used in part
so that the words taken come near the target. The driver, which sees block totals only, splits the quotas of
all sources down a binary tree of output shards: at each node the left half's blocks are one multivariate
hypergeometric draw. Each source's randomly ordered blocks are then handed out without overlap according to
the leaf counts, and the rows of a shard are shuffled locally.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import split_counts
from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of bytes other than ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` -> also ``sid`` (rank by code point, null last), ``weight``, ``target``.

    The targets share ``share`` times all sizes by weight; none exceeds ``most`` times its source's size, and
    what a capped source can't take goes to the others by weight. That fixed point is min(cap, level * weight)
    for one level, found from running sums over the sources in the order in which they reach their caps.
    One row a source: this is metadata, ordered in one task.
    """
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int") - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("_level", level)
    reached = F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.struct(F.col("_cap") / F.col("weight"), "sid", "_level"))
    best = levelled.withColumn("_best", F.min(reached).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_best._level") * F.col("weight"), F.col("_cap")))
    return best.withColumn("target", target).select("sid", "source", "source_size", "source_rows", "weight", "target")


def splitting_tree(rng: np.random.Generator, quotas: list[int], n_shards: int) -> list[list[int]]:
    """Blocks of each source in each shard: halve the shards again and again, drawing the left half's blocks of
    each source at each node; shard totals differ by one at most."""
    total = sum(quotas)
    caps = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]

    def node(have: list[int], low: int, high: int) -> list[list[int]]:
        if high - low == 1:
            return [have]
        mid = (low + high) // 2
        left = split_counts(rng, have, sum(caps[low:mid]))
        return node(left, low, mid) + node([h - k for h, k in zip(have, left)], mid, high)

    return node(quotas, 0, n_shards)


def mix_sources(rows: DataFrame, n_shards: int = 16, seed: int = 29, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (3, 1, 2), max_blocks: int = 65_536, block_rows: int = 64) -> DataFrame:
    """``rows`` needs ``source`` and ``size`` (long); returns its columns with ``source_size``, ``target``,
    ``copies`` (int), ``taken`` (copies * size) and ``shards`` (array<int>, one entry a copy).

    Defined results: null sources form one source, last in order; null sizes count 0; rows of size 0 are never
    taken; repeated rows are separate rows; an empty table stays empty. Columns with this function's own names
    are replaced. ``rows`` must give the same rows on every read, as files do. Draws hang on what a row holds, not on where it lies: runs on the same rows agree however Spark
    cuts the files, and of rows alike in every column any may be the one that is taken. What reaches the driver: at
    most ``max_blocks`` block totals plus one row a source.
    """
    rows = rows.drop("source_size", "target", "copies", "taken", "shards", "sid", "_row", "_block", "_key")
    names = rows.columns
    spark = rows.sparkSession
    rows = rows.withColumn("_key", F.xxhash64(*names)).withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    # Only what draws need is written; the rows themselves are read again at the end.
    base = materialize(rows.select("source", "size", "_key").withColumn("_row", F.monotonically_increasing_id()))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = materialize(source_targets(sizes, weights, share, float(most)))
    found = targets.orderBy("sid").collect()
    total_rows = sum(r["source_rows"] for r in found)
    shared_out = max(1, total_rows // max_blocks, block_rows)
    n_blocks = [max(1, r["source_rows"] // shared_out) for r in found]

    sources = targets.withColumn("_blocks", F.greatest(F.lit(1), F.floor(F.col("source_rows") / shared_out)).cast("long"))

    def deal(df: DataFrame) -> DataFrame:
        of = df.join(F.broadcast(sources) if len(found) <= 10_000 else sources, df["source"].eqNullSafe(sources["source"])).drop(sources["source"])
        return of.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_key"), F.col("_blocks")).cast("int"))

    dealt = deal(base)
    words: dict[tuple[int, int], int] = {(r["sid"], r["_block"]): r["w"] for r in dealt.groupBy("sid", "_block").agg(F.sum("size").alias("w")).collect()}

    rng = np.random.default_rng(seed)
    handed: list[list[int]] = []  # of each source: its blocks in the order in which they are handed out
    rest: list[tuple[int, int]] = []  # the block of each source that is used in part, and how many of its words
    for r, k in zip(found, n_blocks):
        passes = int(r["target"] // r["source_size"]) if r["source_size"] else 0
        left = max(0.0, r["target"] - passes * r["source_size"])
        order = rng.permutation(k).tolist()
        mine = order * passes
        part = (-1, 0)
        for b in order if passes < most else []:
            w = words.get((r["sid"], b), 0)
            mine.append(b)
            if w > left:
                part = (b, round(left))
                break
            left -= w
        handed.append([mine[i] for i in rng.permutation(len(mine))])
        rest.append(part)
    leaves = splitting_tree(rng, [len(x) for x in handed], n_shards)
    plan: dict[tuple[int, int], list[int]] = {}
    at = [0] * len(found)
    for shard, counts in enumerate(leaves):
        for s, n in enumerate(counts):
            for b in handed[s][at[s] : at[s] + n]:
                plan.setdefault((s, b), []).append(shard)
            at[s] += n
    table = spark.createDataFrame(
        [(s, b, shards, rest[s][1] if rest[s][0] == b else None) for (s, b), shards in plan.items()],
        "sid int, _block int, _shards array<int>, _part bigint",
    )
    used = dealt.join(table.where("_part is not null"), ["sid", "_block"])
    in_part = _part_of_block(used.select("sid", "_row", "_key", "size", "_part"), seed).join(used.select("_row", "_key"), "_row")
    chosen = in_part.groupBy("_key").agg(F.count("*").alias("_chosen"))
    planned = deal(rows).join(table, ["sid", "_block"], "left")
    # Only the rows of blocks that are used in part are exchanged, one block a source. Of rows alike in every column
    # as many are taken as were drawn.
    partly = planned.where("_part is not null").join(chosen, "_key", "left")
    place = F.row_number().over(Window.partitionBy("_key").orderBy("size"))
    partly = partly.withColumn("_in", (place <= F.coalesce("_chosen", F.lit(0))).cast("int")).drop("_chosen")
    planned = planned.where("_part is null").withColumn("_in", F.lit(0)).unionByName(partly)
    whole = F.coalesce(F.size("_shards"), F.lit(0)) - F.col("_part").isNotNull().cast("int")
    copies = F.when(F.col("size") > 0, whole + F.coalesce(F.col("_in"), F.lit(0))).otherwise(0)
    return planned.withColumn("copies", copies.cast("int")).select(
        *names,
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("copies") > 0, F.slice("_shards", F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>")).alias("shards"),
    )


def _part_of_block(rows: DataFrame, seed: int, rows_each: int = 64) -> DataFrame:
    """``_row`` and ``_in`` = 1 of the rows that fill ``_part`` words of a source's last block: first small random
    cells in order while they fit, then the largest rows that fit of the cell in which the words run out."""
    count = Window.partitionBy("sid")
    cells = rows.groupBy("sid").agg(F.greatest(F.lit(1), F.floor(F.count("*") / rows_each)).alias("_n")).join(rows, "sid")
    cells = cells.withColumn("_cell", F.pmod(F.xxhash64(F.lit(seed + 1), "_key"), F.col("_n")))
    sums = cells.groupBy("sid", "_cell").agg(F.sum("size").alias("_w"), F.first("_part").alias("_part"))
    upto = F.coalesce(F.sum("_w").over(count.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_upto", upto).where("_upto <= _part")
    cells = cells.drop("_part").join(sums, ["sid", "_cell"])
    full = cells.where("_upto + _w <= _part").select("_row")
    last = cells.where("_upto + _w > _part").groupBy("sid", "_cell").agg(
        F.first(F.col("_part") - F.col("_upto")).alias("_left"),
        F.reverse(F.array_sort(F.collect_list(F.struct("size", "_key", "_row")))).alias("_all"),
    )
    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<bigint>").alias("rows"))
    fill = F.aggregate(
        "_all",
        start,
        lambda acc, x: F.when(x["size"] <= acc["left"], F.struct((acc["left"] - x["size"]).alias("left"), F.concat(acc["rows"], F.array(x["_row"])).alias("rows"))).otherwise(acc),
    )
    chosen = last.select(F.explode(fill["rows"]).alias("_row"))
    return full.unionByName(chosen).withColumn("_in", F.lit(1))


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The result of ``mix_sources`` with one row a copy: ``shard`` says where it goes. Join the wide columns, then
    ``repartition("shard")`` and sort each shard by a hash for its random order."""
    return mixed.withColumn("shard", F.explode("shards")).drop("shards")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to 150% of their words, sources weighing 3, 1, 2 by turns, none above twice its size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(rows)
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "copies", "shards")
