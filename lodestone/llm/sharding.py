"""Uniform random sharding with exact shard sizes, from a hypergeometric communication matrix.

The rows are dealt to blocks by a hash of the row, each block's count is known, and the driver draws how
many rows of each block go to each shard: one multivariate hypergeometric draw per block from the shards'
remaining capacities. Given these counts, a random order inside each block, the exchange, and a random
order inside each shard give every arrangement of the rows the same chance, while the shard sizes are exact.
Only the block counts (``max_blocks`` at most) reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good items among ``n`` drawn without replacement; any population size.

    numpy draws populations up to 10**9; beyond that the ratio-of-uniforms rejection of Stadlober is used.
    """
    total = good + bad
    if n <= 0 or good <= 0:
        return 0
    if n >= total:
        return good
    if bad <= 0:
        return n
    if total < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    small, take = min(good, bad), min(n, total - n)
    p = small / total
    mode = (take + 1) * (small + 1) // (total + 2)
    spread = math.sqrt((total - take) * take * p * (1 - p) / (total - 1) + 0.5)
    centre, width = take * p + 0.5, 1.7155277699214135 * spread + 0.8989161620588988

    def weight(k: int) -> float:
        return sum(map(math.lgamma, (k + 1, small - k + 1, take - k + 1, total - small - take + k + 1)))

    at_mode, low, high = weight(mode), max(0, take + small - total), min(take, small)
    while True:
        x, y = rng.random(), rng.random()
        k = math.floor(centre + width * (y - 0.5) / x) if x else low - 1
        if low <= k <= high and 2 * math.log(x) <= at_mode - weight(k):
            break
    if good > bad:
        k = take - k
    return k if n <= total - n else good - k


def split_counts(rng: np.random.Generator, caps: list[int], n: int) -> list[int]:
    """One multivariate hypergeometric draw of ``n`` items from colours with ``caps`` items each."""
    out, rest = [], sum(caps)
    for c in caps:
        rest -= c
        k = hypergeometric(rng, c, rest, n)
        out.append(k)
        n -= k
    return out


def communication_matrix(block_rows: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows of each block that go to each shard. Shard sizes differ by one at most and the matrix has the
    distribution that a uniform random permutation of all rows would give it."""
    rng = np.random.default_rng(seed)
    total = sum(block_rows)
    caps = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for n in block_rows:
        row = split_counts(rng, caps, n)
        caps = [c - k for c, k in zip(caps, row)]
        matrix.append(row)
    return matrix


def _key(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def shuffle_into_shards(rows: DataFrame, n_shards: int = 24, seed: int = 17, block_rows: int = 20_000, max_blocks: int = 16_384) -> DataFrame:
    """Add ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 within the shard) to ``rows``.

    ``rows`` must be narrow: carry keys and join the wide columns afterwards. Every row gets one place,
    repeated rows and rows of nulls too; an empty table stays empty; with fewer rows than shards some shards
    stay empty. Columns of ``rows`` are kept, but for ones named like this function's own (``shard``, ``slot``
    and the underscored working columns), which are replaced.
    """
    own = ["shard", "slot", "_row", "_key", "_block", "_place", "_bounds", "_order", "_part", "_rows", "_before"]
    rows = rows.drop(*own)
    names = rows.columns
    spark = rows.sparkSession
    # Places hang on what a row holds, so that runs agree however the files are cut; the number, written out, only
    # tells rows apart that are alike in every column.
    base = materialize(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", F.xxhash64(*names)))
    total = base.count()
    blocks = min(max_blocks, max(64, math.ceil(total / block_rows)))
    dealt = base.withColumn("_block", F.pmod(_key(seed, "_key"), F.lit(blocks)).cast("int"))
    counted = {r["_block"]: r["n"] for r in dealt.groupBy("_block").agg(F.count("*").alias("n")).collect()}
    sizes = [counted.get(b, 0) for b in range(blocks)]
    matrix = communication_matrix(sizes, n_shards, seed)
    bounds = [(b, [int(x) for x in np.cumsum(row)]) for b, row in enumerate(matrix)]
    table = spark.createDataFrame(bounds, "_block int, _bounds array<bigint>")

    inside = Window.partitionBy("_block").orderBy(_key(seed + 1, "_key"), "_row")
    sent = (
        dealt.withColumn("_place", F.row_number().over(inside) - 1)
        .join(table, "_block")
        .withColumn("shard", F.size(F.filter("_bounds", lambda x: x <= F.col("_place"))))
        .drop("_bounds", "_place", "_block")
    )
    # A shard can be larger than a task should be: it is ordered in parts by the leading bits of the key.
    bits = max(0, min(12, math.ceil(math.log2(max(1, total / n_shards / block_rows)))))
    sent = sent.withColumn("_order", _key(seed + 2, "_key"))
    sent = sent.withColumn("_part", F.shiftright(F.col("_order"), 64 - bits).cast("int") if bits else F.lit(0))
    if bits:
        sent = materialize(sent)
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard", "_part").orderBy("_order", "_row")
    placed = sent.withColumn("slot", F.row_number().over(within).cast("long") - 1)
    if bits:
        parts = sent.groupBy("shard", "_part").agg(F.count("*").alias("_rows"))
        parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        placed = placed.join(parts, ["shard", "_part"]).withColumn("slot", F.col("slot") + F.col("_before"))
    return placed.select(*names, "shard", "slot")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards of row counts at most one apart. Size: bytes of the text (null: none) plus 8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shuffle_into_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
