"""Packing of tokenized documents into sequences by a configuration linear program.

Only longer documents are cut. What has to be packed is then a histogram of piece lengths, at most ``capacity``
entries however large the corpus. A configuration is a multiset of lengths that fits one sequence. The program asks
for the fewest sequences, counted by configuration and in fractions, that hold all pieces. It is solved by
multiplicative weights: every length carries a price, a knapsack solved by dynamic programming finds the dearest
configurations, and each use of one lowers the prices of its lengths by a factor. The sums of what was used are the
fractional solution; the prices, scaled so that no configuration costs more than one, bound the optimum from below.
The fractions are then rounded to whole sequences of whole configurations and the pieces left over go by best fit.

The driver sees the histogram and returns configurations with repetitions; pieces find their place by their rank
within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

CAPACITY, END = 1024, 2


#: Of each part of the rounds: its share, the factor exp(-step) of a price whose length was used once over, and how
#: far below the dearest configuration another may be to be used in the same round.
SCHEDULE = ((0.2, 0.15, 0.03), (0.3, 0.05, 0.02), (0.5, 0.02, 0.01))


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every fill up to ``capacity``: the dearest multiset of ``lengths`` (ascending) in it, the number + 1 of the
    length taken last where one ends just there, and the largest such fill up to it."""
    fills = np.arange(capacity + 1)
    value, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, fills, "right")
    for c in range(int(lengths[0]), capacity + 1):
        gain = value[c - lengths[: upto[c]]] + prices[: upto[c]]
        k = int(gain.argmax())
        if gain[k] > value[c - 1]:
            value[c], taken[c] = gain[k], k + 1
        else:
            value[c] = value[c - 1]
    return value, taken, np.maximum.accumulate(np.where(taken > 0, fills, 0))


def dearest_with_each(lengths: np.ndarray, taken: np.ndarray, ends: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each length (rows) in the dearest configuration that holds at least one piece of a length (columns)."""
    copies = np.eye(len(lengths))
    column, fill = np.arange(len(lengths)), ends[capacity - lengths]
    while True:
        column, fill = column[fill > 0], fill[fill > 0]
        if not len(column):
            return copies
        k = taken[fill] - 1
        copies[k, column] += 1
        fill = ends[fill - lengths[k]]


def configuration_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """The configuration program of ``counts`` pieces of ``lengths`` (ascending, all counts above 0), solved by
    ``rounds`` of pricing: ({((length, copies), ...): sequences}, lower bound of the optimum).

    The sequences hold the volume of all pieces; of a single length they may hold a few percent more or less. Each
    part of the schedule starts from the mean of the last one's prices; the last part's uses are the solution.
    """
    n = counts.astype(float)
    # No two pieces over half a sequence share one: their number is a bound too.
    prices = lengths / capacity
    bound, used = float(n[lengths > capacity / 2].sum()), {}
    for share, step, near in SCHEDULE:
        used, mean, turns = {}, np.zeros(len(n)), max(1, round(rounds * share))
        for _ in range(turns):
            value, taken, ends = knapsack(lengths, prices, capacity)
            prices = prices / value[capacity]
            bound = max(bound, float(n @ prices))
            mean += prices / turns
            copies = dearest_with_each(lengths, taken, ends, capacity)
            worth = prices @ copies
            # Prices only fall, so what is near the dearest of the round's start is as near to the dearest now.
            while worth[best := int(worth.argmax())] >= 1 - near:
                at = np.flatnonzero(copies[:, best])
                k = copies[at, best]
                times = float((n[at] / k).min())
                config = tuple(zip(lengths[at].tolist(), k.astype(int).tolist()))
                used[config] = used.get(config, 0.0) + times
                change = prices[at] * np.expm1(-step * k * times / n[at])
                prices[at] += change
                worth += change @ copies[at]
        prices = mean / knapsack(lengths, mean, capacity)[0][capacity]
        bound = max(bound, float(n @ prices))
    volume = sum(times * sum(x * k for x, k in config) for config, times in used.items())
    scale = float(lengths @ n) / volume
    return {config: times * scale for config, times in used.items()}, bound


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 240) -> tuple[list[tuple[int, list[tuple[int, int]]]], float]:
    """[(repetitions, [(length, copies)])] that pack the histogram exactly, and the program's lower bound of their sum.

    Rounding goes through the configurations from the most used one, carries the fractions along and takes whole
    repetitions while whole pieces are there for them.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    full = int(left[capacity])
    out: list[tuple[int, list[tuple[int, int]]]] = [(full, [(capacity, 1)])] if full else []
    left[capacity] = 0
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return out, float(full)
    solution, bound = configuration_program(lengths, left[lengths], capacity, rounds)
    carried = 0.0
    for config, times in sorted(solution.items(), key=lambda x: (-x[1], x[0])):
        carried += times
        whole = int(carried)
        carried -= whole
        whole = min(whole, *(int(left[x]) // k for x, k in config))
        if whole:
            for x, k in config:
                left[x] -= whole * k
            out.append((whole, list(reversed(config))))
    return out + _best_fit(left, capacity), bound + full


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Longest first, each with the longest pieces that still fit; equal sequences at once."""
    left, out = left.copy(), []
    while left.any():
        room, config = capacity, {}
        while room > 0:
            fits = np.flatnonzero(left[: room + 1])
            fits = [x for x in fits[::-1] if left[x] > config.get(int(x), 0)]
            if not fits:
                break
            config[int(fits[0])] = config.get(int(fits[0]), 0) + 1
            room -= int(fits[0])
        times = min(int(left[x]) // k for x, k in config.items())
        for x, k in config.items():
            left[x] -= times * k
        out.append((times, sorted(config.items(), reverse=True)))
    return out


def place_table(packed: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from_rank, to_rank, first_sequence, offset): the pieces of a length with these ranks lie at this
    offset of consecutive sequences."""
    rank: dict[int, int] = {}
    table, sequence = [], 0
    for times, config in packed:
        offset = 0
        for length, copies in config:
            for _ in range(copies):
                at = rank.get(length, 0)
                table.append((length, at, at + times, sequence, offset))
                rank[length] = at + times
                offset += length
        sequence += times
    return table


def _pieces(path: str, capacity: int, end: int, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            n, index, piece, start, length, crc = batch.num_rows, [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at : first if k == 0 else at + capacity]
                    index.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            take = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in keep), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[*keep, "piece", "start", "length", "ids_crc32"],
            )

    return run


def encoder(path: str):
    """Text -> token ids of the tokenizer file ``path``, without added special tokens.

    A byte-level file that has a rank file of the same name beside it is run by ``tiktoken``, three times as fast
    with the same ids; every other one by ``tokenizers``. A special token's own string in a text is that token.
    """
    import base64
    import os

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if os.path.exists(ranks):
        import json

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        run = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        return lambda text: run.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    run = Tokenizer.from_file(path)
    return lambda text: np.array(run.encode(text, add_special_tokens=False).ids, np.uint32)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, seed: int = 7, rank_cells: int = 256) -> DataFrame:
    """``docs`` (doc_id, text) -> one row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and then ``end``; null text is empty, so every row has a piece. A document longer
    than ``capacity`` is cut into pieces of ``capacity`` tokens, the first piece taking the remainder. Rows with
    equal or null doc_id are separate documents. Other columns of ``docs`` are ignored. Sequence ids are gapless.
    """
    spark = docs.sparkSession
    keys = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    schema = "doc_id bigint, _row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        raise TypeError("doc_id must be bigint")
    pieces = materialize(keys.mapInArrow(_pieces(tokenizer, capacity, end, ("doc_id", "_row")), schema))

    # Rank within a length: by cells, so that one length with most of the pieces is no single task's work.
    cell = F.pmod(F.xxhash64(F.lit(seed), "_row", "piece"), F.lit(rank_cells)).cast("int")
    celled = pieces.withColumn("_cell", cell)
    counts = celled.groupBy("length", "_cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    packed, _ = configurations(histogram, capacity)
    table = place_table(packed)

    within = Window.partitionBy("length", "_cell").orderBy("_row", "piece")
    ranked = celled.withColumn("_in", F.row_number().over(within) - 1).join(counts.drop("n"), ["length", "_cell"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in"))
    # A few entries a configuration; rounds and lengths bound the configurations, whatever the input.
    slots: dict[int, list[tuple[int, int, int]]] = {}
    for length, low, _, sequence, offset in table:
        slots.setdefault(length, []).append((low, sequence, offset))
    shared = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine, slot = np.flatnonzero(length == x), of[x]
                k = np.searchsorted(slot[:, 0], rank[mine], "right") - 1
                sequence[mine] = slot[k, 1] + rank[mine] - slot[k, 0]
                offset[mine] = slot[k, 2]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, out)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
