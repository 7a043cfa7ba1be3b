"""Removal of repeated substrings: suffixes sorted from a sampled cover, compared with their neighbours.

The shape is that of difference-cover suffix sorting, bounded to the ``WIDTH`` bytes that matter here:

1. *Sample.* Positions are sampled so that every string of ``WIDTH`` bytes covers a sample at an offset that its
   own bytes decide. A cover of fixed residues (two of three positions) has this property too but sends 2/3 of
   all bytes as records of 16 bytes or more through the exchange; here the cover is the positions of least hash
   among neighbouring ``CORE``-byte strings, about 2 in ``WIDTH - CORE`` positions.
2. *Sort sampled triples.* A sample's triple is (bytes before, core, bytes after), up to the reach of any string
   that covers it, each part named by a hash. Samples are sorted by core and then by the rest. A core that
   occurs once can't be part of a repeat and is discarded.
3. *Settle by names.* No recursion is needed, as only ``WIDTH`` bytes count. Samples with equal names for the whole triple repeat with all the strings around them:
   all but the first are settled without looking at bytes. Only the first of each name goes on, and only where
   one core has several names.
4. *Merge remaining suffixes.* For these the strings at the offsets between samples are named from their bytes and
   merged, core by core, in text order. Those around a core with more than ``CROWD`` samples are dealt by core and
   name instead, so that no task has to hold a frequent core's strings.
5. *Compare adjacent prefixes.* Equal neighbours share ``WIDTH`` bytes; all but the earliest are removed.

Names are 64-bit hashes, so their order is arbitrary but the same everywhere, which is all that comparing
neighbours for equality needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import Roller, mix, slices, texts
from .storage import materialize, numbered

WIDTH, CORE = 100, 36
#: A string of WIDTH bytes starts at most REACH bytes before its sample.
REACH = WIDTH - CORE
_LAST = np.iinfo(np.int64).max
FULL, BORDER, RANGE, CROWDED = 0, 1, 2, 3
#: Samples of a core up to which one task merges the strings around it.
CROWD = 10_000
#: Tasks that one string around a crowded core is dealt to.
DEALS = 64
#: 48 bits of the names of core and triple. Cores that share 48 bits do no harm: the triple's name and the bytes that
#: are merged later tell them apart.
_SAMPLES = "core bigint, name bigint, ord bigint, _row bigint, at int, upto int"


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def sample_positions(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions with the least core hash of any string of WIDTH bytes. ``hashes``: of the core at each position;
    ``starts``: mask of the positions where a string of WIDTH bytes starts within its document."""
    if not starts.any():
        return np.empty(0, np.int64)
    windows = REACH + 1
    padded = np.concatenate((hashes, np.full(windows - 1, np.uint64(2**64 - 1))))
    least = np.where(starts[: len(hashes)], _slide(padded, windows, np.minimum), np.uint64(0))
    most = _slide(np.concatenate((np.zeros(windows - 1, np.uint64), least)), windows, np.maximum)
    return np.flatnonzero((most == hashes) & (most != 0))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    core, rest = Roller(101), Roller(202)
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        rows = batch.column("_row").to_numpy()
        order = batch.column("doc_id").fill_null(_LAST).to_numpy()
        found = []
        for i, j in slices(offsets):
            at = (offsets[i : j + 1] - offsets[i]).astype(np.int64)
            part = data[offsets[i] : offsets[j]]
            if len(part) < WIDTH:
                continue
            ends = np.repeat(at[1:], np.diff(at))
            starts = np.arange(len(part)) + WIDTH <= ends
            hashes = core.windows(core.sums(part), CORE)
            pos = sample_positions(hashes, starts)
            pos = pos[pos + CORE <= ends[pos]]
            doc = np.searchsorted(at, pos, "right") - 1
            left = np.minimum(pos - at[doc], REACH)
            right = np.minimum(at[doc + 1] - pos, WIDTH)
            around = mix(rest.spans(rest.sums(part), pos - left, pos + right) + left.astype(np.uint64))
            found.append((hashes[pos], around, i + doc, pos - at[doc], left, right))
        if not found:
            continue
        key, around, doc, pos, left, right = map(np.concatenate, zip(*found))
        first = _first_here(key, around, order[doc], rows[doc], pos)
        again = ~first
        # Repeats within this batch are settled here: strings start from ``low`` to ``high``. They travel under a
        # key of their own, so that a common passage doesn't gather in one task.
        low, high, whose = pos[again] - left[again], pos[again] + right[again] - WIDTH, doc[again]
        ok = high >= low
        low, high, whose = _joined(low[ok], high[ok], whose[ok])
        own = mix(rows[whose].astype(np.uint64) * np.uint64(2654435761) + low.astype(np.uint64))
        key, around = np.concatenate((key[first], own)), np.concatenate((around[first], own))
        out = [
            (key >> np.uint64(16)).view(np.int64),
            (around >> np.uint64(16)).view(np.int64),
            np.concatenate((order[doc[first]], order[whose])),
            np.concatenate((rows[doc[first]], rows[whose])),
            np.concatenate((pos[first], low)).astype(np.int32),
            np.concatenate((np.full(int(first.sum()), -1), high)).astype(np.int32),
        ]
        for a in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in out], names=["core", "name", "ord", "_row", "at", "upto"])


def _first_here(key, around, order, row, pos) -> np.ndarray:
    """Mask of the samples that are the earliest of their triple."""
    name = mix(key ^ mix(around))
    by = np.argsort(name, kind="stable")
    same = name[by][1:] == name[by][:-1]
    if not same.any():
        return np.ones(len(key), bool)
    group = np.concatenate(([0], np.cumsum(~same)))
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    by, group = by[several], group[several]
    by = by[np.lexsort((pos[by], row[by], order[by], group))]
    first = np.ones(len(key), bool)
    g = np.sort(group)
    first[by[1:][g[1:] == g[:-1]]] = False
    return first


def _joined(low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one document that overlap or touch, joined. In: ordered by document and position."""
    if not len(low):
        return low, high, doc
    wide = np.int64(1) << np.int64(40)
    reach = np.maximum.accumulate(high + doc * wide) - doc * wide
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (low[1:] > reach[:-1] + 1)))
    begin = np.flatnonzero(new)
    return low[begin], np.maximum.reduceat(high, begin), doc[begin]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the border samples of each document."""
    core = Roller(101)
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        out: list[list] = [[], [], [], [], [], []]
        lists = batch.column("border")
        for i, (row, order) in enumerate(zip(batch.column("_row").to_pylist(), batch.column("ord").to_pylist())):
            pos = lists[i].values.to_numpy()
            if not len(pos):
                continue
            own = data[offsets[i] : offsets[i + 1]]
            whole = own.tobytes()
            keys = core.spans(core.sums(own), pos, pos + CORE).view(np.int64)
            for p, k in zip(pos.tolist(), keys.tolist()):
                left = min(p, REACH)
                for column, x in zip(out, (k, order, row, p, left, whole[p - left : p + WIDTH])):
                    column.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["key", "ord", "_row", "at", "before", "bytes"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names and starts of the strings around the samples of crowded cores."""
    core, roll = Roller(101), Roller(303)
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        lists = batch.column("crowded")
        out: list[list] = [[], [], [], [], []]
        many = 0
        for i, (row, order) in enumerate(zip(batch.column("_row").to_pylist(), batch.column("ord").to_pylist())):
            pos = np.sort(lists[i].values.to_numpy().astype(np.int64))
            own = data[offsets[i] : offsets[i + 1]]
            keys = core.spans(core.sums(own), pos, pos + CORE).view(np.int64)
            sums, last = roll.sums(own), {}
            for p, k in zip(pos.tolist(), keys.tolist()):
                # A string that holds its core twice belongs to the core's first place, as in ``_merge``.
                start = np.arange(max(p - REACH, 0, last.get(k, -1) + 1), min(p, len(own) - WIDTH) + 1)
                last[k] = p
                for column, x in zip(out, (np.full(len(start), k), roll.spans(sums, start, start + WIDTH).view(np.int64), np.full(len(start), order), np.full(len(start), row), start)):
                    column.append(x)
                many += len(start)
            if many > 100_000 or i == batch.num_rows - 1:
                columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 4 + [pa.int32()])], names=["key", "name", "ord", "_row", "at"])
                out, many = [[], [], [], [], []], 0


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border samples sorted by core and text order -> ranges of starts of strings that occurred before.

    State is the names of the strings around the core at hand; a core's rows can span any number of batches."""
    roll = Roller(303)
    span = REACH + WIDTH
    roll._grow(span + 1)
    last, last_row, last_at, seen = None, None, 0, np.empty(0, np.uint64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, row = batch.column("key").to_numpy(), batch.column("_row").to_numpy()
        at, left = batch.column("at").to_numpy().astype(np.int64), batch.column("before").to_numpy().astype(np.int64)
        data, offsets = texts(batch.column("bytes").cast(pa.large_binary()).view(pa.large_string()))
        length = np.diff(offsets)
        grid = np.zeros((n, span), np.uint8)
        where = np.repeat(np.arange(n) * span + REACH - left - offsets[:-1], length) + np.arange(offsets[0], offsets[-1])
        grid.ravel()[where] = data[offsets[0] : offsets[-1]]
        sums = np.zeros((n, span + 1), np.uint64)
        np.cumsum(roll.values[grid] * roll.powers[:span], axis=1, out=sums[:, 1:])
        start = np.arange(REACH + 1)
        names = (sums[:, start + WIDTH] - sums[:, start]) * roll.inverses[start]
        names = mix(mix(names) + key.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
        valid = (start[None, :] >= (REACH - left)[:, None]) & (start[None, :] + WIDTH <= (REACH - left + length)[:, None])
        # A string that holds its core twice would meet itself: it belongs to the core's first place.
        joins = last_at - at[0] + REACH + 1 if (key[0], row[0]) == (last, last_row) else 0
        follows = np.concatenate(([joins], np.where((key[1:] == key[:-1]) & (row[1:] == row[:-1]), at[:-1] - at[1:] + REACH + 1, 0)))
        valid &= start[None, :] >= follows[:, None]
        flat, index = names[valid], np.flatnonzero(valid)
        text = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))[index // (REACH + 1)]
        by = np.lexsort((at[index // (REACH + 1)] + index % (REACH + 1), text, flat))
        again = np.zeros(len(flat), bool)
        again[by[1:]] = flat[by][1:] == flat[by][:-1]
        head = int(np.searchsorted(key != key[0], True)) if key[0] == last else 0
        in_head = index < head * (REACH + 1)
        if head:
            again[in_head] |= np.isin(flat[in_head], seen)
        tail = int(n - np.searchsorted(key[::-1] != key[-1], True))
        in_tail = index >= tail * (REACH + 1)
        seen = np.union1d(seen, flat[in_tail]) if key[-1] == last else np.unique(flat[in_tail])
        last, last_row, last_at = key[-1], row[-1], at[-1]
        hit = np.zeros((n, REACH + 3), np.int8)
        marks = np.zeros(n * (REACH + 1), np.int8)
        marks[index[again]] = 1
        hit[:, 1:-1] = marks.reshape(n, REACH + 1)
        step = np.diff(hit, axis=1)
        r, low = np.nonzero(step == 1)
        _, high = np.nonzero(step == -1)
        shift = at[r] - REACH
        yield pa.RecordBatch.from_arrays([pa.array(row[r]), pa.array((low + shift).astype(np.int32)), pa.array((high - 1 + shift).astype(np.int32))], names=["_row", "low", "high"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        out: list[list] = [[], [], [], [], []]
        for i, row in enumerate(batch.column("_row").to_pylist()):
            own = data[offsets[i] : offsets[i + 1]]
            n = len(own)
            pos = batch.column("full")[i].values.to_numpy().astype(np.int64)
            low = [np.maximum(pos - REACH, 0)]
            high = [np.minimum(pos, n - WIDTH)]
            for name in ("ranges", "merged"):
                pairs = batch.column(name)[i].values
                if pairs is not None and len(pairs):
                    first, last = pairs.flatten()
                    low.append(first.to_numpy().astype(np.int64))
                    high.append(last.to_numpy().astype(np.int64))
            low, high = np.concatenate(low), np.concatenate(high)
            real = high >= low
            change = np.bincount(low[real], minlength=n + 1) - np.bincount(high[real] + WIDTH, minlength=n + 1)
            gone = np.cumsum(change[:n]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
            kept = own[~gone].tobytes()
            for column, x in zip(out, (row, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)):
                column.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["_row", "n_removed", "n_spans", "kept_sha256", "kept"])


def _repeated(strings: DataFrame) -> DataFrame:
    """The ``strings`` (key, name, ord, _row, at) that occurred before. One that many texts hold is dealt to ``DEALS``
    tasks; only the first of each part, whose ``deal`` is null then, meet each other."""
    place = lambda: F.row_number().over(Window.partitionBy("key", "name", "deal").orderBy("ord", "_row", "at"))
    dealt = strings.withColumn("deal", F.pmod("_row", F.lit(DEALS)))
    dealt = dealt.withColumn("deal", F.when(place() > 1, F.col("deal")))
    return dealt.withColumn("place", place()).where("deal is not null or place > 1")


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) -> ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Every byte in a string of WIDTH bytes that also starts earlier (smaller doc_id; then file order; then earlier
    in the text) is removed. Strings are judged on the input and never cross documents. Null texts are empty;
    texts under WIDTH bytes lose nothing; null doc_ids come last; rows with equal doc_id are separate texts in
    file order. Other columns of ``docs`` are ignored. With ``with_kept`` also ``kept``, the bytes that are left
    (null where nothing was removed).
    """
    rows = numbered(docs.select("doc_id", "text"))
    samples = rows.where("text is not null").mapInArrow(_sample, _SAMPLES)
    # One exchange by core serves both windows.
    core = Window.partitionBy("core")
    triple = Window.partitionBy("core", "name").orderBy("ord", "_row", "at")
    named = (
        samples.repartition("core")
        .withColumn("place", F.row_number().over(triple))
        .withColumn("names", F.min("name").over(core) != F.max("name").over(core))
        .withColumn("crowd", F.count(F.lit(1)).over(core))
        .where("upto >= 0 or place > 1 or names")
    )
    kind = F.when(F.col("upto") >= 0, RANGE).when(F.col("place") > 1, FULL).when(F.col("crowd") > CROWD, CROWDED).otherwise(BORDER)
    each = named.select("_row", "ord", "at", "upto", kind.alias("kind")).groupBy("_row").agg(
        F.first("ord").alias("ord"),
        F.collect_list(F.when(F.col("kind") == FULL, F.col("at"))).alias("full"),
        F.collect_list(F.when(F.col("kind") == BORDER, F.col("at"))).alias("border"),
        F.collect_list(F.when(F.col("kind") == CROWDED, F.col("at"))).alias("crowded"),
        F.collect_list(F.when(F.col("kind") == RANGE, F.struct("at", "upto"))).alias("ranges"),
    )
    each = materialize(each)
    # All uses below read the one exchange of the texts.
    found = each.join(rows.select("_row", "text").hint("merge"), "_row")
    border = found.where(F.size("border") > 0).select("_row", "ord", "border", "text").mapInArrow(_contexts, "key bigint, ord bigint, _row bigint, at int, before int, bytes binary")
    merged = border.repartition("key").sortWithinPartitions("key", "ord", "_row", "at").mapInArrow(_merge, "_row bigint, low int, high int")
    if not each.where(F.size("crowded") > 0).isEmpty():
        crowded = found.where(F.size("crowded") > 0).select("_row", "ord", "crowded", "text")
        again = _repeated(crowded.mapInArrow(_strings, "key bigint, name bigint, ord bigint, _row bigint, at int"))
        merged = merged.unionByName(again.select("_row", F.col("at").alias("low"), F.col("at").alias("high")))
    merged = merged.groupBy("_row").agg(F.collect_list(F.struct("low", "high")).alias("merged"))
    cut = found.drop("ord", "border", "crowded").join(merged.hint("merge"), "_row", "left").where(F.col("merged").isNotNull() | (F.size("full") > 0) | (F.size("ranges") > 0))
    schema = "_row bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    cut = cut.mapInArrow(_remove, schema).withColumnRenamed("kept_sha256", "cut_sha256")
    if not with_kept:
        cut = cut.drop("kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = rows.select("_row", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("whole_sha256"))
    return whole.join(cut.hint("merge"), "_row", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
        *(["kept"] if with_kept else []),
    )


def op1_suffix_array(spark, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes removed from all ``documents``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
