"""Exact duplicates by composable polynomial fingerprints.

A text is normalised (each run of white space becomes one space) and cut into pieces of ``PIECE`` bytes, written once:
a huge document is then spread over the splits of that table. Pieces are hashed wherever they lie, each as
``sum(byte[i] * base**i)`` modulo a prime, together with ``base**length``; the hash of two joined pieces is
``hash(x) + base**len(x) * hash(y)``, so a document's fingerprint is a fold over its few pieces. Two primes and the
length make the fingerprint. Equal fingerprints are no proof: each such row is compared piece by piece with its
group's first row, in groups dealt by piece and salt, holding one piece at a time. Rows that differ after all start
over among themselves, until none differs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import SLICE, slices, texts
from .storage import materialize, scratch

#: Bytes of a piece: 9 bits of a byte, 31 of a power and 18 of a piece's length stay below 63.
PIECE = 1 << 18
#: The two largest primes below 2**31.
PRIMES = (2147483647, 2147483629)
#: Rows of a group that are compared in one task with a copy of the first; groups that are broadcast at most, and
#: their least rows; rows that are broadcast at most.
SALT_ROWS, HOT_GROUPS, HOT_ROWS, BROADCAST_ROWS = 64, 1000, 1000, 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PIECES = "_row bigint, doc_id bigint, at int, sha string, bytes binary"


def _collapse(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``raw`` with every run of white space as one space, and which bytes stayed. ``first`` marks bytes before which
    no run reaches back."""
    space = _SPACE[raw]
    again = np.zeros(len(raw), bool)
    again[1:] = space[1:] & space[:-1]
    keep = ~again | first
    return np.where(space, np.uint8(0x20), raw)[keep], keep


def _stream(raw: np.ndarray) -> Iterator[bytes]:
    """A long text's normalised pieces; all but the last have ``PIECE`` bytes."""
    rest, after_space = b"", False
    for i in range(0, len(raw), SLICE):
        part = raw[i : i + SLICE]
        first = np.zeros(len(part), bool)
        first[0] = not after_space
        after_space, lead = bool(_SPACE[part[-1]]), after_space and bool(_SPACE[part[0]])
        done, _ = _collapse(part, first)
        rest += (done[1:] if lead else done).tobytes()
        while len(rest) > PIECE:
            yield rest[:PIECE]
            rest = rest[PIECE:]
    yield rest


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("sha", pa.string()), ("bytes", pa.binary())])
    for batch in batches:
        rows, ids = batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist()
        data, offsets = texts(batch.column("text"))
        for i, j in slices(offsets):
            if offsets[j] - offsets[i] > SLICE:  # one long text
                sha, held = hashlib.sha256(), None
                for k, piece in enumerate(_stream(data[offsets[i] : offsets[j]])):
                    sha.update(piece)
                    if held is not None:
                        yield pa.RecordBatch.from_pylist([held], schema)
                    held = {"_row": rows[i], "doc_id": ids[i], "at": k, "sha": None, "bytes": piece}
                yield pa.RecordBatch.from_pylist([held | {"sha": sha.hexdigest()}], schema)
                continue
            at = offsets[i : j + 1] - offsets[i]
            first = np.zeros(at[-1] + 1, bool)
            first[at] = True
            done, keep = _collapse(data[offsets[i] : offsets[j]], first[:-1])
            at = np.concatenate(([0], np.cumsum(keep)))[at]
            out = []
            for k in range(i, j):
                whole = done[at[k - i] : at[k - i + 1]].tobytes()
                pieces = [whole[x : x + PIECE] for x in range(0, max(1, len(whole)), PIECE)]
                for n, piece in enumerate(pieces):
                    last = n == len(pieces) - 1
                    out.append((rows[k], ids[k], n, hashlib.sha256(whole).hexdigest() if last else None, piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _hash(primes: tuple[int, int], seed: int = 13):
    """Hashes of pieces and the powers by which what follows them is shifted."""
    rng = np.random.default_rng(seed)
    bases = [int(rng.integers(p // 2, p)) for p in primes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = []
        for base, p in zip(bases, primes):
            table = np.ones(PIECE + 1, np.int64)
            done = 1
            while done <= PIECE:  # doubles the table
                step = table[:done] * pow(base, done, p) % p
                table[done : 2 * done] = step[: PIECE + 1 - done]
                done *= 2
            powers.append(table)
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for value in batch.column("bytes"):
                own = np.frombuffer(value.as_buffer(), np.uint8).astype(np.int64) + 1
                n = len(own)
                row = [n]
                for table, p in zip(powers, primes):
                    row += [int(np.dot(own, table[:n])) % p, int(table[n])]
                for column, x in zip(out, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), batch.column("at"), batch.column("sha"), *(pa.array(c, pa.int64()) for c in out)], names=["_row", "doc_id", "at", "sha", "n", "h1", "w1", "h2", "w2"])

    return run


def fingerprints(pieces: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``_row, doc_id, text_sha256`` and the fingerprint ``n, f1, f2`` of each document of ``pieces``."""
    schema = "_row bigint, doc_id bigint, at int, sha string, n bigint, h1 bigint, w1 bigint, h2 bigint, w2 bigint"
    hashed = pieces.mapInArrow(_hash(primes), schema)
    one = hashed.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("sha").alias("text_sha256"), F.array_sort(F.collect_list(F.struct("at", "n", "h1", "w1", "h2", "w2"))).alias("_all"))
    zero, unit = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def join(a: Column, x: Column) -> Column:
        shifted = ((a[h] + a[w] * x[h]) % F.lit(p) for h, w, p in (("h1", "w1", primes[0]), ("h2", "w2", primes[1])))
        powers = ((a[w] * x[w]) % F.lit(p) for w, p in (("w1", primes[0]), ("w2", primes[1])))
        (h1, h2), (w1, w2) = shifted, powers
        return F.struct((a["n"] + x["n"]).alias("n"), h1.alias("h1"), w1.alias("w1"), h2.alias("h2"), w2.alias("w2"))

    start = F.struct(zero.alias("n"), zero.alias("h1"), unit.alias("w1"), zero.alias("h2"), unit.alias("w2"))
    return one.withColumn("_f", F.aggregate("_all", start, join)).select("_row", "doc_id", "text_sha256", F.col("_f.n").alias("n"), F.col("_f.h1").alias("f1"), F.col("_f.h2").alias("f2"))


_PRINT = ["n", "f1", "f2"]
_FIRST = "struct(doc_id IS NULL, doc_id, _row)"


def _grouped(prints: DataFrame) -> DataFrame:
    """``prints`` with its group's first row ``rep``, that row's doc_id ``keep_id`` and ``group_size``.

    Groups of a thousandth of all rows and more are at most a thousand: these are broadcast and their rows aren't
    exchanged. All others are joined.
    """
    groups = prints.groupBy(*_PRINT).agg(F.count("*").alias("group_size"), F.min(F.expr(_FIRST)).alias("_first")).where("group_size > 1")
    groups = materialize(groups.select(*_PRINT, "group_size", F.col("_first._row").alias("rep"), F.col("_first.doc_id").alias("keep_id")))
    bar = max(HOT_ROWS, prints.count() // HOT_GROUPS)
    hot, cold = F.broadcast(groups.where(F.col("group_size") >= bar)), groups.where(F.col("group_size") < bar)
    out = prints.join(hot, _PRINT).unionByName(prints.join(hot, _PRINT, "left_anti").join(cold, _PRINT, "left"), allowMissingColumns=True)
    return out.select("_row", "doc_id", "text_sha256", *_PRINT, F.coalesce("rep", "_row").alias("rep"), F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``rep, at, salt`` with the first row's piece in front; those whose piece differs from it."""
    key, head = None, b""
    for batch in batches:
        wrong = []
        for rep, at, salt, member, row, piece in zip(*(batch.column(c).to_pylist() for c in ("rep", "at", "salt", "member", "_row")), batch.column("bytes")):
            if not member:
                key, head = (rep, at, salt), piece.as_py()
            elif key != (rep, at, salt) or piece.as_py() != head:
                wrong.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.int64())], names=["_row"])


def _differing(pieces: DataFrame, grouped: DataFrame) -> DataFrame:
    """``_row`` of the rows that are unlike their group's first row."""
    some = grouped.where("group_size > 1").select("_row", "rep", F.ceil(F.col("group_size") / SALT_ROWS).cast("int").alias("_salts"))
    members = some.where("_row <> rep").select("_row", "rep", F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int").alias("salt"), F.lit(1).alias("member"))
    first = some.where("_row = rep").select("_row", "rep", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    wanted = materialize(members.unionByName(first))
    n = wanted.count()
    if n == 0:
        return wanted.select("_row")
    met = pieces.select("_row", "at", "bytes").join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "_row")
    met = met.repartition("rep", "at", "salt").sortWithinPartitions("rep", "at", "salt", "member")
    return materialize(met.mapInArrow(_compare, "_row bigint").distinct())


def exact_duplicates(docs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``docs`` (doc_id, text) -> one row each: ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes``.

    Texts are equal when identical after every run of white space ``[\\x20\\x09-\\x0D]+`` became one space; null counts
    as empty, empty texts are equal to each other. The row with the smallest doc_id stays (null last; of equal doc_ids
    the first in file order), ``keep_id`` is its doc_id. ``text_sha256`` and ``n_bytes`` are of the normalised text.
    Repeated rows are separate rows; an empty table stays empty; other columns are ignored. ``primes`` below 2**31.
    """
    spark = docs.sparkSession
    with scratch(spark):
        rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
        pieces = materialize(rows.mapInArrow(_cut, _PIECES))
        grouped = materialize(_grouped(materialize(fingerprints(pieces, primes))))
        wrong = _differing(pieces, grouped)
        if wrong.isEmpty():
            out = grouped
        else:
            settled = []
            while not wrong.isEmpty():
                settled.append(grouped.join(wrong, "_row", "left_anti"))
                grouped = materialize(_grouped(materialize(grouped.join(wrong, "_row", "left_semi").drop("rep", "keep_id", "group_size"))))
                wrong = _differing(pieces, grouped)
            out = grouped
            for done in settled:
                out = out.unionByName(done)
            sizes = out.groupBy("rep").agg(F.count("*").alias("group_size"))
            out = out.drop("group_size").join(sizes, "rep")
        out = out.withColumn("kept", F.col("_row") == F.col("rep")).withColumnRenamed("n", "n_bytes")
        return materialize(out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes"), keep=True)


def op13_exact(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates among all ``documents``, white space aside."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256, octet_length(encode(t)) AS n_bytes
FROM n WINDOW w AS (PARTITION BY t)"""
