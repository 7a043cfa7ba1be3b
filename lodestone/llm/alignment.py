"""Alignment of two tokenizers over a corpus: which of their tokens cover the same bytes, and how often.

Both tokenizers leave a single space between two other characters as the start of a token, so a text falls into units,
``" word"``, that both encode on their own and no token spans. A task encodes and aligns each distinct unit once; a
document is the sum of its units. Where tokens of both end, groups end; an A token and a B token are linked where
their bytes overlap, which is once for every stretch between two neighbouring ends of either.

A first pass counts the links of each pair of ids, a task at a time. The distinct pairs are dealt to buckets, each
bucket gets a minimal perfect hash, and the tasks' counts, written into dense vectors by hash, are added up a tree
of sums. The second pass aligns the documents again and looks the pairs' counts up by hash, with the keys beside the
counts to tell a pair from another. Tables of more than ``BLOCK_PAIRS`` pairs are looked up a block of buckets at a
time and the parts are added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import perfect
from .storage import materialize, scratch

#: Buckets of pairs; pairs of which a task counts before it hands them on; pairs broadcast at a time (16 bytes each).
BUCKETS, TASK_PAIRS, BLOCK_PAIRS = 1024, 1 << 20, 1 << 22
#: Units and their characters that a task keeps aligned; texts of so many characters are aligned at a time.
UNITS, UNIT_CHARS, TEXT_CHARS = 200_000, 1 << 24, 1 << 20
#: Vectors added up in one task of the tree.
FAN = 32
#: An id pair as one number: a * SHIFT + b.
SHIFT = 1 << 24

_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_level(path: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """The encoder of a byte-level file without special tokens, and the bytes of each id. A rank file of the same
    name beside it is run by ``tiktoken`` with the same ids, faster than ``tokenizers``."""
    import base64
    import json
    import os

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            lengths[i] = len(token)
        run = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        return run.encode_ordinary, lengths
    from tokenizers import Tokenizer

    run = Tokenizer.from_file(path)
    run.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    lengths = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        lengths[i] = len(token)  # one character a byte
    return lambda text: run.encode(text, add_special_tokens=False).ids, lengths


def pieces(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """The encoder of a sentencepiece file, which puts a space in front, and the bytes of each id."""
    import sentencepiece

    run = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(run.get_piece_size()):
        piece = run.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if run.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: run.encode(texts, num_threads=1), table


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a``, ``b``: ascending byte offsets where tokens end, the last ones equal. Numbers of the linked tokens, link by
    link, and whether a group ends with the link."""
    ends = np.concatenate((a, b))
    ends.sort(kind="stable")  # merges two sorted runs
    ends = ends[np.diff(ends, prepend=-1) > 0]
    i, j = np.searchsorted(a, ends), np.searchsorted(b, ends)
    return i, j, (a[i] == ends) & (b[j] == ends)


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers up to ``most``, left-aligned with room for a separator, and their lengths."""
    text = [str(i).encode() for i in range(most + 1)]
    width = len(text[-1]) + 1
    return np.frombuffer(b"".join(t.ljust(width, b",") for t in text), np.uint8).reshape(-1, width), np.array(list(map(len, text)))


class _Seen(dict):
    """Numbers units in the order in which they are first met."""

    fresh: list[str]

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.fresh.append(unit)
        return number


class Aligner:
    """Aligned units of one task. Numbers of a unit: ``n_a, n_b, n_groups, n_links``; ``codes[starts[u]:starts[u + 1]]``
    are its pairs; ``bad`` where B's bytes aren't the unit's."""

    def __init__(self, a_path: str, b_path: str, with_groups: bool):
        self.encode_a, self.a_bytes = byte_level(a_path)
        self.encode_b, table = pieces(b_path)
        self.b_table, self.b_bytes = table, np.array(list(map(len, table)), np.int64)
        self.with_groups = with_groups
        if with_groups:
            self.digits, self.digit_n = _digits(max(len(self.a_bytes), len(table)))
        self.clear()

    def clear(self) -> None:
        self.seen, self.chars = _Seen(), 0
        self.seen.fresh = []
        self.numbers, self.bad, self.groups = np.zeros((0, 4), np.int64), np.zeros(0, bool), []
        self.codes, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.seen) > UNITS or self.chars > UNIT_CHARS or len(self.codes) > TASK_PAIRS

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units of all ``texts``, one after the other, and where each text's begin (and the last ends)."""
        parts = [_CUT.split(t) if t else [] for t in texts]
        at = np.cumsum([0, *map(len, parts)])
        of = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(parts)), np.int64, int(at[-1]))
        if self.seen.fresh:
            self._add(self.seen.fresh)
            self.chars += sum(map(len, self.seen.fresh))
            self.seen.fresh = []
        return of, at

    def whole(self, text: str) -> bool:
        of, _ = self.units([text])
        return not self.bad[of].any()

    def _encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A, and how many each unit has. Units that neither begin nor end with white space are encoded together,
        as the text they make with single spaces between them."""
        if len(units) > 1 and any(u[0].isspace() or u[-1].isspace() for u in units):
            half = len(units) // 2
            return tuple(np.concatenate(x) for x in zip(self._encode_a(units[:half]), self._encode_a(units[half:])))
        ids = np.asarray(self.encode_a(" " + " ".join(units)), np.int64)
        if len(units) == 1:
            return ids, np.array([len(ids)])
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        return ids, np.diff(np.searchsorted(np.cumsum(self.a_bytes[ids]), ends) + 1, prepend=0)

    def _add(self, units: list[str]) -> None:
        ids_a, n_a = self._encode_a(units)
        b = self.encode_b(units)
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        ids_b = np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        size = np.array([len(u.encode()) + 1 for u in units])
        bad = (_sums(self.a_bytes[ids_a], np.cumsum([0, *n_a])) != size) | (_sums(self.b_bytes[ids_b], np.cumsum([0, *n_b])) != size)
        if not bad.any():
            raw, bytes_b = b" " + " ".join(units).encode(), b"".join(map(self.b_table.__getitem__, ids_b.tolist()))
        if bad.any() or raw != bytes_b:
            table = self.b_table
            bad |= np.array([b"".join(map(table.__getitem__, ids)) != b" " + u.encode() for u, ids in zip(units, b)])
            ids_a, ids_b = ids_a[~np.repeat(bad, n_a)], ids_b[~np.repeat(bad, n_b)]
            n_a, n_b = np.where(bad, 1, n_a), np.where(bad, 1, n_b)  # a stand-in that aligns: one token each
            ids_a, ids_b = (np.insert(ids, (np.cumsum(np.where(bad, 0, n)) - np.where(bad, 0, n))[bad], 0) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        len_a, len_b = self.a_bytes[ids_a], self.b_bytes[ids_b]
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        len_a[first_a[bad]] = len_b[first_b[bad]] = 1
        i, j, ends = align(np.cumsum(len_a), np.cumsum(len_b))
        codes = ids_a[i] * SHIFT + ids_b[j]
        unit_of_a = np.repeat(np.arange(len(units)), n_a)
        links = np.bincount(unit_of_a[i], minlength=len(units))
        groups = np.bincount(unit_of_a[i[ends]], minlength=len(units))
        numbers = np.stack([n_a, n_b, groups, links], axis=1)
        self.numbers, self.bad = np.concatenate([self.numbers, numbers]), np.concatenate([self.bad, bad])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(links)])
        self.codes = np.concatenate([self.codes, codes])
        if self.with_groups:
            self.groups += self._texts(ids_a, ids_b, i[ends], j[ends], np.cumsum(groups))

    def _texts(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, upto: np.ndarray) -> list[str]:
        """``a1,a2|b1;...`` of each unit; ``upto``: groups up to the end of each. ``last_a``, ``last_b``: numbers of
        each group's last tokens."""
        group_a, group_b = np.searchsorted(last_a, np.arange(len(ids_a))), np.searchsorted(last_b, np.arange(len(ids_b)))
        ids, separator = np.zeros(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        before_b = np.concatenate(([0], last_b + 1))  # B tokens before a group
        place_a, place_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + last_a[group_b] + 1
        ids[place_a], ids[place_b] = ids_a, ids_b
        separator[place_a[last_a]], separator[place_b[last_b]] = ord("|"), ord(";")
        cells, n = self.digits[ids], self.digit_n[ids]
        cells[np.arange(len(ids)), n] = separator
        text = cells[np.arange(cells.shape[1]) <= n[:, None]].tobytes().decode()
        chars = np.cumsum(n + 1)[place_b[last_b[upto - 1]]]
        return [text[x : y - 1] for x, y in zip([0, *chars[:-1].tolist()], chars.tolist())]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.concatenate((np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)))
    return run[at[1:]] - run[at[:-1]]


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, bool]]:
    """Runs of texts of ``TEXT_CHARS`` bytes together at most, or of one longer text (True)."""
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    i = 0
    while i < len(size):
        j = min(len(size), max(i + 1, int(np.searchsorted(at, at[i] + TEXT_CHARS, "right")) - 1))
        yield i, j, bool(at[j] - at[i] > TEXT_CHARS)
        i = j


def _segments(text: str) -> Iterator[str]:
    """A long text in parts of about ``TEXT_CHARS`` characters whose units are the text's."""
    start = 0
    while cut := _CUT.search(text, start + TEXT_CHARS):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def _count(a_path: str, b_path: str):
    """Texts -> ``bucket, codes, counts``: the links of each pair of ids in this task, by bucket."""

    def hand_on(codes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        distinct, at = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, np.concatenate([np.zeros(0, np.int64), *counts]))
        bucket = perfect.bucket_of(distinct, BUCKETS)
        order = np.argsort(bucket, kind="stable")
        mine, first = np.unique(bucket[order], return_index=True)
        ends = np.append(first, len(order)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(mine, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(distinct[order])), pa.ListArray.from_arrays(ends, pa.array(total[order]))], names=["bucket", "codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Aligner(a_path, b_path, False)
        uses, codes, counts, held = np.zeros(0, np.int64), [], [], 0

        def use(of: np.ndarray) -> None:
            nonlocal uses
            now = np.bincount(of, minlength=len(units.seen))
            now[: len(uses)] += uses
            uses = now

        def close() -> None:
            nonlocal uses, held
            n = np.diff(units.starts)
            used = np.repeat(uses > 0, n)
            codes.append(units.codes[used])
            counts.append(np.repeat(uses, n)[used])
            held += len(codes[-1])
            units.clear()
            uses = np.zeros(0, np.int64)

        for batch in batches:
            column = batch.column("text")
            for i, j, long in _runs(column):
                if not long:
                    of, at = units.units(column.slice(i, j - i).to_pylist())
                    use(of[np.repeat(_sums(units.bad[of].astype(np.int64), at) == 0, np.diff(at))])
                elif all(units.whole(s) for s in _segments(column[i].as_py())):
                    for s in _segments(column[i].as_py()):
                        use(units.units([s])[0])
                if units.full():
                    close()
                    if held > 4 * TASK_PAIRS:
                        yield hand_on(codes, counts)
                        codes, counts, held = [], [], 0
        close()
        yield hand_on(codes, counts)

    return run


_TABLE = "bucket int, sizes array<int>, words binary, codes array<bigint>, counts array<bigint>"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's distinct pairs -> its perfect hash and the pairs in the order of their indices."""
    for batch in batches:
        out = []
        for bucket, codes in zip(batch.column("bucket").to_pylist(), batch.column("codes")):
            keys = codes.values.to_numpy(zero_copy_only=False)
            sizes, words = perfect.build(keys)
            ordered = np.empty(len(keys), np.int64)
            ordered[perfect.Index([bucket], [sizes], [words], BUCKETS)(keys)] = keys
            out.append({"bucket": bucket, "sizes": sizes, "words": words.tobytes(), "codes": ordered})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("codes", pa.list_(pa.int64()))]))


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by bucket and salt, the bucket's hash before its counts: one dense vector of counts for each."""
    key, index, total = None, None, np.zeros(0, np.int64)
    schema = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("total", pa.list_(pa.int64()))])
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            bucket, salt, n = (batch.column(c)[r].as_py() for c in ("bucket", "salt", "n"))
            if n is not None:  # the hash
                if key is not None:
                    out.append({"bucket": key[0], "salt": key[1], "total": total})
                key, total = (bucket, salt), np.zeros(n, np.int64)
                index = perfect.Index([bucket], [batch.column("sizes")[r].as_py()], [np.frombuffer(batch.column("words")[r].as_py(), np.uint64)], BUCKETS)
            else:
                codes, counts = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("codes", "counts"))
                total[index(codes)] += counts  # a task's pairs are distinct
        yield pa.RecordBatch.from_pylist(out, schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"bucket": key[0], "salt": key[1], "total": total}], schema)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors sorted by bucket and salt, added up."""
    key, total = None, np.zeros(0, np.int64)
    schema = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("total", pa.list_(pa.int64()))])
    for batch in batches:
        out = []
        for bucket, salt, own in zip(batch.column("bucket").to_pylist(), batch.column("salt").to_pylist(), batch.column("total")):
            if key != (bucket, salt):
                if key is not None:
                    out.append({"bucket": key[0], "salt": key[1], "total": total})
                key, total = (bucket, salt), np.zeros(len(own), np.int64)
            total = total + own.values.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pylist(out, schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"bucket": key[0], "salt": key[1], "total": total}], schema)


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Links of all ``docs`` (text) by pair: a row a bucket, with its perfect hash and, by index, pairs and counts."""
    local = materialize(docs.select("text").mapInArrow(_count(a_path, b_path), "bucket int, codes array<bigint>, counts array<bigint>").withColumn("_part", F.spark_partition_id()))
    distinct = local.select("bucket", F.explode("codes").alias("code")).distinct()
    keys = distinct.groupBy("bucket").agg(F.collect_list("code").alias("codes"))
    hashes = materialize(keys.mapInArrow(_hashes, "bucket int, sizes array<int>, words binary, codes array<bigint>"))
    parts = local.agg(F.max("_part")).first()[0]
    salts = 1 + (parts or 0) // FAN
    head = hashes.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.size("codes").alias("n"), "sizes", "words")
    rows = head.unionByName(local.select("bucket", (F.col("_part") % salts).cast("int").alias("salt"), "codes", "counts"), allowMissingColumns=True)
    rows = rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("n").isNull())
    vectors = rows.mapInArrow(_dense, "bucket int, salt int, total array<bigint>")
    while salts > 1:  # the tree
        salts = -(-salts // FAN)
        vectors = vectors.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int")).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(_add, "bucket int, salt int, total array<bigint>")
    return materialize(hashes.join(vectors.select("bucket", F.col("total").alias("counts")), "bucket"))


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, counts in zip(batch.column("codes"), batch.column("counts")):
            b, n = codes.values.to_numpy(zero_copy_only=False) % SHIFT, counts.values.to_numpy(zero_copy_only=False)
            ids, at = np.unique(b, return_inverse=True)
            most = np.zeros(len(ids), np.int64)
            np.maximum.at(most, at, n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(most)], names=["b", "most"])


def _look_up(a_path: str, b_path: str, table, best):
    """Documents aligned again, their links' counts looked up in one block of the table."""
    names = ["_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, most = table.value, best.value
        index = perfect.Index([b[0] for b in blocks], [b[1] for b in blocks], [np.frombuffer(b[2], np.uint64) for b in blocks], BUCKETS)
        keys, counts = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(b[k], np.int64) for b in blocks)]) for k in (3, 4))
        units, found = Aligner(a_path, b_path, True), np.zeros((0, 2), np.int64)

        def documents(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
            """Sums of each text, whether all of its units are good, and its groups."""
            nonlocal found
            of, at = units.units(texts)
            if len(units.numbers) > len(found):
                new = units.codes[units.starts[len(found)] :]
                here = index(new)
                known = (here >= 0) & (keys[here] == new) if len(keys) else np.zeros(len(new), bool)
                n = np.where(known, counts[here], 0) if len(keys) else np.zeros(len(new), np.int64)
                top = known & (n == most[new % SHIFT])
                cut = units.starts[len(found) :] - units.starts[len(found)]
                found = np.concatenate([found, _sums(np.stack([top, n], axis=1).astype(np.int64), cut)])
            groups = units.groups
            cut = zip(at[:-1].tolist(), at[1:].tolist())
            return _sums(np.concatenate([units.numbers[of], found[of]], axis=1), at), _sums(units.bad[of].astype(np.int64), at) == 0, [";".join(map(groups.__getitem__, of[x:y].tolist())) for x, y in cut]

        for batch in batches:
            column = batch.column("text")
            for i, j, long in _runs(column):
                if not long:
                    sums, good, groups = documents(column.slice(i, j - i).to_pylist())
                    digest = [hashlib.sha256(g.encode()).hexdigest() if ok and g else "" for ok, g in zip(good, groups)]
                else:
                    sums, good, sha = np.zeros((1, 6), np.int64), np.ones(1, bool), hashlib.sha256()
                    for k, s in enumerate(_segments(column[i].as_py())):
                        more, ok, groups = documents([s])
                        sums, good = sums + more, good & ok
                        sha.update(((";" if k else "") + groups[0]).encode())
                    digest = [sha.hexdigest() if good[0] else ""]
                sums = np.where(good[:, None], sums, 0)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column("_row"), own.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in sums.T), pa.array(digest, pa.string())], names=names)
                if units.full():
                    units.clear()
                    found = found[:0]

    return run


def align_corpus(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``docs`` (doc_id, text) -> one row each: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A (a byte-level file) encodes a space and the text, B (a sentencepiece file) the text, both without special
    tokens. A null or empty text, or one that B doesn't give back byte by byte, has no tokens: zeros and ''. A pair's
    count is the number of links of the corpus between these two ids; a link is among ``n_best`` if its pair has the
    highest count of all pairs of its B id. Repeated rows and rows with equal or null doc_id are separate documents; an
    empty table stays empty; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    schema = "_row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    with scratch(spark):
        table = pair_counts(docs, a_path, b_path)
        sizes = {r["bucket"]: r["n"] for r in table.select("bucket", F.size("codes").alias("n")).collect()}  # BUCKETS rows
        most = np.zeros(1, np.int64)
        for r in table.select("codes", "counts").mapInArrow(_best, "b int, most bigint").groupBy("b").agg(F.max("most").alias("most")).collect():  # a row a B id
            if r["b"] >= len(most):
                most = np.concatenate([most, np.zeros(r["b"] + 1, np.int64)])
            most[r["b"]] = r["most"]
        best = spark.sparkContext.broadcast(most)
        blocks, room = [[]], BLOCK_PAIRS
        for bucket in sorted(sizes):
            if sizes[bucket] > room and blocks[-1]:
                blocks, room = [*blocks, []], BLOCK_PAIRS
            blocks[-1].append(bucket)
            room -= sizes[bucket]
        out = None
        for block in blocks:
            found = table.where(F.col("bucket").between(block[0], block[-1]) if block else F.lit(False)).toArrow().sort_by("bucket")
            held = [(b, s, w, *(found[c][r].values.to_numpy().tobytes() for c in ("codes", "counts"))) for r, (b, s, w) in enumerate(zip(*(found[c].to_pylist() for c in ("bucket", "sizes", "words"))))]
            part = rows.mapInArrow(_look_up(a_path, b_path, spark.sparkContext.broadcast(held), best), schema)
            out = part if out is None else out.unionByName(part)
        if len(blocks) > 1:  # each block counts the links of its own pairs
            same = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            out = out.groupBy("_row").agg(*(F.first(c).alias(c) for c in same), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        return materialize(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), keep=True)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` aligned between a byte-level and a piece tokenizer."""
    import public_tokenizers

    return align_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
