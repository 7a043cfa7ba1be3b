"""Exact Jaccard components of documents by an n-gram join with adaptive multi-match prefixes.

Two sets of n and m shingles with 100 |A and B| >= P |A or B| share at least ceil(P n / 100) of A's and ceil(P m / 100)
of B's shingles. So in any global order of the shingles, for any l, they share at least l shingles of the first
n - ceil(P n / 100) + l of A and of the like prefix of B: each document may pick its own l, and a pair is verified
when it shares as many prefix shingles as the smaller of its two l. Documents with equal sets are one class.

The join runs twice. The first time every class has a prefix in the order of the hashes, with l of a tenth of
what a partner must share. A class that has fewer than l prefix shingles in common with any other class links with
nothing and is done; that takes one count over a quarter of all shingles and leaves near copies and little else.

The second time the order is by the exact number of documents that hold a shingle, rare ones first. Shingles that one
document alone holds (lone) match nothing; of the others up to ``RARE`` documents hold a rare one, more a frequent
one. Two documents whose frequent shingles alone don't reach the overlap share rare ones, how many follows from the
sizes; they meet over prefixes of their rare shingles, whose groups are small by definition. The others consist of
frequent shingles almost wholly, as copies of one text do. They meet over prefixes of their frequent shingles, together
with a class of sizes, since two sizes bound what both must hold. In both orders a document picks the l of least
estimated cost: a longer prefix costs index entries but asks for more matches.

Components need no list of all pairs within a group: first each prefix shingle links its documents to the one of
them with the least of its own, verified exactly; then all candidate pairs *between* the components found so far are
verified. Pairs inside a component can't change it, so no link between components is lost. Inside the join a pair is
dropped when the buckets that only one of the two has a shingle in leave less than the overlap.

Joins whose sides grow with the data are sort-merge joins at every size, so that small runs show the plan of large ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import Shingler
from .storage import materialize, numbered, scratch

#: A shingle of more documents than this is frequent. Steers cost, never the result.
RARE = 32
#: Cost of an index entry against one of comparing a shingle.
INDEX_COST = 20.0
#: Words of 64 buckets that tell which of them hold a document's shingles, for the bound on overlaps.
WORDS = 8
#: Ratio of the sizes in one class of sizes.
SIZE_CLASS = 1.05
#: Members that are compared with one document in one task.
MEMBERS_A_TASK = 2_000
_CHOICES = np.array([1, 2, 4, 8, 16, 32, 64, 128])


def _head(n: int, percent: int) -> tuple[int, int]:
    """Length of the first prefix of a set of ``n`` and how many of it the prefix of a similar set, which may be
    smaller and ask for fewer, shares."""
    need = (percent * n + 99) // 100
    smallest = (percent * need + 99) // 100
    return n - need + 1 + need // 10, 1 + smallest // 10


def _count_shingles(n: int, seed: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n, seed)
        for batch in batches:
            sizes, prints, heads, least = [], [], [], []
            for s in shingler.sets(batch.column("text")):
                m, k = _head(len(s), percent) if len(s) else (0, 0)
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
                heads.append(s[:m].view(np.int64))
                least.append(k)
            offsets = np.cumsum([0, *map(len, heads)])
            flat = np.concatenate(heads) if heads else np.empty(0, np.int64)
            short = [int.from_bytes(p[:8], "little", signed=True) if p else None for p in prints]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(short, pa.int64()), pa.array(least, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                names=["_row", "doc_id", "n", "print", "short", "least", "head"],
            )

    return run


def _sets(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n, seed)
        for batch in batches:
            sets = [s.view(np.int64) for s in shingler.sets(batch.column("text"))]
            offsets = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["_row", "entries"])

    return run


def prefix_of(held: np.ndarray, least: int) -> tuple[int, int]:
    """Length of the prefix of shingles that ``held`` documents hold each, in order, of which a similar set shares
    ``least`` in all, and how many of the prefix it shares: the ``l`` of least estimated cost."""
    met = np.cumsum(held.astype(np.float64))
    choices = _CHOICES[_CHOICES <= least]
    lengths = len(held) - least + choices
    cost = met[lengths - 1] / choices * len(held) + choices * INDEX_COST
    k = int(np.argmin(cost))
    return int(lengths[k]), int(choices[k])


def sign_of(shingles: np.ndarray) -> np.ndarray:
    """``WORDS`` words of bits, set where a shingle falls into the bucket of its last bits."""
    held = np.zeros(64 * WORDS, bool)
    held[shingles & (64 * WORDS - 1)] = True
    return np.packbits(held).view(np.int64)


def _prefixes(percent: int):
    """``_row, n, met`` (array of structs of the documents that hold it, ``c``, and the shingle, ``e``) -> the prefixes
    of the rare and the frequent ones, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = batch.column("met")
            offsets = met.offsets.to_numpy()
            inner = met.values
            counts, shingles = inner.field("c").to_numpy(), inner.field("e").to_numpy()
            columns: tuple[list, ...] = ([], [], [], [], [])
            entries: list[np.ndarray] = []
            signs = []
            for n, a, b in zip(batch.column("n").to_pylist(), offsets[:-1], offsets[1:]):
                c, e = counts[a:b], shingles[a:b]
                order = np.lexsort((e, c))
                c, e = c[order], e[order]
                need = (percent * n + 99) // 100
                m = int(np.searchsorted(c, RARE, "right"))
                signs.append(sign_of(e))
                rare, k = prefix_of(c[:m], max(1, need - (len(c) - m))) if m else (0, 0)
                hot, l = prefix_of(c[m:], max(1, need - m)) if len(c) - m >= need else (0, 0)
                for col, x in zip(columns, (len(c) - m, len(c), k, l, rare)):
                    col.append(x)
                entries.append(np.concatenate((e[:rare], e[m : m + hot])))
            ends = np.cumsum([0, *map(len, entries)])
            flat = np.concatenate(entries) if entries else np.empty(0, np.int64)
            sign = np.concatenate(signs) if signs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"),
                    batch.column("n"),
                    *(pa.array(x, pa.int32()) for x in columns),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(signs) + 1) * WORDS, pa.int32()), pa.array(sign)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["_row", "n", "frequent", "others", "krare", "khot", "rares", "sign", "entries"],
            )

    return run


_INFO = ("n", "frequent", "others", "krare", "khot", "sign")


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def _side(info: DataFrame, s: str) -> list[Column]:
    return [info[c].alias(s + c) for c in _INFO]


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(SIZE_CLASS))).cast("int")


def _overlap(percent: int) -> Column:
    """The overlap that sets of ``xn`` and ``yn`` shingles need."""
    return F.expr(f"({percent} * (xn + yn) + {99 + percent}) div {100 + percent}")


def _may_be_similar(percent: int) -> Column:
    """The sizes, and the buckets of the shingles that others hold too (``others``), allow the overlap: a bucket of one
    of the two alone holds a shingle that they don't share."""
    apart = sum((F.bit_count(F.col("xsign")[i].bitwiseXOR(F.col("ysign")[i])) for i in range(1, WORDS)), F.bit_count(F.col("xsign")[0].bitwiseXOR(F.col("ysign")[0])))
    most = F.col("xothers") + F.col("yothers") - apart
    return (100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")) & (F.least("xothers", "yothers") >= _overlap(percent)) & (most >= 2 * _overlap(percent))


def _verify(percent: int):
    """Rows sorted by ``a, part, b``; the row of ``a`` itself has a null ``b``. Yields the pairs that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found: tuple[list, list] = ([], [])
            sets = batch.column("entries")
            offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
            for a, b, i, j in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), offsets[:-1], offsets[1:]):
                s = flat[i:j]
                if b is None:
                    of, own = a, s.copy()
                elif of == a:
                    at = np.searchsorted(own, s)
                    both = int((own[np.minimum(at, len(own) - 1)] == s).sum())
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        found[0].append(a)
                        found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose shingles (in ``sets``) are similar. A document with many partners is sent to as many
    tasks as they need."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_A_TASK).cast("int").alias("parts"))
    other = sets.select(F.col("_row").alias("b"), "entries")
    members = _join(pairs, many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = _join(members, other, "b").select("a", "part", "b", "entries")
    own = _join(many, sets.select(F.col("_row").alias("a"), "entries"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"), "entries")
    return own.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "b").mapInArrow(_verify(percent), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, seed: int = 5) -> DataFrame:
    """As ``_components``, for every row: ``doc_id, n_shingles, component_id``, the smallest doc_id of its component."""
    placed = _components(numbered(docs.select("doc_id", "text")), n, percent, seed)
    ids = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(ids, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, seed: int = 5) -> DataFrame:
    """``docs`` with one row of each component of similar texts, the one of smallest doc_id (null last), then the
    first in file order. Rows without words all stay. All columns are kept."""
    rows = numbered(docs.drop("_row"))
    placed = _components(rows.select("_row", "doc_id", "text"), n, percent, seed)
    first = placed.groupBy("component").agg(F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    gone = materialize(placed.join(first, "component").where("_row <> first").select("_row"))
    return rows.join(gone, "_row", "left_anti").drop("_row")


def _crossing(index: DataFrame, group: DataFrame, info: DataFrame, percent: int, frequent: bool) -> DataFrame:
    """Pairs ``a, b`` of different components (``group``) that share enough of the prefixes in ``index``."""
    grouped = _join(index, group, "_row", "left").withColumn("component", F.coalesce("component", "_row"))
    each = grouped.groupBy("entry", "component").agg(F.count("*").alias("c"))
    main = each.groupBy("entry").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("components")).where("components > 1").drop("components")
    grouped = materialize(_join(_join(grouped, main, "entry"), info, "_row"))
    # Of two documents in different components one at least is outside the entry's main component, so only those
    # look for partners: pairs inside a large component are never met.
    x = grouped.where("component <> main").select(F.col("entry").alias("xentry"), F.col("_row").alias("a"), F.col("component").alias("ca"), *_side(grouped, "x"))
    y = grouped.select(F.col("entry").alias("yentry"), F.col("_row").alias("b"), F.col("component").alias("cb"), (F.col("component") == F.col("main")).alias("in_main"), *_side(grouped, "y"))
    shared = F.least("xfrequent", "yfrequent")
    keys = F.col("xentry") == F.col("yentry")
    if frequent:
        # A partner is no smaller than the overlap and no larger than this document's frequent shingles allow.
        low = F.expr(f"({percent} * xn + 99) div 100")
        high = F.least(F.expr(f"100 * xn div {percent}"), F.expr(f"{100 + percent} * xfrequent div {percent} - xn"))
        x = x.where(low <= high).withColumn("xsize", F.explode(F.sequence(_size_class(low), _size_class(high))))
        y = y.withColumn("ysize", _size_class(F.col("yn")))
        keys = keys & (F.col("xsize") == F.col("ysize"))
    decided = (shared >= _overlap(percent)) if frequent else (shared < _overlap(percent))
    least = F.least("xkhot", "ykhot") if frequent else F.least("xkrare", "ykrare")
    pairs = _join(x, y, keys & (F.col("ca") != F.col("cb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & decided & _may_be_similar(percent))
    counted = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("c"), F.first(least).alias("least"))
    return counted.where("c >= least").select("a", "b")


def _components(rows: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """``rows`` (_row, doc_id, text; numbered once) -> ``_row, doc_id, n, component`` (a row number) for every row.

    Two rows link when their sets of ``n``-word shingles (A-Z lower-cased) overlap by ``percent`` % of their union
    or more; a component is all rows reachable by links. A text with fewer than
    ``n`` words is one shingle; null texts and texts without words have no shingles and link with nothing. Rows
    with equal doc_id or null doc_id are separate rows; a component of null ids only has a null id.
    """
    with scratch(rows.sparkSession):
        listed, classes = _classes(rows, n, percent, seed)
        met = classes.where("meets").select(F.col("rep").alias("_row"), "n")
        sets = materialize(_join(rows.select("_row", "text"), met, "_row", "left_semi").mapInArrow(_sets(n, seed), "_row bigint, entries array<bigint>"))
        prefixes = materialize(_met(sets, met, percent).mapInArrow(_prefixes(percent), "_row bigint, n bigint, frequent int, others int, krare int, khot int, rares int, sign array<bigint>, entries array<bigint>"))
        group = connected_components(_links(prefixes, sets, percent)).select(F.col("node").alias("rep"), "component")
        class_of = classes.select("print", "rep").join(group, "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
        return materialize(listed.join(class_of, "print", "left").select("_row", "doc_id", "n", F.coalesce("component", "_row").alias("component")), keep=True)


def _classes(rows: DataFrame, n: int, percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``_row, doc_id, n, print`` of every row, and ``print, rep, n, meets`` of every set that occurs."""
    with scratch(rows.sparkSession):
        counted = materialize(rows.mapInArrow(_count_shingles(n, seed, percent), "_row bigint, doc_id bigint, n bigint, print binary, short bigint, least int, head array<bigint>"))
        # Equal sets have equal prints: a shingle whose least and greatest (short) print are equal is in one class only.
        held = counted.select("short", F.explode("head").alias("entry")).groupBy("entry").agg(F.min("short").alias("short"), F.max("short").alias("other"))
        lone = held.where("short = other").groupBy("short").agg(F.count("*").alias("lone"))
        classes = counted.where("n > 0").groupBy("print").agg(F.min("_row").alias("rep"), F.first("n").alias("n"), F.first("short").alias("short"), F.first(F.size("head") - F.col("least")).alias("most"))
        classes = _join(classes, lone, "short", "left").select("print", "rep", "n", (F.coalesce("lone", F.lit(0)) <= F.col("most")).alias("meets"))
        return materialize(counted.select("_row", "doc_id", "n", "print"), keep=True), materialize(classes, keep=True)


def _met(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``_row, n, met``: each set's shingles that other sets hold too, where they can be enough."""
    entries = sets.select("_row", F.explode("entries").alias("e"))
    counts = entries.groupBy("e").agg(F.count("*").alias("c")).where("c > 1")
    held = _join(entries, counts, "e").groupBy("_row").agg(F.collect_list(F.struct("c", "e")).alias("met"))
    return _join(held, sizes, "_row").where(100 * F.size("met") >= percent * F.col("n")).select("_row", "n", "met")


def _links(prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Similar pairs ``a, b`` that have the components of all similar pairs."""
    info = prefixes.select("_row", *_INFO)
    index = prefixes.select("_row", (F.col("n") - F.col("frequent")).alias("own"), "rares", F.posexplode("entries").alias("at", "entry")).select("_row", "own", "entry", (F.col("at") >= F.col("rares")).alias("frequent"))
    pivots = index.groupBy("entry").agg(F.min_by("_row", F.struct("own", "_row")).alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    index = materialize(_join(index, pivots, "entry"))

    starred = index.where("_row <> a").select("a", F.col("_row").alias("b")).distinct()
    for s, key in (("x", "a"), ("y", "b")):
        starred = _join(starred, info.select(F.col("_row").alias(key), *_side(info, s)), key)
    tried = materialize(starred.where(_may_be_similar(percent)).select("a", "b"))
    links = materialize(_similar(tried, sets, percent))

    group = connected_components(links).select(F.col("node").alias("_row"), "component")
    kinds = [_crossing(index.where("frequent" if kind else "not frequent").select("entry", "_row"), group, info, percent, kind) for kind in (False, True)]
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = materialize(_join(kinds[0].unionByName(kinds[1]), known, ["a", "b"], "left_anti"))
    return links.unionByName(_similar(crossing, sets, percent))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` over 4-word shingles at a Jaccard similarity of 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
