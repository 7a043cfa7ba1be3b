"""Which names occur in which texts, by Aho-Corasick automata: a text is walked once, whatever the number of names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import written

#: Names and their characters in one automaton; more are dealt to several, each of which walks the texts.
SHARD_NAMES, SHARD_CHARS = 200_000, 1 << 23
#: Characters of a name that a text must hold before more of it is looked up.
HEAD = 8
#: Pairs put out at a time.
PAIRS = 100_000
#: Parts of a document that holds a thousandth of all chunks or more; there are a thousand such documents at most.
HOT_PARTS, HOT_DOCUMENTS, HOT_ROWS = 64, 1000, 10_000


def automaton(names: list[str]):
    """An automaton whose matches are numbers of ``names``; none without names."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, name in enumerate(names):
        made.add_word(name, i)
    if not names:
        return None
    made.make_automaton()
    return made


def found_in(made, text: str | None) -> list[int]:
    """Numbers of the names that ``text`` contains, each once, ascending."""
    return sorted({i for _, i in made.iter(text)}) if made is not None and text else []


def _shards(names: DataFrame) -> Iterator[list[str]]:
    """The distinct non-empty names of the column ``key`` in lists of bounded size, one at a time on the driver."""
    keys = written(names.select("key").where("key <> ''").distinct(), "names")
    n, chars = keys.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_NAMES), -(-chars // SHARD_CHARS))
    dealt = keys.withColumn("_shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    for s in range(shards):
        yield [r["key"] for r in dealt.where(F.col("_shard") == s).select("key").collect()]


def _walked(texts: DataFrame, column: str, keys: list[str], emit: Callable, schema: T.StructType) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        made = automaton(names)
        for batch in batches:
            yield from emit(batch, [found_in(made, t) for t in batch.column(column).to_pylist()], names)

    return texts.mapInArrow(run, schema)


def contained(texts: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``texts`` without ``column`` for each distinct ``key`` of ``names`` (not empty) that ``column`` contains, with
    ``key``. Letters count as they are: lower both sides to ignore case. Null texts contain nothing."""
    keep = [c for c in texts.columns if c != column]
    schema = T.StructType([*(texts.schema[c] for c in keep), T.StructField("key", T.StringType())])

    def emit(batch: pa.RecordBatch, hits: list[list[int]], keys: list[str]) -> Iterator[pa.RecordBatch]:
        at, of = [], []
        for i, own in enumerate(hits):
            at += [i] * len(own)
            of += [keys[k] for k in own]
            if len(at) >= PAIRS or i == len(hits) - 1:
                rows = batch.select(keep).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(of, pa.string())], names=[*keep, "key"])
                at, of = [], []

    out = None
    for keys in _shards(names):
        part = _walked(texts.select(*keep, column), column, keys, emit, schema)
        out = part if out is None else out.unionByName(part)
    return out


def count_contained(texts: DataFrame, column: str, names: DataFrame, out: str) -> DataFrame:
    """``texts`` with ``out``: how many distinct keys of ``names`` its ``column`` contains.

    Names of up to ``HEAD`` characters, and the beginnings of longer ones, make the automata. Where a text has such a
    beginning, its pieces of the lengths of the names that begin so meet the names in a join: automata grow with the
    beginnings, not with the names. Equal texts count as one until they get their number.
    """
    columns = [c for c in texts.columns if c != out]
    texts = texts.select(*columns, F.unhex(F.sha2(column, 256)).alias("_text_hash"))
    keys = written(names.select("key").where("key <> ''").distinct(), "names")
    heads = written(keys.groupBy(F.substring("key", 1, HEAD).alias("head")).agg(F.collect_set(F.length("key")).alias("lengths")), "heads")
    found = written(_beginnings(texts.where(F.col(column).isNotNull()), column, heads).distinct(), "found")
    long = found.where("piece IS NOT NULL").select("_text_hash", "piece").distinct().join(keys, F.col("piece") == F.col("key")).select("_text_hash", F.lit(1).cast("long").alias("n"))
    hits = long.unionByName(found.where("piece IS NULL").select("_text_hash", "n")).groupBy("_text_hash").agg(F.sum("n").alias("_n"))
    return texts.join(hits, "_text_hash", "left").select(*columns, F.coalesce("_n", F.lit(0).cast("long")).alias(out))


def _beginnings(texts: DataFrame, column: str, heads: DataFrame) -> DataFrame:
    """``_text_hash, shard, piece, n``: pieces of a text that begin with a ``head`` and have one of its ``lengths``; in a
    row without a piece, how many of the shard's heads that are whole names it contains."""
    kind = texts.schema["_text_hash"]
    schema = T.StructType([kind, T.StructField("shard", T.IntegerType()), T.StructField("piece", T.StringType()), T.StructField("n", T.LongType())])
    shards, out = max(1, -(-heads.count() // SHARD_NAMES)), None
    for shard in range(shards):
        part = heads.where(F.pmod(F.xxhash64("head"), F.lit(shards)) == shard).select("head", "lengths").toArrow()
        shared = texts.sparkSession.sparkContext.broadcast((part["head"].to_pylist(), part["lengths"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, shard=shard) -> Iterator[pa.RecordBatch]:
            names, lengths = shared.value
            whole = [min(n) <= HEAD for n in lengths]
            longer = [[x for x in n if x > HEAD] for n in lengths]
            made = automaton(names)
            for batch in batches:
                rows: list[tuple] = []
                for i, (own, text) in enumerate(zip(batch.column("_text_hash").to_pylist(), batch.column(column).to_pylist())):
                    known, pieces = set(), set()
                    for end, k in made.iter(text) if made is not None else ():
                        if whole[k]:
                            known.add(k)
                        start = end + 1 - len(names[k])
                        pieces.update(text[start : start + n] for n in longer[k] if start + n <= len(text))
                    rows += [(own, shard, piece, 0) for piece in pieces]
                    if known:
                        rows.append((own, shard, None, len(known)))
                    if len(rows) >= PAIRS or i == batch.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.binary(), pa.int32(), pa.string(), pa.int64()))], names=schema.names)
                        rows = []

        found = texts.select("_text_hash", column).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def contained_by_group(entities: DataFrame, texts: DataFrame, group: str, entity: str, text_id: str) -> DataFrame:
    """``group, entity, text_id``, distinct, where a text contains an entity's name of its own group.

    ``entities``: group, entity, ``name``; ``texts``: group, text_id, ``content``; both lower-cased by the caller. Each
    group's names make one automaton, ahead of its texts in the order of a partition; texts of a large group are
    dealt to parts, to each of which its names go. Rows without a group meet nothing.
    """
    texts = texts.where(F.col(group).isNotNull())
    sizes = texts.groupBy(group).agg(F.count("*").alias("_n"))
    bar = max(HOT_ROWS, texts.count() // HOT_DOCUMENTS)
    hot = F.broadcast(sizes.where(F.col("_n") >= bar).select(group, F.lit(HOT_PARTS).alias("_parts")))
    names = entities.where((F.col(group).isNotNull()) & (F.col("name") != "")).select(group, entity, "name").distinct().join(hot, group, "left")
    names = names.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    parts = F.pmod(F.xxhash64(text_id), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")
    rows = names.select(group, "_part", F.lit(0).alias("_kind"), entity, "name").unionByName(
        texts.join(hot, group, "left").select(group, parts.alias("_part"), F.lit(1).alias("_kind"), text_id, F.col("content").alias("name")), allowMissingColumns=True
    )
    rows = rows.repartition(group, "_part").sortWithinPartitions(group, "_part", "_kind")
    schema = T.StructType([entities.schema[group], entities.schema[entity], texts.schema[text_id]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, keys, of, made = None, [], {}, None
        for batch in batches:
            out: list[tuple] = []
            for g, p, kind, e, name, t in zip(*(batch.column(c).to_pylist() for c in (group, "_part", "_kind", entity, "name", text_id))):
                if (g, p) != place:
                    place, of, made = (g, p), {}, None
                if kind == 0:
                    of.setdefault(name, []).append(e)
                    continue
                if made is None:
                    keys = list(of)
                    made = automaton(keys)
                out += [(g, x, t) for x in {x for k in found_in(made, name) for x in of[keys[k]]}]
            types = [batch.schema.field(c).type for c in (group, entity, text_id)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(types)], names=[group, entity, text_id])

    return rows.mapInArrow(run, schema).distinct()
