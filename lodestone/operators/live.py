"""Rows that follow their documents: a segment a change, an entity graph kept by plus and minus counts over them, and
a corpus whose deletions reach chunks, wiki entries, vectors, graph and keyword index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import MIN_COUNT, confidence, pairs
from .index import LiveIndex

#: Parts of a segment by document: a change reads those of earlier segments that its documents fall into.
PARTS = 64


class LiveRows:
    """Rows of documents in a folder of its own, a segment a change.

    A segment holds the new rows, in parts by document, and the documents that earlier segments lose by it. Its commit
    is written last: what a change that failed left is written over, and a batch given again changes nothing.
    ``compact`` starts over from one segment, so that reading doesn't slow down with the number of changes.
    """

    #: Whether rows of other documents are left out by a join before they are written. Wide rows would go through an
    #: exchange more for it; theirs are looked for by key in what was written, and only if there are some, it is again.
    JOINED = False

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str = "document_id", parts: int = PARTS):
        self.spark, self.path, self.columns, self.key, self.parts = spark, path.rstrip("/"), columns, key, parts
        self.keys = T.StructType([T._parse_datatype_string(columns)[key]])

    def _complete(self, what: str) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = hadoop(f"{self.path}/{what}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(hadoop(p, "_SUCCESS")))

    def batches(self) -> list[int]:
        """Committed batches, in order."""
        return self._complete("commits")

    def _read(self, what: str, schema, batch: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}/batch={batch}")

    def _put(self, df: DataFrame, what: str, batch: int, by: str | None = None) -> None:
        """``by`` splits into folders of files of even size, however many rows one of them has."""
        writer = (df.hint("rebalance", by) if by else df).write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{what}/batch={batch}")

    def _all(self, what: str, schema: str, before: int | None = None) -> DataFrame:
        """Segments since the last compaction, with their ``batch``; those before one, as they were then."""
        done = [b for b in self.batches() if before is None or b < before]
        base = max((b for b in self._complete("bases") if b in done), default=None)
        out = self.spark.createDataFrame([], schema + ", batch int")
        for b in done:
            if base is None or b >= base:
                out = out.unionByName(self._read(what, schema, b).withColumn("batch", F.lit(b)))
        return out

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _live(self, before: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """Live rows, or those that were before a batch; with ``ids`` those of these documents, whose parts are read."""
        rows = self._all("rows", self.columns + ", part int", before)
        if ids is not None:
            parts = [r["part"] for r in ids.select(self._part().alias("part")).distinct().collect()]  # as many as a segment has, at most
            rows = rows.where(F.col("part").isin(parts)).join(ids.select(self.key), self.key, "left_semi")
        lost = self._all("lost", self.spark.createDataFrame([], self.keys)._jdf.schema().toDDL(), before).groupBy(self.key).agg(F.max("batch").alias("_lost"))
        return rows.join(lost, self.key, "left").where("_lost IS NULL OR _lost <= batch").drop("_lost", "batch")

    def rows(self) -> DataFrame:
        """The rows that are live."""
        return self._live().drop("part")

    def lost(self, batch: int) -> DataFrame:
        """Rows that went, or were replaced, by ``batch``: found in the segments before it, not kept a second time."""
        return self._live(batch, self._read("lost", self.keys, batch)).drop("part")

    def _derive(self, batch: int, new: DataFrame, lost: DataFrame) -> None:
        """What a subclass keeps beside the rows."""

    def change(self, batch: int, documents: DataFrame, rows: DataFrame | None = None) -> None:
        """``documents`` (the key) came, changed or went: ``rows`` are all that they have now, and replace what they
        had. Rows of other documents, or without one, are left out. Batches ascend."""
        done = self.batches()
        if batch in done:
            return
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        ids = documents.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        self._put(ids, "ids", batch)
        ids = self._read("ids", ids.schema, batch)
        new = self.spark.createDataFrame([], self.columns)
        if rows is not None:
            new = rows.select(*new.columns).where(F.col(self.key).isNotNull())
        put = lambda df: self._put(df.withColumn("part", self._part()), "rows", batch, by="part")
        put(new.join(ids, self.key, "left_semi") if self.JOINED else new)
        if not self.JOINED and not self._read("rows", self.keys, batch).distinct().join(ids, self.key, "left_anti").isEmpty():
            put(new.join(ids, self.key, "left_semi"))
        self._put(self._live(ids=ids).select(self.key).distinct(), "lost", batch)
        self._derive(batch, self._read("rows", self.columns, batch), self.lost(batch))
        self._put(self.spark.range(1), "commits", batch)

    def compact(self, batch: int) -> None:
        """One segment with all that is live, as a batch of its own; those before aren't read any more."""
        done = self.batches()
        if batch in done:
            return
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        self._put(self._live(), "rows", batch, by="part")
        self._put(self.spark.createDataFrame([], self.keys), "lost", batch)
        self._fold(batch)
        self._put(self.spark.range(1), "bases", batch)
        self._put(self.spark.range(1), "commits", batch)

    def _fold(self, batch: int) -> None:
        """What a subclass keeps beside the rows, for a compacted segment."""


class LiveGraph(LiveRows):
    """Mentions of entities in the chunks of documents, and the counts of entities and of pairs that share a chunk.

    A change writes counts of its new mentions and, negative, of those that go; it reads no others. An entity or edge
    is there while its sum is large enough: what only deleted documents mention goes with them.
    """

    JOINED = True
    PAIRS, ENTITIES = "source string, target string, weight bigint", "entity string, mentions bigint"

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", parts: int = PARTS):
        super().__init__(spark, path, f"document_id {id_type}, chunk_id {id_type}, entity string", "document_id", parts)

    def _sums(self, df: DataFrame, value: str) -> DataFrame:
        keys = [c for c in df.columns if c not in (value, "batch")]
        return df.groupBy(*keys).agg(F.sum(value).alias(value)).where(F.col(value) != 0)

    def _derive(self, batch: int, new: DataFrame, lost: DataFrame) -> None:
        self._put(lost, "went", batch)
        lost = self._read("went", self.columns, batch)
        signed = [(rows.where("entity IS NOT NULL").distinct(), sign) for rows, sign in ((new, 1), (lost, -1))]
        counted = lambda rows, sign: rows.groupBy("entity").agg((sign * F.count("*")).alias("mentions"))
        linked = lambda rows, sign: pairs(rows, "document_id", "chunk_id").groupBy("source", "target").agg((sign * F.count("*")).alias("weight"))
        for what, of, value in (("entities", counted, "mentions"), ("pairs", linked, "weight")):
            plus, minus = (of(*s) for s in signed)
            self._put(self._sums(plus.unionByName(minus), value), what, batch)

    def _fold(self, batch: int) -> None:
        self._put(self.entities(), "entities", batch)
        self._put(self._sums(self._all("pairs", self.PAIRS), "weight"), "pairs", batch)

    def entities(self) -> DataFrame:
        """``entity, mentions``: chunks that mention it."""
        return self._sums(self._all("entities", self.ENTITIES), "mentions")

    def edges(self, least: int = MIN_COUNT) -> DataFrame:
        """``source, target, weight, confidence``, as ``graph.cooccurrence`` of all live mentions."""
        edges = self._sums(self._all("pairs", self.PAIRS), "weight").where(F.col("weight") >= least)
        return edges.withColumn("confidence", confidence(F.col("weight")))

    def follow(self, changes: DataFrame, checkpoint: str):
        """A writer of a stream of ``document_id, chunk_id, entity``; a document's rows come in one micro-batch and
        replace what it had, and one without entity alone deletes it. A micro-batch that comes again changes nothing."""
        return changes.writeStream.foreachBatch(lambda rows, batch: self.change(batch, rows, rows.where("entity IS NOT NULL"))).option("checkpointLocation", checkpoint)


class LiveCorpus:
    """Documents with their chunks, wiki entries, vectors, entity graph and keyword index, changed together.

    The stores take a batch one after the other, each exactly once; the corpus commits it when all have. A batch that
    failed halfway is given again and goes on where it stopped.
    """

    TABLES = {"chunks": "document_id {id}, chunk_id {id}, content string", "wiki": "document_id {id}, summary string", "vectors": "document_id {id}, vector_id {id}"}

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", parts: int = PARTS):
        path = path.rstrip("/")
        self.tables = {name: LiveRows(spark, f"{path}/{name}", columns.format(id=id_type), parts=parts) for name, columns in self.TABLES.items()}
        self.graph = LiveGraph(spark, f"{path}/graph", id_type, parts)
        self.index = LiveIndex(spark, f"{path}/index", id_type)
        self.log = LiveRows(spark, f"{path}/log", f"document_id {id_type}", parts=parts)

    def batches(self) -> list[int]:
        """Batches that all stores hold."""
        return self.log.batches()

    def change(self, batch: int, documents: DataFrame, mentions: DataFrame | None = None, **rows: DataFrame) -> None:
        """``documents`` (document_id) came, changed or went, and have these ``mentions`` and ``rows`` of the tables now.

        The index follows the chunks: those that went leave it, by the ids that the chunk table lost.
        """
        if batch in self.batches():
            return
        for name, table in self.tables.items():
            table.change(batch, documents, rows.get(name))
        self.graph.change(batch, documents, mentions)
        chunks = self.tables["chunks"]
        new = chunks._read("rows", chunks.columns, batch).select(F.col("chunk_id").alias("id"), "content")
        self.index.change(batch, new, chunks.lost(batch).select(F.col("chunk_id").alias("id")))
        self.log.change(batch, documents)
