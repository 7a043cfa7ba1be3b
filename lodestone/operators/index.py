"""A keyword index that lives on: forward rows and token statistics in segments, and a bounded search over them.

A document's row holds its length, its distinct tokens and their counts. Statistics are sums of plus and minus rows by
token, so a change writes what it adds and takes away and reads nothing else. A search sends the queries' weights to
the rows; every task keeps the best ``k`` of each query and skips documents that can't reach them any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize
from ..sources.store import written

# Fixed values of Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries sent to the rows at a time; products of rows and queries that a task holds; parts of a segment.
MAX_QUERIES, CELLS, PARTS = 10_000, 1 << 21, 16
#: Tokens, or bytes of text, of a part of a batch that is worked on at a time.
BATCH_TOKENS, BATCH_BYTES = 1 << 18, 1 << 20
#: Scores closer than this may be equal when rounded.
SLACK = 1e-5


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of ``BATCH_TOKENS`` tokens or ``BATCH_BYTES`` of text, or one more row: what is made of
    one stays small."""
    of = batch.column(column)
    size, most = (pc.list_value_length(of), BATCH_TOKENS) if pa.types.is_list(of.type) else (pc.binary_length(of), BATCH_BYTES)
    upto = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < batch.num_rows:
        n = max(1, int(np.searchsorted(upto[i:], (upto[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, n)
        i += n


def forward(chunks: DataFrame) -> DataFrame:
    """``chunks`` (id, content) -> ``id, dl, tokens, counts``: distinct tokens and how often each occurs. Null content
    is no document; an empty one has length 0."""
    texts = chunks.select("id", "content").where(F.col("content").isNotNull())
    schema = T.StructType([texts.schema["id"], T.StructField("dl", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks of documents of like length have like impacts, and so tight bounds.
        alike = (b.take(pc.sort_indices(pc.binary_length(b.column("content")))) for b in batches)
        for batch in (part for b in alike for part in _parts(b, "content")):
            # What ``tokenize`` gives: bytes of other scripts are no ASCII letters or digits.
            every = pc.split_pattern_regex(pc.ascii_lower(batch.column("content")), "[^a-z0-9]+")
            token = every.flatten()
            real = pc.not_equal(token, "")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(every).to_numpy(zero_copy_only=False))[real.to_numpy(zero_copy_only=False)]
            length = np.bincount(row, minlength=batch.num_rows)
            coded = token.filter(real).dictionary_encode()
            words = len(coded.dictionary)
            cell, n = np.unique(row * max(1, words) + coded.indices.to_numpy().astype(np.int64), return_counts=True)
            ends = np.searchsorted(cell, np.arange(len(length) + 1) * max(1, words)).astype(np.int32)
            tokens = coded.dictionary.take(pa.array(cell % max(1, words)))
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (tokens.cast(pa.string()), pa.array(n, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(length, pa.int32()), *lists], names=["id", "dl", "tokens", "counts"])

    return texts.mapInArrow(run, schema)


def token_counts(rows: DataFrame, sign: int = 1) -> DataFrame:
    """``token, df, n, dl`` of forward rows: documents a token, and in the row of the null token all and their length."""
    long = T.LongType()
    each = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg((sign * F.count("*")).alias("df")).withColumns({"n": F.lit(0).cast(long), "dl": F.lit(0).cast(long)})
    total = rows.agg((sign * F.count("*")).alias("n"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("dl"))
    return each.unionByName(total.select(F.lit(None).cast("string").alias("token"), F.lit(0).cast(long).alias("df"), "n", F.col("dl").cast(long).alias("dl")))


def totals(stats: DataFrame) -> DataFrame:
    """One row: ``n`` documents of ``avgdl`` tokens."""
    one = stats.where("token IS NULL").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    return one.select("n", F.when(F.col("n") > 0, F.col("dl") / F.col("n")).alias("avgdl"))


def inverse_frequencies(stats: DataFrame) -> DataFrame:
    """``token, df, idf``; a negative one becomes ``EPSILON`` times the mean over all tokens."""
    df = stats.where("token IS NOT NULL").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    raw = df.join(F.broadcast(totals(stats)))  # one row
    raw = raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    return raw.join(F.broadcast(floor)).select("token", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


class Weights:
    """Weights of up to ``MAX_QUERIES`` queries' tokens, by token, and the search of one task over forward rows.

    ``scored`` counts the pairs of a query's token and a document's that were multiplied.
    """

    def __init__(self, query: np.ndarray, token: np.ndarray, weight: np.ndarray, n_queries: int, avgdl: float, k: int):
        self.tokens, code = np.unique(token, return_inverse=True)
        order = np.lexsort((query, code))
        self.query, self.weight, self.code = query[order], weight[order], code[order]
        self.starts = np.searchsorted(self.code, np.arange(len(self.tokens) + 1))
        self.n, self.avgdl, self.k, self.scored = n_queries, avgdl, k, 0
        self.value_set = pa.array(self.tokens.tolist(), pa.string())
        # The score that a document must reach: the k-th of those seen.
        self.least = np.full(n_queries, -np.inf)
        self.best: list[list[tuple[float, object]]] = [[] for _ in range(n_queries)]
        #: Weights by query, the largest first, and the end of each one's query among them.
        self.rank = np.lexsort((-self.weight, self.query))
        self.end = np.searchsorted(self.query[self.rank], self.query[self.rank], "right")

    def _later(self, most: np.ndarray) -> np.ndarray:
        """What each token and those of less weight in its query can add, if it is ``most`` for each."""
        sums = np.concatenate(([0.0], np.cumsum(most[self.rank])))
        out = np.empty(len(most))
        out[self.rank] = sums[self.end] - sums[:-1]
        return out

    def _products(self, row: np.ndarray, token: np.ndarray, impact: np.ndarray, wanted: np.ndarray, rows: int) -> np.ndarray:
        """Sums of weight times impact over the postings and the ``wanted`` weights: rows by queries."""
        upto = np.concatenate(([0], np.cumsum(wanted)))
        low, high = upto[self.starts[token]], upto[self.starts[token + 1]]
        n = high - low
        at = np.flatnonzero(wanted)[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.scored += len(at)
        return np.bincount(np.repeat(row, n) * self.n + self.query[at], self.weight[at] * np.repeat(impact, n), rows * self.n).reshape(rows, self.n)

    def add(self, ids: list, dl: np.ndarray, token: np.ndarray, row: np.ndarray, count: np.ndarray) -> None:
        """Postings of known tokens: ``row`` numbers the documents ``ids``, ascending."""
        rows = len(ids)
        impact = count * (K1 + 1) / (count + K1 * (1 - B + B * dl[row] / self.avgdl))
        # The largest score of each token in this block. Tokens that, with all of less weight, leave a document below
        # are looked at only where the others let it pass.
        largest = np.zeros(len(self.tokens))
        np.maximum.at(largest, token, impact)
        most = np.maximum(self.weight, 0) * largest[self.code]
        needed = self._later(most) >= self.least[self.query] - SLACK
        score = self._products(row, token, impact, needed, rows)
        rest = np.bincount(self.query[~needed], most[~needed], self.n)
        passed = score + rest >= np.maximum(self.least, 0) - SLACK
        if not needed.all():
            passed &= score != 0
            dense = np.zeros((rows, len(self.tokens)))
            dense[row, token] = impact
            doc, query = np.nonzero(passed)
            others = np.flatnonzero(~needed)
            by_query = others[np.argsort(self.query[others], kind="stable")]
            start = np.searchsorted(self.query[by_query], np.arange(self.n + 1))
            n = start[query + 1] - start[query]
            at = by_query[np.repeat(start[query] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pair = np.repeat(np.arange(len(doc)), n)
            found = dense[np.repeat(doc, n), self.code[at]]
            self.scored += int((found > 0).sum())
            score[doc, query] += np.bincount(pair, found * self.weight[at], len(doc))
        for q in np.flatnonzero(passed.any(0)):
            mine = np.round(score[:, q], 6)
            at = np.flatnonzero(passed[:, q] & (mine > 0) & (mine >= self.least[q]))
            if len(at) > self.k:
                at = at[mine[at] >= -np.partition(-mine[at], self.k - 1)[self.k - 1]]
            if len(at):
                self.best[q] = sorted([*self.best[q], *((-s, ids[i]) for s, i in zip(mine[at].tolist(), at.tolist()))])[: self.k]
                if len(self.best[q]) == self.k:
                    self.least[q] = -self.best[q][-1][0]

    def add_batch(self, batch: pa.RecordBatch) -> None:
        step = max(1, CELLS // max(self.n, len(self.tokens), 1))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            length = pc.list_value_length(part.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
            token = pc.index_in(part.column("tokens").flatten(), self.value_set)
            known = pc.is_valid(token).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(part.num_rows), length)[known]
            count = part.column("counts").flatten().to_numpy()[known].astype(np.float64)
            self.add(part.column("id").to_pylist(), part.column("dl").to_numpy().astype(np.float64), token.drop_null().to_numpy().astype(np.int64), row, count)


def search(rows: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``rows`` (forward), their ``stats``, ``queries`` (query_id, query) -> ``query_id, id, bm25_score, rank``: the ``k``
    best documents of each query with a positive score, ties by id. A token that a query repeats counts again.

    The rows are read once for every ``MAX_QUERIES`` queries and never exchanged; ``k`` rows a query and task are.
    """
    from .retrieval import top_per_query

    spark = rows.sparkSession
    schema = T.StructType([queries.schema["query_id"], rows.schema["id"], T.StructField("bm25_score", T.DoubleType())])
    q = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    weighted = q.join(inverse_frequencies(stats), "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight"))
    n = queries.count()
    blocks = max(1, -(-n // MAX_QUERIES))
    weighted = written(weighted.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "weights") if blocks > 1 else weighted.withColumn("_block", F.lit(0))
    avgdl = totals(stats).first()["avgdl"] or 1.0
    out = None
    for block in range(blocks):
        found = weighted.where(F.col("_block") == block).drop("_block").toArrow().sort_by([("query_id", "ascending"), ("token", "ascending")])
        coded = found["query_id"].combine_chunks().dictionary_encode()
        shared = spark.sparkContext.broadcast((coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.array(found["token"].to_pylist(), object), found["weight"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, query, token, weight = shared.value
            mine = Weights(query, token, weight, len(names), avgdl, k)
            kinds = None
            for batch in batches:
                kinds = batch.schema.field("id").type
                if names:
                    mine.add_batch(batch)
            hits = [(names[i], x, -s) for i, best in enumerate(mine.best) for s, x in best]
            if hits:
                of = pa.array([h[0] for h in hits])
                yield pa.RecordBatch.from_arrays([of, pa.array([h[1] for h in hits], kinds), pa.array([h[2] for h in hits])], names=["query_id", "id", "bm25_score"])

        part = rows.select("id", "dl", "tokens", "counts").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return top_per_query(out, k, F.col("bm25_score").desc(), "id")


class LiveIndex:
    """Segments of an index in a folder of its own. Every change is a segment named by its batch: forward rows of the
    new documents, in parts by id; minus and plus statistics by token; ids that earlier segments lose. A change reads
    only the parts of earlier segments that its ids fall into, and a batch given again changes nothing."""

    DOCS = "id {id}, dl int, tokens array<string>, counts array<int>, part int"
    STATS = "token string, df bigint, n bigint, dl bigint"

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type

    def batches(self) -> list[int]:
        """Batches that are complete, in order: those whose last write, the commit, is there."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []

    def _read(self, what: str, schema: str, batch: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}/batch={batch}")

    def _all(self, what: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema + ", batch int")
        for b in self.batches():
            out = out.unionByName(self._read(what, schema, b).withColumn("batch", F.lit(b)))
        return out

    def _part(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")

    def documents(self, ids: DataFrame | None = None) -> DataFrame:
        """Forward rows that are live: not in a later segment's lost ids. With ``ids`` those of these documents, whose
        parts are read, and which go through one exchange."""
        gone = self._all("gone", f"id {self.id_type}").groupBy("id").agg(F.max("batch").alias("_gone"))
        rows = self._all("docs", self.DOCS.format(id=self.id_type))
        if ids is not None:
            parts = [r["part"] for r in ids.select(self._part("id").alias("part")).distinct().collect()]  # PARTS at most
            rows = rows.where(F.col("part").isin(parts)).join(ids.select("id"), "id", "left_semi")
        return rows.join(gone, "id", "left").where("_gone IS NULL OR _gone <= batch").drop("_gone", "batch")

    def stats(self) -> DataFrame:
        return self._all("stats", self.STATS).drop("batch")

    def change(self, batch: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """``upserts`` (id, content; an id once) replace or join the documents, ``deletes`` (id) go; an id in both
        stays as the upsert has it. Batches ascend."""
        done = self.batches()
        if batch in done:
            return
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        key = f"id {self.id_type}"
        # Texts are dealt to the parts, in tasks of even size, and become tokens there: rows of tokens are twice as large.
        part = self._part("id")
        new = forward(upserts.withColumn("part", part).hint("rebalance", "part")) if upserts is not None else self.spark.createDataFrame([], f"{key}, dl int, tokens array<string>, counts array<int>")
        put = lambda df, what: df.write.mode("overwrite").parquet(f"{self.path}/{what}/batch={batch}")
        new.withColumn("part", part).sortWithinPartitions("part", "dl").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/docs/batch={batch}")
        new = self._read("docs", self.DOCS.format(id=self.id_type), batch)
        ids = new.select("id") if deletes is None else new.select("id").unionByName(deletes.select("id"))
        if upserts is not None:  # a text that became null is no document any more
            ids = ids.unionByName(upserts.select("id"))
        put(ids.distinct(), "gone")
        old = self.documents(self._read("gone", key, batch))
        put(token_counts(new).unionByName(token_counts(old, -1)).groupBy("token").agg(*(F.sum(c).alias(c) for c in ("df", "n", "dl"))).where("df <> 0 OR n <> 0 OR dl <> 0"), "stats")
        put(self.spark.range(1), "commits")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return search(self.documents(), self.stats(), queries, k)
