"""Centroid clustering with heap-ordered bounds, exact in whole numbers.

Vectors are packed into blocks, a row each, that carry their clustering state along: every vector's cluster and, for
each cluster, a heap of its vectors by gap. A gap is a lower bound of the distance to the second nearest centroid
less an upper one of that to the nearest. When centroids move, all gaps of a cluster shrink by the same drift at
most (its own centroid's move and the largest of the others'), so the drift is added up once a cluster and a gap
enters its heap raised by the drift so far. Only vectors whose raised gap the drift has reached are popped, compared
with all centroids exactly and pushed again; blocks without one don't even reach Python. Centroids follow from the
sums of vectors that changed sides, added up in Spark; the driver holds centroids and their sums.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, scratch

#: Vectors of a block: what a task holds at a time.
BLOCK = 4096
#: Bounds are kept apart from the true values by this share, far above what rounding can move them.
SLACK = 1e-9
MOST = (1 << 63) - 1

_STATE = "ids array<bigint>, wide int, data binary, cluster binary, heap_n array<int>, heap_key binary, heap_at binary, tops array<double>, moved array<decimal(38,0)>"
_TYPES = [
    ("ids", pa.list_(pa.int64())), ("wide", pa.int32()), ("data", pa.binary()), ("cluster", pa.binary()), ("heap_n", pa.list_(pa.int32())),
    ("heap_key", pa.binary()), ("heap_at", pa.binary()), ("tops", pa.list_(pa.float64())), ("moved", pa.list_(pa.decimal128(38, 0))),
]


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to all centroids (both whole numbers): by a matrix product while
    every term is exact in double precision, in 64-bit integers while sums fit, else in Python's integers."""
    if not len(x):
        return np.zeros((0, len(centroids)), np.int64)
    most = max(abs(int(a)) for m in (x, centroids) for a in (m.min(), m.max()))
    bound = 4 * x.shape[1] * most * most
    if bound < 1 << 53:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    kind = np.int64 if bound <= MOST else object
    return np.stack([((x.astype(kind) - c.astype(kind)) ** 2).sum(1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, the smaller number of equal ones, and its gap, never above the true one."""
    d = squared(x, centroids)
    own = np.argmin(d, axis=1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d], int)
    if d.shape[1] == 1:
        return own, np.full(len(x), np.inf)
    roots = np.sqrt(d.astype(np.float64))
    upper = roots[np.arange(len(x)), own]
    roots[np.arange(len(x)), own] = np.inf
    return own, roots.min(1) * (1 - SLACK) - upper * (1 + SLACK)


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far the gap of each cluster's vectors may have shrunk when the centroids moved."""
    d = [math.sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y))) * (1 + SLACK) for x, y in zip(before, after)]
    return np.array([d[c] + max([*d[:c], *d[c + 1 :], 0.0]) for c in range(len(d))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            x = part.column("x").flatten().to_numpy(zero_copy_only=False)
            most = max(int(x.max()), -int(x.min()) - 1)
            wide = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
            yield pa.RecordBatch.from_pylist([{"ids": part.column("vec_id").to_pylist(), "wide": wide, "data": x.astype(f"i{wide}").tobytes()}], pa.schema(_TYPES))


def _step(centroids: np.ndarray, drift: np.ndarray | None):
    """Assign all vectors of a block (``drift`` None) or those whose gap has expired."""
    k, dims = centroids.shape

    def block(row: dict) -> dict:
        n = len(row["ids"])
        x = np.frombuffer(row["data"], f"i{row['wide']}").reshape(n, dims)
        moved = np.zeros((k, dims + 1), object)
        if drift is None:
            cluster = np.full(n, -1, np.int32)
            heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
            popped = list(range(n))
            base = np.zeros(k)
        else:
            cluster = np.frombuffer(row["cluster"], np.int32).copy()
            ends = np.cumsum([0, *row["heap_n"]])
            keys, at = np.frombuffer(row["heap_key"]), np.frombuffer(row["heap_at"], np.int32)
            heaps = [list(zip(keys[a:b].tolist(), at[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
            popped, base = [], drift
            for c, heap in enumerate(heaps):
                while heap and heap[0][0] <= drift[c]:
                    popped.append(heapq.heappop(heap)[1])
        own, gap = nearest(x[popped].astype(np.int64), centroids)
        for i, c, g in zip(popped, own.tolist(), gap.tolist()):
            heapq.heappush(heaps[c], (g + base[c], i))
        old, popped = cluster[popped], np.array(popped, int)
        cluster[popped] = own
        for c in range(k):
            for side, sign in ((own, 1), (old, -1)):
                mine = popped[(side == c) & (own != old)]
                if len(mine):
                    some = x[mine].astype(object if row["wide"] == 8 else np.int64).sum(0)
                    moved[c, :dims] += sign * some.astype(object)
                    moved[c, dims] += sign * len(mine)
        flat = [e for heap in heaps for e in heap]
        return row | {
            "cluster": cluster.tobytes(), "heap_n": [len(h) for h in heaps], "heap_key": np.array([e[0] for e in flat]).tobytes(), "heap_at": np.array([e[1] for e in flat], np.int32).tobytes(),
            "tops": [h[0][0] if h else None for h in heaps], "moved": [Decimal(int(m)) for m in moved.ravel()] if moved.any() else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([block(batch.slice(i, 1).to_pylist()[0])], pa.schema(_TYPES))

    return run


def _places(centroids: np.ndarray):
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x = np.frombuffer(row["data"], f"i{row['wide']}").reshape(-1, dims).astype(np.int64)
                cluster = np.frombuffer(row["cluster"], np.int32)
                far = np.zeros(len(x), np.int64)
                for c in np.unique(cluster):
                    d = squared(x[cluster == c], centroids[c : c + 1])[:, 0]
                    far[cluster == c] = np.minimum(d, MOST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: float = 64.0, dims: int = 64, seed: int = 1) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors with other than ``dims`` components, or with null or non-finite ones, are left out. Each component x
    becomes floor(scale * x). Centroids start as the ``k`` vectors of smallest sha256 of "seed:vec_id"; ``rounds``
    times all vectors go to the nearest centroid (ties: smaller number) and every centroid that has vectors becomes
    floor of their mean; then they are assigned once more. Fewer vectors than ``k`` make fewer centroids. Repeated
    rows are separate vectors; null ids are kept but start no centroid while others can; no vector gives no row; other
    columns are ignored. Components beyond a long are held at its ends, and so are distances and their sums.
    """
    spark = vectors.sparkSession
    whole = (F.size("embedding") == dims) & F.forall("embedding", lambda e: e.isNotNull() & (F.abs(e) < float("inf")))
    component = F.transform("embedding", lambda e: F.floor(F.greatest(F.least(e.cast("double") * scale, F.lit(9.2e18)), F.lit(-9.2e18))))
    kept = vectors.where(F.col("embedding").isNotNull()).where(whole).select("vec_id", component.alias("x"))
    with scratch(spark):
        name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        starts = kept.orderBy(name.asc_nulls_last(), "vec_id", "x").limit(k).collect()
        if not starts:
            return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        centroids = np.array([r["x"] for r in starts], np.int64)
        k = len(centroids)
        sums = np.zeros((k, dims + 1), object)
        state = materialize(kept.mapInArrow(_pack, _STATE))
        state = materialize(state.mapInArrow(_step(centroids, None), _STATE))
        drift = np.zeros(k)
        for _ in range(rounds):
            changes = state.where("moved is not null").select(F.posexplode("moved").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v"))
            for r in changes.collect():  # one row a component of a centroid
                sums[r["p"] // (dims + 1), r["p"] % (dims + 1)] += int(r["v"])
            after = centroids.copy()
            for c in range(k):
                if sums[c, dims]:
                    after[c] = [s // sums[c, dims] for s in sums[c, :dims]]
            drift = drift + drifts(centroids, after)
            centroids = after
            expired = F.exists(F.zip_with("tops", F.array(*map(F.lit, drift.tolist())), lambda top, d: top <= d), lambda e: F.coalesce(e, F.lit(False)))
            quiet = state.where(~expired).withColumn("moved", F.lit(None).cast("array<decimal(38,0)>"))
            state = materialize(state.where(expired).mapInArrow(_step(centroids, drift), _STATE).unionByName(quiet))
        placed = materialize(state.select("ids", "wide", "data", "cluster").mapInArrow(_places(centroids), "vec_id bigint, cluster int, distance bigint"), keep=True)
    inertia = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    total = min(MOST, sum(inertia.values()))
    table = spark.createDataFrame([(c, min(MOST, d), total, digests[c]) for c, d in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """All ``embeddings`` of 64 finite components in 16 clusters."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT r, c AS cluster, d FROM (SELECT e.r, k.c, sum((e.x - k.x) * (e.x - k.x))::BIGINT AS d FROM e JOIN c{i} k USING (j) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
c{i + 1} AS MATERIALIZED (SELECT k.c, k.j, CASE WHEN n IS NULL THEN k.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} k LEFT JOIN (SELECT cluster AS c, j, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN e USING (r) GROUP BY ALL) USING (c, j))"""


ORACLE = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
e AS MATERIALIZED (SELECT r, j, floor(64 * embedding[j]::DOUBLE)::BIGINT AS x FROM kept, (SELECT unnest(generate_series(1, 64)) AS j)),
c0 AS MATERIALIZED (SELECT c, j, x FROM e JOIN (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept QUALIFY c < 16) USING (r)),
{", ".join(_round_sql(i) for i in range(4))}
SELECT vec_id, cluster::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN kept USING (r) JOIN (SELECT c AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c3 GROUP BY c) USING (cluster)"""
