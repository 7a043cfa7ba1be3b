"""Exact near-duplicates among embeddings by dual traversal of cover trees.

Unit vectors with cosine >= c are within sqrt(2 - 2c) of each other, so cosine links are a distance join in a
metric space. A cover tree of nested levels with halving radii over a bounded sample of the vectors deals all
vectors to its leaves; each leaf knows the largest distance to any vector dealt to it, over all rows, and each node
above it a bound. The dual traversal walks pairs of nodes of that tree from its root and drops a pair when the
distance of the centres exceeds both covering radii plus the threshold. The leaf pairs that are left are joined tile
by tile: a task gets two tiles, builds their own cover trees and traverses those; node pairs whose radii prove every
pair similar are counted without comparing vectors. Where a net of the next radius doesn't thin the points out, as
with vectors that lie about equally far from each other, a node isn't divided: its pairs are compared as products of
matrices in single precision, and in double precision where that comes near the threshold.

Only counts and a spanning forest of the links leave a task. Equal vectors are one class from the start, and no pair
list is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize, scratch

#: Vectors in the sampled tree, rows of a tile, vectors of a node that is compared outright.
SAMPLE, TILE, LEAF = 1_024, 4_096, 64
#: Rows of a tile that are compared with another node at once; centres after which a net must have thinned the points out.
BLOCK, TRIED = 512, 32
_SLACK = 1e-9


class CoverTree:
    """Nested levels over ``points`` (unit vectors): every node's centre is one of its points, radii halve from
    level to level, and ``reach`` is the exact largest distance from a node's centre to its points."""

    def __init__(self, points: np.ndarray, radius: float = 2.0, leaf: int = LEAF, least: float = 1e-3):
        self.centre: list[int] = []
        self.reach: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        if len(points):
            self._add(points, np.arange(len(points)), 0, radius, leaf, least)

    def _add(self, points: np.ndarray, members: np.ndarray, centre: int, radius: float, leaf: int, least: float) -> int:
        at = len(self.centre)
        self.centre.append(centre)
        self.reach.append(float(np.sqrt(np.maximum(0, 2 - 2 * (points[members] @ points[centre]))).max()))
        self.members.append(members)
        self.children.append([])
        half = min(radius, self.reach[at] * 1.0001) / 2
        if len(members) <= leaf or half < least:
            return at
        # A net of the half radius, the parent's centre first; when it would not thin the points out, this is a leaf.
        mine = points[members]
        near = np.full(len(members), np.inf)
        owner = np.zeros(len(members), np.int64)
        centres: list[int] = []
        nxt = int(np.flatnonzero(members == centre)[0])
        while True:
            d = np.sqrt(np.maximum(0, 2 - 2 * (mine @ mine[nxt])))
            closer = d < near
            near[closer], owner[closer] = d[closer], len(centres)
            centres.append(nxt)
            nxt = int(np.argmax(near))
            if near[nxt] <= half:
                break
            if len(centres) % TRIED == 0 and int((near <= half).sum()) < 4 * len(centres):
                return at
        for k, c in enumerate(centres):
            self.children[at].append(self._add(points, members[owner == k], int(members[c]), half, leaf, least))
        return at


def dual_traversal(a: CoverTree, x: np.ndarray, b: CoverTree, y: np.ndarray, threshold: float) -> Iterator[tuple[int, int, bool]]:
    """Pairs of nodes that together hold all pairs within ``threshold``; True: every pair of theirs is."""
    stack = [(0, 0)] if a.centre and b.centre else []
    while stack:
        i, j = stack.pop()
        d = float(np.sqrt(max(0.0, 2 - 2 * float(x[a.centre[i]] @ y[b.centre[j]]))))
        if d - a.reach[i] - b.reach[j] > threshold + _SLACK:
            continue
        if d + a.reach[i] + b.reach[j] < threshold - _SLACK:
            yield i, j, True
        elif a.children[i] and (a.reach[i] >= b.reach[j] or not b.children[j]):
            stack += [(k, j) for k in a.children[i]]
        elif b.children[j]:
            stack += [(i, k) for k in b.children[j]]
        else:
            yield i, j, False


class _Forest:
    """The set of each of a task's rows; keeps the links that joined two sets."""

    def __init__(self, n: int):
        self.of, self.links = np.arange(n), []

    def join(self, i: int, others: np.ndarray) -> None:
        """Links row ``i`` with each of ``others``."""
        sets, first = np.unique(self.of[others], return_index=True)
        for k, j in zip(sets.tolist(), others[first].tolist()):
            if k != self.of[i]:
                self.of[self.of == k] = self.of[i]
                self.links.append((i, j))


def leaf_pairs(tree: CoverTree, points: np.ndarray, far: np.ndarray, threshold: float) -> set[tuple[int, int]]:
    """Pairs of leaves (numbered in order) of a tree over sampled ``points`` that may hold rows within ``threshold``;
    ``far``: each leaf's largest distance to a row dealt to it."""
    leaves = [i for i in range(len(tree.centre)) if not tree.children[i]]
    number = {i: k for k, i in enumerate(leaves)}
    below: dict[int, list[int]] = {}
    for i in reversed(range(len(tree.centre))):  # children come after their parent
        below[i] = [number[i]] if i in number else [k for c in tree.children[i] for k in below[c]]
        centres = points[[tree.centre[leaves[k]] for k in below[i]]]
        gaps = np.sqrt(np.maximum(0, 2 - 2 * centres @ points[tree.centre[i]])) if i not in number else np.zeros(1)
        tree.reach[i] = float((gaps + far[below[i]]).max())
    return {(k, m) for i, j, _ in dual_traversal(tree, points, tree, points, threshold) for k in below[i] for m in below[j]}


def tile_links(x: np.ndarray, y: np.ndarray, xw: np.ndarray, yw: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weighted link counts of the rows of ``x`` and of ``y`` (raw vectors) and a spanning forest of their links, the
    rows of ``y`` numbered after those of ``x``. ``same``: ``y`` is ``x``, whose counts then come first."""
    xl, yl = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    xu, yu = x / xl[:, None], y / yl[:, None]
    xs, ys = xu.astype(np.float32), yu.astype(np.float32)
    a = CoverTree(xu)
    b = a if same else CoverTree(yu)
    threshold = float(np.sqrt(2 - 2 * cosine))
    xn, yn = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    forest = _Forest(len(x) + (0 if same else len(y)))
    shift = 0 if same else len(x)
    for i, j, sure in dual_traversal(a, xu, b, yu, threshold):
        p, q = a.members[i], b.members[j]
        if same and sure and i != j and len(np.intersect1d(p, q)):
            sure = False
        if sure:
            xn[p] += yw[q].sum()
            if not same:
                yn[q] += xw[p].sum()
            if same and i == j:
                xn[p] -= xw[p]
            forest.join(int(p[0]), q + shift)
            forest.join(int(q[0]) + shift, p)
            continue
        slack = (x.shape[1] + 8) * 1.2e-7  # of products of unit vectors in single precision
        for at in range(0, len(p), BLOCK):
            rows = p[at : at + BLOCK]
            close = xs[rows] @ ys[q].T >= cosine - slack
            rows, cols = rows[close.any(1)], q[close.any(0)]
            if not len(rows):
                continue
            hit = (x[rows] @ y[cols].T) / (xl[rows][:, None] * yl[cols][None, :]) >= cosine
            if same:
                hit &= rows[:, None] != cols[None, :]
            xn[rows] += hit @ yw[cols]
            if not same:
                yn[cols] += xw[rows] @ hit
            for k, r in enumerate(rows.tolist()):
                if hit[k].any():
                    forest.join(r, cols[hit[k]] + shift)
    return xn, yn, forest.links


def _vectors(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, seed: int = 3, sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """``vectors`` (vec_id, embedding: array of numbers) -> ``vec_id, n_links, component_id, kept`` for every row.

    Rows link when their cosine, in double precision, is at least ``cosine``. Null vectors, vectors of zeros, with
    null or non-finite components or of another length than their partner's link with nothing. Repeated rows and
    equal vec_ids are separate rows and link like any other; a component of null ids has a null id. Other columns
    are ignored.
    """
    with scratch(vectors.sparkSession):
        placed = materialize(_placed(vectors, cosine, seed, sample, tile), keep=True)
    ids = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = placed.join(ids, "component")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _placed(vectors: DataFrame, cosine: float, seed: int, sample: int, tile: int) -> DataFrame:
    """``vec_id, n_links, component`` (a row number) of every row."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("_row", F.monotonically_increasing_id())
    usable = F.coalesce(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False))
    # +0.0 turns -0.0 into 0.0, so that equal vectors are equal arrays.
    rows = materialize(rows.withColumn("v", F.when(usable, F.transform("v", lambda e: e + F.lit(0.0)))))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("_row").alias("rep"), F.count("*").alias("w"))
    classes = materialize(classes.withColumn("dim", F.size("v")))

    # The sampled tree: rows of least hash, at most ``sample`` of each dimension that occurs.
    chosen: dict[int, np.ndarray] = {}
    for r in classes.select("dim").distinct().limit(64).collect():
        some = classes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64(F.lit(seed), "rep"), "rep").limit(sample).select("v").collect()
        x = np.array([s["v"] for s in some])
        chosen[r["dim"]] = x / np.sqrt((x * x).sum(1))[:, None]
    trees = {d: CoverTree(x, leaf=8) for d, x in chosen.items()}
    leaves = {d: [i for i in range(len(t.centre)) if not t.children[i]] for d, t in trees.items()}
    shared = spark.sparkContext.broadcast({d: chosen[d][[trees[d].centre[i] for i in leaves[d]]] for d in trees})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            leaf, distance = np.zeros(len(dims), np.int32), np.full(len(dims), 2.0)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                if int(d) not in shared.value:
                    continue
                x = _vectors(batch.column("v").take(pa.array(mine)))
                dot = (x / np.sqrt((x * x).sum(1))[:, None]) @ shared.value[int(d)].T
                leaf[mine] = dot.argmax(1)
                distance[mine] = np.sqrt(np.maximum(0, 2 - 2 * dot.max(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(distance)], names=[*batch.schema.names, "leaf", "distance"])

    dealt = materialize(classes.mapInArrow(deal, "v array<double>, rep bigint, w bigint, dim int, leaf int, distance double"))
    reach = {(r["dim"], r["leaf"]): (r["n"], r["far"]) for r in dealt.groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()}

    # Neighbouring small leaves share a tile, a large leaf has several to itself. The driver finds the groups of leaves
    # that can link, at most as many pairs as the sample allows; Spark expands them to pairs of tiles.
    threshold = float(np.sqrt(2 - 2 * cosine))
    tiles: list[tuple[int, int, int, int]] = []  # (dim, leaf, first tile, tiles)
    near: set[tuple[int, int, int, int]] = set()  # (first tile, tiles) of two groups
    first = 0
    for d in sorted({k[0] for k in reach}):
        mine = [k for k in range(max(1, len(leaves.get(d, [0])))) if (d, k) in reach]
        of: dict[int, tuple[int, int]] = {}
        shares, filled = None, 0  # the group that still takes leaves, and its rows
        for k in mine:
            n = reach[(d, k)][0]
            parts = -(-n // tile)
            if shares is not None and filled + n <= tile:
                of[k], filled = shares, filled + n
                continue
            of[k], first = (first, parts), first + parts
            shares, filled = (of[k], n) if parts == 1 else (None, 0)
        tiles += [(d, k, *of[k]) for k in mine]
        near_leaves = {(0, 0)}
        if d in trees:
            far = np.array([reach.get((d, k), (0, 0.0))[1] for k in range(len(leaves[d]))])
            near_leaves = leaf_pairs(trees[d], chosen[d], far, threshold)
        near |= {(*min(of[k], of[m]), *max(of[k], of[m])) for k, m in near_leaves if k in of and m in of}
    rowed = spark.createDataFrame(tiles or [(0, 0, 0, 1)], "dim int, leaf int, first int, parts int")
    tiled = dealt.join(rowed, ["dim", "leaf"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col("parts")).cast("int"))
    pairs = spark.createDataFrame(sorted(near) or [(0, 1, 0, 1)], "fa int, na int, fb int, nb int")
    for x in "ab":
        pairs = pairs.withColumn(x, F.explode(F.sequence(F.col(f"f{x}"), F.col(f"f{x}") + F.col(f"n{x}") - 1)))
    wanted = pairs.where("a <= b").select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    sent = tiled.select("tile", "rep", "w", "v").join(wanted, "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by the pair: a pair's rows are consecutive, two tiles at most.
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            i, j = t["a"][0].as_py(), t["b"][0].as_py()
            left = np.flatnonzero(t["tile"].to_numpy() == i)
            right = np.flatnonzero(t["tile"].to_numpy() == j)
            v, rep, w = _vectors(t["v"].combine_chunks()), t["rep"].to_numpy(), t["w"].to_numpy()
            xn, yn, links = tile_links(v[left], v[right], w[left], w[right], i == j, cosine) if len(left) and len(right) else (np.zeros(len(left), np.int64), np.zeros(len(right), np.int64), [])
            names = rep[left] if i == j else np.concatenate((rep[left], rep[right]))
            n = xn if i == j else np.concatenate((xn, yn))
            some = n > 0
            la, lb = (names[[x for x, _ in links]], names[[y for _, y in links]]) if links else (np.empty(0, np.int64),) * 2
            node = np.concatenate((names[some], la))
            other = pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(lb, pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), other, pa.array(np.concatenate((n[some], np.zeros(len(la), np.int64))), pa.int64())], names=["node", "other", "n"])

        now = None
        for batch in batches:
            keys = batch.column("a").to_numpy().astype(np.int64) << 32 | batch.column("b").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e == s:
                    continue
                if now is not None and keys[s] != now:
                    yield done()
                now = keys[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield done()

    sent = sent.select("a", "b", "tile", "rep", "w", "v").repartition("a", "b").sortWithinPartitions("a", "b")
    found = materialize(sent.mapInArrow(compare, "node bigint, other bigint, n bigint"))
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    group = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of_class = (
        classes.select("v", "w", F.col("rep").alias("node"))
        .join(counts, "node", "left")
        .join(group, "node", "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    return rows.join(of_class, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_row").alias("component"))


def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links of all ``embeddings`` at a cosine of 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
