"""Entity graphs: mentions, co-occurrence, bounded traversal, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from . import matching

MAX_PAIRS, MIN_COUNT = 50, 2
#: An entity of this many neighbours is a hub; parts that those who come to one are dealt to.
HUB, SALTS = 10_000, 32


def pairs(mentions: DataFrame, *chunk: str) -> DataFrame:
    """``source, target``, source first by name, for each chunk (columns ``chunk``) that mentions both.

    A chunk's entities are paired in one array, so there is one exchange to gather them and none to pair them; a
    chunk holds few entities.
    """
    each = mentions.groupBy(*chunk).agg(F.array_sort(F.collect_set("entity")).alias("e")).where("size(e) > 1")
    first = each.select(F.posexplode("e").alias("i", "source"), "e")
    return first.select("source", F.explode(F.slice("e", F.col("i") + 2, F.greatest(F.size("e") - F.col("i") - 1, F.lit(0)))).alias("target"))


def confidence(weight: Column) -> Column:
    return F.round(F.least(F.lit(1.0), weight / 10.0), 2)


def cooccurrence(mentions: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """``mentions`` (chunk_id, entity; distinct) -> undirected edges ``source, target, weight, confidence``."""
    edges = pairs(mentions, "chunk_id").groupBy("source", "target").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    return edges.withColumn("confidence", confidence(F.col("weight")))


def top_edges(edges: DataFrame, k: int = MAX_PAIRS) -> DataFrame:
    return edges.orderBy(F.col("weight").desc(), "source", "target").limit(k)


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def within(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Entities at most ``depth`` (1 to 3) undirected steps from ``start`` (entity), with their distance, 0 included."""
    found = walks(edges, start.select(F.lit(0).alias("seed"), "entity"), depth)
    return found.drop("seed")


def adjacency(edges: DataFrame, hub: int = HUB, salts: int = SALTS, first: int | None = None) -> DataFrame:
    """``edges`` in both directions as ``entity, salt, target, target_salts``, written once; with ``first`` only each
    entity's first neighbours by name.

    Entities of ``hub`` neighbours or more are there ``salts`` times, so that those who come to one are dealt to as
    many tasks; there are at most a ``hub``-th as many of them as edges.
    """
    both = written(mirrored(edges), "edges")
    hubs = both.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= hub).select(F.col("source").alias("hub"))
    if first is not None:
        by_name = Window.partitionBy("source").orderBy("target")
        both = written(both.withColumn("_n", F.row_number().over(by_name)).where(F.col("_n") <= first).drop("_n"), "edges")
    if hubs.isEmpty():
        return both.select(F.col("source").alias("entity"), F.lit(0).alias("salt"), "target", F.lit(1).alias("target_salts"))
    hubs = hubs.withColumn("salts", F.lit(salts))
    dealt = both.join(hubs, F.col("source") == F.col("hub"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("hub", "salts")
    to = dealt.join(hubs, F.col("target") == F.col("hub"), "left")
    return written(to.select(F.col("source").alias("entity"), "salt", "target", F.coalesce("salts", F.lit(1)).alias("target_salts")), "edges")


def walks(edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = None, hub: int = HUB, salts: int = SALTS) -> DataFrame:
    """``seed, entity, distance`` of all entities at most ``depth`` (1 to 3) undirected steps from the entities of each
    seed (``seeds``: seed, entity), those at distance 0 included.

    The frontiers of all seeds are one table and go through the edges together; what a seed has seen is kept by seed
    and entity.

    With ``limit``, those that ``nearest`` ranks up to it are there, and not all others: a seed that has as many
    entities beyond its own goes no further, as all that is missing then is farther than these, and of an entity's
    neighbours only the first by name are followed, ``limit`` and as many as a seed has of its own. A seed that goes on
    has seen fewer than these, so an entity with more neighbours gives it all that it still lacks, and any neighbour
    left out has a later name. So a seed makes at most about ``limit`` squared rows a step, however large the hubs are.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1 to 3")
    own = seeds.select("seed", "entity").where("entity IS NOT NULL").distinct()
    first = None
    if limit is not None:
        first = limit + (own.groupBy("seed").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    near = adjacency(edges, hub, salts, first)
    many = near.groupBy("entity").agg((F.max("salt") + 1).alias("_salts"))
    frontier = own.join(many, "entity", "left").select("seed", "entity", F.lit(0).alias("distance"), F.coalesce("_salts", F.lit(1)).alias("_salts"))
    reached = frontier = written(frontier, "walks")
    for step in range(1, depth + 1):
        if limit is not None and step > 1:
            full = reached.where("distance > 0").groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
            frontier = frontier.join(full, "seed", "left_anti")
        salted = frontier.select("seed", "entity", F.pmod(F.xxhash64("seed"), F.col("_salts").cast("long")).cast("int").alias("salt"))
        to = salted.join(near, ["entity", "salt"]).select("seed", F.col("target").alias("entity"), F.lit(step).alias("distance"), F.col("target_salts").alias("_salts")).distinct()
        frontier = to.join(reached.select("seed", "entity"), ["seed", "entity"], "left_anti")
        if step < depth:
            frontier = written(frontier.select(*reached.columns), "walks")
        reached = reached.unionByName(frontier)
    return reached.drop("_salts")


def nearest(edges: DataFrame, seeds: DataFrame, depth: int, limit: int) -> DataFrame:
    """``seed, entity, distance, rank``: the ``limit`` nearest entities of each seed without its own, ties by name."""
    found = walks(edges, seeds, depth, limit).where("distance > 0")
    order = Window.partitionBy("seed").orderBy("distance", "entity")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def match_entity(name: Column, query: str) -> Column:
    """Either name contains the other, ignoring case."""
    q = query.lower()
    return F.contains(F.lower(name), F.lit(q)) | F.contains(F.lit(q), F.lower(name))


def related_entities(edges: DataFrame, entities: DataFrame, name: str, depth: int = 2, seeds: int = 5, limit: int = 50) -> DataFrame:
    start = entities.where(match_entity(F.col("entity"), name)).orderBy("entity").limit(seeds)
    return within(edges, start, depth).where("distance > 0").orderBy("distance", "entity").limit(limit)


def expand_entities(edges: DataFrame, entities: DataFrame, name: str, seeds: int = 3) -> DataFrame:
    """Matching entities and their outgoing neighbours, an empty list where there is none."""
    start = entities.where(match_entity(F.col("entity"), name)).orderBy("entity").limit(seeds)
    out = edges.select(F.col("source").alias("entity"), "target")
    return start.join(out, "entity", "left").groupBy("entity").agg(F.array_sort(F.collect_set("target")).alias("neighbours"))


def subgraph(edges: DataFrame, centre: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (``entity, is_center``) and edges within reach of ``centre``."""
    nodes = within(edges, centre, depth)
    inside = nodes.select(F.col("entity").alias("source"))
    kept = edges.join(inside, "source", "left_semi").join(inside.withColumnRenamed("source", "target"), "target", "left_semi")
    return nodes.select("entity", (F.col("distance") == 0).alias("is_center")), kept


def stats(entities: DataFrame, edges: DataFrame, kind: str = "type") -> DataFrame:
    """Entities by type with both totals."""
    totals = entities.agg(F.count("*").alias("entities")).join(edges.agg(F.count("*").alias("relations")))
    return entities.groupBy(kind).agg(F.count("*").alias("count")).join(F.broadcast(totals))


def delete_document(mentions: DataFrame, document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions without those of ``document`` (chunk_id), and the entities that still have one."""
    kept = mentions.join(document, "chunk_id", "left_anti")
    return kept, mentions.select("entity").distinct().join(kept, "entity", "left_semi")


def search(entities: DataFrame, term: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Substring search, optionally by type; a null confidence comes first, as in descending graph order."""
    hit = entities.where(F.contains(F.lower("entity"), F.lit(term.lower())))
    if kind is not None:
        hit = hit.where(F.col("type") == kind)
    return hit.orderBy(F.col("confidence").desc_nulls_first(), "entity").limit(limit)


def graph_score(chunks: DataFrame, names: DataFrame, each: float = 0.3) -> DataFrame:
    """``chunks`` with ``graph_score``: ``each`` for every distinct name of ``names`` (entity) it contains, case aside."""
    lowered = chunks.withColumn("_text", F.lower("content"))
    counted = matching.count_contained(lowered, "_text", names.select(F.lower("entity").alias("key")), "_hits")
    return counted.withColumn("graph_score", F.round(F.col("_hits") * each, 6)).drop("_text", "_hits")


def entity_mentions(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of a document that contain one of the document's entities (document_id, name), case aside."""
    names = entities.select("document_id", "entity_id", F.lower("name").alias("name"))
    return matching.contained_by_group(names, chunks.select("document_id", "chunk_id", F.lower("content").alias("content")), "document_id", "entity_id", "chunk_id")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins by key, as property overwrite does."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
