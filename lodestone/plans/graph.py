"""Graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators.live import LiveCorpus, LiveGraph
from ..sources import tables as T
from ..sources.store import new_path, written
from ..sources.tables import with_sql


def _edges(s, d):
    return G.cooccurrence(T.mentions(s, d))


def _entities(s, d):
    m = T.mentions(s, d).groupBy("entity").agg(F.count("*").alias("n"))
    return m.select("entity", F.substring("entity", 1, 7).alias("type"), F.when(F.col("n") % 5 != 0, F.round(F.col("n") / 1000.0, 3)).alias("confidence"))


def _every_seed(edges):
    return G.mirrored(edges).select(F.col("source").alias("seed"), F.col("source").alias("entity")).distinct()


def _text_edges(s, d):
    return written(G.cooccurrence(_line_mentions(s, d)), "edges")


def _seeds(s, d):
    return _entities(s, d).where("entity = 'Brand#11'")


def _text_mentions(s, d):
    e = X.each_entity(T.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text"), "text")
    e = e.select("document_id", "e.name", X.entity_id(F.col("e.name"), F.col("e.type")).alias("entity_id")).distinct()
    return G.entity_mentions(e, T.lines(s, d))


def _all_names(s, d):
    """All customers and parts, and the words of the parts' names."""
    part, customer = T.table(s, d, "part"), T.table(s, d, "customer")
    words = part.select(F.explode(F.split("p_name", " ")).alias("entity"))
    return customer.select(F.col("c_name").alias("entity")).unionByName(part.select(F.col("p_name").alias("entity"))).unionByName(words)


def _parse(s, d):
    """Model output for entities: names of two characters or more at a confidence of at least 0.5, the first of an id."""
    raw = T.table(s, d, "part").select("p_partkey", F.split("p_brand", "#")[0].alias("kind"), F.col("p_type").alias("name"), ((F.col("p_partkey") % 10) / 10.0).alias("confidence"))
    good = raw.where((F.length("name") >= 2) & (F.col("confidence") >= 0.5)).withColumn("entity_id", X.entity_id(F.col("name"), F.col("kind")))
    return good.groupBy("entity_id").agg(F.min("p_partkey").alias("first_seen"), F.max("confidence").alias("confidence"))


def _relations(s, d):
    """Model output for relations: both ends known, no loops, a confidence of at least 0.6."""
    known = _entities(s, d).where("confidence is not null").select("entity")
    raw = T.table(s, d, "part").select(F.col("p_brand").alias("source"), F.concat(F.lit("Brand#"), ((F.col("p_partkey") % 5 + 1) * 10 + F.col("p_size") % 5 + 1).cast("string")).alias("target"), ((F.col("p_partkey") % 10) / 10.0).alias("confidence"))
    good = raw.where("confidence >= 0.6 and source <> target")
    good = good.join(known.withColumnRenamed("entity", "source"), "source", "left_semi").join(known.withColumnRenamed("entity", "target"), "target", "left_semi")
    return good.groupBy("source", "target").agg(F.max("confidence").alias("confidence"))


def _delete(s, d):
    gone = T.mentions(s, d).where("chunk_id % 3 <> 0").select("chunk_id").distinct()
    kept, entities = G.delete_document(T.mentions(s, d), gone)
    return kept.groupBy("entity").agg(F.count("*").alias("mentions")).join(entities, "entity")


def _line_mentions(s, d):
    """The names in each line of the documents."""
    found = X.each_entity(T.lines(s, d).select("document_id", "chunk_id", "content"), "content")
    return found.select("document_id", "chunk_id", F.col("e.name").alias("entity")).distinct()


def _refreshed_graph(s, d):
    """A graph that follows its documents: a third comes later, some change and some go, and one batch comes twice."""
    now = written(_line_mentions(s, d), "mentions")
    ids = T.table(s, d, "documents").select(F.col("doc_id").alias("document_id"))
    changed = now.withColumn("entity", F.concat("entity", F.lit(" (changed)"))).where("document_id % 5 = 2")
    live = LiveGraph(s, new_path(s, "graph"))
    live.change(1, ids.where("document_id % 3 <> 1"), now)
    second = ids.where("document_id % 3 = 1 OR document_id % 5 = 2 OR document_id % 7 = 3")
    rows = now.where("document_id % 3 = 1").unionByName(changed.where("document_id % 3 <> 1")).where("document_id % 7 <> 3")
    live.change(2, second, rows)
    live.change(2, second, rows)
    live.compact(3)
    third = ids.where("(document_id % 3 = 1 AND document_id % 5 = 2 AND document_id % 7 <> 3) OR (document_id % 3 <> 1 AND document_id % 11 = 5)")
    live.change(4, third, changed.where("document_id % 3 = 1"))
    return live


def _cascade(s, d):
    """What chunks, wiki, vectors, graph and index hold of each document after a quarter of the documents went."""
    docs = T.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    lines = T.lines(s, d).select("document_id", "chunk_id", "content")
    vectors = T.table(s, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("vec_id").alias("vector_id"))
    every = docs.select("document_id").unionByName(vectors.select("document_id"))
    corpus = LiveCorpus(s, new_path(s, "corpus"))
    corpus.change(1, every, _line_mentions(s, d), chunks=lines, wiki=docs.withColumnRenamed("text", "summary"), vectors=vectors)
    corpus.change(2, docs.where("document_id % 4 = 0"))
    chunks = corpus.tables["chunks"].rows()
    indexed = corpus.index.documents().select(F.col("id").alias("chunk_id")).join(chunks.select("chunk_id", "document_id"), "chunk_id", "left")
    stores = {name: t.rows() for name, t in corpus.tables.items()} | {"mentions": corpus.graph.rows(), "indexed": indexed}
    counts = None
    for name, rows in stores.items():
        one = rows.select("document_id", F.lit(name).alias("store"))
        counts = one if counts is None else counts.unionByName(one)
    return counts.groupBy("document_id").agg(*(F.count_if(F.col("store") == name).alias(name) for name in stores))


QUERIES = {
    "graph_nodes": lambda s, d: _entities(s, d),
    "graph_mentions": lambda s, d: T.mentions(s, d).groupBy("entity").agg(F.count("*").alias("chunks")),
    "graph_edges": lambda s, d: _edges(s, d),
    "cooccurrence": lambda s, d: G.top_edges(_edges(s, d)),
    "graph_stats": lambda s, d: G.stats(_entities(s, d), _edges(s, d)),
    "graph_delete_doc": _delete,
    "entity_match": lambda s, d: _entities(s, d).where(G.match_entity(F.col("entity"), "all of brand#12 and brand#34")).select("entity"),
    "entity_search": lambda s, d: G.search(_entities(s, d), "brand#2", None, 5),
    "related_entities": lambda s, d: G.related_entities(_edges(s, d), _entities(s, d), "Brand#1", 2, 2, 15),
    "brand_walks": lambda s, d: G.nearest(_edges(s, d), _entities(s, d).select(F.col("entity").alias("seed"), "entity"), 3, 20),
    "text_walks": lambda s, d: (lambda e: G.nearest(e, _every_seed(e), 3, 50))(_text_edges(s, d)),
    "expand_entities": lambda s, d: G.expand_entities(_edges(s, d), _entities(s, d), "Brand#", 3).select("entity", F.array_join("neighbours", ",").alias("neighbours")),
    "entity_subgraph": lambda s, d: G.subgraph(_edges(s, d), _seeds(s, d), 2)[0],
    "entity_subgraph_edges": lambda s, d: G.subgraph(_edges(s, d), _seeds(s, d), 1)[1].select("source", "target", "weight"),
    "entity_mentions": _text_mentions,
    "entity_parse": _parse,
    "relation_parse": _relations,
    "graph_refresh": lambda s, d: _refreshed_graph(s, d).edges(),
    "graph_refresh_entities": lambda s, d: _refreshed_graph(s, d).entities(),
    "corpus_cascade": _cascade,
    "graph_score": lambda s, d: G.graph_score(T.lines(s, d), _all_names(s, d)).select("chunk_id", "graph_score"),
}

_EDGES = """edges AS (SELECT a.entity AS source, b.entity AS target, count(*) AS weight, round(least(1.0::DOUBLE, count(*) / 10.0::DOUBLE), 2) AS confidence FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= 2),
both_ways AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
entities AS (SELECT entity, substr(entity, 1, 7) AS type, CASE WHEN count(*) % 5 <> 0 THEN round(count(*) / 1000.0::DOUBLE, 3) END AS confidence FROM mentions GROUP BY entity)"""


def _g(query: str, *extra: str) -> str:
    return with_sql("", "mentions").rstrip() + ", " + ", ".join([_EDGES, *extra]) + "\n" + query


_REACH = lambda seeds, depth: f"reach AS (WITH RECURSIVE r(entity, distance) AS (SELECT entity, 0 FROM ({seeds}) UNION SELECT target, distance + 1 FROM r JOIN both_ways ON source = entity WHERE distance < {depth}) SELECT entity, min(distance)::INT AS distance FROM r GROUP BY entity)"
_LINES_ENT = "ents AS (SELECT DISTINCT doc_id AS document_id, name, substr(md5(lower(name) || '|' || lower(type)), 1, 16) AS entity_id FROM ({}) WHERE length(name) >= 2)"

ORACLES = {
    "graph_nodes": _g("SELECT * FROM entities"),
    "graph_mentions": _g("SELECT entity, count(*) AS chunks FROM mentions GROUP BY entity"),
    "graph_edges": _g("SELECT * FROM edges"),
    "cooccurrence": _g("SELECT * FROM edges ORDER BY weight DESC, source, target LIMIT 50"),
    "graph_stats": _g("SELECT type, count(*) AS count, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM edges) AS relations FROM entities GROUP BY type"),
    "graph_delete_doc": _g("SELECT entity, count(*) AS mentions FROM mentions WHERE chunk_id % 3 = 0 GROUP BY entity"),
    "entity_match": _g("SELECT entity FROM entities WHERE contains(lower(entity), 'all of brand#12 and brand#34') OR contains('all of brand#12 and brand#34', lower(entity))"),
    "entity_search": _g("SELECT * FROM entities WHERE contains(lower(entity), 'brand#2') ORDER BY confidence DESC NULLS FIRST, entity LIMIT 5"),
    "related_entities": _g("SELECT * FROM reach WHERE distance > 0 ORDER BY distance, entity LIMIT 15", _REACH("SELECT entity FROM entities WHERE contains(lower(entity), 'brand#1') ORDER BY entity LIMIT 2", 2)),
    "expand_entities": _g("SELECT e.entity, coalesce(string_agg(DISTINCT target, ',' ORDER BY target), '') AS neighbours FROM (SELECT entity FROM entities ORDER BY entity LIMIT 3) e LEFT JOIN edges ON source = e.entity GROUP BY e.entity"),
    "entity_subgraph": _g("SELECT entity, distance = 0 AS is_center FROM reach", _REACH("SELECT entity FROM entities WHERE entity = 'Brand#11'", 2)),
    "entity_subgraph_edges": _g("SELECT source, target, weight FROM edges WHERE source IN (SELECT entity FROM reach) AND target IN (SELECT entity FROM reach)", _REACH("SELECT entity FROM entities WHERE entity = 'Brand#11'", 1)),
    "entity_parse": "SELECT substr(md5(lower(p_type) || '|brand'), 1, 16) AS entity_id, min(p_partkey) AS first_seen, max((p_partkey % 10) / 10.0::DOUBLE) AS confidence FROM part WHERE length(p_type) >= 2 AND (p_partkey % 10) / 10.0 >= 0.5 GROUP BY 1",
    "relation_parse": _g("SELECT source, target, max(confidence) AS confidence FROM (SELECT p_brand AS source, 'Brand#' || ((p_partkey % 5 + 1) * 10 + p_size % 5 + 1) AS target, (p_partkey % 10) / 10.0::DOUBLE AS confidence FROM part) WHERE confidence >= 0.6 AND source <> target AND source IN (SELECT entity FROM entities WHERE confidence IS NOT NULL) AND target IN (SELECT entity FROM entities WHERE confidence IS NOT NULL) GROUP BY ALL"),
    "graph_score": with_sql(""", names AS (SELECT DISTINCT lower(n) AS name FROM (SELECT c_name AS n FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part) WHERE n <> '')
SELECT chunk_id, round(count(name) * 0.3::DOUBLE, 6) AS graph_score FROM lines LEFT JOIN names ON contains(lower(content), name) GROUP BY chunk_id""".lstrip(), "lines").replace("\n,", ","),
}
from .text import _ents  # noqa: E402

ORACLES["entity_mentions"] = with_sql("", "lines").rstrip() + ", " + _LINES_ENT.format(_ents) + " SELECT DISTINCT document_id, entity_id, chunk_id FROM ents JOIN lines USING (document_id) WHERE contains(lower(content), lower(name))"

_NAMED = with_sql("", "lines").rstrip() + ", named AS (SELECT DISTINCT doc_id AS chunk_id, name AS entity FROM (" + _ents.replace("FROM documents", "FROM (SELECT chunk_id AS doc_id, content AS text FROM lines)") + ") WHERE length(name) >= 2)"
_NOW = _NAMED + """, now AS (SELECT chunk_id, CASE WHEN document_id % 5 = 2 THEN entity || ' (changed)' ELSE entity END AS entity FROM named JOIN lines USING (chunk_id)
WHERE document_id % 7 <> 3 AND NOT (document_id % 3 <> 1 AND document_id % 11 = 5))
"""
ORACLES["graph_refresh"] = _NOW + "SELECT a.entity AS source, b.entity AS target, count(*) AS weight, round(least(1.0::DOUBLE, count(*) / 10.0::DOUBLE), 2) AS confidence FROM now a JOIN now b ON a.chunk_id = b.chunk_id AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= 2"
ORACLES["graph_refresh_entities"] = _NOW + "SELECT entity, count(*) AS mentions FROM now GROUP BY entity"
ORACLES["corpus_cascade"] = _NAMED + """, held AS (SELECT document_id, 'chunks' AS store FROM lines UNION ALL SELECT doc_id, 'wiki' FROM documents UNION ALL SELECT vec_id, 'vectors' FROM embeddings
UNION ALL SELECT document_id, 'mentions' FROM named JOIN lines USING (chunk_id) UNION ALL SELECT document_id, 'indexed' FROM lines)
SELECT document_id, """ + ", ".join(f"count(*) FILTER (store = '{s}') AS {s}" for s in ("chunks", "wiki", "vectors", "mentions", "indexed")) + " FROM held WHERE NOT (document_id % 4 = 0 AND document_id IN (SELECT doc_id FROM documents)) GROUP BY document_id"

_NEAREST = """, w AS (WITH RECURSIVE r(seed, entity, distance) AS (SELECT source, source, 0 FROM both_ways UNION SELECT seed, target, distance + 1 FROM r JOIN both_ways ON source = entity WHERE distance < 3)
SELECT seed, entity, min(distance)::INT AS distance FROM r GROUP BY ALL HAVING min(distance) > 0)
SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, entity)::INT AS rank FROM w QUALIFY rank <= """
ORACLES["brand_walks"] = _g("").rstrip() + _NEAREST + "20"
ORACLES["text_walks"] = _NAMED + ", mentions AS (SELECT * FROM named), " + _EDGES + _NEAREST + "50"
