"""Retrieval and vector queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import DATE
from ..operators import index as I
from ..operators import retrieval as R
from ..operators import upsert as U
from ..sources import tables as T
from ..sources.store import new_path, written


def _vectors(s, d):
    return T.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _vq(s, d):
    """Every hundredth vector is a query against all."""
    return _vectors(s, d).where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding")


def _corpus(s, d):
    return _vectors(s, d)


def _chunks(s, d):
    return T.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _text_queries(s, d):
    """Every benchmark text; the numbers meet those of the vector queries."""
    return T.table(s, d, "benchmark").select((F.col("item_id") * 100).alias("query_id"), F.col("text").alias("query"))


def _semantic(s, d, k=R.CANDIDATES):
    return R.semantic_search(_vq(s, d), _corpus(s, d), k)


def _bm25(s, d, k=R.CANDIDATES):
    return R.Bm25Index(_chunks(s, d)).search(_text_queries(s, d), k)


def _fused(s, d):
    """Fused hits and the keyword hits among them, found once."""
    keyword = written(_bm25(s, d), "hits")
    # Half of a score of six digits has seven: eight leave no ties to round.
    return R.hybrid_search(_semantic(s, d), keyword, R.FUSED, digits=8), keyword


def _hybrid(s, d):
    return _fused(s, d)[0]


def _promoted(s, d):
    fused, keyword = _fused(s, d)
    return R.promote(written(fused, "hits"), keyword)


def _survivors(s, d):
    fused, keyword = _fused(s, d)
    return R.survivors(keyword, fused).select("query_id", "id", "bm25_score")


def _changed_documents(s, d):
    """What becomes of the documents: a third comes later, some then change and some go."""
    docs = _chunks(s, d)
    later = docs.where("id % 3 = 1")
    changed = docs.where("id % 5 = 2").withColumn("content", F.concat("content", F.lit(" Addendum the of")))
    return docs.where("id % 3 <> 1"), later, changed, docs.where("id % 7 = 3").select("id")


def _refreshed(s, d):
    """An index that follows its documents through three changes, the second one delivered twice."""
    first, later, changed, gone = _changed_documents(s, d)
    live = I.LiveIndex(s, new_path(s, "live"))
    live.change(1, first)
    live.change(2, later.unionByName(changed.where("id % 3 <> 1")).where("id % 7 <> 3"), gone)
    live.change(2, later, gone)
    live.change(3, changed.where("id % 3 = 1 AND id % 7 <> 3"), first.where("id % 11 = 5").select("id"))
    return live


def _refresh_stats(s, d):
    stats = _refreshed(s, d).stats()
    return I.inverse_frequencies(stats).select("token", "df", F.round("idf", 6).alias("idf"))


def _date_boost(s, d):
    index = R.Bm25Index(_chunks(s, d))
    q = _text_queries(s, d)
    dated = q.withColumn("query", F.concat("query", F.lit(" 2024-01-15 the")))
    dates = dated.select("query_id", F.array_join(F.regexp_extract_all("query", F.lit(DATE), F.lit(0)), " ").alias("query"))
    return R.best_of_passes(index.search(dated, 50), index.search(dates.withColumn("query", F.concat("query", F.lit(" the"))), 50))


def _upsert(s, d):
    base = _vectors(s, d)
    delta = base.where("id % 9 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2)).withColumn("label", F.lit(99))
    out = U.upsert(base, delta, "id")
    return out.select("id", "label", F.round(R.norm(F.col("embedding")), 4).alias("norm"))


def _min_max(s, d):
    hits = T.table(s, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "value")
    return hits.select("query_id", "id", F.round(R.min_max("value"), 6).alias("scaled"))


def _verify(s, d):
    a = _semantic(s, d, 5).select("query_id", "id")
    # A copy that lost every seventh vector.
    moved = _corpus(s, d).where("id % 7 <> 0")
    b = R.semantic_search(_vq(s, d), moved, 5).select("query_id", "id")
    return a.intersect(b).groupBy("query_id").agg(F.count("*").alias("overlap"))


QUERIES = {
    "semantic_search": lambda s, d: _semantic(s, d, 10),
    "bm25_search": lambda s, d: _bm25(s, d, 10),
    "bm25_stats": lambda s, d: R.Bm25Index(_chunks(s, d)).idf().select("token", "df", F.round("idf", 6).alias("idf")),
    "hybrid_search": _hybrid,
    "hybrid_survivors": _survivors,
    "bm25_refresh": lambda s, d: _refreshed(s, d).search(_text_queries(s, d), 10),
    "bm25_refresh_stats": _refresh_stats,
    "hybrid_promoted": _promoted,
    "rrf_search": lambda s, d: R.reciprocal_rank_fusion(_semantic(s, d), _bm25(s, d), 20),
    "bm25_date_boost": _date_boost,
    "min_max_normalize": _min_max,
    "cosine_pairs": lambda s, d: R.semantic_search(_vq(s, d), _corpus(s, d), None).select("query_id", "id", "similarity"),
    "l2_normalize": lambda s, d: _vectors(s, d).select("id", F.round(R.l2_normalize(F.col("embedding"))[0], 6).alias("first"), F.round(R.norm(R.l2_normalize(F.col("embedding"))), 6).alias("norm")),
    "recall_at_k": lambda s, d: R.recall_at_k(_semantic(s, d, 10), _vectors(s, d).select("id", "label")),
    "list_vector_ids": lambda s, d: _vectors(s, d).where("embedding is not null").select("id").orderBy("id").limit(10_000),
    "get_vectors": lambda s, d: _vectors(s, d).where(F.col("id").isin(3, 5, 8, 13, 10**9)).select("id", "label"),
    "vector_count": lambda s, d: _vectors(s, d).agg(F.count("embedding").alias("n")),
    "vector_upsert": _upsert,
    "vector_delete": lambda s, d: U.clear_column(_vectors(s, d), _vectors(s, d).where("label = 3"), "id", "embedding").select("id", F.size("embedding").alias("dims"), "cleared"),
    "vector_migrate": lambda s, d: _vectors(s, d).where("embedding is not null").select("id", "label"),
    "vector_verify": _verify,
}

_TOK = "regexp_split_to_array({}, '[^a-zA-Z0-9]+')"
_SEM = f"""vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
sem0 AS (SELECT query_id, vec_id AS id, round(list_dot_product(q, embedding::DOUBLE[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS similarity FROM vq, embeddings WHERE embedding IS NOT NULL),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM sem0)"""
_INDEX_OF = lambda docs: f"""tok AS (SELECT id, lower(t) AS token FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(text, '[^a-zA-Z0-9]+')) AS t FROM {docs}) WHERE t <> ''),
postings AS (SELECT token, id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9]+'), lambda t: t <> '')) AS dl FROM {docs}),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idf0 AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings, totals GROUP BY token),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM idf0) ELSE raw END AS idf FROM idf0)"""  # noqa: E731
_INDEX = _INDEX_OF("documents")
# The documents as they are after the three changes.
_LIVE = """live AS (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN text || ' Addendum the of' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3 AND NOT (doc_id % 3 <> 1 AND doc_id % 11 = 5))"""
_TQ = "tq AS (SELECT item_id * 100 AS query_id, text AS query FROM benchmark)"


def _bm25_sql(name: str, queries: str) -> str:
    return f"""{name}_q AS (SELECT query_id, lower(t) AS token, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_split_to_array(query, '[^a-zA-Z0-9]+')) AS t FROM {queries}) WHERE t <> '' GROUP BY ALL),
{name}_s AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25_score FROM postings JOIN {name}_q USING (token) JOIN idf USING (token) JOIN dl USING (id), totals GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, id)::INT AS rank FROM {name}_s)"""


_SCALE = lambda c: f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END ELSE ({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0) END"
_HYB = f"""{_SEM}, {_INDEX}, {_TQ}, {_bm25_sql('bm', 'tq')},
bm100 AS (SELECT query_id, id, bm25_score, rank FROM bm WHERE rank <= 100 AND bm25_score > 0), sem100 AS (SELECT * FROM sem WHERE rank <= 100),
both0 AS (SELECT query_id, id, coalesce(similarity, 0.0) AS similarity, coalesce(bm25_score, 0.0) AS bm25_score FROM (SELECT query_id, id, similarity FROM sem100) FULL JOIN (SELECT query_id, id, bm25_score FROM bm100) USING (query_id, id)),
scored AS (SELECT query_id, id, similarity, bm25_score, round((0.5::DOUBLE * ({_SCALE('similarity')}) + 0.5::DOUBLE * ({_SCALE('bm25_score')})) / 1.0, 8) AS hybrid_score FROM both0 WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, id)::INT AS rank FROM scored QUALIFY rank <= 50)"""

ORACLES = {
    "semantic_search": f"WITH {_SEM} SELECT * FROM sem WHERE rank <= 10",
    "bm25_search": f"WITH {_INDEX}, {_TQ}, {_bm25_sql('bm', 'tq')} SELECT * FROM bm WHERE rank <= 10 AND bm25_score > 0",
    "bm25_refresh": f"WITH {_LIVE}, {_INDEX_OF('live')}, {_TQ}, {_bm25_sql('bm', 'tq')} SELECT * FROM bm WHERE rank <= 10 AND bm25_score > 0",
    "bm25_refresh_stats": f"WITH {_LIVE}, {_INDEX_OF('live')} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "bm25_stats": f"WITH {_INDEX} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "hybrid_search": f"WITH {_HYB} SELECT query_id, id, similarity, bm25_score, hybrid_score, rank FROM fused",
    "hybrid_survivors": f"WITH {_HYB} SELECT query_id, id, bm25_score FROM bm100 ANTI JOIN fused USING (query_id, id)",
    "hybrid_promoted": f"""WITH {_HYB}, listed AS (SELECT query_id, id, 0.0::DOUBLE AS similarity, bm25_score, NULL::DOUBLE AS hybrid_score, 0 AS grp FROM bm100 ANTI JOIN fused USING (query_id, id)
UNION ALL SELECT query_id, id, similarity, bm25_score, hybrid_score, CASE WHEN similarity = 0 AND bm25_score > 0 THEN 1 ELSE 2 END FROM fused)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grp, CASE WHEN grp < 2 THEN -bm25_score ELSE -hybrid_score END, id)::INT AS rank FROM listed""",
    "rrf_search": f"WITH {_HYB}, rrf AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score FROM (SELECT query_id, id, rank FROM sem100 UNION ALL SELECT query_id, id, rank FROM bm100) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id)::INT AS rank FROM rrf QUALIFY rank <= 20",
    "bm25_date_boost": f"WITH {_INDEX}, {_TQ}, dated AS (SELECT query_id, query || ' 2024-01-15 the' AS query FROM tq), dates AS (SELECT query_id, array_to_string(regexp_extract_all(query, '{DATE}'), ' ') || ' the' AS query FROM dated), {_bm25_sql('p1', 'dated')}, {_bm25_sql('p2', 'dates')} SELECT query_id, id, max(bm25_score) AS bm25_score FROM (SELECT * FROM p1 WHERE rank <= 50 AND bm25_score > 0 UNION ALL SELECT * FROM p2 WHERE rank <= 50 AND bm25_score > 0) GROUP BY ALL",
    "min_max_normalize": f"SELECT user_id AS query_id, event_id AS id, round({_SCALE('value')}, 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)",
    "cosine_pairs": f"WITH {_SEM} SELECT query_id, id, similarity FROM sem0",
    "l2_normalize": "SELECT vec_id AS id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, 1.0::DOUBLE AS norm FROM embeddings",
    "recall_at_k": f"WITH {_SEM} SELECT query_id, round(avg((l.label = o.label)::INT), 6) AS recall FROM sem JOIN embeddings l ON l.vec_id = id JOIN embeddings o ON o.vec_id = query_id WHERE rank <= 10 GROUP BY query_id",
    "list_vector_ids": "SELECT vec_id AS id FROM embeddings WHERE embedding IS NOT NULL ORDER BY id LIMIT 10000",
    "get_vectors": "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (3, 5, 8, 13, 1000000000)",
    "vector_count": "SELECT count(embedding) AS n FROM embeddings",
    "vector_upsert": "SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN 99 ELSE label END AS label, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * CASE WHEN vec_id % 9 = 0 THEN 2 ELSE 1 END, 4) AS norm FROM embeddings",
    "vector_delete": "SELECT vec_id AS id, CASE WHEN label <> 3 THEN len(embedding)::INT END AS dims, label = 3 AS cleared FROM embeddings",
    "vector_migrate": "SELECT vec_id AS id, label FROM embeddings WHERE embedding IS NOT NULL",
    "vector_verify": f"WITH {_SEM}, moved AS (SELECT query_id, id FROM sem0 WHERE id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 5) SELECT query_id, count(*) AS overlap FROM sem JOIN moved USING (query_id, id) WHERE rank <= 5 GROUP BY query_id",
}
