"""Memory, wiki, answer and monitoring queries and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import memory as M
from ..operators import monitoring as O
from ..operators import retrieval as R
from ..operators import upsert as U
from ..sources import tables as T
from ..sources.tables import with_sql
from ..streaming import alerts as L

NOW = dt.datetime(2024, 1, 10)


def _facts(s, d):
    return T.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", ((F.col("vec_id") % 10) / 10.0).alias("confidence"))


def _wiki(s, d):
    """An entry a document: its text as the summary, its source, language and all words as topics, the id as the order."""
    docs = T.table(s, d, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.col("text").alias("summary"), F.concat(F.array("source", "lang"), F.split(F.lower("text"), " ")).alias("topics"), F.col("doc_id").alias("updated_at"))


def _reviewed(s, d):
    """Every benchmark text as an answer over the lines of a document; the citations are none, right or partly strange."""
    q = T.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))
    context = _hits(s, d).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("content")), " ").alias("context"), F.array_sort(F.collect_list("chunk_id")).alias("known"))
    cite = lambda c: F.struct(c.cast("string").alias("chunk_id"))
    first = F.array(cite(F.col("known")[0]))
    cited = F.when(F.col("query_id") % 3 == 0, F.concat(first, F.array(cite(F.lit("x")), cite(F.lit("y"))))).when(F.col("query_id") % 3 == 1, first).otherwise(F.array().cast("array<struct<chunk_id:string>>"))
    support = A.claim_support(F.col("answer"), F.col("context"))
    return q.join(context, "query_id").select("query_id", A.review(cited, F.col("known"), support, (F.col("query_id") % 4).cast("int")).alias("r")).select("query_id", "r.*")


def _facts_added(s, d):
    old = _facts(s, d).select("id", F.lit("old").alias("fact"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.lit("import").alias("source"), F.lit(None).cast("string").alias("source_id"), "confidence")
    new = T.table(s, d, "documents").select((F.col("doc_id") + 1_000_000_000).alias("id"), F.col("text").alias("fact"), F.col("doc_id").cast("string").alias("source_id"))
    return M.add_facts(old, new).select("id", F.md5("fact").alias("fact"), F.size("embedding").alias("dims"), "source", "source_id", "confidence")


def _even(s, d):
    return T.messages(s, d).where("session_id % 2 = 0").select("session_id").distinct()


def _doc_chunks(s, d):
    docs = T.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.md5("text").alias("digest"))
    n = T.lines(s, d).groupBy("document_id").agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last"))
    return docs.join(n, "document_id", "left").select("document_id", "digest", F.coalesce("chunks", F.lit(0)).alias("chunks"), "last")


def _cascade(s, d):
    gone = T.table(s, d, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("document_id"))
    return U.delete_where_parent(T.lines(s, d), gone, "document_id").groupBy("document_id").agg(F.count("*").alias("chunks"))


def _hits(s, d):
    """Every document is a question, its lines are the hits in order."""
    return T.lines(s, d).select(F.col("document_id").alias("query_id"), "document_id", "chunk_id", "content", (F.col("chunk_index") + 1).cast("int").alias("rank"))


def _claims(s, d):
    q = T.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))
    context = _hits(s, d).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("content")), " ").alias("context"))
    return q.join(context, "query_id").select("query_id", F.round(A.claim_support(F.col("answer"), F.col("context")), 6).alias("support"), (A.claim_support(F.col("answer"), F.col("context")) >= A.MIN_SUPPORT).alias("passed"))


def _citations(s, d):
    b = T.table(s, d, "benchmark")
    one = F.struct(F.col("item_id").cast("string").alias("chunk_id"), (F.col("item_id") * 2).cast("string").alias("document_id"), F.col("text").alias("content_snippet"))
    two = F.struct(F.lit("x").alias("chunk_id"), F.lit("y").alias("document_id"), F.lit("").alias("content_snippet"))
    return b.select("item_id", F.when(F.col("item_id") % 3 == 0, F.array(one, two)).when(F.col("item_id") % 3 == 1, F.array(one)).otherwise(F.array().cast("array<struct<chunk_id:string,document_id:string,content_snippet:string>>")).alias("c"), "text")


def _synthesize(s, d):
    c = _citations(s, d)
    kind = F.element_at(F.array(*map(F.lit, ("greeting", "irrelevant", "hybrid", "semantic", "keyword"))), (F.col("item_id") % 5 + 1).cast("int"))
    error = F.when(F.col("item_id") % 17 == 0, "timeout").otherwise("")
    feedback = F.when(F.col("item_id") % 4 == 0, "check sources").otherwise("")
    text = A.respond(kind, F.col("text"), (F.col("item_id") % 11) / 10.0, F.col("c"), feedback, F.col("item_id") % 8 != 0, error)
    return c.select("item_id", text.alias("response"))


def _honesty(s, d):
    e = T.table(s, d, "events")
    answer = F.element_at(F.array(*map(F.lit, ("I don't know.", "The answer is 4.", "  Not enough information here", "", "I cannot answer that", "Paris"))), (F.col("event_id") % 6 + 1).cast("int"))
    score = (F.col("event_id") % 101) / 100.0 - 0.05
    bm25 = F.when(F.col("event_id") % 4 == 0, 2.0).otherwise(0.0)
    return e.select("event_id", A.is_refused(answer, F.col("event_id") % 50 != 0, score, bm25, F.col("event_id") % 2 == 0).alias("refused"))


def _invalid(s, d):
    cited = _hits(s, d).select("query_id", F.when(F.col("chunk_id") % 3 == 0, F.col("chunk_id") + 7).otherwise(F.col("chunk_id")).alias("chunk_id"))
    return A.invalid_citations(cited, _hits(s, d))


def _excerpt(s, d):
    docs = T.table(s, d, "documents")
    return docs.select("doc_id", F.md5(A.excerpt(F.col("text"), F.lit("tion ible 2024-01-15"))).alias("digest"))


#: Bounds that fit the values of the events, which stand for latencies.
_BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)


def _alert(low, high, minutes, least):
    def run(s, d):
        status = F.when(F.col("status") == 500, 500).when(F.col("request_id") % 7 == 0, 429).when(F.col("request_id") % 5 == 0, 404).otherwise(200)
        hit = O.status_alerts(T.request_log(s, d).withColumn("status", status), low, high, f"{minutes} minutes", "1 minute", least, by=("path",))
        return hit.select("path", F.unix_seconds("start").alias("start"), "total", "errors")

    return run


QUERIES = {
    "working_memory_last10": lambda s, d: M.last_messages(T.messages(s, d)),
    "working_history": lambda s, d: M.oldest_messages(T.messages(s, d), 5),
    "history_block": lambda s, d: M.history_block(T.messages(s, d)),
    "session_summary": lambda s, d: M.session_summary(T.messages(s, d)),
    "session_topics": lambda s, d: M.session_topics(T.messages(s, d)).select("session_id", F.array_join("topics", ",").alias("topics")),
    "episodic_upsert": lambda s, d: U.upsert(M.session_summary(T.messages(s, d)), M.session_summary(T.messages(s, d).where("turn < 3")).where("session_id % 2 = 0"), "session_id"),
    "ttl_prune": lambda s, d: M.expire(T.activities(s, d), "date", F.lit(NOW), 5).select("activity_id", "date"),
    "prune_low_conf": lambda s, d: M.confident(_facts(s, d)).select("id", "confidence"),
    "facts_min_conf": lambda s, d: M.confident(_facts(s, d), 0.5).select("id", "confidence"),
    "fact_search": lambda s, d: R.semantic_search(_facts(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), M.confident(_facts(s, d), 0.5), 5),
    "usage_increment": lambda s, d: M.count_usage(T.table(s, d, "events").select("event_type", F.lit(1).alias("usage_count")).distinct(), T.table(s, d, "events").where("value > 10"), "event_type"),
    "topics_overlap": lambda s, d: M.with_topics(_wiki(s, d), ["the", "of", "der", "de"]).select("document_id", F.md5("summary").alias("summary")),
    "metadata_filter": lambda s, d: T.table(s, d, "events").where(F.get_json_object("props", "$.k").cast("int") == 42).select("event_id", "props"),
    "reassemble_text": lambda s, d: M.reassemble(T.lines(s, d)).select("document_id", F.md5("text").alias("digest"), "chunks"),
    "document_with_chunks": _doc_chunks,
    "doc_kpis": lambda s, d: T.table(s, d, "documents").agg(F.count("*").alias("documents")).join(T.lines(s, d).agg(F.count("*").alias("chunks"))),
    "recent_documents": lambda s, d: T.table(s, d, "documents").orderBy(F.col("doc_id").desc()).limit(5).select("doc_id", "source", "n_chars"),
    "cascade_delete": _cascade,
    "dedup_exact": lambda s, d: U.exact_duplicates(T.table(s, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "content_hash", "is_duplicate"),
    "wiki_upsert": lambda s, d: U.upsert(_wiki(s, d), _wiki(s, d).where("document_id % 5 = 0").withColumn("summary", F.lit("new")), "document_id").select("document_id", F.md5("summary").alias("summary")),
    "wiki_backfill": lambda s, d: M.wiki_backfill(T.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "source"), _wiki(s, d).where("document_id % 3 <> 0")),
    "wiki_search": lambda s, d: M.wiki_search(_wiki(s, d), " SRC1 ").select("document_id", "match"),
    "context_prompt": lambda s, d: A.context_prompt(_hits(s, d)),
    "bm25_excerpt": _excerpt,
    "claim_support": _claims,
    "critic_review": _reviewed,
    "facts_added": _facts_added,
    "memory_clear": lambda s, d: M.clear(T.messages(s, d), _even(s, d)).groupBy("session_id").agg(F.count("*").alias("n")),
    "memory_cleared": lambda s, d: M.cleared(T.messages(s, d), _even(s, d)),
    "invalid_citations": _invalid,
    "format_citations": lambda s, d: _citations(s, d).select("item_id", A.format_citations(F.col("c")).alias("block")),
    "synthesize": _synthesize,
    "honesty_guard": _honesty,
    "error_rates": lambda s, d: O.error_rates(T.request_log(s, d)),
    "latency_percentiles": lambda s, d: O.latency_percentiles(T.request_log(s, d)),
    "histogram_quantile": lambda s, d: O.histogram_quantile(T.request_log(s, d), 0.95, _BOUNDS),
    "alert_5xx": lambda s, d: O.windowed_error_ratio(T.request_log(s, d), "5 minutes", "1 minute").select(F.unix_seconds("start").alias("start"), "total", "errors"),
    "alert_4xx": _alert(400, 500, 10, 0.25),
    "alert_429": _alert(429, 430, 5, 0.1),
    "alert_states": lambda s, d: L.transitions(T.counter_samples(s, d)),
    "active_buckets": lambda s, d: O.active_buckets(T.request_log(s, d)),
    "ratelimit_tier": lambda s, d: s.createDataFrame([(p,) for p in (*O.TIERS, "/qa/history", "/docs/x", "/health", "/monitoring/errors", "/other", "/searching")], "path string").select("path", O.tier(F.col("path")).alias("t")).select("path", "t.*"),
}

_text = lambda t: t.replace("'", "''")
_short = lambda c, n: f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n - 3}) || '...' ELSE {c} END"
_VEC = "list_dot_product({}, {})"
_WORDS = "list_distinct(list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}')))"
_HITS = "hits AS (SELECT document_id AS query_id, document_id, chunk_id, content, (chunk_index + 1)::INT AS rank FROM lines)"
_CITE = """cited AS (SELECT item_id, text, CASE WHEN item_id % 3 < 2 THEN chr(10) || '---' || chr(10) || '**Sources:**' || chr(10) || '1. `' || item_id || '` (document `' || item_id * 2 || '`)' || chr(10) || '   > ' || substr(text, 1, 200) ELSE '' END || CASE WHEN item_id % 3 = 0 THEN chr(10) || '2. `x` (document `y`)' ELSE '' END AS block FROM benchmark)"""
_SUMMARY = lambda where: f"SELECT session_id, count(*) AS message_count, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'Conversation with no recorded queries' ELSE 'Conversation about: ' || {_short('arg_min(content, turn) FILTER (role = ' + chr(39) + 'user' + chr(39) + ')', 120)} END AS summary FROM messages {where} GROUP BY session_id"
_LE = "CASE " + " ".join(f"WHEN latency <= {b} THEN {b}" for b in _BOUNDS) + " ELSE 'inf'::DOUBLE END"
_LOWER = "CASE le " + " ".join(f"WHEN {b} THEN {a}" for a, b in zip(_BOUNDS, _BOUNDS[1:])) + f" WHEN 'inf'::DOUBLE THEN {_BOUNDS[-1]} ELSE 0.0 END"
_ALERT = lambda low, high, minutes, least: with_sql(f"SELECT path, start, count(*) AS total, count(*) FILTER (status >= {low} AND status < {high}) AS errors FROM (SELECT path, status, unnest(range(epoch(ts)::BIGINT // 60 * 60 - {60 * minutes - 60}, epoch(ts)::BIGINT // 60 * 60 + 60, 60)) AS start FROM (SELECT path, CASE WHEN status = 500 THEN 500 WHEN request_id % 7 = 0 THEN 429 WHEN request_id % 5 = 0 THEN 404 ELSE 200 END AS status, date_trunc('second', ts) AS ts FROM log)) GROUP BY ALL HAVING count(*) FILTER (status >= {low} AND status < {high}) > {least} * count(*)", "log")
_TIER_ROWS = [(p, False, *t) for p, t in O.TIERS.items()] + [("/qa/history", False, 10, 60, 3), ("/docs/x", True, 0, 0, 0), ("/health", True, 0, 0, 0), ("/monitoring/errors", False, 120, 60, 20), ("/other", False, 60, 60, 0), ("/searching", False, 60, 60, 15)]

ORACLES = {
    "working_memory_last10": with_sql("SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 10", "messages"),
    "working_history": with_sql("SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn) <= 5", "messages"),
    "history_block": with_sql(f"SELECT session_id, chr(10) || '---' || chr(10) || '**Recent conversation:**' || chr(10) || string_agg(CASE WHEN role = 'user' THEN '**Q:** ' ELSE '**A:** ' END || {_short('content', 150)}, chr(10) ORDER BY turn) AS history FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 6) GROUP BY session_id", "messages"),
    "session_summary": with_sql(_SUMMARY(""), "messages"),
    "session_topics": with_sql("""SELECT session_id, string_agg(topic, ',' ORDER BY topic) AS topics FROM (SELECT session_id, topic FROM (SELECT DISTINCT session_id, upper(substr(w, 1, 1)) || substr(w, 2) AS topic FROM (SELECT session_id, regexp_replace(unnest(regexp_split_to_array(lower(content), '\\s+')), '^[.,!?()\\[\\]{}:;"'']+|[.,!?()\\[\\]{}:;"'']+$', '', 'g') AS w FROM messages WHERE role = 'user') WHERE length(w) BETWEEN 4 AND 20 AND NOT regexp_full_match(w, '\\d+')) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY topic) <= 10) GROUP BY session_id""", "messages"),
    "episodic_upsert": with_sql(f"SELECT * FROM ({_SUMMARY('')}) WHERE session_id % 2 <> 0 OR session_id NOT IN (SELECT session_id FROM messages WHERE turn < 3) UNION ALL SELECT * FROM ({_SUMMARY('WHERE turn < 3')}) WHERE session_id % 2 = 0", "messages"),
    "ttl_prune": with_sql("SELECT activity_id, date FROM activities WHERE date >= TIMESTAMP '2024-01-10' - INTERVAL 5 DAY", "activities"),
    "prune_low_conf": "SELECT vec_id AS id, (vec_id % 10) / 10.0::DOUBLE AS confidence FROM embeddings WHERE (vec_id % 10) / 10.0 >= 0.3",
    "facts_min_conf": "SELECT vec_id AS id, (vec_id % 10) / 10.0::DOUBLE AS confidence FROM embeddings WHERE (vec_id % 10) / 10.0 >= 0.5",
    "fact_search": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), h AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 6) AS similarity FROM e q, e c WHERE q.vec_id % 100 = 0 AND c.vec_id % 10 >= 5) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM h QUALIFY rank <= 5",
    "usage_increment": "SELECT event_type, 1 + count(*) FILTER (value > 10) AS usage_count FROM events GROUP BY event_type",
    "topics_overlap": "SELECT doc_id AS document_id, md5(text) AS summary FROM documents WHERE list_has_any(list_concat([source, lang], string_split(lower(text), ' ')), ['the', 'of', 'der', 'de'])",
    "metadata_filter": "SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k')::INT = 42",
    "reassemble_text": with_sql("SELECT document_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS digest, count(*)::INT AS chunks FROM lines GROUP BY document_id", "lines"),
    "document_with_chunks": with_sql("SELECT doc_id AS document_id, md5(any_value(text)) AS digest, count(chunk_id) AS chunks, max(chunk_index) AS last FROM documents LEFT JOIN lines ON document_id = doc_id GROUP BY doc_id", "lines"),
    "doc_kpis": with_sql("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM lines) AS chunks", "lines"),
    "recent_documents": "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id DESC LIMIT 5",
    "cascade_delete": with_sql("SELECT document_id, count(*) AS chunks FROM lines WHERE document_id % 4 <> 0 GROUP BY document_id", "lines"),
    "dedup_exact": "SELECT doc_id, sha256(text) AS content_hash, doc_id > min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents",
    "wiki_upsert": "SELECT doc_id AS document_id, md5(CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE text END) AS summary FROM documents",
    "wiki_backfill": "SELECT doc_id AS document_id, source FROM documents WHERE doc_id % 3 = 0",
    "wiki_search": "WITH w AS (SELECT doc_id, text AS summary, list_concat([source, lang], string_split(lower(text), ' ')) AS topics FROM documents), a AS (SELECT doc_id FROM w WHERE summary ILIKE '%SRC1%' ORDER BY doc_id DESC LIMIT 50) SELECT doc_id AS document_id, 'summary' AS match FROM a UNION ALL SELECT doc_id, 'topic' FROM (SELECT * FROM w ORDER BY doc_id DESC LIMIT 100) WHERE len(list_filter(topics, lambda t: contains(lower(t), 'src1'))) > 0 AND doc_id NOT IN (SELECT doc_id FROM a)",
    "context_prompt": with_sql("", "lines").rstrip() + f", {_HITS} SELECT query_id, string_agg('[Chunk ' || rank || '] (chunk_id: ' || chunk_id || ', document_id: ' || document_id || ')' || chr(10) || 'Content: ' || content, chr(10) || chr(10) ORDER BY rank) AS prompt FROM hits GROUP BY query_id",
    "claim_support": with_sql("", "lines").rstrip() + f""", {_HITS}, ctx AS (SELECT query_id, {_WORDS.format("lower(trim(string_agg(content, ' ' ORDER BY content)))")} AS known FROM hits GROUP BY query_id),
sents AS (SELECT query_id, known, list_filter(list_transform(regexp_split_to_array(lower(trim(text)), '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM ctx JOIN benchmark ON item_id = query_id),
each AS (SELECT query_id, known, len(ss) AS total, unnest(ss) AS s FROM sents), scored AS (SELECT query_id, total, length(s) AS l, {_WORDS.format('s')} AS w, known FROM each)
SELECT query_id, round(sum(CASE WHEN l > 20 AND len(w) > 0 AND len(list_intersect(w, known)) >= 0.4 * len(w) THEN 1 ELSE 0 END) / any_value(total)::DOUBLE, 6) AS support, sum(CASE WHEN l > 20 AND len(w) > 0 AND len(list_intersect(w, known)) >= 0.4 * len(w) THEN 1 ELSE 0 END) / any_value(total)::DOUBLE >= 0.3 AS passed FROM scored GROUP BY query_id""",
    "facts_added": "SELECT vec_id AS id, md5('old') AS fact, len(embedding)::INT AS dims, 'import' AS source, NULL AS source_id, (vec_id % 10) / 10.0::DOUBLE AS confidence FROM embeddings UNION ALL SELECT doc_id + 1000000000, md5(text), 64, 'conversation', doc_id::VARCHAR, 1.0::DOUBLE FROM documents",
    "memory_clear": with_sql("SELECT session_id, count(*) AS n FROM messages WHERE session_id % 2 <> 0 GROUP BY session_id", "messages"),
    "memory_cleared": with_sql("SELECT count(*) AS removed FROM messages WHERE session_id % 2 = 0", "messages"),
    "invalid_citations": with_sql("", "lines").rstrip() + f", {_HITS}, c AS (SELECT query_id, CASE WHEN chunk_id % 3 = 0 THEN chunk_id + 7 ELSE chunk_id END AS chunk_id FROM hits) SELECT * FROM c ANTI JOIN hits USING (query_id, chunk_id)",
    "format_citations": f"WITH {_CITE} SELECT item_id, block FROM cited",
    "synthesize": f"WITH {_CITE} SELECT item_id, CASE WHEN item_id % 17 = 0 THEN 'I''m sorry, but I encountered an error processing your question: timeout' || chr(10) || chr(10) || 'Please try again or rephrase your question.' WHEN item_id % 5 = 0 THEN '{A.GREETING.replace(chr(39), chr(39) * 2)}' WHEN item_id % 5 = 1 THEN '{A.IRRELEVANT.replace(chr(39), chr(39) * 2)}' ELSE text || CASE WHEN item_id % 11 > 0 THEN chr(10) || chr(10) || '*Confidence: ' || (item_id % 11) * 10 || '%*' ELSE '' END || CASE WHEN block <> '' THEN chr(10) || block ELSE '' END || CASE WHEN item_id % 8 = 0 THEN chr(10) || chr(10) || '> ⚠️ **Quality note:** check sources' ELSE '' END END AS response FROM cited",
    "honesty_guard": "SELECT event_id, (event_id % 50 = 0) OR (event_id % 2 = 0 AND event_id % 4 <> 0 AND (event_id % 101) / 100.0 - 0.05 >= 0 AND (event_id % 101) / 100.0 - 0.05 < 0.1) OR (event_id % 2 = 1 AND (event_id % 101) / 100.0 - 0.05 < 0.35) OR event_id % 6 IN (0, 2, 3, 4) AS refused FROM events",
    "error_rates": with_sql("SELECT path AS endpoint, count(*) AS total_requests, count(*) FILTER (status BETWEEN 400 AND 499) AS client_errors_4xx, count(*) FILTER (status BETWEEN 500 AND 599) AS server_errors_5xx, round(count(*) FILTER (status BETWEEN 400 AND 599) / count(*) * 100::DOUBLE, 2) AS error_rate_percent FROM log GROUP BY ROLLUP (path)", "log"),
    "latency_percentiles": with_sql("SELECT path, round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.95), 4) AS p95, round(quantile_cont(latency, 0.99), 4) AS p99, min(latency) AS min, max(latency) AS max, round(avg(latency), 4) AS mean FROM log GROUP BY path", "log"),
    "histogram_quantile": with_sql("", "log").rstrip() + f", b AS (SELECT path, {_LE} AS le, count(*) AS n FROM log GROUP BY ALL), c AS (SELECT path, le, n, sum(n) OVER (PARTITION BY path ORDER BY le) AS cum, sum(n) OVER (PARTITION BY path) * 0.95::DOUBLE AS rank FROM b), e AS (SELECT *, cum - n AS below, {_LOWER}::DOUBLE AS lower FROM c) SELECT path, round(CASE WHEN le = 'inf'::DOUBLE THEN {_BOUNDS[-1]} ELSE lower + (le - lower) * (rank - below) / n END, 6) AS value FROM e WHERE cum >= rank AND below < rank",
    "alert_5xx": with_sql("SELECT start, count(*) AS total, count(*) FILTER (status >= 500) AS errors FROM (SELECT status, unnest(range(epoch(ts)::BIGINT // 60 * 60 - 240, epoch(ts)::BIGINT // 60 * 60 + 60, 60)) AS start FROM (SELECT status, date_trunc('second', ts) AS ts FROM log)) GROUP BY start HAVING count(*) FILTER (status >= 500) > 0.05 * count(*)", "log"),
    "alert_4xx": _ALERT(400, 500, 10, 0.25),
    "alert_429": _ALERT(429, 430, 5, 0.1),
    "alert_states": with_sql("", "log", "samples").rstrip() + f""", inc AS (SELECT service, status, (epoch("at")::BIGINT // 60 + 1) * 60 AS tick, CASE WHEN value >= before THEN value - before ELSE value END AS n
  FROM (SELECT service, instance, status, date_trunc('second', "at") AS "at", value, lag(value) OVER (PARTITION BY service, instance, status ORDER BY "at") AS before FROM (SELECT service, instance, status, "at", max(value) AS value FROM samples GROUP BY ALL)) WHERE before IS NOT NULL),
rules(alert, low, high, width, least, hold) AS (VALUES {', '.join(f"('{r.alert}', {r.low}, {r.high}, {r.width}, {r.least}::DOUBLE, {r.hold})" for r in L.RULES)}),
held AS (SELECT alert, hold, service, "at", sum(CASE WHEN status >= low AND status < high THEN n ELSE 0 END) / sum(n)::DOUBLE AS ratio FROM (SELECT *, unnest(range(tick, tick + width, 60)) AS "at" FROM inc, rules)
  GROUP BY alert, hold, least, service, "at" HAVING sum(CASE WHEN status >= low AND status < high THEN n ELSE 0 END) > least * sum(n)),
runs AS (SELECT *, "at" - 60 * row_number() OVER (PARTITION BY alert, service ORDER BY "at") AS run FROM held),
spans AS (SELECT alert, hold, service, min("at") AS a, max("at") AS z FROM runs GROUP BY alert, hold, service, run)
SELECT alert, service, "at", 'pending' AS state, ratio FROM spans JOIN held USING (alert, hold, service) WHERE "at" = a
UNION ALL SELECT alert, service, "at", 'firing', ratio FROM spans JOIN held USING (alert, hold, service) WHERE "at" = a + hold AND z >= a + hold
UNION ALL SELECT alert, service, z + 60, CASE WHEN z >= a + hold THEN 'resolved' ELSE 'inactive' END, NULL FROM spans""",
    "active_buckets": with_sql("SELECT count(DISTINCT ip || ' ' || path) AS active FROM log", "log"),
    "ratelimit_tier": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {str(k).lower()}, {a}, {b}, {c})" for p, k, a, b, c in _TIER_ROWS) + ') AS t(path, skipped, "limit", "window", burst)',
}

_SUPPORT, _KEPT = ORACLES["claim_support"].rsplit("\nSELECT query_id, round(", 1)
ORACLES["critic_review"] = f"""{_SUPPORT}, sup AS (SELECT query_id, round({_KEPT}), known AS (SELECT query_id, min(chunk_id) AS first FROM hits GROUP BY query_id),
parts AS (SELECT query_id, query_id % 4 AS tries, CASE query_id % 3 WHEN 2 THEN '{_text(A.MISSING)}' WHEN 0 THEN '{_text(A.INVALID[0])}x, y{_text(A.INVALID[1])}' END AS sources,
  CASE WHEN NOT passed THEN '{_text(A.UNSUPPORTED[0])}' || round_even(support * 100, 0)::INT || '{_text(A.UNSUPPORTED[1])}' END AS claims FROM sup JOIN known USING (query_id))
SELECT query_id, tries >= 2 OR (sources IS NULL AND claims IS NULL) AS passed, concat_ws(chr(10), sources, claims, CASE WHEN tries >= 2 THEN '{_text(A.FORCED)}' END) AS feedback,
  (tries + CASE WHEN tries >= 2 OR (sources IS NULL AND claims IS NULL) THEN 0 ELSE 1 END)::INT AS retries FROM parts"""
