"""Composite queries: chunking, scraping, re-ranked search, the question pipeline, the rate limiter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models as ML
from ..functions import text as X
from ..operators import answers as A
from ..operators import crm as C
from ..operators import fuzzy
from ..operators import memory as M
from ..operators import retrieval as R
from ..sources import files
from ..sources import tables as T
from ..streaming import limits
from ..streaming import sessions as S
from . import retrieval as RQ
from . import text as XQ


def answer_pipeline(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 5, model=ML.quoting_model, crm: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """``queries`` (query_id, query, embedding and, optionally, history) -> ``query_id, query_type, n_chunks, n_citations,
    confidence, support, retries, passed, refused, response``.

    Greetings and off-topic questions skip retrieval. The others are routed to semantic, keyword or hybrid search and
    re-ranked, keyword hits that this drops first; ``model`` answers over the ``k`` first chunks, whole. An answer that
    the critic rejects is asked for once more with its feedback; what fails again carries it as a note. With ``crm``
    (contacts, deals, activities), questions about them are given the block of their intent after the chunks.
    """
    if "history" not in queries.columns:
        queries = queries.withColumn("history", F.lit(""))
    routed = queries.withColumn("query_type", X.query_class(F.col("query")))
    asked = routed.where(~F.col("query_type").isin("greeting", "irrelevant"))
    wants = lambda *kinds: asked.where(F.col("query_type").isin(*kinds))
    semantic = R.semantic_search(wants("semantic", "hybrid"), vectors, R.CANDIDATES)
    keyword = R.Bm25Index(chunks).search(wants("keyword", "hybrid").select("query_id", "query"), R.CANDIDATES)
    fused = R.hybrid_search(semantic, keyword, R.FUSED)
    hits = fused.join(asked.select("query_id", "query"), "query_id").join(chunks.select("id", "content"), "id")
    best = ML.rerank_keeping_keywords(hits, R.FUSED).where(F.col("rank") <= k)
    shown = best.select("query_id", "rank", F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), "content", "reranker_score", "bm25_score")
    in_order = F.array_sort(F.collect_list(F.struct("rank", "content", "chunk_id")))
    context = shown.groupBy("query_id").agg(in_order.alias("c"), F.max("reranker_score").alias("best"), F.max("bm25_score").alias("bm25"), F.count("*").alias("n_chunks"))
    context = context.select("query_id", F.array_join(F.col("c.content"), "\n").alias("context"), F.col("c.chunk_id").alias("known"), "best", "bm25", "n_chunks")
    full = routed.join(A.context_prompt(shown), "query_id", "left").join(context, "query_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    if crm is not None:
        known = C.question_context(asked.select("query_id", "query"), *crm).select("query_id", F.when(F.col("context") != "", F.concat(F.lit("\n\n"), "context")).alias("_crm"))
        full = full.join(known, "query_id", "left").withColumn("prompt", F.concat("prompt", F.coalesce("_crm", F.lit("")))).drop("_crm")
    full = full.withColumn("prompt", F.concat("prompt", F.lit("\n\nQuestion: "), "query", F.coalesce("history", F.lit(""))))
    full = _answered(full, "first", F.col("prompt"), F.lit(0), model)
    again = F.when(~F.col("first.review.passed"), F.concat("prompt", F.lit("\n\nFeedback: "), F.col("first.review.feedback")))
    full = _answered(full, "second", again, F.col("first.review.retries"), model)
    full = full.withColumn("last", F.when(F.col("first.review.passed") | F.col("prompt").isNull(), F.col("first")).otherwise(F.col("second")))
    refused = A.is_refused(F.col("last.text"), F.col("n_chunks") > 0, F.col("best"), F.col("bm25"), F.lit(True))
    full = full.withColumn("refused", refused)
    none = F.array().cast(full.schema["last"].dataType["citations"].dataType)
    answer, confidence = F.when(F.col("refused"), X.NO_ANSWER).otherwise(F.col("last.text")), F.when(F.col("refused"), 0.0).otherwise(F.col("last.confidence"))
    citations = F.when(F.col("refused"), none).otherwise(F.col("last.citations"))
    response = A.respond(F.col("query_type"), answer, confidence, citations, F.col("last.review.feedback"), F.col("last.review.passed"), F.lit(""))
    return full.select(
        "query_id", "query_type", "n_chunks", F.size(citations).alias("n_citations"), confidence.alias("confidence"), F.col("last.support").alias("support"),
        F.col("last.review.retries").alias("retries"), F.col("last.review.passed").alias("passed"), "refused", response.alias("response"),
    )


def _answered(rows: DataFrame, name: str, prompt, retries, model) -> DataFrame:
    """``rows`` with the struct ``name``: a model's answer to ``prompt``, read as JSON or else as plain text, its review."""
    rows = rows.withColumn("_raw", ML.ask(prompt, model))
    json = F.from_json(X.model_json(F.col("_raw")), ML.ANSWER)
    none = F.array().cast("array<struct<chunk_id:string,document_id:string,content_snippet:string>>")
    rows = rows.withColumn("_text", F.coalesce(json["answer_text"], F.col("_raw"), ML.offline_answer(F.col("prompt"), F.col("n_chunks"))))
    rows = rows.withColumn("_citations", F.coalesce(json["citations"], none)).withColumn("_confidence", F.coalesce(json["confidence_score"], F.lit(0.0)))
    rows = rows.withColumn("_support", F.round(A.claim_support(F.col("_text"), F.coalesce("context", F.lit(""))), 6))
    verdict = A.review(F.col("_citations"), F.col("known"), F.col("_support"), retries)
    fields = [F.col(f"_{n}").alias(n) for n in ("text", "citations", "confidence", "support")]
    return rows.withColumn(name, F.struct(*fields, verdict.alias("review"))).drop("_raw", "_text", "_citations", "_confidence", "_support")


def _qa(s, d):
    q = T.table(s, d, "benchmark").select((F.col("item_id") * 100).alias("query_id"), F.concat(F.when(F.col("item_id") % 3 == 0, "hello ").when(F.col("item_id") % 3 == 1, "explain ").otherwise("define "), F.col("text")).alias("query"))
    q = q.join(RQ._vq(s, d), "query_id", "left")
    history = M.history_block(T.messages(s, d)).select((F.col("session_id") * 100).alias("query_id"), "history")
    return answer_pipeline(q.join(history, "query_id", "left"), RQ._chunks(s, d), RQ._corpus(s, d).select("id", "embedding"))


def _found(s, d):
    return RQ._hybrid(s, d).join(RQ._text_queries(s, d), "query_id").join(RQ._chunks(s, d), "id")


_RERANKED = ("query_id", "id", "hybrid_score", "reranker_score", "rank")


def _limiter(s, d):
    log = T.request_log(s, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return limits.rate_limit(log.select("ip", "path", "request_id", "at"), limit=2, window=86400.0, burst=1)


def _docs(s, d):
    return T.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")


def _embedded(s, d):
    return files.chunks(_docs(s, d)).select("document_id", "chunk_index", F.size(ML.embed(F.col("content"))).alias("dims"))


def _fuzzy(s, d):
    """Every contact by a name as someone types it: a letter left out, and sometimes a digit changed."""
    names = T.contacts(s, d).select("contact_id", "name")
    at = (F.col("contact_id") % 8 + 1).cast("int")
    typed = F.concat(F.substring(F.col("name"), F.lit(1), at - 1), F.substring(F.col("name"), at + 1, F.length("name")))
    typed = F.when(F.col("contact_id") % 3 == 0, F.regexp_replace(typed, "[05]$", "7")).otherwise(typed)
    queries = names.select(F.col("contact_id").alias("query_id"), typed.alias("query"))
    return fuzzy.fuzzy_match(queries, names.select("name"), 0.9).select("query_id", "name", "ratio")


def counting_model():
    """An offline model whose answers tell how many messages of history it was given."""
    return lambda prompts: [f"I read {p.count('**Q:** ') + p.count('**A:** ')} messages. {p.split('Question: ', 1)[1].split(chr(10), 1)[0][:80]}" for p in prompts]


def _turns(s, d):
    """Every user message is asked anew, so that each question sees the answers that its session got here."""
    asked = T.messages(s, d).where("role = 'user'").select("session_id", "turn", F.translate("content", "\n*", " ").alias("query"))
    out = S.converse(asked, counting_model)
    return out.select("session_id", "turn", "query_type", "history", "message_count", "summary", F.array_join("topics", ",").alias("topics"), "response")


QUERIES = {
    "chunk_documents": lambda s, d: files.chunks(_docs(s, d)).select("document_id", "chunk_index", F.length("content").alias("length"), F.md5("content").alias("digest")),
    "ingest_chunks": _embedded,
    "scrape_pages": lambda s, d: files.scrape(T.table(s, d, "pages")).select("page_id", "url", "title", "filename", F.length("text").alias("length")),
    "html_text": lambda s, d: files.scrape(T.table(s, d, "pages")).select("page_id", F.md5("text").alias("digest")),
    "hybrid_rerank": lambda s, d: ML.rerank(_found(s, d), 10).select(*_RERANKED),
    "hybrid_rerank_kept": lambda s, d: ML.rerank_keeping_keywords(_found(s, d), 10).select(*_RERANKED),
    "entity_context": lambda s, d: _docs(s, d).select("document_id", F.explode(ML.entities_in_context(F.col("text"))).alias("e")).select("document_id", "e.*"),
    "qa_pipeline": _qa,
    "session_turns": _turns,
    "rate_limit": _limiter,
    "fuzzy_match": _fuzzy,
}

_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
_BEST = f"""WITH {RQ._HYB}, pas AS (SELECT doc_id AS id, {_WORDS.format('text')} AS p FROM documents), qs AS (SELECT query_id, {_WORDS.format('query')} AS w FROM tq),
rr AS (SELECT query_id, id, bm25_score, hybrid_score, rank AS place, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(len(list_intersect(w, p)) / len(w)::DOUBLE, 6) END AS reranker_score FROM fused JOIN pas USING (id) JOIN qs USING (query_id)),
best AS (SELECT query_id, id, hybrid_score, reranker_score, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, id)::INT AS rank FROM rr QUALIFY rank <= 10)"""

_SHORT = lambda c, n: f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n - 3}) || '...' ELSE {c} END"
_QUOTED = lambda t: "'" + t.replace("'", "''") + "'"
_TOPICS = """list_transform(list_filter(list_transform(regexp_split_to_array(lower(query), '\\s+'), lambda w: regexp_replace(w, '^[.,!?()\\[\\]{}:;"'']+|[.,!?()\\[\\]{}:;"'']+$', '', 'g')), lambda w: length(w) BETWEEN 4 AND 20 AND NOT regexp_full_match(w, '\\d+')), lambda w: replace(upper(substr(w, 1, 1)), 'ẞ', 'SS') || substr(w, 2))"""  # ß becomes SS, as in Spark
_SESSIONS = T.with_sql("", "messages").rstrip() + f""", asked AS (SELECT session_id, turn, replace(replace(content, chr(10), ' '), '*', '') AS query, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS k FROM messages WHERE role = 'user'),
routed AS (SELECT session_id, turn, query, k, {XQ._ROUTE} AS query_type FROM (SELECT *, lower(trim(query)) AS q FROM asked)),
said AS (SELECT *, CASE query_type WHEN 'greeting' THEN {_QUOTED(A.GREETING)} WHEN 'irrelevant' THEN {_QUOTED(A.IRRELEVANT)} ELSE 'I read ' || least(6, 2 * (k - 1)) || ' messages. ' || substr(query, 1, 80) END AS response, {_TOPICS} AS words FROM routed),
pairs AS (SELECT *, '**Q:** ' || {_SHORT('query', 150)} || chr(10) || '**A:** ' || {_SHORT('response', 150)} AS pair FROM said)
SELECT session_id, turn, query_type, CASE WHEN k = 1 THEN '' ELSE chr(10) || '---' || chr(10) || '**Recent conversation:**' || chr(10) || string_agg(pair, chr(10)) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS history,
  2 * k AS message_count, 'Conversation about: ' || first_value({_SHORT('query', 120)}) OVER (PARTITION BY session_id ORDER BY turn) AS summary,
  array_to_string(list_sort(list_distinct(flatten(list(words) OVER (PARTITION BY session_id ORDER BY turn)))) [1:10], ',') AS topics, response FROM pairs"""

#: What no SQL expresses is tested against plain functions.
ORACLES = {
    "session_turns": _SESSIONS,
    "hybrid_rerank": f"{_BEST} SELECT * FROM best",
    "hybrid_rerank_kept": f"{_BEST}, listed AS (SELECT query_id, id, hybrid_score, 0.0::DOUBLE AS reranker_score, place, 0 AS kept FROM rr ANTI JOIN best USING (query_id, id) WHERE bm25_score > 0 UNION ALL SELECT *, 1 FROM best) SELECT query_id, id, hybrid_score, reranker_score, row_number() OVER (PARTITION BY query_id ORDER BY kept, place, id)::INT AS rank FROM listed",
}
