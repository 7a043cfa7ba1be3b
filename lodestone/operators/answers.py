"""Answers: prompts, honesty guard, claim support, citations and the final response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MIN_SENTENCE, MIN_OVERLAP, MIN_SUPPORT = 20, 0.4, 0.3
MAX_RETRIES = 2
# What a failed check tells the model, and the note on an answer that is let through.
MISSING = "MISSING CITATIONS: Your answer does not cite any sources. Please include at least one citation linking back to the chunk IDs provided in the context."
INVALID = ("INVALID CITATIONS: The following chunk IDs do not exist in the retrieved context: ", ". Please cite only chunk IDs from the provided context.")
UNSUPPORTED = ("UNSUPPORTED CLAIMS: Only ", "% of your claims overlap with the retrieved chunks. Make sure every factual statement in your answer is grounded in the provided context.")
FORCED = "(Max retries reached — proceeding with current answer.)"
GREETING = "Hello! I'm your knowledge assistant. Ask me a question about your documents."
IRRELEVANT = "I'm sorry, but your query doesn't appear to be something I can help with. I'm designed to answer questions based on your document knowledge base. Please try asking a question about your documents."


def context_prompt(hits: DataFrame) -> DataFrame:
    """Each query's chunks as numbered blocks. ``hits``: query_id, rank, chunk_id, document_id, content."""
    one = F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit("] (chunk_id: "), F.col("chunk_id").cast("string"), F.lit(", document_id: "), F.col("document_id").cast("string"), F.lit(")\nContent: "), F.col("content"))
    each = hits.withColumn("block", one).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return each.select("query_id", F.array_join(F.col("b.block"), "\n\n").alias("prompt"))


def excerpt(content: Column, query: Column) -> Column:
    """Lines from the first one with a query word of three letters or more, cut to start at the last line with a date."""
    words = F.filter(F.split(F.lower(query), "[^a-zA-Z0-9]+"), lambda t: F.length(t) > 2)
    lines = F.split(content, "\n")
    hit = lambda line: F.exists(words, lambda w: F.contains(F.lower(line), w))
    first = F.array_position(F.transform(lines, hit), F.lit(True))
    # F.trim itself as the function would be given the index as the characters to trim.
    kept = F.transform(F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>")), lambda line: F.trim(line))
    dated = F.transform(kept, lambda line, i: F.when(line.rlike(r"\d{2,4}[-./]\d{1,2}[-./]\d{2,4}"), i + 1).otherwise(0))
    last = F.greatest(F.array_max(F.concat(dated, F.array(F.lit(0)))), F.lit(1))
    return F.array_join(F.slice(kept, last, F.greatest(F.size(kept), F.lit(1))), "\n")


def is_refused(answer: Column, has_chunks: Column, best_score: Column, best_bm25: Column, reranked: Column) -> Column:
    """Whether an answer must be replaced by a refusal: no chunks; a re-ranked best below 0.1 (but not negative) with no
    keyword hit; an unranked best below 0.35; or an answer that refuses itself."""
    a = F.lower(F.trim(answer))
    says = a.isin(*X.REFUSALS)
    for start in X.REFUSAL_STARTS:
        says = says | a.startswith(start)
    weak = reranked & (best_score >= 0) & (best_score < 0.1) & ~(F.coalesce(best_bm25, F.lit(0.0)) > 0)
    return ~has_chunks | F.coalesce(weak, F.lit(False)) | F.coalesce(~reranked & (best_score < 0.35), F.lit(False)) | F.coalesce(says, F.lit(True))


def claim_support(answer: Column, context: Column) -> Column:
    """Share of sentences of more than 20 characters of which 40% of the words of three letters or more are in
    ``context``, of all sentences; 0 without sentences or context words."""
    known = F.array_distinct(X.words(F.lower(F.trim(context)), r"^[a-z]{3,}$"))
    sentences = F.filter(F.transform(F.split(F.lower(F.trim(answer)), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")

    def supported(s: Column) -> Column:
        w = F.array_distinct(X.words(s, r"^[a-z]{3,}$"))
        enough = F.size(F.array_intersect(w, known)) >= MIN_OVERLAP * F.size(w)
        return F.when((F.length(s) > MIN_SENTENCE) & (F.size(w) > 0) & enough, 1).otherwise(0)

    n = F.aggregate(F.transform(sentences, supported), F.lit(0), lambda a, x: a + x)
    return F.when((F.size(known) == 0) | (F.size(sentences) == 0), 0.0).otherwise(F.try_divide(n.cast("double"), F.size(sentences)))


def review(citations: Column, known: Column, support: Column, retries: Column) -> Column:
    """The critic's verdict on an answer, ``{passed, feedback, retries}``: it must cite, cite only the ids in ``known``,
    and have a ``support`` of 30 %. After ``MAX_RETRIES`` failures it passes anyhow. Nulls count as nothing cited, known
    or supported."""
    cited = F.coalesce(F.transform(citations, lambda c: F.coalesce(c["chunk_id"].cast("string"), F.lit(""))), F.array().cast("array<string>"))
    ids = F.coalesce(F.transform(known, lambda i: i.cast("string")), F.array().cast("array<string>"))
    strange = F.filter(cited, lambda i: (i != "") & ~F.array_contains(ids, i))
    share = F.coalesce(support, F.lit(0.0))
    sources = F.when(F.size(cited) == 0, MISSING).when(F.size(strange) > 0, F.concat(F.lit(INVALID[0]), F.array_join(strange, ", "), F.lit(INVALID[1])))
    claims = F.when(share < MIN_SUPPORT, F.concat(F.lit(UNSUPPORTED[0]), F.bround(share * 100, 0).cast("int").cast("string"), F.lit(UNSUPPORTED[1])))
    forced = retries >= MAX_RETRIES
    passed = forced | (sources.isNull() & claims.isNull())
    feedback = F.array_join(F.array_compact(F.array(sources, claims, F.when(forced, FORCED))), "\n")
    return F.struct(passed.alias("passed"), feedback.alias("feedback"), (retries + F.when(passed, 0).otherwise(1)).alias("retries"))


def invalid_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations of chunks that the query didn't get."""
    return citations.join(chunks.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")


def format_citations(citations: Column) -> Column:
    """``[{chunk_id, document_id, content_snippet}]`` as a numbered list, snippets cut at 200 characters."""
    def line(c: Column, i: Column) -> Column:
        head = F.concat((i + 1).cast("string"), F.lit(". `"), c["chunk_id"], F.lit("` (document `"), c["document_id"], F.lit("`)"))
        return F.when(c["content_snippet"] != "", F.concat(head, F.lit("\n   > "), F.substring(c["content_snippet"], 1, 200))).otherwise(head)

    return F.when(F.size(citations) > 0, F.concat(F.lit("\n---\n**Sources:**\n"), F.array_join(F.transform(citations, line), "\n"))).otherwise("")


def respond(query_type: Column, answer: Column, confidence: Column, citations: Column, feedback: Column, passed: Column, error: Column) -> Column:
    """The final text: an apology for an error, a canned reply, or answer, confidence, sources and note."""
    parts = F.array_compact(
        F.array(
            answer,
            F.when(confidence > 0, F.format_string("\n*Confidence: %.0f%%*", confidence * 100)),
            F.when(F.size(citations) > 0, format_citations(citations)),
            F.when((feedback != "") & ~passed, F.concat(F.lit("\n> ⚠️ **Quality note:** "), feedback)),
        )
    )
    sorry = F.concat(F.lit("I'm sorry, but I encountered an error processing your question: "), error, F.lit("\n\nPlease try again or rephrase your question."))
    return F.when(F.coalesce(error, F.lit("")) != "", sorry).when(query_type == "greeting", GREETING).when(query_type == "irrelevant", IRRELEVANT).otherwise(F.array_join(parts, "\n"))
