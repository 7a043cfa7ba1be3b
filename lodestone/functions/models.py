"""Pluggable models: embedding, re-ranking and answering, each with an offline default.

A model is a plain function over a batch; it is built once a Python worker, not once a row.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import ACRONYM, TEXT_ENTITY

DIMENSIONS = 64


def hashing_embedder(dimensions: int = DIMENSIONS) -> Callable[[list[str]], list[list[float]]]:
    """Words hashed into a unit vector; no weights to load."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w, n in Counter(re.findall(r"[a-z0-9]+", (t or "").lower())).items():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dimensions] += (1.0 if h >> 63 else -1.0) * (1 + math.log(n))
            length = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / length for x in v])
        return out

    return embed


def embed(text: Column, model: Callable[[], Callable] = hashing_embedder) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model()
        for b in batches:
            yield pd.Series(of(list(b)))

    return run(text)


def lexical_scorer() -> Callable[[list[str], list[str]], list[float]]:
    """Share of the query's words in the passage."""

    def score(queries: list[str], passages: list[str]) -> list[float]:
        words = lambda t: set(re.findall(r"[a-z0-9]+", (t or "").lower()))
        return [len(q & p) / len(q) if q else 0.0 for q, p in ((words(a), words(b)) for a, b in zip(queries, passages))]

    return score


def _scored(model: Callable[[], Callable]) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of = model()
        for q, p in batches:
            yield pd.Series(of(list(q), list(p)), dtype="float64")

    return F.round(run("query", "content"), 6)


def rerank(hits: DataFrame, k: int, model: Callable[[], Callable] = lexical_scorer, candidates: int = 100) -> DataFrame:
    """``hits`` (query_id, query, id, content, rank) with ``reranker_score``, the ``k`` best of ``candidates`` first."""
    from ..operators.retrieval import top_per_query

    scored = hits.where(F.col("rank") <= candidates).withColumn("reranker_score", _scored(model)).drop("rank")
    return top_per_query(scored, k, F.col("reranker_score").desc(), "id")


def rerank_keeping_keywords(hits: DataFrame, k: int, model: Callable[[], Callable] = lexical_scorer, candidates: int = 100) -> DataFrame:
    """``rerank``, after the hits with a ``bm25_score`` that it drops: those come first, in their old order, scored 0."""
    query = Window.partitionBy("query_id")
    scored = hits.withColumn("reranker_score", _scored(model)).withColumn("_in", F.col("rank") <= candidates)
    place = F.row_number().over(query.orderBy(F.col("_in").desc(), F.col("reranker_score").desc(), "id"))
    scored = scored.withColumn("_place", place).withColumn("_best", F.col("_in") & (F.col("_place") <= k))
    both = scored.where("_best or bm25_score > 0").withColumn("reranker_score", F.when(F.col("_best"), F.col("reranker_score")).otherwise(0.0))
    order = query.orderBy("_best", F.when(F.col("_best"), F.col("_place")).otherwise(F.col("rank")), "id")
    return both.withColumn("rank", F.row_number().over(order)).drop("_in", "_place", "_best")


NOTHING_FOUND = "No relevant information found in the knowledge base."


def offline_answer(prompt: Column, n_chunks: Column) -> Column:
    """What the service says without a language model."""
    return F.when(n_chunks == 0, NOTHING_FOUND).otherwise(F.concat(F.lit("I found relevant documents, but no language model is configured. Context: "), F.substring(prompt, 1, 200)))


#: What a model is asked to answer with.
ANSWER = "answer_text string, citations array<struct<chunk_id string, document_id string, content_snippet string>>, confidence_score double"


def quoting_model() -> Callable[[list[str]], list[str | None]]:
    """An offline stand-in for a language model: quotes the best chunk of the prompt and cites it, as JSON."""
    block = re.compile(r"\[Chunk \d+\] \(chunk_id: (.*?), document_id: (.*?)\)\nContent: (.*?)(?=\n\n\[Chunk \d+\]|\n\nQuestion: |\Z)", re.S)

    def answer(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            m = block.search(p)
            cited = [{"chunk_id": m[1], "document_id": m[2], "content_snippet": m[3][:200]}] if m else []
            out.append(json.dumps({"answer_text": m[3], "citations": cited, "confidence_score": 0.5}) if m else None)
        return out

    return answer


def ask(prompt: Column, model: Callable[[], Callable] = quoting_model) -> Column:
    """The text a language model gives for ``prompt``; null for a null prompt, which isn't sent, or where it gives none.

    ``model()`` is built once a task and maps a list of prompts to as many texts or Nones: the place for a client of a
    service, its timeouts and its fallbacks. Each prompt is sent once in a run of the plan."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model()
        for b in batches:
            sent = b[b.notna()]
            yield pd.Series(of(list(sent)) if len(sent) else [], index=sent.index, dtype=object).reindex(b.index)

    return run.asNondeterministic()(prompt)


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the vectors in ``tokens`` (array of arrays) where ``mask`` is 1; zeros where it is 0 everywhere."""
    masked = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    zero = F.transform(tokens[0], lambda x: x.cast("double") * 0)
    total = F.aggregate(masked, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double")), F.lit(1e-9))
    return F.transform(total, lambda x: x / count)


def entities_in_context(text: Column, around: int = 40) -> Column:
    """``[{name, type, confidence, context}]`` of ``text_entities``' patterns: ``context`` is the match with up to
    ``around`` characters on both sides. The first match of a name and type stays; null gives an empty array."""
    patterns = [(re.compile(p), kind, c) for p, kind, c in TEXT_ENTITY]
    patterns.append((re.compile(r"\b(" + ACRONYM[0].strip("^$") + r")\b"), *ACRONYM[1:]))

    @F.pandas_udf("array<struct<name string, type string, confidence double, context string>>")
    def run(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[dict]:
            found: dict[tuple[str, str], dict] = {}
            for p, kind, c in patterns:
                for m in p.finditer(t or ""):
                    name = m[1].strip()
                    if len(name) >= 2:
                        found.setdefault((name.lower(), kind), {"name": name, "type": kind, "confidence": c, "context": t[max(0, m.start() - around) : m.end() + around]})
            return list(found.values())

        return texts.map(of, na_action=None)

    return run(text)
