"""Toxicity: gradient-boosted trees over a dozen dense features, with isotonic calibration.

The lexicon is learned from labelled rows too: words and word beginnings that are much more frequent in toxic
documents. To keep a feature honest about words it was fitted on, the labelled rows are dealt into folds by
crc32 of the doc_id: 0 is held out and never learned from, 1 and 2 give the lexicon, 3 the trees, 4 the
calibration. Features are computed once, for all rows, in one pass over the text; labels, language, source and
doc_id are never inputs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

FOLDS = 5
#: Bounds: labelled rows that the lexicon, the trees and the calibration each are fitted on; entries of the lexicon.
LEXICON_ROWS, TREE_ROWS, CALIBRATION_ROWS, LEXICON_SIZE = 20_000, 10_000, 10_000, 2_000
#: Words known from the start, so that a few labels suffice; the learned ones join them.
SEED_LEXICON = frozenset("idiot moron stupid loser scum trash pathetic worthless disgusting clown".split())
#: Second person in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself you're u ur du dein deine dich dir ihr euch tu te toi vous votre vos tú usted ustedes vosotros".split())
#: Lengths of word beginnings that the lexicon may hold, written with a trailing ``*``.
STEMS = (4, 5, 6)
NEAR = 5
#: Words whose rating a task remembers.
REMEMBERED = 200_000
FEATURES = (
    "lexicon_share", "lexicon_hits", "lexicon_kinds", "strong_hits", "strong_share", "near_second_person", "second_person_share",
    "capital_share", "capital_words", "exclamations", "questions", "punctuation_share", "obfuscated_share", "repeat_letters", "log_words",
)

_WORD = re.compile(r"\w[\w*@$!1'’-]*\w|\w", re.UNICODE)
_PLAIN = str.maketrans("013457@$!", "oieastasi")
_ODD = re.compile(r"[^\W\d_][*@$!0-9]+[^\W\d_]|(.)\1\1")
_PUNCTUATION = ".,;:!?-*#@$%&\"'()"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; a null id's text is empty."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def word_forms(word: str) -> list[str]:
    """A lower-case word and its beginnings, as the lexicon lists them."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def rate_word(word: str, lexicon: dict[str, float]) -> tuple[float, str, bool]:
    """A lower-case word's weight in the lexicon, its plain form, and whether it was obfuscated."""
    odd = not word.isalpha() and bool(_ODD.search(word))
    plain = word.translate(_PLAIN).replace("*", "") if odd else word
    return max((lexicon.get(f, 0.0) for f in word_forms(plain)), default=0.0), plain, odd


def features(text: str | None, lexicon: dict[str, float], rated: dict[str, tuple] | None = None) -> list[float]:
    """The values of ``FEATURES`` for a text; zeros for null and empty texts. ``rated`` remembers words."""
    text = text or ""
    rated = {} if rated is None else rated
    raw = _WORD.findall(text)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    words = [w.lower() for w in raw]
    hits, strong, kinds = [], 0.0, set()
    odd = 0
    for i, w in enumerate(words):
        if w not in rated:
            rated[w] = rate_word(w, lexicon)
        best, plain, is_odd = rated[w]
        odd += is_odd
        if best:
            hits.append(i)
            strong += best
            kinds.add(plain)
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = sum(1 for i in hits if (k := bisect_left(you, i - NEAR)) < len(you) and you[k] <= i + NEAR)
    letters = sum(map(len, raw))
    capitals = sum(map(str.isupper, text))
    return [
        len(hits) / n, float(len(hits)), float(len(kinds)), strong, strong / n, float(near), len(you) / n,
        capitals / max(1, letters), sum(w.isupper() and len(w) > 1 for w in raw) / n, text.count("!") / n, text.count("?") / n,
        sum(map(text.count, _PUNCTUATION)) / max(1, len(text)), odd / n, len(re.findall(r"(\w)\1\1", text)) / n, math.log1p(n),
    ]


def learn_lexicon(labelled: DataFrame, size: int = LEXICON_SIZE, least_rows: int = 5, least_ratio: float = 3.0) -> dict[str, float]:
    """Form -> log ratio of its document frequency in toxic and other rows, the ``size`` best ones.

    Counts are combined in the tasks and by Spark; the driver gets the ``size`` rows that pass the thresholds.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic].update({f for w in _WORD.findall(text or "") for f in word_forms(w.lower())})
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["form", "bad", "good"])

    total = labelled.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = total["bad"] or 0, total["n"] - (total["bad"] or 0)
    found = {w: 2 * least_ratio for w in SEED_LEXICON}
    if bad == 0 or good == 0:
        return found
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    best = (
        labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(forms, "form string, bad bigint, good bigint")
        .groupBy("form")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(F.col("bad") >= least_rows)
        .withColumn("ratio", F.round(ratio, 6))
        .where(F.col("ratio") >= least_ratio)
        .orderBy(F.col("ratio").desc(), "form")
        .limit(size)
    )
    return found | {r["form"]: float(r["ratio"]) for r in best.collect()}


def _featurize(lexicon: dict[str, float], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rated: dict[str, tuple] = {}
        for batch in batches:
            if len(rated) > REMEMBERED:
                rated.clear()
            values = np.array([features(t, lexicon, rated) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *map(pa.array, values.T)], names=[*keep, *FEATURES])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, trees: int = 15, depth: int = 3) -> DataFrame:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic) -> ``doc_id, held_out, score, predicted, raw`` for every row.

    Labels other than 0 and 1 are ignored; of several labels of a doc_id the largest counts. Null and empty texts
    have all features 0 and are scored like any other. Without labelled rows of both kinds to learn from, the
    score is 0.9 with a word of the seed lexicon and 0.1 without. Repeated rows are scored each. Other columns
    are ignored. The fits use at most ``LEXICON_ROWS``, ``TREE_ROWS`` and ``CALIBRATION_ROWS`` rows, the ones
    of smallest hash.
    """
    docs = docs.select("doc_id", "text").withColumn("fold", fold(F.col("doc_id")))
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0)

    def sample(of: DataFrame, folds: list[int], rows: int) -> DataFrame:
        return of.where(F.col("fold").isin(folds)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    chosen = sample(known.withColumn("fold", fold(F.col("doc_id"))), [1, 2], LEXICON_ROWS).select("doc_id", "toxic")
    lexicon = learn_lexicon(materialize(docs.join(chosen, "doc_id").select("doc_id", "text", "toxic")))
    schema = "doc_id bigint, fold int, " + ", ".join(f"{f} double" for f in FEATURES)
    dense = materialize(docs.mapInArrow(_featurize(lexicon, ["doc_id", "fold"]), schema))

    held = (F.col("fold") == 0).alias("held_out")
    pairs = dense.where("fold <> 0").join(known, "doc_id")
    fit = materialize(sample(pairs, [3], TREE_ROWS).coalesce(1))
    kinds = {r["toxic"] for r in fit.select("toxic").distinct().collect()}
    if kinds != {0, 1}:
        plain = F.when(F.col("lexicon_hits") > 0, 0.9).otherwise(0.1)
        return dense.select("doc_id", held, plain.alias("score"), (plain >= 0.5).cast("int").alias("predicted"), plain.alias("raw"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=3, maxBins=32).fit(vectors.transform(fit))
    by_tree = [_flat(t) for t in model.trees]
    weights = list(model.treeWeights)

    calibration = sample(pairs, [4], CALIBRATION_ROWS)
    raw = dense.select("doc_id", "fold", _margin(by_tree, weights).alias("raw"))
    rated = calibration.select(F.col("toxic").cast("double").alias("toxic"), _margin(by_tree, weights).alias("raw"), F.lit(1.0).alias("w"))
    rated = materialize(rated.coalesce(1))
    if rated.select("toxic").distinct().count() == 2:
        steps = IsotonicRegression(labelCol="toxic", featuresCol="raw", weightCol="w").fit(rated)
        score = _interpolated(F.col("raw"), list(steps.boundaries), list(steps.predictions))
    else:
        score = 1 / (1 + F.exp(-2 * F.col("raw")))
    # Isotonic steps are flat; a share of the trees' own probability keeps the order within a step.
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * score + 0.02 / (1 + F.exp(-2 * F.col("raw")))))
    scored = raw.withColumn("score", score)
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw")


def _flat(tree) -> list:
    """A fitted regression tree as nested (feature, threshold, left, right) or a leaf's value."""

    def node(n):
        if n.subtreeDepth() == 0:
            return float(n.prediction())
        s = n.split()
        return (s.featureIndex(), float(s.threshold()), node(n.leftChild()), node(n.rightChild()))

    return node(tree._call_java("rootNode"))


def _margin(trees: list, weights: list[float]) -> Column:
    """The boosted margin as a Spark expression, so that scoring needs no second pass through Python."""

    def expr(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(t)
        f, threshold, left, right = t
        return F.when(F.col(FEATURES[f]) <= threshold, expr(left)).otherwise(expr(right))

    total = F.lit(0.0)
    for w, t in zip(weights, trees):
        total = total + F.lit(float(w)) * expr(t)
    return total


def _interpolated(x: Column, at: list[float], values: list[float]) -> Column:
    """Piecewise linear through the calibration's points, flat beyond them."""
    out = F.lit(float(values[-1]))
    for (a, u), (b, v) in reversed(list(zip(zip(at, values), zip(at[1:], values[1:])))):
        line = F.lit(float(v)) if b == a else F.lit(float(u)) + (x - float(a)) * ((v - u) / (b - a))
        out = F.when(x < float(b), line).otherwise(out)
    return F.when(x <= float(at[0]), float(values[0])).otherwise(out)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learned from ``labels``."""
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
