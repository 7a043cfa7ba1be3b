"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, centroids, embeddings, exact, jaccard, mixing, packing, pii, quality, sharding, substrings, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": substrings.op1_suffix_array,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii.op3_pii,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_sharding": sharding.op5_sharding,
    "op6_packing": packing.op6_packing,
    "op7_urls": urls.op7_urls,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
    "op11_alignment": alignment.op11_alignment,
    "op12_centroids": centroids.op12_centroids,
    "op13_exact": exact.op13_exact,
}

ORACLES: dict[str, str] = {
    "op7_urls": urls.ORACLE,
    "op9_quality": quality.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_exact": exact.ORACLE,
}
