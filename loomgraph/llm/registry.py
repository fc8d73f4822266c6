"""The operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import chat, embedding_dedup, jaccard_join, language, manifest, packing, pieces, quality, resample, sharding, suffix_dedup, topk, url_filter
from loomgraph.llm.sql import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op4_language_id": language.op4_language_id,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_exact_topk": topk.op3_exact_topk,
        "op5_url_filters": url_filter.op5_url_filters,
        "op6_sharding": sharding.op6_sharding,
        "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
        "op8_embedding_near_dedup": embedding_dedup.op8_embedding_near_dedup,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
        "op11_importance_resampling": resample.op11_importance_resampling,
        "op12_merkle_manifest": manifest.op12_merkle_manifest,
        "op13_chat_formatting": chat.op13_chat_formatting,
    }


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
