"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from eocatalog.llm import byte_bpe, conversation_repair, divergence, embedding_dedup, line_dedup, lm_score, minhash, mixing, packing, pii, quality, token_counts, token_ids


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": token_ids.query,
        "op2_pii": pii.query,
        "op3_line_dedup": line_dedup.query,
        "op4_lm_score": lm_score.query,
        "op5_embedding_dedup": embedding_dedup.query,
        "op6_token_counts": token_counts.query,
        "op7_packing": packing.query,
        "op8_minhash": minhash.query,
        "op9_mixing": mixing.query,
        "op10_quality_rules": quality.query,
        "op11_conversation_repair": conversation_repair.query,
        "op12_source_divergence": divergence.query,
        "op13_byte_bpe": byte_bpe.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op3_line_dedup": line_dedup.ORACLE,
        "op5_embedding_dedup": embedding_dedup.ORACLE,
        "op9_mixing": mixing.ORACLE,
        "op10_quality_rules": quality.ORACLE,
        "op12_source_divergence": divergence.ORACLE,
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
