"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from askloom.llm.bpe import op10_bpe
from askloom.llm.cells import op6_embedding_near_dedup
from askloom.llm.chat import op4_chat_format
from askloom.llm.divergence import op13_source_divergence
from askloom.llm.html import op9_html_extraction
from askloom.llm.katz import op11_katz_scores
from askloom.llm.language import op3_language_id
from askloom.llm.mixing import op5_mixing
from askloom.llm.near_duplicates import op7_minhash_near_dedup
from askloom.llm.oracle import ORACLE
from askloom.llm.quality import op8_quality_classifier
from askloom.llm.resampling import op12_importance_resampling
from askloom.llm.substring_dedup import op2_substring_dedup
from askloom.llm.topk import op1_exact_topk

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_exact_topk,
        op2_substring_dedup,
        op3_language_id,
        op4_chat_format,
        op5_mixing,
        op6_embedding_near_dedup,
        op7_minhash_near_dedup,
        op8_quality_classifier,
        op9_html_extraction,
        op10_bpe,
        op11_katz_scores,
        op12_importance_resampling,
        op13_source_divergence,
    )
}
