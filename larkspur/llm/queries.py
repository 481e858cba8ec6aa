"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.decontaminate import op4_winnowing_decontamination
from larkspur.llm.embeddings import op1_projection_forest_dedup
from larkspur.llm.htmltext import op8_wrapper_html_extraction
from larkspur.llm.langid import op6_mixture_language_id
from larkspur.llm.licenses import op9_tfidf_license_scan
from larkspur.llm.linededup import op10_fuzzy_line_dedup
from larkspur.llm.mixing import op5_hypergeometric_mixing
from larkspur.llm.quality import op3_nbsvm_quality
from larkspur.llm.secrets import op7_markov_secret_scan
from larkspur.llm.simhash import op2_simhash_near_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_projection_forest_dedup": op1_projection_forest_dedup,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_nbsvm_quality": op3_nbsvm_quality,
        "op4_winnowing_decontamination": op4_winnowing_decontamination,
        "op5_hypergeometric_mixing": op5_hypergeometric_mixing,
        "op6_mixture_language_id": op6_mixture_language_id,
        "op7_markov_secret_scan": op7_markov_secret_scan,
        "op8_wrapper_html_extraction": op8_wrapper_html_extraction,
        "op9_tfidf_license_scan": op9_tfidf_license_scan,
        "op10_fuzzy_line_dedup": op10_fuzzy_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {}
