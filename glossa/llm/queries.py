"""Queries of the corpus operators, by name: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .counting import op6_token_counts
from .html import op3_html_extract
from .jaccard import op1_ngram_jaccard_join
from .lm import op9_lm_score
from .mixing import op7_mixing
from .packing import op5_packing
from .simhash import op10_simhash
from .topk import OP4_SQL, op4_topk_search
from .toxicity import op8_toxicity
from .urls import op2_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_url_filter": op2_url_filter,
        "op3_html_extract": op3_html_extract,
        "op4_topk_search": op4_topk_search,
        "op5_packing": op5_packing,
        "op6_token_counts": op6_token_counts,
        "op7_mixing": op7_mixing,
        "op8_toxicity": op8_toxicity,
        "op9_lm_score": op9_lm_score,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_topk_search": OP4_SQL}
