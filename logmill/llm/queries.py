"""The operators as queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hard_negatives, importance, line_dedup
from .decontamination import op2_greedy_tiling
from .embedding_dedup import op8_embedding_cells
from .hard_negatives import op11_pca_negatives
from .importance import op12_importance_dictionary
from .language_mixture import op1_language_mixture
from .licences import op4_licence_sentences
from .line_dedup import op13_line_bloom
from .packing import op7_vector_packing
from .simhash import op6_covering_simhash
from .substring_dedup import op9_substring_dedup
from .token_counts import op5_token_counts
from .token_files import op10_token_files
from .toxicity import op3_toxicity_lexicon


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_mixture, op2_greedy_tiling, op3_toxicity_lexicon, op4_licence_sentences, op5_token_counts, op6_covering_simhash, op7_vector_packing, op8_embedding_cells, op9_substring_dedup, op10_token_files, op11_pca_negatives, op12_importance_dictionary, op13_line_bloom)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL exists where it can say what the operator does on whole tables; the others are held against brute force in the tests."""
    return {"op11_pca_negatives": hard_negatives.SQL, "op12_importance_dictionary": importance.SQL, "op13_line_bloom": line_dedup.SQL}
