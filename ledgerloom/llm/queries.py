"""The queries of the training-data operators, and SQL where it expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .bpe import op3_byte_bpe
from .convtrie import op11_conversation_trie
from .decontam import op13_decontamination
from .embeddings import op10_embedding_near_dedup
from .langid import op2_language_id
from .packing import op5_best_fit_packing
from .quality import op1_quality_rules
from .secrets_scan import op8_secret_scans
from .simhash import op9_simhash_near_dedup
from .spelling import op12_spelling_variants
from .suffix import op7_suffix_array_dedup
from .tokencount import op6_token_counts
from .urlgraph import op4_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (
        op1_quality_rules, op2_language_id, op3_byte_bpe, op4_url_filters, op5_best_fit_packing,
        op6_token_counts, op7_suffix_array_dedup, op8_secret_scans, op9_simhash_near_dedup, op10_embedding_near_dedup,
        op11_conversation_trie, op12_spelling_variants, op13_decontamination,
    )
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    """The others (iterated estimates, classifiers, tokenizers, XXH64 fingerprints) have no
    SQL over whole tables; tests hold them against brute force."""
    return sql.oracle_sql()
