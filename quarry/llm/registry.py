"""Queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from .ann import op10_learned_partitions
from .exact_topk import OP3_SQL, op3_exact_topk
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .hnsw import op11_vector_near_dedup
from .mixing import OP2_SQL, op2_source_mixing
from .packing import op7_harmonic_packing
from .preferences import OP8_SQL, op8_preference_format
from .repair import op12_conversation_repair
from .simhash import op6_simhash
from .token_files import op5_token_files
from .toxicity import op4_toxicity
from .unit_dedup import op9_line_dedup
from .url_filters import op1_sql, op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_source_mixing": op2_source_mixing,
    "op3_exact_topk": op3_exact_topk,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_simhash": op6_simhash,
    "op7_harmonic_packing": op7_harmonic_packing,
    "op8_preference_format": op8_preference_format,
    "op9_line_dedup": op9_line_dedup,
    "op10_learned_partitions": op10_learned_partitions,
    "op11_vector_near_dedup": op11_vector_near_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {"op1_url_filters": op1_sql(), "op2_source_mixing": OP2_SQL, "op3_exact_topk": OP3_SQL, "op8_preference_format": OP8_SQL, "op13_hard_negatives": OP13_SQL}
