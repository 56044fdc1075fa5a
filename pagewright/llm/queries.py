"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_bpe
from .hilbert import op8_hilbert_sharding
from .lines import OP4_SQL, op4_line_dedup
from .mih import op10_mih_neighbours
from .packing import op5_best_fit_packing
from .quality import op9_quality
from .radix import OP3_SQL, op3_exact_dedup
from .rans import op7_token_binary
from .simhash import op2_simhash_near_dedup
from .toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_token_binary": op7_token_binary,
    "op8_hilbert_sharding": op8_hilbert_sharding,
    "op9_quality": op9_quality,
    "op10_mih_neighbours": op10_mih_neighbours,
}

ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op4_line_dedup": OP4_SQL}
