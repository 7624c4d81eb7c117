"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_bpe
from .exact_topk import OP2_SQL, op2_exact_topk
from .language_id import op3_language_id
from .masked_lm import op6_masked_lm
from .ngram_join import OP9_SQL, op9_ngram_join
from .packing import op5_packing
from .quality_rules import OP8_SQL, op8_quality_rules
from .secret_scan import op4_secret_scan
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .url_filter import op10_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_topk": op2_exact_topk,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_packing": op5_packing,
    "op6_masked_lm": op6_masked_lm,
    "op7_bpe": op7_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_join": op9_ngram_join,
    "op10_url_filter": op10_url_filter,
}

#: The others have no SQL: learned models, tokenization, packing and tests of randomness; they are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_exact_topk": OP2_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_ngram_join": OP9_SQL,
}

