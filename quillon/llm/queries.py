"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.chat_format import OP2_SQL, op2_chat_formatting
from quillon.llm.decontaminate import OP3_SQL, op3_decontamination
from quillon.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from quillon.llm.jaccard_join import op13_jaccard_join
from quillon.llm.license_scan import op1_license_scan
from quillon.llm.lm_scoring import op5_lm_scoring
from quillon.llm.near_dedup import op8_near_dedup
from quillon.llm.packing import op7_packing
from quillon.llm.private_data import op6_private_data
from quillon.llm.quality_resampling import op9_quality_resampling
from quillon.llm.quality_rules import op10_quality_rules
from quillon.llm.token_counts import op4_token_counts
from quillon.llm.tokenizer_alignment import op12_tokenizer_alignment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_private_data": op6_private_data,
    "op7_packing": op7_packing,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_resampling": op9_quality_resampling,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLES: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op3_decontamination": OP3_SQL, "op11_hard_negatives": OP11_SQL}
