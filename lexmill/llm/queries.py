"""Registered queries of this subpackage."""

import corpus_pipeline

from .chat_format import OP8_SQL, op8_chat_format
from .chat_repair import OP12_SQL, op12_chat_repair
from .decontaminate import OP5_SQL, op5_decontaminate
from .lm_scoring import op11_lm_scoring
from .mixing import OP7_SQL, op7_mixing
from .near_join import OP4_SQL, op4_near_join
from .pii import op2_pii
from .quality_classifier import op3_quality_classifier
from .quality_rules import op6_quality_rules
from .substring_dedup import op9_substring_dedup
from .token_counts import op10_token_counts
from .toxicity import op1_toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_near_join": op4_near_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_chat_format": op8_chat_format,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_chat_repair": op12_chat_repair,
}
ORACLE_SQL = {
    "op4_near_join": OP4_SQL,
    "op5_decontaminate": OP5_SQL,
    "op7_mixing": OP7_SQL,
    "op8_chat_format": OP8_SQL,
    "op12_chat_repair": OP12_SQL,
}
