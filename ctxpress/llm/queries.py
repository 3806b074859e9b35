"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from ctxpress.llm.chat_format import op3_chat_format
from ctxpress.llm.context_mixing import op2_context_mixing
from ctxpress.llm.decontaminate import OP10_SQL, op10_minhash_containment
from ctxpress.llm.length_histogram import op8_length_histogram
from ctxpress.llm.near_dedup import op7_prob_min_hash
from ctxpress.llm.packing import op9_best_fit_packing
from ctxpress.llm.quality import op4_quality_rules
from ctxpress.llm.resharding import op5_min_cost_reshard
from ctxpress.llm.token_files import op1_token_files
from ctxpress.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_context_mixing": op2_context_mixing,
    "op3_chat_format": op3_chat_format,
    "op4_quality_rules": op4_quality_rules,
    "op5_min_cost_reshard": op5_min_cost_reshard,
    "op6_toxicity": op6_toxicity,
    "op7_prob_min_hash": op7_prob_min_hash,
    "op8_length_histogram": op8_length_histogram,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_minhash_containment": op10_minhash_containment,
}
#: The others train models, draw hashes, encode with a tokenizer or fix file layouts, which SQL does not express.
ORACLE_SQL = {"op10_minhash_containment": OP10_SQL}
