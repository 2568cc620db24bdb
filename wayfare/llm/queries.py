"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, language, line_dedup, lm_score, near_dedup, quality, token_files, toxicity

QUERIES = {
    "op1_spaced_seed_decontamination": decontaminate.op1_spaced_seed_decontamination,
    "op2_host_quality_rules": quality.op2_host_quality_rules,
    "op3_budgeted_chat_windows": chat.op3_budgeted_chat_windows,
    "op4_hyperminhash_near_dedup": near_dedup.op4_hyperminhash_near_dedup,
    "op5_frequency_ranked_token_files": token_files.op5_frequency_ranked_token_files,
    "op6_hyperdimensional_language_id": language.op6_hyperdimensional_language_id,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_higher_order_bpe": bpe.op8_higher_order_bpe,
    "op9_misspelling_toxicity": toxicity.op9_misspelling_toxicity,
    "op10_log_frequency_bloom_lm": lm_score.op10_log_frequency_bloom_lm,
}
ORACLES = {"op2_host_quality_rules": quality.OP2_SQL, "op7_line_dedup": line_dedup.OP7_SQL}
