"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from stratascan.llm import ann, conversations, decontaminate, exact_dedup, lm_score, mixing, near_dedup, packing, quality, secrets, token_files, warc, whitening

QUERIES = {
    "op1_pack_sequences": packing.op1_pack_sequences,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_token_files": token_files.op4_token_files,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_prefix_forest": ann.op6_prefix_forest,
    "op7_arc_to_warc": warc.op7_arc_to_warc,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_backoff_score": lm_score.op10_backoff_score,
    "op11_whitening": whitening.op11_whitening,
    "op12_decontaminate": decontaminate.op12_decontaminate,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op7_arc_to_warc": warc.OP7_SQL,
    "op8_source_mix": mixing.OP8_SQL,
    "op10_backoff_score": lm_score.OP10_SQL,
    "op12_decontaminate": decontaminate.OP12_SQL,
}
