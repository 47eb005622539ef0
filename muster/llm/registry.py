"""The subpackage's queries by name, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from muster.llm import chat, decontam, langid, line_dedup, lm_ctw, mixing, phrases, quality_crf, secrets, simhash, token_counts, toxicity, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op3_quality": quality_crf.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op6_decontam": decontam.op6_decontam,
    "op8_token_counts": token_counts.op8_token_counts,
    "op10_langid": langid.op10_langid,
    "op2_secrets": secrets.op2_secrets,
    "op5_chat": chat.op5_chat,
    "op7_mix": mixing.op7_mix,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op11_lm": lm_ctw.op11_lm,
    "op12_whitening": whitening.op12_whitening,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES: dict[str, str] = {
    "op2_secrets": secrets.OP2_SQL,
    "op5_chat": chat.OP5_SQL,
    "op7_mix": mixing.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
