"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from recohort.llm import bpe, chat, decontaminate, frames, langid, minhash, neighbours, ngrams, quality, repair, suffixes, toxicity, whitening

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_quality": quality.op2_quality,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_minhash": minhash.op4_minhash,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_token_files": frames.op6_token_files,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_ngrams": ngrams.op9_ngrams,
    "op10_bpe": bpe.op10_bpe,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_language_id": langid.op12_language_id,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {"op1_chat_format": chat.OP1_SQL, "op11_conversation_repair": repair.OP11_SQL}
