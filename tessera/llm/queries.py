"""The operators' queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import bpe, chat, collocations, decontaminate, divergence, langid, licenses, lm, pii, preference, quality, secrets, simhash

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_lm_score": lm.op5_lm_score,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_pii": pii.op7_pii,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_simhash_dedup": simhash.op9_simhash_dedup,
    "op10_chat_format": chat.op10_chat_format,
    "op11_collocations": collocations.op11_collocations,
    "op12_quality_rank": preference.op12_quality_rank,
    "op13_divergence": divergence.op13_divergence,
}

SQL = {
    "op2_quality_rules": quality.OP2_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
