"""Queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from runlens.llm import audit, bpe, divergence, fingerprint, langid, licences, lm, neighbours, packing, simhash, substring, tokencount, toxicity

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_packing": packing.op2,
    "op3_neighbours": neighbours.op3,
    "op4_order_minhash": fingerprint.op4,
    "op5_bpe": bpe.op5,
    "op6_lm_scoring": lm.op6,
    "op7_licences": licences.op7,
    "op8_substring_dedup": substring.op8,
    "op9_toxicity": toxicity.op9,
    "op10_simhash": simhash.op10,
    "op11_filter_audit": audit.op11,
    "op12_token_counts": tokencount.op12,
    "op13_divergence": divergence.op13,
}
SQL: dict[str, str] = {"op11_filter_audit": audit.OP11_SQL, "op13_divergence": divergence.OP13_SQL}
