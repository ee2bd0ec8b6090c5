"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, langid, line_dedup, mixing, pii, simhash, substring_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_language_id": langid.op2_language_id,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_rabitq_neighbours": ann.op4_rabitq_neighbours,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_pii": pii.op10_pii,
}

ORACLE_SQL = {"op6_exact_dedup": exact_dedup.SQL}
