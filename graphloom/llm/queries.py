"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, language_id, mixing, near_dedup, pii, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_ann": ann.op2_ann,
    "op3_token_files": token_files.op3_token_files,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe": bpe.op6_bpe,
    "op7_pii": pii.op7_pii,
    "op8_language_id": language_id.op8_language_id,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {"op9_exact_dedup": exact_dedup.SQL, "op10_substring_dedup": substring_dedup.SQL}
