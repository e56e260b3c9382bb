"""Queries of the pipeline operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import dsir, langid, lsh_forest, mixing, nn_descent, pii, pivot_topk, spm_wfst, substring_cms, suffix_family

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_pii_pseudonyms": pii.op2_pii_pseudonyms,
    "op3_exact_topk": pivot_topk.op3_exact_topk,
    "op4_suffix_dedup": suffix_family.op4_suffix_dedup,
    "op5_importance_resampling": dsir.op5_importance_resampling,
    "op6_near_duplicates": lsh_forest.op6_near_duplicates,
    "op7_substring_dedup": substring_cms.op7_substring_dedup,
    "op8_sentencepiece": spm_wfst.op8_sentencepiece,
    "op9_nearest_neighbours": nn_descent.op9_nearest_neighbours,
    "op10_language_id": langid.op10_language_id,
}
SQL = {"op1_mix_sources": mixing.OP1_SQL, "op3_exact_topk": pivot_topk.OP3_SQL}
