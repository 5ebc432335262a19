"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from lumenframe.llm import (byte_bpe, decontaminate, exact_dedup, html_text, language_id, language_model, near_dedup, secrets, spelling,
                            token_counts, toxicity, vector_codes, vector_dedup)

QUERIES = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op9_language_id": language_id.op9_language_id,
    "op3_token_counts": token_counts.op3_token_counts,
    "op8_toxicity": toxicity.op8_toxicity,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op6_main_text": html_text.op6_main_text,
    "op10_language_model": language_model.op10_language_model,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_vector_dedup": vector_dedup.op13_vector_dedup,
}

SQL = {
    "op4_secret_scan": secrets.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_vector_dedup": vector_dedup.SQL,
}
