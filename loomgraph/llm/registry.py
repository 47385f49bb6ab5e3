"""Corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from loomgraph.llm import byte_bpe, conversation_repair, decontamination, exact_dedup, html_text, license_scan, near_dedup, packing, quality_rules, substring_dedup, token_files, toxicity, vector_codes

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_html_text": html_text.op2_html_text,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op7_token_files": token_files.op7_token_files,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLES = {
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op6_license_scan": license_scan.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
