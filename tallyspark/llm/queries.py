"""The registered queries of the text operators, and their SQL where SQL can express them."""

from tallyspark.llm import byte_bpe, exact_topk, filter_audit, jaccard_join, language_id, license_scan, line_quality, packing, personal_data, quality_rules, suffix_dedup, token_alignment, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_line_quality": line_quality.op2_line_quality,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_exact_topk": exact_topk.op4_exact_topk,
    "op5_packing": packing.op5_packing,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_personal_data": personal_data.op11_personal_data,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = exact_topk.ORACLE | jaccard_join.ORACLE | filter_audit.ORACLE
