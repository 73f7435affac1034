"""The queries of this subpackage, on whole tables with production parameters, and their SQL where SQL can express them."""

from . import alignment, ann, bpe, divergence, exact_dedup, lang_id, license_scan, line_dedup, mixing, near_dedup, quality_rules, token_binary, token_counts

QUERIES = {
    "op1_token_counts": token_counts.op1,
    "op2_bpe": bpe.op2,
    "op3_mixing": mixing.op3,
    "op4_host_rules": quality_rules.op4,
    "op5_near_dedup": near_dedup.op5,
    "op6_language_id": lang_id.op6,
    "op7_license_scan": license_scan.op7,
    "op8_line_dedup": line_dedup.op8,
    "op8_line_dedup_passages": line_dedup.op8_passages,
    "op9_token_binary": token_binary.op9,
    "op10_ann": ann.op10,
    "op11_source_divergence": divergence.op11,
    "op12_exact_dedup": exact_dedup.op12,
    "op13_alignment": alignment.op13,
}

ORACLES = {
    "op3_mixing": mixing.SQL,
    "op4_host_rules": quality_rules.SQL,
    "op7_license_scan": license_scan.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op8_line_dedup_passages": line_dedup.PASSAGES_SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_exact_dedup": exact_dedup.SQL,
}
