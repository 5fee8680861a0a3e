"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from pagemill.llm import alignment, bpe, decontaminate, license_templates, phrases, pii, quality_ftrl, quality_rules, sharding, simhash, token_output, toxicity, url_filter

QUERIES = {
    "op1_boosted_rules": quality_rules.op1_boosted_rules,
    "op2_suffix_array_decontamination": decontaminate.op2_suffix_array_decontamination,
    "op3_virtual_slots": sharding.op3_virtual_slots,
    "op4_classifier_chain": toxicity.op4_classifier_chain,
    "op5_gray_simhash": simhash.op5_gray_simhash,
    "op6_template_markup": license_templates.op6_template_markup,
    "op7_hashed_ftrl": quality_ftrl.op7_hashed_ftrl,
    "op8_ranked_vbyte": token_output.op8_ranked_vbyte,
    "op9_backtracking_bpe": bpe.op9_backtracking_bpe,
    "op10_weak_supervision": pii.op10_weak_supervision,
    "op11_stripes": phrases.op11_stripes,
    "op12_perfect_hash_alignment": alignment.op12_perfect_hash_alignment,
    "op13_blocked_bloom": url_filter.op13_blocked_bloom,
}

ORACLES: dict[str, str] = {
    "op2_suffix_array_decontamination": decontaminate.OP2_SQL,
    "op11_stripes": phrases.OP11_SQL,
    "op13_blocked_bloom": url_filter.OP13_SQL,
}
