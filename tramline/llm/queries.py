"""The registered queries of this subpackage and the SQL they can be held against."""

from __future__ import annotations

from . import decontaminate, language_id, minhash_dedup, personal_data, pieces, pitman_yor, quality_classifier, quality_rules, secret_scan, substring_dedup

QUERIES = {
    "op4_personal_data": personal_data.op4_personal_data,
    "op10_pitman_yor": pitman_yor.op10_pitman_yor,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op3_language_id": language_id.op3_language_id,
    "op5_pieces": pieces.op5_pieces,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op1_minhash_dedup": minhash_dedup.op1_minhash_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op8_secret_scan": secret_scan.op8_secret_scan,
}
SQL = {
    "op6_substring_dedup": substring_dedup.SQL,
    "op1_minhash_dedup": minhash_dedup.SQL,
    "op2_quality_rules": quality_rules.SQL,
    "op8_secret_scan": secret_scan.SQL,
}
