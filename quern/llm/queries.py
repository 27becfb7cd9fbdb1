"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm import chat_format, decontaminate, line_dedup, mixing, quality_rules, secret_scan, simhash_dedup, substring_dedup, token_files, url_reputation

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_chat_rotation": chat_format.op3_chat_rotation,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
    "op8_url_reputation": url_reputation.op8_url_reputation,
    "op9_token_files": token_files.op9_token_files,
    "op10_mix": mixing.op10_mix,
}

SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op3_chat_rotation": chat_format.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op8_url_reputation": url_reputation.SQL,
}
