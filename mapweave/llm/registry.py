"""The queries of this subpackage, by name, and the SQL that states some of them."""

from __future__ import annotations

from . import chat_format, decontaminate, fingerprint, line_dedup, lm_score, mixing, near_dedup, pii, quality, url_filter

QUERIES = {
    "op1_quality": quality.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_mixing": mixing.op3,
    "op4_pii": pii.op4,
    "op5_url_filter": url_filter.op5,
    "op6_chat_format": chat_format.op6,
    "op7_fingerprint": fingerprint.op7,
    "op8_near_dedup": near_dedup.op8,
    "op9_lm_score": lm_score.op9,
    "op10_line_dedup": line_dedup.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontaminate.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op6_chat_format": chat_format.ORACLE_SQL,
    "op8_near_dedup": near_dedup.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
}
