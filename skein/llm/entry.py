"""Queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import decontaminate, host_rules, html_extract, langid, line_dedup, mixing, quality_gbt, simhash, token_attribution, warc


def queries() -> dict:
    return {
        "op1_main_text": html_extract.op1_main_text,
        "op2_token_attribution": token_attribution.op2_token_attribution,
        "op3_quality": quality_gbt.op3_quality,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_host_rules": host_rules.op6_host_rules,
        "op7_simhash": simhash.op7_simhash,
        "op8_warc_transactions": warc.op8_warc_transactions,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_language_id": langid.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mix_sources": mixing.mix_sql(),
        "op6_host_rules": host_rules.OP6_SQL,
        "op8_warc_transactions": warc.OP8_SQL,
    }
