"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, jaccard_join, license_scan, line_dedup, quality, secret_scan, token_counts, token_files, topk_search, word_bpe


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.query,
        "op2_quality_classifier": quality.query,
        "op3_license_scan": license_scan.query,
        "op4_secret_scan": secret_scan.query,
        "op5_jaccard_join": jaccard_join.query,
        "op6_word_bpe": word_bpe.query,
        "op7_token_files": token_files.query,
        "op8_line_dedup": line_dedup.query,
        "op9_topk_search": topk_search.query,
        "op10_decontamination": decontaminate.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": jaccard_join.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL, "op9_topk_search": topk_search.ORACLE_SQL}
