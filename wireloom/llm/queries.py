"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, jaccard_join, language_id, media, mixing, nearest, private_data, repeats, secret_scan, token_counts


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_private": private_data.op1_private,
        "op2_secrets": secret_scan.op2_secrets,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_jaccard": jaccard_join.op4_jaccard,
        "op5_nearest": nearest.op5_nearest,
        "op6_language_id": language_id.op6_language_id,
        "pages_language_id": language_id.pages_language_id,
        "op7_media": media.op7_media,
        "op8_repeats": repeats.op8_repeats,
        "op9_bpe": bpe.op9_bpe,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secrets": secret_scan.OP2_SQL,
        "op4_jaccard": jaccard_join.OP4_SQL,
        "op10_mixing": mixing.OP10_SQL,
    }
