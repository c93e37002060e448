"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from starling.llm import embedding_dedup, language_id, minhash_forest, oracles, packing, piece_bpe, quality_classifier, quality_rules, substring_dedup, url_filters, warc_zip


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_language_id": language_id.op2_language_id,
        "op3_packing": packing.op3_packing,
        "op4_warc_zip": warc_zip.op4_warc_zip,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
        "op7_url_filters": url_filters.op7_url_filters,
        "op8_piece_bpe": piece_bpe.op8_piece_bpe,
        "op9_quality_classifier": quality_classifier.op9_quality_classifier,
        "op10_minhash_forest": minhash_forest.op10_minhash_forest,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.OP1_SQL,
        "op4_warc_zip": warc_zip.OP4_SQL,
        "op5_quality_rules": quality_rules.OP5_SQL,
        "op6_embedding_dedup": oracles.OP6_SQL,
        "op7_url_filters": url_filters.OP7_SQL,
        "op10_minhash_forest": oracles.OP10_SQL,
    }
