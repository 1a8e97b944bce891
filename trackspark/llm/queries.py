"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, centroid_clusters, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, merkle, piece_bpe, pii, quality, token_counts, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_token_counts": token_counts.query,
    "op2_language_id": language_id.query,
    "op3_pii": pii.query,
    "op4_decontaminate": decontaminate.query,
    "op5_toxicity": toxicity.query,
    "op6_quality": quality.query,
    "op7_line_dedup": line_dedup.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_centroid_clusters": centroid_clusters.query,
    "op12_piece_bpe": piece_bpe.query,
    "op13_merkle_manifest": merkle.query,
}

ORACLE_SQL = {
    "op9_exact_dedup": exact_dedup.QUERY_SQL,
    "op11_centroid_clusters": centroid_clusters.QUERY_SQL,
    "op13_merkle_manifest": merkle.QUERY_SQL,
}
