"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import embedding_dedup, fingerprint, license_scan, mixing, near_dedup, packing, pii, quality, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_pii": pii.op3_pii,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_license_scan": license_scan.op10_license_scan,
}
SQL = {"op7_embedding_dedup": embedding_dedup.SQL, "op8_near_dedup": near_dedup.SQL, "op9_url_filter": url_filter.SQL}
