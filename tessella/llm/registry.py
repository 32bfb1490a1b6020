"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import compression_quality, divergence, fingerprints, html_extraction, language_id, mixing, near_duplicates, neighbours, packing, quality_rules, sharding, url_filter, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": language_id.query,
        "op2_quality_rules": quality_rules.query,
        "op3_probminhash": near_duplicates.query,
        "op4_best_fit_packing": packing.query,
        "op5_html_extraction": html_extraction.query,
        "op6_compression_quality": compression_quality.query,
        "op7_canonical_digest": fingerprints.query,
        "op8_kd_sharding": sharding.query,
        "op9_temperature_mixing": mixing.query,
        "op10_url_filter": url_filter.query,
        "op11_vector_codes": vector_codes.query,
        "op12_projected_neighbours": neighbours.query,
        "op13_source_divergence": divergence.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filter": url_filter.sql(), "op11_vector_codes": vector_codes.sql(), "op13_source_divergence": divergence.sql()}
