"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lodestone.llm import op1_urls, op2_simhash, op3_quality, op4_bpe, op5_neardup, op6_orc, op7_lm, op8_substring, op9_packing, op10_licenses


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_urls.op1_url_filter,
        op2_simhash.op2_document_fingerprints,
        op2_simhash.fingerprint_neighbours,
        op3_quality.op3_quality_rules,
        op4_bpe.op4_bpe_roundtrip,
        op5_neardup.op5_simhash_neardup,
        op6_orc.op6_token_orc,
        op7_lm.op7_lm_scores,
        op8_substring.op8_substring_dedup,
        op9_packing.op9_packing,
        op10_licenses.op10_license_scan,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op1_url_filter": op1_urls.ORACLE}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
