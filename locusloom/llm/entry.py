"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chunkdedup, fingerprints, licenses, masked_lm, neardup, packing, toxicity, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprints.query,
        "op2_license_scan": licenses.query,
        "op3_url_filter": urlfilter.query,
        "op4_minhash_near_dedup": neardup.query,
        "op5_packing": packing.query,
        "op6_masked_lm": masked_lm.query,
        "op7_nearest_neighbours": ann.query,
        "op8_toxicity": toxicity.query,
        "op9_substring_dedup": chunkdedup.query,
        "op10_bpe": bpe.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": urlfilter.ORACLE, "op4_minhash_near_dedup": neardup.ORACLE}
