"""Queries of this package, by name, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, embedding_join, license_scan, mixing, ngram_join, packing, pii, quality, ranked_search, secret_scan, spelling, token_output, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secret_scan.query,
        "op2_toxicity": toxicity.query,
        "op3_ngram_join": ngram_join.query,
        "op4_license_scan": license_scan.query,
        "op5_embedding_join": embedding_join.query,
        "op6_packing": packing.query,
        "op7_mixing": mixing.query,
        "op8_pii": pii.query,
        "op9_quality": quality.query,
        "op10_token_output": token_output.query,
        "op11_decontamination": decontamination.query,
        "op12_spelling": spelling.query,
        "op13_ranked_search": ranked_search.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_decontamination": decontamination.SQL, "op13_ranked_search": ranked_search.SQL}
