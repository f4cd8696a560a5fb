"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from transcurve.llm import bpe, embeddings, filter_audit, html_extract, jaccard, licenses, line_dedup, media, mixing, secrets, toxicity, warc, whitening

MODULES = (mixing, bpe, secrets, html_extract, media, toxicity, embeddings, licenses, line_dedup, jaccard, whitening, filter_audit, warc)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
