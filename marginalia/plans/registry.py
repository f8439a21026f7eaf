"""Registry of the core queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, fixtures, quality, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (search, documents, quality, fixtures):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval with reranking, lifted to sections with citation labels."""
    return QUERIES["retrieve_rerank"](spark, sf_dir)
