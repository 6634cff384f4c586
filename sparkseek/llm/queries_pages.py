"""Problem 9: keyword-stuffed and link-list pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkseek.llm import stuffing as S


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return S.stuffed(spark.read.parquet(f"{d}/documents.parquet"))


def p9_method(spark: SparkSession, d: str) -> DataFrame:
    """The spam-directed outliers among all documents, whatever else holds: (doc_id, language, distance2, direction)."""
    return S.spam_scores(spark.read.parquet(f"{d}/documents.parquet")).where("outlier").select("doc_id", "language", "distance2", "direction")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Features, robust distance and direction of every document."""
    return S.spam_scores(spark.read.parquet(f"{d}/documents.parquet"))


QUERIES = {"p9_method": p9_method, "p9_found": p9_found, "p9_scores": p9_scores}
SQL: dict[str, str] = {}
