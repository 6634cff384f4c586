"""Any DataFrame as JSON Lines or CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row in ``value``; null fields are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """One CSV record per row in ``value``: nulls are empty cells, and cells with separators, quotes or line breaks are quoted."""

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return df.select(F.concat_ws(",", *(cell(c) for c in df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Part files, each with the header line."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
