"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, key: str | None = None) -> None:
    """CSV with a header; one row per key if a key is given."""
    (df.dropDuplicates([key]) if key else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_audit(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_dictionary(df: DataFrame, path: str) -> None:
    """A word dictionary as words and counts."""
    df.selectExpr("word as words", "cnt as count").write.mode("overwrite").option("header", True).csv(path)
