"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spreads rows that arrive in fewer splits than there are cores, before costly work per row.

    Files are cut into a split for each core unless a split would be smaller than the cost of
    opening a file, so only small inputs are spread; the exchange it costs them is of a few MB.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    leaf = df._jdf.queryExecution().analyzed().collectLeaves().head()
    size = int(str(leaf.stats().sizeInBytes()))
    return df.repartition(want) if size < want * spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() else df
