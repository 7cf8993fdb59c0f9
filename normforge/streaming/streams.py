"""The per-row operators on streams. They keep no state, so they run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from normforge.operators import rejects, vendor
from normforge.sources.config import VendorConfig


def normalized_vendors(spark: SparkSession, folder: str, schema: str, config: VendorConfig = VendorConfig()) -> DataFrame:
    """Parquet files that arrive in a folder, with ``vendor_modified`` cleaned."""
    return vendor.normalize(spark.readStream.schema(schema).parquet(folder), config)


def line_loads(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Raw lines that arrive in a folder, each loaded or with its reason."""
    return rejects.load_lines(spark.readStream.schema(schema).parquet(folder))


def to_parquet(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now, exactly once, and ends."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
