"""Advisory files: discovery, reading and judging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def status_of(document: Column, product_tree: Column, vulnerabilities: Column) -> Column:
    """ok, or not_csaf if one of the three parts is missing."""
    return F.when(document.isNotNull() & product_tree.isNotNull() & vulnerabilities.isNotNull(), "ok").otherwise("not_csaf")


def read_advisories(spark: SparkSession, folder: str) -> DataFrame:
    """(path, status, document, product_tree, vulnerabilities) of every .json file in or below the folder; parts as JSON text.

    status: ok, empty, bad_json or not_csaf; only files that are ok have all parts.
    """
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(folder)
    # a file without bytes is not scanned, so its name is taken from the listing, which the driver holds anyway
    listed = spark.createDataFrame([(f,) for f in read.inputFiles()], "path string")
    # file:/x and file:///x are one path
    texts = read.select(F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):/(?!/)", "$1:///").alias("path"), "value")
    files = listed.join(texts, "path", "left").select("path", F.coalesce("value", F.lit("")).alias("value")).withColumn("v", F.try_parse_json("value"))

    def part(name: str) -> Column:
        found = F.expr(f"variant_get(v, '$.{name}', 'variant')")
        return F.when(F.expr(f"not is_variant_null(variant_get(v, '$.{name}', 'variant'))"), F.to_json(found)).alias(name)

    parts = files.select("path", "value", F.col("v").isNull().alias("bad"), part("document"), part("product_tree"), part("vulnerabilities"))
    status = F.when(F.trim("value") == "", "empty").when(F.col("bad"), "bad_json").otherwise(status_of(F.col("document"), F.col("product_tree"), F.col("vulnerabilities")))
    return parts.select("path", status.alias("status"), "document", "product_tree", "vulnerabilities")


def valid(advisories: DataFrame) -> DataFrame:
    return advisories.where("status = 'ok'").drop("status")


def advisory_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New advisory files as a stream of (path, value)."""
    stream = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).format("text").load(folder)
    return stream.select(F.col("_metadata.file_path").alias("path"), "value")
