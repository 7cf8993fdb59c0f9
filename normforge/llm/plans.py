"""Queries of the problems that live in this subpackage: p1, p3, p7, p8, p9 and p10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normforge.llm import canonical, linkage, mixing, packing, spellings, stuffing, tokens
from normforge.operators import multivalue
from normforge.session import stored
from normforge.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    return spellings.clusters(spread(table(spark, folder, "vendor_testoutput_ref")), "vendor_id", ("vendor", "vendor_modified"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return spellings.row_pairs(_clusters(spark, folder), "vendor_id_a", "vendor_id_b")


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder).withColumnRenamed("row_key", "vendor_id")


def p3_linked(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "string_normalization").select("row_id", "product_name", "product_family", "product_family_modified", "vendor_modified", "vendor")
    return linkage.linked(
        spread(names), "row_id", {"name": "product_name", "family": "product_family", "family2": "product_family_modified", "maker": "vendor_modified", "maker2": "vendor"},
        spread(table(spark, folder, "string_miner")), "device_id", {"type": "device_type", "number": "article_number", "family": "device_family", "maker": "manufacturer"},
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_linked(spark, folder).select("row_id", "device_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "string_normalization").select("row_id", "vendor_modified", "product_family_modified")
    texts = rows.select(F.col("vendor_modified").alias("cell")).where("cell is not null and cell != ''").groupBy("cell").agg(F.count(F.lit(1)).alias("own"))
    several = multivalue.split_texts(texts).where(F.size("values") > 1)
    vendors = canonical.map_to_entries(rows, "row_id", "vendor_modified", table(spark, folder, "canonical_vendors"), "vendor_id", "vendor_name", "name", "short_name", several)
    families = canonical.map_to_entries(rows, "row_id", "product_family_modified", table(spark, folder, "canonical_families"), "family_id", "family_name", "family")
    return vendors.unionByName(families)


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, n_tokens), written once because packing and mixing read it several times."""
    return stored(tokens.with_lengths(spread(table(spark, folder, "documents").select("doc_id", "source", "text")), "doc_id", "text", ("source",)))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_lengths(spark, folder).select("doc_id", "n_tokens"), table(spark, folder, "container_sizes"), "doc_id")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p8_packed(spark, folder), table(spark, folder, "container_sizes"))


def p8_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return packing.bucketed(_lengths(spark, folder).select("doc_id", "n_tokens"), table(spark, folder, "container_sizes"), "doc_id")


def p9_uses(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.uses(_lengths(spark, folder), table(spark, folder, "mix_targets"), "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p9_uses(spark, folder), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed_pages(spread(table(spark, folder, "documents").select("doc_id", "text", "site")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_clusters, p3_found, p3_linked, p7_found, p8_packed, p8_fill, p8_buckets, p9_uses, p9_shares, p10_found)}
SQL: dict[str, str] = {}
