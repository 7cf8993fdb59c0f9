"""Cleaning of product names, families and versions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normforge.functions.text import distinct_members, members, null_if_empty, strip
from normforge.sources.config import ProductConfig


def without_specials(c: Column) -> Column:
    """Blanks for slashes, commas and copyright signs; no brackets; words joined by hyphens apart, codes whole; null if nothing is left."""
    c = F.translate(c, "/\\", "  ")
    c = F.regexp_replace(c, r"(?i)\(c\)|©", " ")
    c = F.translate(F.translate(c, ",", " "), "()", "")
    tokens = F.filter(F.split(c, r"(?U)\s+", -1), lambda t: (t != "") & (t != "-"))
    return null_if_empty(F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\p{L}+(-\p{L}+)+$"), F.translate(t, "-", " ")).otherwise(t)), " "))


def cleaned(c: Column) -> Column:
    return without_specials(strip(F.lower(c)))


def recognised(value: Column, vendors: Column, families: Column, config: ProductConfig) -> Column:
    """struct(value, vendors, families): what family patterns find is taken out of the value and put on the lists."""
    rules = [F.struct(F.lit(v).alias("vendor"), F.lit(f"(?i){p}").alias("pattern")) for v, ps in config.product_regex.items() for p in ps]
    start = F.struct(value.alias("value"), F.coalesce(vendors, F.lit("")).alias("vendors"), families.cast("string").alias("families"))
    if not rules:
        return start

    def step(acc: Column, rule: Column) -> Column:
        value, vendors, families = acc["value"], acc["vendors"], acc["families"]
        hit = F.coalesce(F.regexp_substr(value, rule["pattern"]), F.lit(""))
        found = hit != ""
        with_vendor = F.when(F.array_contains(members(vendors), rule["vendor"]), vendors).when(vendors == "", rule["vendor"]).otherwise(F.concat(vendors, F.lit(", "), rule["vendor"]))
        return F.struct(
            F.when(found, strip(F.replace(value, hit, F.lit("")))).otherwise(value).alias("value"),
            F.when(found, with_vendor).otherwise(vendors).alias("vendors"),
            F.when(found, F.when(families.isNull(), hit).otherwise(F.concat(families, F.lit(", "), hit))).otherwise(families).alias("families"),
        )

    return F.aggregate(F.array(*rules), start, step)


def without_vendors(value: Column, vendors: Column) -> Column:
    """The value without the names on the list, as they are spelt there."""
    return F.aggregate(members(vendors), value, lambda acc, v: strip(F.when(v == "", acc).otherwise(F.replace(acc, v, F.lit("")))))


def version_of(value: Column, raw: Column, old: Column) -> Column:
    return F.when(raw.isNotNull(), raw).when(value.rlike(r"v\d+$"), F.regexp_extract(value, r"v\d+$", 0)).otherwise(old)


def clean_pass(df: DataFrame, column: str, config: ProductConfig) -> DataFrame:
    """One of the two passes, over ``product_family`` or ``product_name``.

    Rows whose cleaned value is empty fall back on what is there already and are left alone
    otherwise; rows without a vendor list keep the value as it was before the patterns.
    """
    name = column == "product_name"
    clean = cleaned(F.col(column))
    back = F.coalesce(F.col("product_family_modified"), F.col(f"{column}_modified")) if name else F.col(f"{column}_modified")
    df = df.withColumn("_clean", clean)
    df = df.withColumn("_r", recognised(F.col("_clean"), F.col("vendor_modified"), F.col("product_family_modified"), config))
    live = F.col("_clean").isNotNull()
    value = without_vendors(F.col("_r.value"), F.col("_r.vendors"))
    df = df.withColumn("_value", F.when(live, value).otherwise(back))
    out = {
        "vendor_modified": F.when(live, F.col("_r.vendors")).otherwise(F.col("vendor_modified")),
        "product_version_modified": F.when(live, version_of(F.col("_value"), F.col("product_version"), F.col("product_version_modified"))).otherwise(F.col("product_version_modified")),
        f"{column}_modified": F.col("_value"),
    }
    if name:
        out["product_family_modified"] = F.when(live, F.col("_r.families")).otherwise(F.col("product_family_modified"))
    return df.withColumns(out).drop("_clean", "_r", "_value")


def function_keywords(c: Column, keywords: tuple[str, ...]) -> Column:
    """Keywords that the value contains, in the order of the list."""
    low = strip(F.lower(c))
    return F.coalesce(F.array_join(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)), ", "), F.lit(""))


def merged_keywords(a: Column, b: Column) -> Column:
    both = F.filter(F.array(a, b), lambda x: x != "")
    return F.array_join(F.array_distinct(F.split(F.array_join(both, ", "), ", ")), ", ")


def without_keywords(value: Column, found: Column, keywords: tuple[str, ...]) -> Column:
    """The value without the found keywords where they stand as words."""
    for k in keywords:
        value = F.regexp_replace(value, F.when(F.array_contains(members(found), k), F.lit(rf"(?U)\b{re.escape(k)}\b")).otherwise(F.lit("(?!)")), F.lit(""))
    return value


def clean_products(df: DataFrame, config: ProductConfig = ProductConfig()) -> DataFrame:
    """Both passes, keywords found and taken out, vendors without repeats. Family before name; the family pass keeps no patterns' families."""
    df = clean_pass(clean_pass(df, "product_family", config), "product_name", config)
    words = config.function_keywords
    df = df.withColumn("function_keywords_found", merged_keywords(function_keywords(F.col("product_name_modified"), words), function_keywords(F.col("product_family_modified"), words)))
    return df.withColumns({
        "vendor_modified": distinct_members(F.col("vendor_modified")),
        "product_name_modified": without_keywords(F.col("product_name_modified"), F.col("function_keywords_found"), words),
        "product_family_modified": without_keywords(F.col("product_family_modified"), F.col("function_keywords_found"), words),
    })


def numeric_version(c: Column) -> Column:
    """Digits and points of a version, without one point at the end."""
    return null_if_empty(F.regexp_replace(F.regexp_replace(c, r"[^0-9.]", ""), r"\.$", ""))


def clean_versions(df: DataFrame) -> DataFrame:
    return df.withColumns({"product_version_modified": numeric_version(F.col("product_version_modified")), "product_version_range_modified": F.col("product_version_range")})
