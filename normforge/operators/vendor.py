"""Cleaning of vendor names: one expression, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normforge.functions.text import collapse, masked_delete, strip
from normforge.sources.config import VendorConfig

# Endings that make a name a host name.
URL_SUFFIX = r"\.(com|de|org|net|info|gov|io|uk|eu|nl|fr)$"


def filled(c: Column) -> Column:
    """Null and empty as the text None."""
    return F.when(c.isNull() | (c == ""), "None").otherwise(c)


def parts(c: Column) -> Column:
    """The names of a field, split at ', ' and ' and '."""
    return F.split(filled(c), ", | and ", -1)


def precleaned(part: Column) -> Column:
    return strip(collapse(F.regexp_replace(part, r"\(.*?\)", " ")))


def postcleaned(part: Column) -> Column:
    c = collapse(F.regexp_replace(part, " & ", " "))
    c = strip(F.regexp_replace(c, r"(?iU)\bKG$", " "))
    c = F.regexp_replace(c, r"(?U)\s?\.$|^\.\s?|\s\.\s", "")
    c = F.translate(c, "/\\", "")
    c = F.regexp_replace(c, r"(?i)\(c\)|©", "")
    return F.regexp_replace(c, URL_SUFFIX, "")


def joined(cleaned: Column) -> Column:
    c = F.regexp_replace(F.array_join(cleaned, ", "), "(, ){2}", ", ")
    return F.regexp_replace(c, r"(?U)\b,\s?$", "")


def normalized(c: Column, config: VendorConfig = VendorConfig()) -> Column:
    """The cleaned vendor field."""
    return joined(F.transform(parts(c), lambda p: postcleaned(masked_delete(precleaned(p), config.pre_delete))))


def normalize(df: DataFrame, config: VendorConfig = VendorConfig(), column: str = "vendor", out: str = "vendor_modified") -> DataFrame:
    """Replaces ``vendor_modified``."""
    return df.withColumn(out, normalized(F.col(column), config))


def normalize_distinct(df: DataFrame, config: VendorConfig = VendorConfig(), column: str = "vendor", out: str = "vendor_modified") -> DataFrame:
    """The same by cleaning each distinct value once and joining back, null meeting null; worth it for costly cleaning only."""
    once = df.select(F.col(column).alias("_key")).distinct().withColumn("_clean", normalized(F.col("_key"), config))
    return df.drop(out).join(once, F.col(column).eqNullSafe(F.col("_key")), "left").drop("_key").withColumnRenamed("_clean", out)


def audit(df: DataFrame, config: VendorConfig = VendorConfig(), column: str = "vendor") -> DataFrame:
    """What each step made of the field; blank where a step changed nothing."""
    steps = {"prepared": parts(F.col(column))}
    steps["precleaned"] = F.transform(steps["prepared"], precleaned)
    steps["deleted"] = F.transform(steps["precleaned"], lambda p: masked_delete(p, config.pre_delete))
    steps["postcleaned"] = F.transform(steps["deleted"], postcleaned)
    out, before = [F.col(column)], None
    for name, c in steps.items():
        text = F.array_join(c, ", ")
        out.append((text if before is None else F.when(text == before, "").otherwise(text)).alias(f"{name}_fin"))
        before = text
    return df.select(*out)
