"""Resolving names to the master words of a synonym dictionary."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normforge.functions.text import collapse, strip
from normforge.operators.vendor import normalized
from normforge.sources.config import VendorConfig, read_structured

SCHEMA = "attribute string, attr_pos int, master string, master_pos int, cell string"
SMALL = 20_000


def dictionary(spark: SparkSession, data: Mapping[str, Mapping[str, object]] | str | Path) -> DataFrame:
    """Long table of a dictionary {attribute: {"alias": [..], master: [..]}} or of a YAML or JSON file; cells that are no lists are N/A."""
    if not isinstance(data, Mapping):
        data = read_structured(data)
    rows = [(a, i, m, j, " , ".join(v) if isinstance(v, list | tuple) else "N/A") for i, (a, masters) in enumerate(data.items()) for j, (m, v) in enumerate(masters.items())]
    return spark.createDataFrame(rows, SCHEMA)


def query_word(c: Column) -> Column:
    """A name as it is looked up: punctuation as blanks."""
    return strip(collapse(F.regexp_replace(c, r"[)(,\-._/]", " ")))


def attribute_named(words: DataFrame, name: str) -> str | None:
    """The only attribute with the name among its aliases, else None."""
    hits = words.where((F.col("master") == "alias") & F.contains(F.lower("cell"), F.lit(name.lower()))).select("attribute").distinct().limit(2).collect()
    return hits[0].attribute if len(hits) == 1 else None


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))


def _beginnings(c: Column) -> Column:
    """Every substring of up to three letters."""
    c = F.lower(c)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(*[F.substring(c, i, F.lit(n)) for n in (1, 2, 3)]))))


def _longest(c: Column) -> Column:
    """The longest word, the first of equals; null if there is none."""
    return F.array_max(F.transform(_tokens(c), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def resolve(df: DataFrame, column: str, words: DataFrame, attribute: str | None = None, literal: bool = True, out: str = "master", vendor: VendorConfig | None = None) -> DataFrame:
    """Adds the master words of each value, ', '-joined in dictionary order; '' if none.

    A value that is an alias of one attribute gives the attribute's name, of several their names.
    Distinct values are looked up once. A value stands in a cell only if its longest word does, so
    values and cells meet on words by an equi-join and are verified then; in the cells of aliases,
    where parts of words count, and for values without a word they meet on the first letters.
    Unless ``literal`` is true values are read as regular expressions, which can't be looked up by
    a key; the dictionary may then have ``SMALL`` cells at most. With ``vendor`` and the attribute
    Manufacturer the value is cleaned first.
    """
    chosen = attribute_named(words, attribute) if attribute else None
    if chosen:
        words = words.where(F.col("attribute") == chosen)
    value = F.col(column)
    if vendor is not None and chosen == "Manufacturer":
        value = normalized(value, vendor)
    keyed = df.withColumn("_q", query_word(value))
    pattern = F.concat(F.lit("(?iuU)\\b\\Q"), F.col("_q"), F.lit("\\E\\b")) if literal else F.concat(F.lit("(?iuU)\\b"), F.col("_q"), F.lit("\\b"))
    inside = F.contains(F.lower("cell"), F.lower("_q"))
    cells = words.where("cell != 'N/A'")
    asked = keyed.where("_q != ''").select("_q").distinct()
    if literal:
        by_word = asked.withColumn("k", _longest(F.col("_q"))).where("k is not null").join(cells.withColumn("k", F.explode(_tokens(F.col("cell")))), "k")
        start = F.substring(F.lower("_q"), 1, 3)
        odd = asked.withColumn("k", start).withColumn("wordless", _longest(F.col("_q")).isNull())
        by_start = odd.join(cells.withColumn("k", F.explode(_beginnings(F.col("cell")))), "k").where("wordless or master = 'alias'").drop("wordless")
        hits = by_word.unionByName(by_start).drop("k").distinct().where(inside & (F.regexp_like(F.col("cell"), pattern) | (F.col("master") == "alias")))
    else:
        if cells.limit(SMALL + 1).count() > SMALL:
            raise ValueError(f"regular expressions are looked up in dictionaries of at most {SMALL} cells")
        hits = asked.join(F.broadcast(cells), F.regexp_like(F.col("cell"), pattern) | ((F.col("master") == "alias") & inside), "inner")
    hits = hits.withColumn("whole", F.regexp_like(F.col("cell"), pattern))
    alias = F.col("master") == "alias"
    found = hits.groupBy("_q").agg(
        F.bool_or(alias & F.col("whole")).alias("by_alias"),
        F.sort_array(F.collect_list(F.when(~alias & F.col("whole"), F.struct("attr_pos", "master_pos", "master")))).alias("masters"),
        F.sort_array(F.collect_set(F.when(alias, F.struct("attr_pos", "attribute")))).alias("attributes"),
    )
    answer = F.when(F.col("by_alias"), F.array_join(F.col("attributes.attribute"), " , ")).otherwise(F.array_join(F.col("masters.master"), ", "))
    return keyed.join(found.select("_q", answer.alias(out)), "_q", "left").drop("_q").withColumn(out, F.coalesce(out, F.lit("")))
