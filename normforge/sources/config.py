"""Configuration: file search, loading, and defaults of our own."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that are searched, in order.
SEARCH_PATH = (".", "../../data", "data")


def find_file(name: str, folders: Sequence[str] = SEARCH_PATH) -> Path:
    """The first file of that name in or below the folders."""
    for folder in folders:
        for hit in sorted(Path(folder).rglob(name)) if Path(folder).is_dir() else ():
            return hit
    raise FileNotFoundError(f"{name} is in none of {', '.join(folders)}")


def read_json(path: str | Path) -> dict:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise FileNotFoundError(f"no configuration at {path}") from e


def read_yaml(path: str | Path) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs PyYAML; JSON of the same structure works without") from e
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def read_structured(path: str | Path) -> dict:
    """YAML or JSON, by the ending."""
    return read_json(path) if str(path).endswith(".json") else read_yaml(path)


#: What stands for no value in a CSV file.
NO_VALUE = "n/a"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; all columns are text, blanks at the ends are kept, ``n/a`` and empty fields are null."""
    options = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df = spark.read.options(**options).csv(path)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(NO_VALUE, ""), F.col(f"`{c}`")).alias(c) for c in df.columns])


def _numbered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds row_pos, from 0 in the order of the file, which for one file is the order of its splits."""
    position = F.struct("_part", "_at")
    marked = df.select(*columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    return marked.select((F.row_number().over(Window.orderBy(position)) - 1).cast("int").alias("row_pos"), *columns)


def read_sheet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A device corpus as a table with row_pos: parquet or CSV; .xlsx where pandas can read it. Other endings are an error."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        rows = read_table(spark, path)
        return _numbered(rows, columns)
    elif path.endswith(".xlsx"):
        import pandas as pd

        frame = pd.read_excel(path, dtype=str).fillna("")
    else:
        raise ValueError(f"{path} is no .xlsx, .csv or .parquet file")
    frame.insert(0, "row_pos", range(len(frame)))
    return spark.createDataFrame(frame[["row_pos", *columns]])


@dataclass(frozen=True)
class VendorConfig:
    """Phrases deleted from vendor names; regular expressions."""

    pre_delete: tuple[str, ...] = (
        r"(?i)\ba subsidiary of\b", r"(?i)\ban affiliate of\b", r"^and ", r"(?i)\bInc\b\.?", r"(?i)\bLtd\b\.?", r"(?i)\bLLC\b", r"(?i)\bGmbH\b", r"(?i)\bCorp(oration)?\b\.?", r"(?i)\bPty\b",
    )


@dataclass(frozen=True)
class ProductConfig:
    """Family patterns by vendor, and words that name a function."""

    product_regex: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"Lirrdimont Nordpaburn": (r"robmuvault( \d+)?", r"velrizon( \d+)?"), "Weltiquist Skolkelon": (r"corrigate( \d+)?",), "Ostzonix Drusulex": (r"(jet|ix)[a-z]+ \d+",)}
    )
    function_keywords: tuple[str, ...] = ("firmware", "controller", "module", "drive unit", "cpu")


@dataclass(frozen=True)
class MinerConfig:
    """Patterns by category and vendor (one pattern or a list), and the corpus columns."""

    patterns: dict[str, dict[str, str | tuple[str, ...] | None]]
    search_columns: tuple[str, ...] = ("device_family", "device_type", "article_number")
    vendor_column: str = "manufacturer"

    @classmethod
    def load(cls, path: str | Path, categories: Sequence[str] | None = None, **others: object) -> MinerConfig:
        """From a YAML or JSON collection {category: {vendor: pattern, list of patterns or null}}; of the given categories only, if any are given."""
        found = read_structured(path)
        missing = [c for c in categories or () if c not in found]
        if missing:
            raise KeyError(f"{path} has no category {', '.join(missing)}")
        return cls({c: {v: tuple(p) if isinstance(p, list) else p for v, p in (found[c] or {}).items()} for c in categories or found}, **others)
