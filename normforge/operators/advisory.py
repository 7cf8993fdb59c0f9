"""Flattening of advisories into one row per product."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normforge.operators.nested import buffers, records

LEAF_SHAPE = {"": {"branches[]": "branch", "full_product_names[]": "full_product_name"}, "branch": {"branches[]": "branch"}}


def data_source(document: Column) -> Column:
    """The first reference that is a .json file; null if none is, missing if there are no references."""
    refs = F.from_json(F.get_json_object(document, "$.references"), "array<struct<url:string>>")
    return F.when(refs.isNull(), "missing").otherwise(F.try_element_at(F.filter(refs, lambda r: r["url"].endswith(".json")), F.lit(1))["url"])


def flatten(df: DataFrame, key: str, tree: str = "product_tree") -> DataFrame:
    """(key, node_path, attrs, full_product_name_branch, product_id, full_product_names), one row per leaf.

    A tree with ``full_product_names`` gives these only. Otherwise each branch without
    ``branches`` gives a row, its ``attrs`` being the category -> name pairs on the way to it, the
    inner of equal categories winning. An empty ``branches`` list gives no row.

    The records of all trees are found by the structural index, each with its own text only, and a
    leaf gathers the categories on its path where it stands: one pass, no row moves.
    """
    given = F.get_json_object(F.col(tree), "$.full_product_names").isNotNull()
    source = df.select(F.col(key).alias("record_key"), F.col(tree).cast("string").alias("record_text"), given.alias("given")).where("record_text is not null")
    key_type = dict(source.dtypes)["record_key"]
    names = [key, "node_path", "attrs", "full_product_name_branch", "product_id", "full_product_names"]
    schema = f"`{key}` {key_type}, node_path string, attrs map<string,string>, full_product_name_branch string, product_id string, full_product_names string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, listed = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            for low, high in buffers(texts):
                which, (paths, parents, kinds, own) = records(texts[low:high], LEAF_SHAPE, alone=True)
                at, rows, seen = [], [], {}
                # a parent comes before its children, as levels are found one after the other
                for doc, path, parent, kind, text in zip((which + low).tolist(), paths, parents, kinds, own, strict=True):
                    node = json.loads(text, strict=False)
                    node = node if isinstance(node, dict) else {}
                    if kind == "full_product_name":
                        at.append(doc)
                        rows.append((path, {}, None, _text(node.get("product_id")), _text(node.get("name"))))
                    elif not listed[doc]:
                        attrs = {**seen.get((doc, parent), {}), _text(node.get("category")) or "": _text(node.get("name")) or ""}
                        seen[doc, path] = attrs
                        if node.get("branches") is None:
                            product = node.get("product")
                            found = product if isinstance(product, dict) else {}
                            of = [None, None] if product is None else [_text(found.get(f)) or "" for f in ("name", "product_id")]
                            at.append(doc)
                            rows.append((path, attrs, *of, None))
                if at:
                    columns = list(zip(*rows, strict=True))
                    maps = pa.array([list(m.items()) for m in columns[1]], pa.map_(pa.string(), pa.string()))
                    texts_of = [pa.array(c, pa.string()) for c in (columns[0], *columns[2:])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), texts_of[0], maps, *texts_of[1:]], names)

    return source.mapInArrow(work, schema)


def _text(value: object) -> str | None:
    """A JSON value as text: strings as they are, others as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def conformed(flat: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The wanted categories as columns, null where a row has none."""
    keep = [c for c in flat.columns if c != "attrs"]
    return flat.select(*keep, *[F.try_element_at("attrs", F.lit(c)).alias(c) for c in columns if c not in keep])


def undefined_columns(flat: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows) of the categories that no wanted column takes."""
    extra = F.array_except(F.map_keys("attrs"), F.array(*map(F.lit, columns)))
    return flat.select(F.explode(extra).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("rows"))
