"""Queries of the data-processing problems that live in the core: p2, p4, p5 and p6."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normforge.operators import drift, multivalue, nested, rejects
from normforge.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejects(spread(table(spark, folder, "process_csaf_lines")))


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.loaded(spread(table(spark, folder, "process_csaf_lines"))).withColumn("revision", F.col("revision").cast("string"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    changes = drift.schema_changes(table(spark, folder, "process_csaf_attrs"))
    return changes.where(F.col("change_kind").isin("added", "removed", "renamed", "retyped")).select("file_id", "field_name", "change_kind", "new_name")


def predefined_columns(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """The column list, a fixed table of some 14 rows."""
    return [(r.column_name, r.json_type) for r in table(spark, folder, "predefined_columns").orderBy("column_pos").collect()]


def p4_conformed(spark: SparkSession, folder: str) -> DataFrame:
    return drift.conform(table(spark, folder, "process_csaf_attrs"), predefined_columns(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return multivalue.unpacked(table(spark, folder, "string_normalization"), "row_id", ["vendor", "vendor_modified"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten_records(spread(table(spark, folder, "process_csaf_files")), "file_id", "product_tree", with_text=False)


def p6_products(spark: SparkSession, folder: str) -> DataFrame:
    """Products and full product names with the branch they hang on."""
    nodes = nested.flatten_records(spread(table(spark, folder, "process_csaf_files")), "file_id", "product_tree")
    products = nodes.where(F.col("node_kind").isin("product", "full_product_name"))
    return products.select("file_id", "node_path", "parent_path", F.get_json_object("node_text", "$.name").alias("product_name"), F.get_json_object("node_text", "$.product_id").alias("product_id"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_loaded, p4_found, p4_conformed, p5_found, p6_found, p6_products)}


def _each(source: str, of: str, path: str) -> str:
    """Positions in a JSON array."""
    return f"{source}, range(coalesce(json_array_length({of}, '{path}'), 0)::BIGINT) r(i)"


_NODES = f"""WITH RECURSIVE t AS (SELECT file_id, product_tree::JSON AS j FROM process_csaf_files WHERE json_valid(product_tree) AND json_type(product_tree::JSON) = 'OBJECT'),
b(file_id, node_path, parent_path, n) AS (SELECT file_id, '/branches/' || i, '', (j -> 'branches') -> i::INT FROM {_each('t', 'j', '$.branches')}
UNION ALL SELECT file_id, node_path || '/branches/' || i, node_path, (n -> 'branches') -> i::INT FROM {_each('b', 'n', '$.branches')}),
h AS (SELECT file_id, node_path || '/product' AS node_path, node_path AS parent_path, 'product' AS node_kind, n -> 'product' AS n FROM b WHERE json_type(n -> 'product') = 'OBJECT'
UNION ALL SELECT file_id, '/full_product_names/' || i, '', 'full_product_name', (j -> 'full_product_names') -> i::INT FROM {_each('t', 'j', '$.full_product_names')})"""
_JSON = """json_valid({0}) AND try(json_type({0})) = '{1}' AND NOT regexp_matches(regexp_replace({0}, '"([^"\\\\]|\\\\.)*"', '""', 'g'), ',\\s*[}}\\]]|NaN|Infinity|[iI]nf|[nN]an')"""
_LINES = f"""WITH l AS (SELECT line_id, regexp_replace(coalesce(raw_line, ''), '\\r\\z', '') AS x FROM process_csaf_lines),
q AS (SELECT line_id, regexp_full_match(x, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS quoted, regexp_extract_all(',' || x, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) AS f FROM l),
c AS (SELECT line_id, quoted, list_transform(f, lambda v: CASE WHEN v LIKE '"%' THEN replace(substring(v, 2, length(v) - 2), '""', '"') ELSE v END) AS f FROM q),
v AS (SELECT *, regexp_matches(f[3], '^0*[1-9][0-9]*$') AND regexp_matches(f[4], '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9]))?$') AND f[4] NOT LIKE '0000%' AND try_cast(f[4][1:10] AS DATE) IS NOT NULL
AND (f[5] = '' OR (regexp_matches(f[5], '^[0-9]+(\\.[0-9]+)?$') AND try_cast(f[5] AS DOUBLE) <= 10)) AS fits FROM c)"""
SQL: dict[str, str] = {
    "p2_found": f"""{_LINES} SELECT line_id, reason AS fail_reason FROM (SELECT line_id, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 7 THEN 'columns' WHEN NOT coalesce({_JSON.format('f[6]', 'OBJECT')}, false) THEN 'document'
WHEN NOT coalesce({_JSON.format('f[7]', 'ARRAY')}, false) THEN 'vulnerabilities' WHEN NOT coalesce(fits, false) THEN 'value' END AS reason FROM v) WHERE reason IS NOT NULL""",
    "p6_found": f"""{_NODES} SELECT file_id, node_path, parent_path, 'branch' AS node_kind FROM b UNION ALL SELECT file_id, node_path, parent_path, node_kind FROM h
UNION ALL SELECT file_id, node_path || '/product_identification_helper/model_numbers/' || i, node_path, 'model_number' FROM {_each('h', 'n', '$.product_identification_helper.model_numbers')}""",
    "p6_products": f"{_NODES} SELECT file_id, node_path, parent_path, n ->> 'name' AS product_name, n ->> 'product_id' AS product_id FROM h",
}
