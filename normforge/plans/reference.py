"""Queries over the cleaning, lookup, mining, spelling and flattening operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normforge.functions.text import masked_delete
from normforge.operators import advisory, mining, product, spell, synonym, vendor
from normforge.sources.advisories import status_of
from normforge.sources.config import MinerConfig, ProductConfig, VendorConfig
from normforge.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
VENDORS, PRODUCTS = VendorConfig(), ProductConfig()
SYNONYMS = {
    "Manufacturer": {"alias": ["vendor", "manufacturer", "maker"], "lirrdimont": ["Lirrdimont Nordpaburn", "LORB", "Lirrdimont"], "crimsedex": ["Crimsedex", "Crimsedex Drives"], "unnamed": None},
    "Device_Role": {"alias": ["role", "device role", "type"], "plc": ["CPU", "controller", "PLC"], "drive": ["drive unit", "servo drive"], "io": ["I/O module", "module", "remote io"]},
}
MINER = MinerConfig(
    patterns={
        "Device Type": {"any": (r"[A-Z]{3}-\d{4}-[A-Z]", r"[A-Z]{3} \d{4}-[A-Z]"), "coarse": r"\b(?:CPU|drive unit|controller)\b"},
        "Version": {"any": r"V ?\d+\.\d+(?:\.\d+)?"},
        "Article Number": {"any": None, "other": (r"\d{2}[-.:]\d{4}[-.:]\d{4}",)},
    },
    search_columns=("device_family",),
)
CORPUS = MinerConfig(patterns={})
#: White space and word characters for engines whose classes are ASCII only.
W = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
L = r"[\p{L}\p{N}\p{M}_]"
#: Letters beyond ASCII in the tables that are compared by edits, one control character for each in engines that count bytes.
WIDE = "äöüÄÖÜßéèêàâçîôû©®"


def _products(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "string_normalization"))


def _devices(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "string_miner"))


def vendor_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return vendor.normalize(_products(spark, folder)).select("row_id", "vendor_modified")


def vendor_distinct_joinback(spark: SparkSession, folder: str) -> DataFrame:
    return vendor.normalize_distinct(table(spark, folder, "string_normalization")).select("row_id", "vendor_modified")


def vendor_masked_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return _products(spark, folder).select("row_id", masked_delete(F.col("vendor"), VENDORS.pre_delete).alias("masked"))


def vendor_audit(spark: SparkSession, folder: str) -> DataFrame:
    return vendor.audit(spread(table(spark, folder, "vendor_testoutput_ref")))


def url_suffix_strip(spark: SparkSession, folder: str) -> DataFrame:
    return _products(spark, folder).select("row_id", F.regexp_replace("vendor", vendor.URL_SUFFIX, "").alias("bare"))


def product_special_chars(spark: SparkSession, folder: str) -> DataFrame:
    return _products(spark, folder).select("row_id", product.cleaned(F.col("product_name")).alias("clean"))


def product_clean(spark: SparkSession, folder: str) -> DataFrame:
    done = product.clean_products(_products(spark, folder), PRODUCTS)
    return done.select("row_id", "vendor_modified", "product_name_modified", "product_family_modified", "product_version_modified", "function_keywords_found")


def version_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _products(spark, folder).select("row_id", product.version_of(product.cleaned(F.col("product_name")), F.col("product_version"), F.col("product_version_modified")).alias("version"))


def version_numeric(spark: SparkSession, folder: str) -> DataFrame:
    df = _products(spark, folder).withColumn("product_version_modified", F.col("product_version"))
    return product.clean_versions(df).select("row_id", "product_version_modified", "product_version_range_modified")


def function_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return _products(spark, folder).select("row_id", product.function_keywords(F.col("product_name"), PRODUCTS.function_keywords).alias("found"))


def keyword_removal(spark: SparkSession, folder: str) -> DataFrame:
    found = product.function_keywords(F.col("product_name"), PRODUCTS.function_keywords)
    return _products(spark, folder).select("row_id", product.without_keywords(F.col("product_name"), found, PRODUCTS.function_keywords).alias("rest"))


def synonym_lookup(spark: SparkSession, folder: str) -> DataFrame:
    values = table(spark, folder, "string_miner").select(F.col("device_type").alias("value")).where("value is not null").distinct()
    return synonym.resolve(values, "value", synonym.dictionary(spark, SYNONYMS), "role")


def synonym_alias(spark: SparkSession, folder: str) -> DataFrame:
    values = table(spark, folder, "predefined_columns").select(F.col("column_name").alias("value"))
    return synonym.resolve(values, "value", synonym.dictionary(spark, SYNONYMS))


def synonym_normalize(spark: SparkSession, folder: str) -> DataFrame:
    values = table(spark, folder, "string_miner").select(F.col("manufacturer").alias("value")).where("value is not null").distinct()
    return synonym.resolve(values, "value", synonym.dictionary(spark, SYNONYMS), "manufacturer", vendor=VENDORS)


def mine_regex_exact(spark: SparkSession, folder: str) -> DataFrame:
    found = mining.match(_devices(spark, folder), "annotation", MINER)
    return found.select("device_id", *[F.try_element_at("found", F.lit(c)).alias(a) for c, a in (("Device Type", "device_type"), ("Version", "version"), ("Article Number", "article"))])


def mine_regex_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    families = MinerConfig(patterns={"Device Family": {"Lirrdimont Nordpaburn": ("Robmuvault [0-9]+", "Velrizon [0-9]+"), "Weltiquist Skolkelon": "Corrigate [0-9]+"}})
    found = mining.match_fuzzy(_devices(spark, folder), "device_family", families, max_errors=1)
    return found.select("device_id", F.try_element_at("found", F.lit("Device Family")).alias("family"))


def mine_levenshtein_window(spark: SparkSession, folder: str) -> DataFrame:
    windows = mining.similar_windows(F.col("product_name"), F.col("product_family"), 0.85)
    return _products(spark, folder).select("row_id", F.coalesce(F.size(windows), F.lit(0)).cast("long").alias("hits"), F.array_max(F.transform(windows, lambda w: w["sim"])).alias("best"))


def mine_levenshtein_best(spark: SparkSession, folder: str) -> DataFrame:
    corpus = table(spark, folder, "canonical_families").select(F.col("family_id").cast("int").alias("row_pos"), F.col("family_name").alias("device_family"))
    return mining.match_levenshtein(_devices(spark, folder).select("device_id", "annotation"), "device_id", "annotation", corpus, MINER).select("device_id", "value", "similarity")


def mine_levenshtein_devices(spark: SparkSession, folder: str) -> DataFrame:
    """As mine_levenshtein_best, with the device corpus and all its search columns; without SQL, where this would be all pairs."""
    devices = table(spark, folder, "string_miner")
    return mining.match_levenshtein(_devices(spark, folder).select("device_id", "annotation"), "device_id", "annotation", devices, CORPUS)


def word_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return spell.frequencies(_devices(spark, folder), whole=["manufacturer"], by_blank=["manufacturer", "device_family"], by_word=["device_family"]).select("word", "cnt")


def _dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return spell.frequencies(table(spark, folder, "canonical_families"), by_word=["family_name"]).select("word", "cnt")


def _families(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "string_normalization").where("product_family is not null").select("product_family")


def _family_words(spark: SparkSession, folder: str) -> DataFrame:
    return _families(spark, folder).distinct().select(F.explode(F.split("product_family", r"(?U)\s+")).alias("word")).where("word != ''").distinct()


def spell_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return spell.candidates(_family_words(spark, folder), _dictionary(spark, folder)).select("word", "candidate", "cnt", "distance")


def spell_best(spark: SparkSession, folder: str) -> DataFrame:
    return spell.best(_family_words(spark, folder), _dictionary(spark, folder))


def spell_split(spark: SparkSession, folder: str) -> DataFrame:
    return spell.best_split(_families(spark, folder), "product_family", _dictionary(spark, folder))


COLUMNS = ("vendor", "product_family", "product_name", "product_version")


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    return advisory.flatten(spread(table(spark, folder, "process_csaf_files")), "file_id")


def tree_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return advisory.conformed(_flat(spark, folder).where("node_path like '/branches%'"), COLUMNS).drop("full_product_names")


def tree_full_names(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(spark, folder).where("node_path like '/full_product_names%'").select("file_id", "node_path", "full_product_names", "product_id")


def undefined_columns(spark: SparkSession, folder: str) -> DataFrame:
    return advisory.undefined_columns(_flat(spark, folder), COLUMNS)


def data_source_url(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "process_csaf_files")).select("file_id", advisory.data_source(F.col("document")).alias("data_source"))


def advisory_status(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "process_csaf_files").groupBy(status_of(F.col("document"), F.col("product_tree"), F.col("vulnerabilities")).alias("status")).agg(F.count(F.lit(1)).alias("files"))


def union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "canonical_vendors").unionByName(table(spark, folder, "canonical_families"), allowMissingColumns=True)


def corpus_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    return mining.corpus_cells(_devices(spark, folder), CORPUS).select(F.col("row_pos").cast("long").alias("row_pos"), "attribute", "word")


def group_list_join(spark: SparkSession, folder: str) -> DataFrame:
    families = table(spark, folder, "canonical_families").where("vendor_id is not null").groupBy("vendor_id").agg(F.array_join(F.sort_array(F.collect_list("family_name")), ", ").alias("families"))
    return table(spark, folder, "canonical_vendors").join(families, "vendor_id", "left").select("vendor_id", "families")


def argmax_first(spark: SparkSession, folder: str) -> DataFrame:
    best = F.max_by("device_id", F.struct(F.length("device_family"), -F.col("row_pos"), -F.col("device_id")))
    return table(spark, folder, "string_miner").where("device_family is not null").groupBy("manufacturer").agg(best.alias("device_id"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'^{W}+|{W}+$')}, '', 'g')"


def _narrow(x: str) -> str:
    """A text with one byte for each letter."""
    codes = [c for c in range(1, 32) if c not in (9, 10, 11, 12, 13, 28, 29, 30, 31)]
    return f"translate({x}, {_q(WIDE)}, {' || '.join(f'chr({c})' for c in codes[: len(WIDE)])})"


def _masked(source: str) -> str:
    """Columns d0, d1, ... of the phrase deletion."""
    steps = [f"{source} AS d0"]
    for k, p in enumerate(VENDORS.pre_delete, 1):
        steps.append(f"CASE WHEN regexp_matches({source}, {_q(p)}) THEN regexp_replace(d{k - 1}, {_q(p)}, ' ', 'g') ELSE d{k - 1} END AS d{k}")
    return ", ".join(steps)


_LAST = f"d{len(VENDORS.pre_delete)}"


def _vendor_steps(name: str, key: str) -> str:
    """CTEs src, prep, pre, del, post of the vendor cleaning."""
    post = f"regexp_replace(regexp_replace({_LAST}, ' & ', ' ', 'g'), {_q(W + '+')}, ' ', 'g')"
    post = _strip(f"regexp_replace({post}, {_q(f'(?i)(^|[^\\p{{L}}\\p{{N}}_])KG$')}, '\\1 ', 'g')")
    post = f"regexp_replace({post}, {_q(rf'{W}?\.$|^\.{W}?|{W}\.{W}')}, '', 'g')"
    post = f"replace(replace({post}, '/', ''), chr(92), '')"
    post = f"regexp_replace(regexp_replace({post}, '(?i)\\(c\\)|©', '', 'g'), {_q(vendor.URL_SUFFIX)}, '', 'g')"
    return f"""WITH src AS (SELECT {key}, vendor, CASE WHEN vendor IS NULL OR vendor = '' THEN 'None' ELSE vendor END AS f FROM {name}),
prep AS (SELECT {key}, vendor, unnest(string_split_regex(f, ', | and ')) AS part, generate_subscripts(string_split_regex(f, ', | and '), 1) AS pos FROM src),
pre AS (SELECT *, {_strip(f"regexp_replace(regexp_replace(part, '\\(.*?\\)', ' ', 'g'), {_q(W + '+')}, ' ', 'g')")} AS o FROM prep),
del AS (SELECT *, {_masked('o')} FROM pre),
post AS (SELECT *, {post} AS c FROM del)"""


_VENDOR_SQL = f"""{_vendor_steps('string_normalization', 'row_id')},
agg AS (SELECT row_id, regexp_replace(string_agg(c, ', ' ORDER BY pos), '(, ){{2}}', ', ', 'g') AS j FROM post GROUP BY row_id)
SELECT row_id, regexp_replace(j, {_q(f'({L}),{W}?$')}, '\\1', 'g') AS vendor_modified FROM agg"""


def _clean_sql(c: str) -> str:
    x = f"translate({_strip(f'lower({c})')}, '/' || chr(92), '  ')"
    x = f"regexp_replace(replace(regexp_replace({x}, '(?i)\\(c\\)|©', ' ', 'g'), ',', ' '), '[()]', '', 'g')"
    x = f"list_filter(string_split_regex({x}, {_q(W + '+')}), lambda t: t <> '' AND t <> '-')"
    return f"nullif(array_to_string(list_transform({x}, lambda t: CASE WHEN regexp_matches(t, '^\\p{{L}}+(-\\p{{L}}+)+$') THEN replace(t, '-', ' ') ELSE t END), ' '), '')"


def _pass_sql(source: str, column: str, n: int) -> str:
    """CTEs of one product pass, ending in y1 or y2; each step is materialised, or its text would be repeated in the next."""
    name = column == "product_name"
    ctes = [f"x{n}_0 AS MATERIALIZED (SELECT *, {_clean_sql(column)} AS v0, coalesce(vm, '') AS e, fm AS f FROM {source})", f"r{n}_0 AS MATERIALIZED (SELECT *, v0 AS v FROM x{n}_0)"]
    k = 0
    for maker, patterns in PRODUCTS.product_regex.items():
        for p in patterns:
            k += 1
            ctes += [
                f"x{n}_{k} AS MATERIALIZED (SELECT *, coalesce(regexp_extract(v, {_q('(?i)' + p)}, 0), '') AS h FROM r{n}_{k - 1})",
                f"""r{n}_{k} AS MATERIALIZED (SELECT * EXCLUDE (h, v, e, f), CASE WHEN h <> '' THEN {_strip("replace(v, h, '')")} ELSE v END AS v,
CASE WHEN h = '' OR list_contains(string_split(e, ', '), {_q(maker)}) THEN e WHEN e = '' THEN {_q(maker)} ELSE e || {_q(', ' + maker)} END AS e,
CASE WHEN h = '' THEN f WHEN f IS NULL THEN h ELSE f || ', ' || h END AS f FROM x{n}_{k})""",
            ]
    bare = f"""list_reduce(list_prepend(v, string_split(e, ', ')), lambda a, b: CASE WHEN b = '' THEN a ELSE {_strip("replace(a, b, '')")} END)"""
    back = "coalesce(fm, nm)" if name else "fm"
    ctes.append(f"w{n} AS MATERIALIZED (SELECT *, v0 IS NOT NULL AS live, CASE WHEN v0 IS NOT NULL THEN {bare} ELSE {back} END AS w FROM r{n}_{k})")
    version = "CASE WHEN NOT live THEN pm WHEN product_version IS NOT NULL THEN product_version WHEN regexp_matches(w, 'v\\d+$') THEN regexp_extract(w, 'v\\d+$', 0) ELSE pm END"
    after = "w AS nm, CASE WHEN live THEN f ELSE fm END AS fm" if name else "nm, w AS fm"
    ctes.append(f"y{n} AS MATERIALIZED (SELECT row_id, product_name, product_family, product_version, CASE WHEN live THEN e ELSE vm END AS vm, {version} AS pm, {after} FROM w{n})")
    return ", ".join(ctes)


def _keywords_sql(c: str) -> str:
    return "coalesce(array_to_string(list_filter([" + ", ".join(map(_q, PRODUCTS.function_keywords)) + f"], lambda k: contains({_strip(f'lower({c})')}, k)), ', '), '')"


def _removal_sql(c: str, found: str) -> str:
    for k in PRODUCTS.function_keywords:
        c = f"CASE WHEN list_contains(string_split({found}, ', '), {_q(k)}) THEN regexp_replace({c}, {_q(rf'\b{k}\b')}, '', 'g') ELSE {c} END" if k == PRODUCTS.function_keywords[0] else f"regexp_replace({c}, CASE WHEN list_contains(string_split({found}, ', '), {_q(k)}) THEN {_q(rf'\b{k}\b')} ELSE '[^\\x{{0}}-\\x{{10FFFF}}]' END, '', 'g')"
    return c


def _synonym_values() -> str:
    rows = []
    for i, (a, masters) in enumerate(SYNONYMS.items()):
        for j, (m, v) in enumerate(masters.items()):
            rows.append(f"({_q(a)}, {i}, {_q(m)}, {j}, {_q(' , '.join(v) if v else 'N/A')})")
    return "d(attribute, attr_pos, master, master_pos, cell) AS (VALUES " + ", ".join(rows) + ")"


def _synonym_sql(values: str, attribute: str | None, cleaned: str = "value") -> str:
    """values: a query with the column value, and if need be its cleaned form."""
    chosen = f" AND attribute = {_q(attribute)}" if attribute else ""
    word = _strip(f"regexp_replace(regexp_replace({cleaned}, '[)(,\\-._/]', ' ', 'g'), {_q(W + '+')}, ' ', 'g')")
    hit = "regexp_matches(cell, '(?i)\\b' || regexp_escape(q) || '\\b')"
    return f"""{_synonym_values()}, vals AS ({values}), qs AS (SELECT value, {word} AS q FROM vals),
hits AS (SELECT q, attribute, attr_pos, master, master_pos, {hit} AS whole, contains(lower(cell), lower(q)) AS inside FROM (SELECT DISTINCT q FROM qs WHERE q <> '') CROSS JOIN d WHERE cell <> 'N/A'{chosen}),
found AS (SELECT q, bool_or(master = 'alias' AND whole) AS by_alias, string_agg(master, ', ' ORDER BY attr_pos, master_pos) FILTER (WHERE master <> 'alias' AND whole) AS masters,
string_agg(attribute, ' , ' ORDER BY attr_pos) FILTER (WHERE master = 'alias' AND inside) AS attributes FROM hits GROUP BY q)
SELECT value, coalesce(CASE WHEN by_alias THEN attributes ELSE masters END, '') AS master FROM qs LEFT JOIN found USING (q)"""


_TYPED = f"SELECT DISTINCT w AS word FROM (SELECT unnest(string_split_regex(product_family, {_q(W + '+')})) AS w FROM string_normalization) WHERE w <> ''"
_DICT = f"SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(family_name, {_q(f'{L}[\\p{{L}}\\p{{N}}\\p{{M}}_' + chr(39) + f']*{L}|{L}')})) AS word FROM canonical_families) GROUP BY word"
_SPELL = f"""WITH asked AS ({_TYPED}), known AS ({_DICT}), pairs AS (SELECT a.word, k.word AS candidate, cnt, damerau_levenshtein({_narrow('a.word')}, {_narrow('k.word')}) AS distance FROM asked a JOIN known k ON abs(length(a.word) - length(k.word)) <= 2 WHERE damerau_levenshtein({_narrow('a.word')}, {_narrow('k.word')}) <= 2),
tier AS (SELECT word, candidate, cnt, distance FROM pairs QUALIFY distance = min(distance) OVER (PARTITION BY word)),
best AS (SELECT a.word, coalesce(arg_min(candidate, struct_pack(n := -cnt, c := candidate)), '') AS best FROM asked a LEFT JOIN tier t ON a.word = t.word GROUP BY a.word)"""
_TREE = f"""WITH RECURSIVE trees AS (SELECT file_id, product_tree::JSON AS j FROM process_csaf_files WHERE json_valid(product_tree) AND json_type(product_tree::JSON) = 'OBJECT' AND (product_tree::JSON -> 'full_product_names') IS NULL),
b AS (SELECT file_id, '/branches/' || i AS node_path, (j -> 'branches') -> i::INT AS n, [coalesce(((j -> 'branches') -> i::INT) ->> 'category', '')] AS cats, [coalesce(((j -> 'branches') -> i::INT) ->> 'name', '')] AS names
FROM trees, range(coalesce(json_array_length(j, '$.branches'), 0)::BIGINT) r(i)
UNION ALL SELECT file_id, node_path || '/branches/' || i, (n -> 'branches') -> i::INT, list_append(cats, coalesce(((n -> 'branches') -> i::INT) ->> 'category', '')), list_append(names, coalesce(((n -> 'branches') -> i::INT) ->> 'name', ''))
FROM b, range(coalesce(json_array_length(n, '$.branches'), 0)::BIGINT) r(i)),
leaf AS (SELECT * FROM b WHERE (n -> 'branches') IS NULL)"""


def _category(c: str) -> str:
    """Name of the innermost branch of a category."""
    return f"names[len(cats) - list_position(list_reverse(cats), {_q(c)}) + 1] AS {c}"


_WINDOW = "list_transform(range(1, greatest(length(t) - length(w) + 2, 1)), lambda i: 1 - levenshtein(substring(t, i, length(w)), w) / length(w))"
SQL: dict[str, str] = {
    "vendor_normalize": _VENDOR_SQL,
    "vendor_distinct_joinback": _VENDOR_SQL,
    "vendor_masked_phrases": f"SELECT row_id, {_LAST} AS masked FROM (SELECT row_id, {_masked('vendor')} FROM string_normalization)",
    "vendor_audit": f"""{_vendor_steps('vendor_testoutput_ref', 'vendor_id')},
agg AS (SELECT vendor_id, any_value(vendor) AS vendor, string_agg(part, ', ' ORDER BY pos) AS a, string_agg(o, ', ' ORDER BY pos) AS b, string_agg({_LAST}, ', ' ORDER BY pos) AS c2, string_agg(c, ', ' ORDER BY pos) AS e FROM post GROUP BY vendor_id)
SELECT vendor, a AS prepared_fin, CASE WHEN b = a THEN '' ELSE b END AS precleaned_fin, CASE WHEN c2 = b THEN '' ELSE c2 END AS deleted_fin, CASE WHEN e = c2 THEN '' ELSE e END AS postcleaned_fin FROM agg""",
    "url_suffix_strip": f"SELECT row_id, regexp_replace(vendor, {_q(vendor.URL_SUFFIX)}, '', 'g') AS bare FROM string_normalization",
    "product_special_chars": f"SELECT row_id, {_clean_sql('product_name')} AS clean FROM string_normalization",
    "product_clean": f"""WITH s AS (SELECT row_id, product_name, product_family, product_version, vendor_modified AS vm, product_name_modified AS nm, product_family_modified AS fm, product_version_modified AS pm FROM string_normalization),
{_pass_sql('s', 'product_family', 1)}, {_pass_sql('y1', 'product_name', 2)},
k AS MATERIALIZED (SELECT *, array_to_string(list_distinct_ordered, ', ') AS kw FROM (SELECT *, list_filter(allk, lambda x, i: list_position(allk, x) = i) AS list_distinct_ordered FROM (SELECT *, list_filter(list_concat(string_split({_keywords_sql('nm')}, ', '), string_split({_keywords_sql('fm')}, ', ')), lambda x: x <> '') AS allk FROM y2)))
SELECT row_id, array_to_string(list_filter(string_split(vm, ', '), lambda x, i: list_position(string_split(vm, ', '), x) = i), ', ') AS vendor_modified, {_removal_sql('nm', 'kw')} AS product_name_modified, {_removal_sql('fm', 'kw')} AS product_family_modified, pm AS product_version_modified, kw AS function_keywords_found FROM k""",
    "version_extract": f"SELECT row_id, CASE WHEN product_version IS NOT NULL THEN product_version WHEN regexp_matches(c, 'v\\d+$') THEN regexp_extract(c, 'v\\d+$', 0) ELSE product_version_modified END AS version FROM (SELECT *, {_clean_sql('product_name')} AS c FROM string_normalization)",
    "version_numeric": "SELECT row_id, nullif(regexp_replace(regexp_replace(product_version, '[^0-9.]', '', 'g'), '\\.$', ''), '') AS product_version_modified, product_version_range AS product_version_range_modified FROM string_normalization",
    "function_keywords": f"SELECT row_id, {_keywords_sql('product_name')} AS found FROM string_normalization",
    "keyword_removal": f"SELECT row_id, {_removal_sql('product_name', 'kw')} AS rest FROM (SELECT *, {_keywords_sql('product_name')} AS kw FROM string_normalization)",
    "synonym_lookup": "WITH " + _synonym_sql("SELECT DISTINCT device_type AS value FROM string_miner WHERE device_type IS NOT NULL", "Device_Role"),
    "synonym_alias": "WITH " + _synonym_sql("SELECT column_name AS value FROM predefined_columns", None),
    "synonym_normalize": "WITH " + _synonym_sql(
        f"SELECT value, regexp_replace(j, {_q(f'({L}),{W}?$')}, '\\1', 'g') AS cleaned FROM (" + _vendor_steps("(SELECT DISTINCT manufacturer AS vendor, manufacturer AS value FROM string_miner WHERE manufacturer IS NOT NULL)", "value")
        + " SELECT value, regexp_replace(string_agg(c, ', ' ORDER BY pos), '(, ){2}', ', ', 'g') AS j FROM post GROUP BY value)", "Manufacturer", "cleaned"),
    "mine_regex_exact": """SELECT device_id, coalesce(nullif(regexp_extract(annotation, '(?i)\\b(?:CPU|drive unit|controller)\\b', 0), ''), nullif(regexp_extract(annotation, '(?i)[A-Z]{3}-\\d{4}-[A-Z]', 0), ''), nullif(regexp_extract(annotation, '(?i)[A-Z]{3} \\d{4}-[A-Z]', 0), '')) AS device_type,
nullif(regexp_extract(annotation, '(?i)V ?\\d+\\.\\d+(?:\\.\\d+)?', 0), '') AS version, nullif(regexp_extract(annotation, '\\d{2}[-.:]\\d{4}[-.:]\\d{4}', 0), '') AS article FROM string_miner""",
    "mine_levenshtein_window": f"""WITH s AS (SELECT row_id, {_narrow('product_name')} AS t, {_narrow('product_family')} AS w FROM string_normalization),
x AS (SELECT row_id, CASE WHEN length(w) > 0 THEN list_filter({_WINDOW}, lambda v: v >= 0.85) ELSE [] END AS sims FROM s)
SELECT row_id, coalesce(len(sims), 0)::BIGINT AS hits, list_max(sims) AS best FROM x""",
    "mine_levenshtein_best": f"""WITH t AS (SELECT device_id, annotation AS t, {_narrow('annotation')} AS b FROM string_miner WHERE annotation IS NOT NULL),
p AS (SELECT device_id, t, b, family_name AS w, family_id AS pos, unnest(range(1, greatest(length(t) - length(family_name) + 2, 1))) AS i FROM t CROSS JOIN (SELECT family_id, {_narrow('family_name')} AS family_name FROM canonical_families) f),
s AS (SELECT device_id, substring(t, i, length(w)) AS part, pos, i, 1 - levenshtein(substring(b, i, length(w)), w) / length(w) AS sim FROM p)
SELECT device_id, {_strip('arg_max(part, struct_pack(s := sim, p := -pos, i := -i))')} AS value, max(sim) AS similarity FROM s WHERE sim >= 0.85 GROUP BY device_id""",
    "word_frequencies": f"""SELECT word, count(*) AS cnt FROM (SELECT {_strip('manufacturer')} AS word FROM string_miner UNION ALL SELECT unnest(string_split_regex({_strip('manufacturer')}, {_q(W + '+')})) FROM string_miner
UNION ALL SELECT unnest(string_split_regex({_strip('device_family')}, {_q(W + '+')})) FROM string_miner UNION ALL SELECT unnest(regexp_extract_all(device_family, {_q(f"{L}[\\p{{L}}\\p{{N}}\\p{{M}}_']*{L}|{L}")})) FROM string_miner) WHERE word IS NOT NULL AND word <> '' GROUP BY word""",
    "spell_candidates": f"{_SPELL} SELECT word, candidate, cnt, distance FROM tier",
    "spell_best": f"{_SPELL} SELECT word, best FROM best",
    "spell_split": f"""{_SPELL}, texts AS (SELECT DISTINCT product_family FROM string_normalization WHERE product_family IS NOT NULL),
parts AS (SELECT product_family, unnest(list_filter(string_split_regex(product_family, {_q(W + '+')}), lambda x: x <> '')) AS word, unnest(range(len(list_filter(string_split_regex(product_family, {_q(W + '+')}), lambda x: x <> '')))) AS pos FROM texts),
fixed AS (SELECT product_family, bool_or(best = '') AS lost, string_agg(best, ' ' ORDER BY pos) AS best FROM parts JOIN best USING (word) GROUP BY product_family)
SELECT product_family, CASE WHEN lost IS NULL OR lost THEN '' ELSE best END AS best FROM texts LEFT JOIN fixed USING (product_family)""",
    "tree_flatten": f"{_TREE} SELECT file_id, node_path, CASE WHEN (n -> 'product') IS NOT NULL THEN coalesce(n ->> '$.product.name', '') END AS full_product_name_branch, CASE WHEN (n -> 'product') IS NOT NULL THEN coalesce(n ->> '$.product.product_id', '') END AS product_id, "
    + ", ".join(map(_category, COLUMNS)) + " FROM leaf",
    "tree_full_names": """SELECT file_id, '/full_product_names/' || i AS node_path, j -> 'full_product_names' -> i::INT ->> 'name' AS full_product_names, j -> 'full_product_names' -> i::INT ->> 'product_id' AS product_id
FROM (SELECT file_id, product_tree::JSON AS j FROM process_csaf_files WHERE json_valid(product_tree)) t, range(coalesce(json_array_length(j, '$.full_product_names'), 0)::BIGINT) r(i)""",
    "undefined_columns": f'{_TREE} SELECT cat AS "column", count(*) AS rows FROM (SELECT unnest(list_distinct(cats)) AS cat FROM leaf) WHERE cat NOT IN ({", ".join(map(_q, COLUMNS))}) GROUP BY cat',
    "data_source_url": """SELECT file_id, CASE WHEN (d -> 'references') IS NULL THEN 'missing' ELSE list_filter(from_json(d -> 'references', '[{"url": "VARCHAR"}]'), lambda r: r.url LIKE '%.json')[1].url END AS data_source FROM (SELECT file_id, document::JSON AS d FROM process_csaf_files)""",
    "advisory_status": "SELECT CASE WHEN document IS NOT NULL AND product_tree IS NOT NULL AND vulnerabilities IS NOT NULL THEN 'ok' ELSE 'not_csaf' END AS status, count(*) AS files FROM process_csaf_files GROUP BY 1",
    "union_by_name": "SELECT * FROM canonical_vendors UNION ALL BY NAME SELECT * FROM canonical_families",
    "corpus_unpivot": "SELECT row_pos::BIGINT AS row_pos, attribute, word FROM (UNPIVOT (SELECT row_pos, device_family, device_type, article_number FROM string_miner) ON device_family, device_type, article_number INTO NAME attribute VALUE word) WHERE word <> ''",
    "group_list_join": "SELECT v.vendor_id, string_agg(family_name, ', ' ORDER BY family_name) AS families FROM canonical_vendors v LEFT JOIN canonical_families f USING (vendor_id) GROUP BY v.vendor_id",
    "argmax_first": "SELECT manufacturer, arg_max(device_id, struct_pack(n := length(device_family), p := -row_pos, d := -device_id)) AS device_id FROM string_miner WHERE device_family IS NOT NULL GROUP BY manufacturer",
}
QUERIES: dict[str, Query] = {f.__name__: f for f in (
    vendor_normalize, vendor_distinct_joinback, vendor_masked_phrases, vendor_audit, url_suffix_strip, product_special_chars, product_clean, version_extract, version_numeric, function_keywords, keyword_removal,
    synonym_lookup, synonym_alias, synonym_normalize, mine_regex_exact, mine_regex_fuzzy, mine_levenshtein_window, mine_levenshtein_best, mine_levenshtein_devices, word_frequencies, spell_candidates, spell_best, spell_split,
    tree_flatten, tree_full_names, undefined_columns, data_source_url, advisory_status, union_by_name, corpus_unpivot, group_list_join, argmax_first,
)}
