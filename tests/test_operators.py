"""Semantics of single operators, by tables of cases."""

import json

import pytest
from pyspark.sql import functions as F

from normforge.functions.text import masked_delete, strip
from normforge.operators import advisory, mining, product, spell, synonym, vendor
from normforge.sources import config, sinks
from normforge.sources.advisories import read_advisories, valid
from normforge.sources.config import MinerConfig, VendorConfig
from normforge.streaming import streams

BARE = VendorConfig(pre_delete=())


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_vendor(spark):
    cases = {
        None: "None", "": "None", "A, and B and C": "A, and B, C", "Siemens (former X) AG": "Siemens AG", "Alpha & Beta KG": "Alpha Beta", "x.com": "x", "x.com.de": "x.com", "A/B \\C": "AB C", "A Ltd .": "A Ltd",
        "Dräger ©": "Dräger ", "a, , , b": "a, , b", "a, , ": "a", "  ": "",
    }
    got = column(spark, list(cases), lambda c: vendor.normalized(c, BARE))
    assert got == list(cases.values())


# Vendor names with the results they must have without a phrase list, and names that stay as they are.
GOLDEN = {
    " CP Plus": "CP Plus", "Qognify ": "Qognify", "Honeywell ": "Honeywell", "Baicells ": "Baicells", "Enphase ": "Enphase", "TEL-STER Sp. z o. o.": "TEL-STER Sp. z o. o", "FANUC ": "FANUC", "": "None",
    "multiple trailer and brake manufacturers": "multiple trailer, brake manufacturers", "Johnson & Johnson": "Johnson Johnson", "Rittal ": "Rittal", "Keysight ": "Keysight", "Medtronic ": "Medtronic",
    "Open Design Alliance (ODA)": "Open Design Alliance", "Panasonic ": "Panasonic",
}
KEPT = "Omron|Emerson|ABB|GE Digital|i.MX|LCDS - LeÃ£o Consultoria e Desenvolvimento de Sistemas Ltda ME|DrÃ¤ger|Opto 22|xArrow|Pepperl+Fuchs|mySCADA|Phoenix Contact|Aethon, ST Engineering|Red Lion, AutomationDirect|IDenticard|EZAutomation".split("|")


def test_golden_vendors(spark):
    want = GOLDEN | {k: k for k in KEPT}
    assert column(spark, list(want), lambda c: vendor.normalized(c, BARE)) == list(want.values())


# Lookups (value, attribute) with the master words they must give over a dictionary that has these names.
LOOKUPS = [
    ("Hersteller", None, "Manufacturer"), ("device role", None, "Device_Role"), ("device-role", None, "Device_Role"), ("LS", None, "LS Electric, LS industrial system"), ("ge", None, "GE digital, GE healthcare"), ("io device", None, ""),
    ("SIEMENS", None, "Siemens, siemens energy"), ("Phoenix Contact GmbH", None, "Phoenix Contact"), ("PxC", None, "Phoenix Contact"), ("Asea Brown Boveri", None, "ABB"), ("Dräger", None, ""), ("SIEMENS", "Device Role", ""),
    ("SIEMENS", "Manufacturer", "Siemens, siemens energy"), ("Phoenix Contact GmbH", "Manufacturer", "Phoenix Contact"), ("PxC", "Manufacturer", "Phoenix Contact"), ("Asea Brown Boveri", "Manufacturer", "ABB"), ("PLC", None, "RTU-PLC"),
    ("SPS", None, "RTU-PLC"), ("Firewall", None, ""), ("switch", None, ""), ("bus coupler", None, ""), ("BK", None, ""), ("Human Machine Interface", None, "HMI-Field"), ("Domain-Controller", None, ""), ("SPS", "Device Role", "RTU-PLC"),
    ("io device", "Device Role", ""), ("Firewall", "Device Role", ""), ("switch", "Device Role", ""), ("bus coupler", "Device Role", ""),
]


def test_golden_synonyms(spark):
    data = {
        "Manufacturer": {"alias": ["Hersteller", "vendor", "manufacturer"], "LS Electric": ["LS", "LSIS"], "LS industrial system": ["LS IS", "LS"], "GE digital": ["GE"], "GE healthcare": ["GE", "GE Medical"], "Siemens": ["Siemens AG"], "siemens energy": ["Siemens Gamesa"], "Phoenix Contact": ["PxC", "Phoenix Contact GmbH & Co. KG", "Phoenix Contact GmbH"], "ABB": ["Asea Brown Boveri"]},
        "Device_Role": {"alias": ["device role", "Rolle"], "RTU-PLC": ["PLC", "SPS", "RTU"], "HMI-Field": ["HMI", "Human Machine Interface"]},
    }
    words = synonym.dictionary(spark, data)
    for attribute in (None, "Device Role", "Manufacturer"):
        want = {v: m for v, a, m in LOOKUPS if a == attribute}
        got = synonym.resolve(spark.createDataFrame([(v,) for v in want], "v string"), "v", words, attribute, vendor=BARE).collect()
        assert {r.v: r.master for r in got} == want


def test_masked_deletion_looks_at_the_untouched_text(spark):
    assert column(spark, ["abc", "bb", None], lambda c: masked_delete(c, ["b", "ac"], "")) == ["ac", "", None]


def test_strip_takes_all_white_space(spark):
    assert column(spark, ["\t a\xa0", " b "], strip) == ["a", "b"]


def test_distinct_joinback_equals_expression(spark):
    df = spark.createDataFrame([("a, b.com",), (None,), ("",), ("a, b.com",)], "vendor string")
    one, two = (sorted(r.vendor_modified for r in f(df).collect()) for f in (vendor.normalize, vendor.normalize_distinct))
    assert one == two


def test_special_characters(spark):
    cases = {"a/b\\c": "a b c", "6ES7-1 x-y-z": "6es7-1 x y z", "- -- -abc": "-- -abc", "(c) ©": None, "A,(B)": "a b", "": None, None: None}
    assert column(spark, list(cases), product.cleaned) == list(cases.values())


def test_versions(spark):
    cases = {"3.4.5.RevA": "3.4.5", "1.0-2": "1.02", "3..": "3.", "abc": None, None: None}
    assert column(spark, list(cases), product.numeric_version) == list(cases.values())


def test_windows(spark):
    df = spark.createDataFrame([("xx S7-1500 yy", "S7-1500"), ("S7", "S7-1500"), (None, "a"), ("a", "")], "t string, w string")
    got = [r.n for r in df.select(F.size(mining.similar_windows(F.col("t"), F.col("w"), 0.85)).alias("n")).collect()]
    assert got[:2] == [1, 0] and got[3] == 0


def test_fuzzy_patterns(spark):
    rules = MinerConfig(patterns={"T": {"a": "Robmuvault", "b": ("Velrizon", "Ixostar")}})
    df = spark.createDataFrame([("the Robmuvalt 5",), ("Velrizon",), ("none",), (None,)], "s string")
    got = [r.found for r in mining.match_fuzzy(df, "s", rules, 1).collect()]
    assert got[0]["T"].strip() == "Robmuvalt" and got[1] == {"T": "Velrizon"} and got[2] == {} and got[3] is None
    assert [r.found for r in mining.match(df, "s", rules).collect()][:3] == [{}, {"T": "Velrizon"}, {}]


def test_levenshtein_finds_what_brute_force_finds(spark):
    corpus = spark.createDataFrame([(0, "Robmuvault 200"), (1, "Velrizon 500"), (2, "Velrizon 500")], "row_pos int, device_family string")
    texts = ["x Robmuvalt 200 y", "Velrizon 500", "velrizom 50O", "Robmuvaul 2000", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    got = {(r.k, r.value): r.similarity for r in mining.match_levenshtein(df, "k", "s", corpus, MinerConfig(patterns={}, search_columns=("device_family",))).collect()}
    assert {k for k, _ in got} == {0, 1, 3} and got[1, "Velrizon 500"] == 1.0


def test_levenshtein_broadcasts_no_table_of_the_corpus(spark):
    """Only filters of a fixed size go through the driver, however many pieces the corpus has; duplicate and null keys keep their best."""
    corpus = spark.createDataFrame([(i, f"Name{i:05d}x") for i in range(3000)], "row_pos int, device_family string")
    df = spark.createDataFrame([(1, "a Name00007x"), (1, "Name00003x"), (None, "Name00O09x"), (None, ""), (2, "Name02999x" * 2)], "k int, s string")
    found = mining.match_levenshtein(df, "k", "s", corpus, MinerConfig(patterns={}, search_columns=("device_family",)))
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "device_family", "Name00003x", 1.0), (2, "device_family", "Name02999x", 1.0), (None, "device_family", "Name00O09x", 0.9)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    log, bits = mining.Filter.of(spark.range(50_000).select(F.xxhash64("id").alias("h")), 10**12)
    assert len(bits) == (1 << log) // 8 == 1 << 24


def test_edit_tiers(spark):
    assert [spell.edits_between(a, b) for a, b in (("ab", "ba"), ("ca", "abc"), ("abc", "abc"), ("", "ab"), ("abc", "xyz"))] == [1, 2, 0, 2, 3]
    words = spark.createDataFrame([("plc",), ("pcl",), ("zzzzz",), (None,)], "word string")
    known = spark.createDataFrame([("plc", 3), ("pc", 9), ("pcl1", 1)], "word string, cnt long")
    assert {r.word: r.best for r in spell.best(words, known).collect()} == {"plc": "plc", "pcl": "pc", "zzzzz": ""}


def test_synonyms(spark):
    words = synonym.dictionary(spark, {"M": {"alias": ["maker"], "siemens": ["Siemens AG", "Siemens"], "none": None}, "R": {"alias": ["role"], "plc": ["CPU", "S7 (plc)"]}})
    df = spark.createDataFrame([("siemens",), ("cpu",), ("maker",), ("c**",), ("-",), ("",), (None,)], "v string")
    got = {r.v: r.master for r in synonym.resolve(df, "v", words).collect()}
    assert got == {"siemens": "siemens", "cpu": "plc", "maker": "M", "c**": "", "-": "", "": "", None: ""}


def test_flatten(spark):
    tree = {"branches": [{"category": "vendor", "name": "V", "branches": [
        {"category": "vendor", "name": "W", "branches": [{"category": "product_name", "name": "P", "product": {"name": "full", "product_id": "1"}}, {"name": "Q"}]}, {"category": "x", "name": "dropped", "branches": []}]}]}
    both = {"full_product_names": [{"name": "F", "product_id": "9"}], **tree}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps(both)), (3, None), (4, "{")], "file_id long, product_tree string")
    got = [(r.file_id, r.attrs, r.full_product_name_branch, r.product_id, r.full_product_names) for r in advisory.flatten(df, "file_id").collect()]
    want = [(1, {"vendor": "W", "": "Q"}, None, None, None), (1, {"vendor": "W", "product_name": "P"}, "full", "1", None), (2, {}, None, "9", "F")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_advisory_files(spark, tmp_path):
    ok = {"document": {"references": [{"url": "a.html"}, {"url": "b.json"}]}, "product_tree": {}, "vulnerabilities": []}
    (tmp_path / "sub").mkdir()
    for name, text in {"ok.json": json.dumps(ok), "sub/bad.json": "{", "none.json": "{}", "null.json": json.dumps(ok | {"vulnerabilities": None}), "empty.json": "", "x.txt": "{}"}.items():
        (tmp_path / name).write_text(text)
    df = read_advisories(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.status for r in df.collect()} == {"ok.json": "ok", "bad.json": "bad_json", "none.json": "not_csaf", "null.json": "not_csaf", "empty.json": "empty"}
    assert [r.u for r in valid(df).select(advisory.data_source(F.col("document")).alias("u")).collect()] == ["b.json"]
    docs = spark.createDataFrame([("{}",), ('{"references":[]}',), ('{"references":[{"url":"x"}]}',)], "document string")
    assert [r.u for r in docs.select(advisory.data_source(F.col("document")).alias("u")).collect()] == ["missing", None, None]


def test_configuration(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    assert config.read_structured(config.find_file("a.json", [str(tmp_path)])) == {"x": 1}
    with pytest.raises(FileNotFoundError):
        config.find_file("none.json", [str(tmp_path)])
    with pytest.raises(ValueError):
        config.read_sheet(spark, "corpus.txt", ["a"])
    (tmp_path / "c.csv").write_text('manufacturer,x\nn/a,1\n" a, b ",2\n"",3\nn/a x,4\n"say ""hi""",5\n')
    assert [tuple(r) for r in config.read_sheet(spark, str(tmp_path / "c.csv"), ["manufacturer"]).collect()] == [(0, None), (1, " a, b "), (2, None), (3, "n/a x"), (4, 'say "hi"')]
    (tmp_path / "m.json").write_text(json.dumps({"Version": {"any": r"V\\d+", "none": None}, "Type": {"a": ["x", "y"]}}))
    assert MinerConfig.load(tmp_path / "m.json").patterns == {"Version": {"any": r"V\\d+", "none": None}, "Type": {"a": ("x", "y")}}
    assert list(MinerConfig.load(tmp_path / "m.json", ["Type"]).patterns) == ["Type"]
    with pytest.raises(KeyError):
        MinerConfig.load(tmp_path / "m.json", ["Family"])


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("a (x), b.com",), (None,)], "vendor string")
    df.write.parquet(str(tmp_path / "in"))
    streams.to_parquet(streams.normalized_vendors(spark, str(tmp_path / "in"), "vendor string"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = sorted(r.vendor_modified for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.vendor_modified for r in vendor.normalize(df).collect())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q", y'), ("a", 'x "q", y')], "vendor string, vendor_modified string")
    sinks.write_csv(df, str(tmp_path / "c"), "vendor")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()
    assert [tuple(r) for r in back] == [("a", 'x "q", y')]
    sinks.write_dictionary(spark.createDataFrame([("w", 2)], "word string, cnt long"), str(tmp_path / "d"))
    assert spark.read.option("header", True).csv(str(tmp_path / "d")).columns == ["words", "count"]
