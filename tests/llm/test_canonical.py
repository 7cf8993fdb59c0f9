from normforge.llm import canonical as C

VENDORS = [(1, "Lirrdimont Nordpaburn", "LORB"), (2, "Lirrdimont Urkumont Electronics", "LUKE"), (3, "Bovsumer Kymüwall", "BCXX"), (4, "Tamkarad", "TKD")]
FAMILIES = [(11, "Robmuvault 200", 1), (12, "Robmuvault 500", 1), (13, "Ixostar 1200", None)]
NAMES = {
    "lirrdimont nordpaburn": 1, "Lirrdimnot Nordpabrun GmbH & Co. KG": 1, "LORB AG": 1, "www.lirrdimont-nordpaburn.example": 1, "lirrdimontnordpaburn.test": 1, "Nordpaburn, Lirrdimont": 1, "Lirrdi. Nordpa.": 1, "LirrdiNordpa": 1,
    "Lirrdimont Urkumont Group": 2, "Lirrdimont Zelnomer": 0, "BovsumerKymÃ¼wall": 3, "Bovsumer Kymuewall": 3, "Tamkarad Power & Light": 4, "unknown": 0, "Tamkarad Zelnomer": 0, "?": 0, "  ": 0, "x" * 30_000: 0,
}
TYPED = {"Serie Robmuvault 200": 11, "robmuvault2oo": 11, "200 Robmuvault": 11, "Robmuvault-500": 12, "Robmuvautl_500 line": 12, "Lirrdimont Robmuvault 500": 12, "Robmuvault 700": 0, "Robmuvault": 0, "Ixos. 1200": 13, "software": 0}


def run(spark, values, reference, id_col, name_col, kind, short=None):
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate([*values, *list(values)[:1], None, ""])], "row_id long, v string, canonical_id string")
    got = C.map_to_entries(df, "row_id", "v", reference, id_col, name_col, kind, short)
    return {r.row_id: r.canonical_id for r in got.collect()}


def test_vendors(spark):
    ref = spark.createDataFrame(VENDORS, "vendor_id long, vendor_name string, short_name string")
    values = {**NAMES, "Tamkarad": None}
    got = run(spark, values, ref, "vendor_id", "vendor_name", "name", "short_name")
    assert got == {i: v for i, v in enumerate([*values.values(), next(iter(NAMES.values()))]) if v is not None}
    assert set(run(spark, NAMES, ref.limit(0), "vendor_id", "vendor_name", "name", "short_name").values()) == {0}


def test_long_lists_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "INDEX_ROWS", 2)
    test_vendors(spark)
    test_families(spark)


def test_families(spark):
    ref = spark.createDataFrame(FAMILIES, "family_id long, family_name string, vendor_id long")
    got = run(spark, TYPED, ref, "family_id", "family_name", "family")
    assert got == dict(enumerate([*TYPED.values(), 11]))


def test_repair_finds_all_within_the_budget():
    index = C.Index([(i, n, s) for i, n, s in VENDORS], "name")
    from normforge.llm.names import budget, osa

    for word in ("lirrdimnot", "nordpaburn", "nordpabur", "kymuwal", "tamkard", "zzz"):
        found = {w for w, *_ in index.repair(word)}
        want = {w for w in index.posting if osa(word, w, 9) <= min(budget(word), budget(w))}
        assert want <= found


def test_blocks_change_nothing(spark, monkeypatch):
    """Ids and scores' order are the same for a list in one block and in many."""
    ref = spark.createDataFrame(VENDORS, "vendor_id long, vendor_name string, short_name string")
    one = run(spark, NAMES, ref, "vendor_id", "vendor_name", "name", "short_name")
    for size in (1, 2, 3):
        monkeypatch.setattr(C, "INDEX_ROWS", size)
        assert run(spark, NAMES, ref, "vendor_id", "vendor_name", "name", "short_name") == one
    monkeypatch.setattr(C, "INDEX_ROWS", 1)
    entries = C._entries(ref, "vendor_id", "vendor_name", "short_name")
    whole = C.Index(VENDORS, "name")
    for index in C.indexes(entries, "name"):
        assert all(abs(whole.idf[w] - i) < 1e-12 for w, i in index.value.idf.items()) and index.value.top == whole.top


def test_families_without_numbers(spark):
    ref = spark.createDataFrame([(1, "Robmuvault", None), (2, "Velrizon 500", None), (3, "Ixostar Prime", None)], "family_id long, family_name string, vendor_id long")
    values = {"Robmuvaul": 1, "Robmuvault series": 1, "Robmuvault 700": 0, "Lirrdimont Velrizon-500": 2, "Velrizon": 0, "500": 0, "Prime Ixostar": 3, "zzz": 0}
    got = run(spark, values, ref, "family_id", "family_name", "family")
    assert [got.get(i) for i in range(8)] == list(values.values())
