"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = {n: q for n, q in entry.oracle_sql().items() if n in entry.reference.SQL or n in entry.core.SQL}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(frame):
    def plain(v):
        if pd.isna(v):
            return None
        return v if isinstance(v, str) else round(float(v), 9)

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = entry.queries()[name](spark, FOLDER).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_without_sql_runs(spark):
    for name in ("p2_loaded", "p4_found", "p4_conformed", "p5_found", "mine_regex_fuzzy"):
        assert entry.queries()[name](spark, FOLDER).count() >= 0, name


def test_spelling_over_every_family_equals_brute_force(spark, tmp_path):
    from normforge.operators.spell import edits_between

    texts = ["Dynavauelt-900", "Velriizon-2000", "Ixostär 300", "Robmuvault_5/x", "Ixostar 300", "Velrizon", "\u00a0Dynavault\t900 ", None, ""]
    known = ["Dynavault 900", "Velrizon-2000", "Ixostar 300", "Ixostär", "Velrizon", "Dynavault"]
    spark.createDataFrame([(t,) for t in texts], "product_family string").write.parquet(f"{tmp_path}/string_normalization.parquet")
    spark.createDataFrame([(i, k) for i, k in enumerate(known)], "family_id long, family_name string").write.parquet(f"{tmp_path}/canonical_families.parquet")
    counts = {r.word: r.cnt for r in entry.reference._dictionary(spark, str(tmp_path)).collect()}
    asked = {w for t in texts if t for w in t.split()}
    tiers = {w: {k: edits_between(w, k) for k in counts if edits_between(w, k) <= 2} for w in asked}
    near = {w: {k: d for k, d in c.items() if d == min(c.values())} for w, c in tiers.items()}
    best = {w: min(c, key=lambda k: (-counts[k], k), default="") for w, c in near.items()}
    got = {name: entry.queries()[name](spark, str(tmp_path)).collect() for name in ("spell_candidates", "spell_best", "spell_split")}
    assert sorted(map(tuple, got["spell_candidates"])) == sorted((w, k, counts[k], d) for w, c in near.items() for k, d in c.items())
    assert {r.word: r.best for r in got["spell_best"]} == best
    whole = {t: "" if not t.split() or "" in [best[w] for w in t.split()] else " ".join(best[w] for w in t.split()) for t in texts if t is not None}
    assert {r.product_family: r.best for r in got["spell_split"]} == whole and best["Ixostär"] == "Ixostär" and best["Velriizon-2000"] == ""


@pytest.mark.parametrize("pieces", [300_000, 1])
def test_mining_with_the_device_corpus_equals_brute_force(spark, tmp_path, monkeypatch, pieces):
    from normforge.operators import mining
    from normforge.operators.mining import corpus_cells

    monkeypatch.setattr(mining, "PIECES", pieces)

    rows = [
        (7, 0, "Robmuvault 200", "ABC-1234-X", "12-3456-7890", "scan: Robmuvalt 2000 ABC-1234-Y 12.3456.7890 ok"), (8, 1, "Velrizon 500", "DEF 5678-Q", None, "DFE 5678-Q and ABC-1234-X, 21-3456-7890"),
        (9, 2, "Velrizon 500", "", "6G19.8H46.25", "Velrízon 500 / 6G19 8H46.25"), (10, 3, None, "X1", "AB", None), (11, 4, "Ixostär", "x", None, "Ixostär"), (12, 5, None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, "device_id long, row_pos int, device_family string, device_type string, article_number string, annotation string")
    df.write.parquet(f"{tmp_path}/string_miner.parquet")

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, line[0] = line[0], i
            for j, y in enumerate(b, 1):
                old, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, old + (x != y))
        return line[-1]

    want = {}
    for c in corpus_cells(df, entry.reference.CORPUS).collect():
        for r in rows:
            for i in range(len(r[5] or "") - len(c.word) + 1):
                part = r[5][i : i + len(c.word)]
                sim = 1 - distance(part, c.word) / len(c.word)
                if sim >= 0.85:
                    k = (r[0], c.attribute)
                    want[k] = max(want.get(k, ()), (sim, -c.row_pos, -i, part.strip()))
    got = {(r.device_id, r.attribute): (r.value, r.similarity) for r in entry.queries()["mine_levenshtein_devices"](spark, str(tmp_path)).collect()}
    assert got == {k: (v[3], v[0]) for k, v in want.items()} and {a for _, a in got} == {"device_family", "device_type", "article_number"}


def test_synonyms_meet_by_words_as_all_pairs_do(spark):
    """Lookups by equi-join against a nested loop over values and cells, with odd values."""
    import re

    from normforge.operators import synonym

    data = {"Role": {"alias": ["role", "device role", "R&D role"], "plc": ["CPU 315", "controller", "PLC"], "io": ["I/O module", "module x", "C++", "über-modul"]}, "Maker": {"alias": ["maker", "vendor"], "acme": ["ACME", "Acme Corp", "& Sons"], "none": None}}
    words = synonym.dictionary(spark, data)
    values = ["cpu", "CPU 315", "module", "mod", "le", "role", "ole", "O module", "&", "acme corp", "++", "ÜBER modul", "über", "", "x", "vendor", "zzz", "c", "i o module", "R"]
    got = {r.value: r.master for r in synonym.resolve(spark.createDataFrame([(v,) for v in values], "value string"), "value", words).collect()}
    cells = [(a, i, m, j, c) for a, i, m, j, c in map(tuple, words.collect()) if c != "N/A"]
    for v in values:
        q = re.sub(r"\s+", " ", re.sub(r"[)(,\-._/]", " ", v)).strip()
        whole = [(a, i, m, j) for a, i, m, j, c in cells if q and re.search(rf"\b{re.escape(q)}\b", c, re.I)]
        inside = sorted({(i, a) for a, i, m, j, c in cells if m == "alias" and q and q.lower() in c.lower()})
        want = " , ".join(a for _, a in inside) if any(m == "alias" for _, _, m, _ in whole) else ", ".join(m for i, j, m in sorted((i, j, m) for _, i, m, j in whole if m != "alias"))
        assert got[v] == want, v
