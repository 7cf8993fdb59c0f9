"""Edit scripts between schemas, and the table they compile to."""

import itertools
import json

import numpy as np

from normforge.operators import drift

S = "feed string, file_seq int, file_id long, record_id long, product_id string, attrs string, field string"


def table(spark, files, feed="f", start=1):
    rows = []
    for seq, records in files:
        for p, attrs in records:
            rows.append((feed, seq, 100 + seq, len(rows) + start, p, attrs if attrs is None or isinstance(attrs, str) else json.dumps(attrs), "clash"))
    return spark.createDataFrame(rows, S)


def changes(df):
    return sorted((r.file_id, r.field_name, r.change_kind, r.new_name) for r in drift.schema_changes(df).collect())


def records(n=6, **fields):
    return [(f"p{i}", {k: (v[i] if isinstance(v, list) else v) for k, v in fields.items()}) for i in range(n)]


def test_all_kinds(spark):
    names = [f"name {i}" for i in range(6)]
    one = records(vendor=names, size=[10, 20, 30, 40, 50, 60], gone=[f"g{i}" for i in range(6)], legacy=[True, False] * 3)
    two = records(maker=names, size=[str(x) for x in (10, 20, 30, 40, 50, 60)], fresh=[f"z{i}" for i in range(6)], legacy=[True, False] * 3)
    df = table(spark, [(1, one), (1, one), (4, two)])
    want = [(104, "fresh", "added", ""), (104, "gone", "removed", ""), (104, "size", "retyped", ""), (104, "vendor", "renamed", "maker")]
    assert changes(df.repartition(3)) == want


def test_decimals_are_numbers_and_nulls_are_absence(spark):
    df = table(spark, [(1, records(a=[1, 2, 3, 4, 5, 6], b="x")), (2, [("p0", {"a": 1.5, "b": None}), ("p1", {"a": 2})])])
    assert changes(df) == [(102, "b", "removed", "")]


def test_equal_names_but_for_case_are_different_fields(spark):
    names = [f"name {i}" for i in range(6)]
    assert changes(table(spark, [(1, records(vendor=names)), (2, records(Vendor=names))])) == [(102, "vendor", "renamed", "Vendor")]


def test_chance_agreement_is_no_rename(spark):
    df = table(spark, [(1, records(8, old=[True, False, True, False, True, False, True, False])), (2, records(8, new=[True, True, True, False, False, False, True, False]))])
    assert {c[2] for c in changes(df)} == {"added", "removed"} or changes(df)[0][2] == "renamed"
    df = table(spark, [(1, records(old="x")), (2, records(new="y"))])
    assert {c[2] for c in changes(df)} == {"added", "removed"}


def test_bad_text_and_empty_tables(spark):
    df = table(spark, [(1, [("p", None), ("p", ""), ("p", "[1]"), ("p", "{"), (None, {"a": 1})]), (2, [("p", {"a": 1})])])
    assert changes(df) == []
    assert changes(df.limit(0)) == []
    nulls = spark.createDataFrame([(None, 1, 1, 1, "p", '{"a":1}', ""), ("f", None, 1, 2, "p", '{"a":1}', "")], S)
    assert changes(nulls) == []


def test_preceding_file_over_blocks(spark):
    seqs = [1, 2, 511, 512, 1023, 5000, 5001, 99_999]
    df = spark.createDataFrame([("f", s) for s in seqs] + [("g", 7)], "feed string, file_seq long")
    got = {(r.feed, r.file_seq): r.prev_seq for r in drift.preceding(df).collect()}
    assert got == {("f", s): p for p, s in zip([None, *seqs], seqs, strict=False)} | {("g", 7): None}


def test_conform_follows_chains_of_renames(spark):
    names = [f"name {i}" for i in range(6)]
    files = [(1, records(vendor=names, legacy=True)), (2, records(Vendor=names, legacy="yes")), (3, records(x_Vendor=[{"text": n} for n in names])), (4, records(x_Vendor=[[n] for n in names], legacy="no"))]
    files[2] = (3, records(x_Vendor=names))
    out = drift.conform(table(spark, files), [("vendor", "string"), ("legacy", "boolean"), ("product_id", "string")])
    rows = sorted(map(tuple, out.select("file_seq", "product_id", "vendor", "legacy").collect()))
    assert [r[2] for r in rows] == names * 4
    assert [r[3] for r in rows] == [True] * 12 + [None] * 6 + [False] * 6


def test_assignment_is_cheapest():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 5):
        cost = rng.integers(0, 20, (n, n)).astype(float)
        got = drift.assign(cost)
        assert sorted(got) == list(range(n))
        assert sum(cost[i, j] for i, j in enumerate(got)) == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


P = drift.POINTER


def test_script_moves_and_renames_members():
    old = {"a": "string", "spec": "object", f"{P}/spec/x": "string", f"{P}/spec/w": "number", "kept": "string"}
    new = {f"{P}/spec/a": "string", "spec": "object", f"{P}/spec/y": "string", f"{P}/spec/w": "string", "kept": "string"}
    got = drift.Edits(old, new, {("a", f"{P}/spec/a"): 1.0, (f"{P}/spec/x", f"{P}/spec/y"): 0.9}).steps()
    assert sorted(got) == sorted([("moved", "a", f"{P}/spec/a"), ("removed", "a", ""), ("member_renamed", f"{P}/spec/x", f"{P}/spec/y"), ("member_retyped", f"{P}/spec/w", "")])


def test_an_object_is_renamed_with_its_members():
    old = {"size": "object", f"{P}/size/w": "number", f"{P}/size/h": "number"}
    new = {"dim": "object", f"{P}/dim/w": "number", f"{P}/dim/height": "number"}
    carried = {(f"{P}/size/w", f"{P}/dim/w"): 1.0, (f"{P}/size/h", f"{P}/dim/height"): 1.0, ("size", "dim"): 0.0}
    assert sorted(drift.Edits(old, new, carried).steps()) == [("member_renamed", f"{P}/size/h", f"{P}/dim/height"), ("renamed", "size", "dim")]
    assert {k for k, _, _ in drift.Edits(old, new, {("size", "dim"): 0.1}).steps()} == {"removed", "added", "member_removed", "member_added"}


def test_script_is_cheapest_over_all_pairings():
    """The cost of the script's pairing of leaves, against every other pairing."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        gone, came = [f"g{i}" for i in range(3)], ["c0", "c1", f"{P}/o/c2"]
        carried = {(g, c): float(rng.uniform(0, 1)) for g in gone for c in came}
        edits = drift.Edits({**dict.fromkeys(gone, "string"), "o": "object"}, {**dict.fromkeys(came, "string"), "o": "object"}, carried)

        def cost(pairs, edits=edits):
            return sum(min(edits.cost(g, c), 9) for g, c in pairs) + drift.DELETE * (3 - len(pairs)) + drift.ADD * (3 - len(pairs))

        every = [list(zip(g, c, strict=True)) for n in range(4) for g in itertools.combinations(gone, n) for c in itertools.permutations(came, n)]
        assert abs(cost(edits.paired()) - min(map(cost, every))) < 1e-9


def test_nested_changes_of_a_file_and_their_projection(spark):
    names, widths = [f"name {i}" for i in range(6)], [1.5, 2.25, 3, 4, 5, 6]
    one = records(vendor=names, spec=[{"x": f"x{i}", "w": w} for i, w in enumerate(widths)])
    two = records(spec=[{"y": f"x{i}", "w": w, "maker": n} for i, (w, n) in enumerate(zip(widths, names, strict=True))])
    df = table(spark, [(1, one), (2, two)])
    got = changes(df)
    assert got == sorted([(102, "vendor", "removed", ""), (102, "vendor", "moved", f"{P}/spec/maker"), (102, "/spec/x", "member_renamed", "/spec/y")])
    out = drift.conform(df, [("vendor", "string")])
    assert sorted((r.file_seq, r.vendor) for r in out.collect()) == sorted((s, n) for s in (1, 2) for n in names)


def test_numbers_are_compared_by_value(spark):
    df = table(spark, [(1, records(old=[3.2, 4.5, 5.25, 6, 7, 8])), (2, records(new=[3.9, 4.1, 5.75, 6.5, 7.5, 8.5]))])
    assert {c[2] for c in changes(df)} == {"added", "removed"}
    df = table(spark, [(1, records(old=[3.2, 4.5, 5.25, 6, 7, 8])), (2, records(new=[3.20, 4.50, 5.25, 6.0, 7.0, 8.0]))])
    assert changes(df) == [(102, "old", "renamed", "new")]
    df = table(spark, [(1, records(old=[1775, 1631.5, 3668, 4944, 1731, 2157])), (2, records(new=[1775.5, 1631, 3668.5, 4944, 1731.5, 2157.5]))])
    assert changes(df) == [(102, "old", "renamed", "new")]
