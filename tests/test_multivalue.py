"""Packed fields."""

import pytest

from normforge.operators import multivalue as mv

NAMES = ["Alba Norden", "Berko", "Cimra Solt", "Dorado Works", "Evim", "Fandor Light", "Gasko Power & Light", "Halm Pumps and Valves"]
FIELDS = {
    "Alba Norden; Berko": ["Alba Norden", "Berko"],
    "Alba Norden, Inc., Berko": ["Alba Norden, Inc.", "Berko"],
    "Berko (B, formerly Nord)|Evim": ["Berko (B, formerly Nord)", "Evim"],
    '"Alba Norden, Ltd."\t\'Berko\'': ["Alba Norden, Ltd.", "Berko"],
    '["Alba Norden", "Evim"]': ["Alba Norden", "Evim"],
    "1. Alba Norden 2. Berko 3. Evim": ["Alba Norden", "Berko", "Evim"],
    "(1) Berko; (2) Evim": ["Berko", "Evim"],
    "Berko;;Evim; ": ["Berko", "Evim"],
    "Alba Norden, Berko, and Evim": ["Alba Norden", "Berko", "Evim"],
    "Berko / Evim": ["Berko", "Evim"],
    "Gasko Power & Light; Evim": ["Gasko Power & Light", "Evim"],
    "Gasko Power & Light and Berko": ["Gasko Power & Light", "Berko"],
    "Berko + Evim GmbH & Co. KG": ["Berko", "Evim GmbH & Co. KG"],
}
SINGLE = ["Alba Norden GmbH & Co. KG", "Halm Pumps and Valves", "Gasko Power & Light", "n/a", "Berko, Corp.", "", None, "Evim\t", ";;"]


def test_splits(spark):
    rows = [(i, t, None, "c") for i, t in enumerate([*FIELDS, *SINGLE])]
    plain = [(1000 + i, t, None, "c") for i, t in enumerate(NAMES * 12 + ["n/a"] * 20 + ["Alba Power & Light", "Cimra Power & Light"] * 4 + ["Evim Pumps and Valves", "Dorado Pumps and Valves"] * 4)]
    df = spark.createDataFrame(rows + rows[:1] + plain, "row_id long, vendor string, vendor_modified string, field_name string")
    got = {}
    for r in mv.unpacked(df, "row_id", ["vendor", "vendor_modified"]).collect():
        got.setdefault(r.row_id, []).append((r.value_pos, r.vendor_value))
    want = {i: [(k + 1, v) for k, v in enumerate(x)] for i, x in enumerate(FIELDS.values())}
    assert {k: sorted(v) for k, v in got.items() if k} == {k: v for k, v in want.items() if k}
    assert sorted(got[0]) == sorted(want[0] * 2)  # the repeated row gives its own rows


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "row_id long, vendor string")
    assert mv.unpacked(df, "row_id", ["vendor"]).count() == 0
    assert mv.unpacked(df.limit(0), "row_id", ["vendor"]).count() == 0


@pytest.mark.parametrize("text", ["a" * 50_000, ", " * 5_000, "(" * 1_000, '"' * 999, "a;" * 3_000 + "b"])
def test_long_texts_are_parsed_whole(text):
    field = mv.Field(text)
    assert len(field.parse(frozenset())) == len([p for p in text.replace(",", ";").split(";") if any(c.isalnum() for c in p)])


def test_same_result_in_any_partitioning(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*FIELDS, *NAMES * 3])], "row_id long, vendor string")
    one, many = (sorted(map(tuple, mv.unpacked(df.repartition(n), "row_id", ["vendor"]).collect())) for n in (1, 5))
    assert one == many
