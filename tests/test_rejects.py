"""Raw lines: the format rules case by case, and against a reading of the rules by hand."""

import csv
import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from normforge.operators import rejects

GOOD = 'a.json,ID,1,2024-02-29,7.5,"{""a"": [1, ""x,y""]}","[]"'
CASES = [
    (GOOD, None),
    (GOOD + "\r", None),
    (GOOD.replace("2024-02-29", "2024-02-29T23:59:59+02:00"), None),
    (GOOD.replace(",7.5,", ",,"), None),
    (GOOD.replace("[1, ", "[1,\n "), None),
    (None, "columns"), ("", "columns"), ("a,b", "columns"), (GOOD + ",", "columns"),
    (GOOD[:-1], "quoting"), (GOOD.replace("a.json", 'a".json'), "quoting"), (GOOD.replace('""a""', '"a"'), "quoting"),
    (GOOD.replace('{""a""', "{'a'"), "document"), (GOOD.replace('"{""a"": [1, ""x,y""]}"', '"[]"'), "document"), (GOOD.replace("[1, ", "[NaN, "), "document"), (GOOD.replace("[1, ", "[01, "), "document"),
    (GOOD.replace('"[]"', "{}"), "vulnerabilities"), (GOOD.replace('"[]"', ""), "vulnerabilities"),
    (GOOD.replace(",1,", ",0,"), "value"), (GOOD.replace(",1,", ",1.5,"), "value"), (GOOD.replace("2024-02-29", "2023-02-29"), "value"), (GOOD.replace("2024-02-29", "2024-02-29T24:00:00Z"), "value"),
    (GOOD.replace("7.5", "10.01"), "value"), (GOOD.replace("7.5", "high"), "value"), (GOOD.replace("7.5", "-1"), "value"),
]


@pytest.mark.parametrize(("line", "reason"), CASES)
def test_each_rule(line, reason):
    got, _ = rejects.split_lines(pa.array([GOOD, line, GOOD], pa.string()))
    assert [rejects.REASONS[r] if r >= 0 else None for r in got] == [None, reason, None]


def test_every_line_ends_in_one_table(spark):
    rows = [(i, line, "x") for i, (line, _) in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "line_id long, raw_line string, fail_reason string").repartition(3)
    bad, good = rejects.rejects(df).collect(), rejects.loaded(df).collect()
    assert sorted((r.line_id, r.fail_reason) for r in bad) == sorted((i, why) for i, (_, why) in enumerate(CASES) if why for _ in range(2))
    assert len(bad) + len(good) == len(rows)
    assert {r.tracking_id for r in good} == {"ID"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id long, raw_line string")
    assert rejects.rejects(df).count() == rejects.loaded(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\n\r\x01é', max_size=6), min_size=7, max_size=7), min_size=1, max_size=5))
def test_cells_survive_quoting(rows):
    lines = []
    for row in rows:
        lines.append(",".join('"' + c.replace('"', '""') + '"' for c in row))
    _, cells = rejects.split_lines(pa.array(lines))
    assert [[cells[f][i].as_py() for f in rejects.FIELDS] for i in range(len(rows))] == rows


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8), st.integers(0, 40))
def test_deep_reader_agrees_with_the_parser(value, cut):
    text = json.dumps(value)
    for t in (text, text[:cut], text + "]", text.replace(",", ",,")):
        assert rejects._deep_kind(t) == rejects.json_kind(t), t


def test_deep_json_is_read():
    deep = '{"a":' + "[" * 200_000 + "]" * 200_000 + "}"
    line = next(iter(_csv(["f", "t", "1", "2020-01-01", "", deep, "[]"])))
    assert rejects.split_lines(pa.array([line]))[0].tolist() == [-1]


def _csv(row):
    import io

    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(row)
    yield out.getvalue()
