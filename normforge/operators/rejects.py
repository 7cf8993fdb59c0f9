"""Loading raw CSV lines whose cells hold JSON, apart from the lines that can't be loaded.

Every line ends in exactly one of two tables: the loaded one, with typed cells, or the rejects
with the first reason that applies, of ``quoting``, ``columns``, ``document``,
``vulnerabilities`` and ``value``. A batch of lines goes as one buffer through pyarrow's CSV
reader: rows of a wrong width come back through its invalid-row callback, the others as string
columns, whose cells are then cast as whole vectors.

pyarrow accepts stray quotes that the format forbids, so the quote grammar is tested first, by
one linear-time pattern over the vector of lines. Line breaks inside a line are carried through
the reader as bytes that UTF-8 never holds, so that no line can break into two or swallow the next.

Defined results: a null line and an empty line have no seven fields (``columns``); repeated lines
are each loaded or rejected; further input columns are ignored.
"""

from __future__ import annotations

import datetime
import io
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pc_csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("file_name", "tracking_id", "revision", "released", "score", "document", "vulnerabilities")
REASONS = ("quoting", "columns", "document", "vulnerabilities", "value")
FIELD = r'("([^"]|"")*"|[^",]*)'
LINE = rf"(?s)^{FIELD}(,{FIELD})*$"
REVISION = r"^0*[1-9][0-9]*$"
RELEASED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2}))?$"
SCORE = r"^[0-9]+(\.[0-9]+)?$"
#: What line breaks, and the mark itself, become while a line is in the reader.
ESCAPES = (("\x01", "\x01a"), ("\n", "\x01n"), ("\r", "\x01r"))
#: Bytes of lines that are read at once.
BUFFER_BYTES = 8 << 20
TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null))')


def _no_constant(_: str) -> None:
    raise ValueError("NaN and Infinity are no JSON")


def json_kind(text: str) -> type | None:
    """dict, list or object for strict JSON text, None if it isn't JSON."""
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_int=str, parse_float=str)
    except RecursionError:
        return _deep_kind(text)
    except ValueError:
        return None
    return type(value) if isinstance(value, dict | list) else object


def _deep_kind(text: str) -> type | None:
    """json_kind without recursion, for text nested too deeply for the parser."""
    stack, at, wants = [], 0, "value"  # wants: value, value or ], key, key or }, colon, more
    while True:
        m = TOKEN.match(text, at)
        if not m:
            break
        at, mark, scalar = m.end(), m.group(1), m.group(2)
        if wants in ("value", "value or ]") and (scalar or mark in ("{", "[")):
            if mark:
                stack.append(mark)
            wants = {"{": "key or }", "[": "value or ]"}.get(mark, "more")
        elif wants in ("key", "key or }") and scalar and scalar[0] == '"':
            wants = "colon"
        elif wants == "colon" and mark == ":":
            wants = "value"
        elif stack and mark == ("}" if stack[-1] == "{" else "]") and wants in ("more", "key or }" if stack[-1] == "{" else "value or ]"):
            stack.pop()
            wants = "more"
        elif stack and wants == "more" and mark == ",":
            wants = "key" if stack[-1] == "{" else "value"
        else:
            return None
        if wants == "more" and not stack:
            break
    first = text.lstrip(" \t\n\r")[:1]
    return {"{": dict, "[": list}.get(first, object) if wants == "more" and not stack and not text[at:].strip(" \t\n\r") else None


def _existing(text: str) -> bool:
    try:
        moment = datetime.datetime.fromisoformat(text)
    except ValueError:
        return False
    return text[:4] != "0000" and moment is not None


def _each(column: pa.Array, test: Callable[[str], bool]) -> np.ndarray:
    """The test of every distinct value, spread over the rows."""
    coded = column.dictionary_encode()
    hits = np.fromiter((test(v) for v in coded.dictionary.to_pylist()), bool, len(coded.dictionary))
    return hits[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, bool)


def _matches(column: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False).astype(bool)


def split_lines(lines: pa.Array) -> tuple[np.ndarray, dict[str, list]]:
    """Reason number of each line (-1: good), and the string cells of the lines that have seven fields, with their line numbers under "at"."""
    count = len(lines)
    reason = np.full(count, -1, np.int8)
    lines = pc.fill_null(lines, "")
    lines = pc.replace_substring_regex(lines, r"\r\z", "", max_replacements=1)
    quoted = _matches(lines, LINE)
    reason[~quoted] = REASONS.index("quoting")
    good = np.flatnonzero(quoted)
    cells: dict[str, list] = {"at": []} | {f: [] for f in FIELDS}
    if not len(good):
        return reason, cells
    raw = lines.take(pa.array(good))
    for plain, escaped in ESCAPES:
        raw = pc.replace_substring(raw, plain, escaped)
    numbered = pc.binary_join_element_wise(pc.cast(pa.array(good), pa.string()), raw, ",").cast(pa.binary())
    narrow: list[int] = []

    def on_invalid(row: pc_csv.InvalidRow) -> str:
        narrow.append(int(row.text.partition(",")[0]))
        return "skip"

    buffer = b"\n".join(numbered.to_pylist()) + b"\n"
    names = ["at", *FIELDS]
    try:
        read = pc_csv.read_csv(
            io.BytesIO(buffer),
            read_options=pc_csv.ReadOptions(use_threads=False, column_names=names, block_size=len(buffer) + 1),
            parse_options=pc_csv.ParseOptions(invalid_row_handler=on_invalid, newlines_in_values=False),
            convert_options=pc_csv.ConvertOptions(check_utf8=False, column_types={n: pa.string() for n in names}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid as empty:  # every row was rejected
        if "Empty CSV" not in str(empty) and len(narrow) < len(good):
            raise
        read = None
    reason[narrow] = REASONS.index("columns")
    if read is None or not read.num_rows:
        return reason, cells
    columns = {}
    for name in names:
        column = read.column(name).combine_chunks()
        for plain, escaped in reversed(ESCAPES):
            column = pc.replace_substring(column, escaped, plain)
        columns[name] = column
    at = columns["at"].cast(pa.int64()).to_numpy()
    found = np.full(len(at), -1, np.int8)

    def fails(bad: np.ndarray, why: str) -> None:
        found[bad & (found < 0)] = REASONS.index(why)

    fails(~_each(columns["document"], lambda t: json_kind(t) is dict), "document")
    fails(~_each(columns["vulnerabilities"], lambda t: json_kind(t) is list), "vulnerabilities")
    score = columns["score"]
    shaped = _matches(score, SCORE)
    within = np.zeros(len(at), bool)
    within[shaped] = pc.cast(score.filter(pa.array(shaped)), pa.float64()).to_numpy(zero_copy_only=False) <= 10
    blank = pc.equal(score, "").to_numpy(zero_copy_only=False)
    dated = _matches(columns["released"], RELEASED)
    dated &= _each(columns["released"], _existing)
    fails(~(_matches(columns["revision"], REVISION) & dated & (within | blank)), "value")
    reason[at] = found
    return reason, {n: columns[n] for n in names} | {"at": at}


def load_lines(df: DataFrame, key: str = "line_id", line: str = "raw_line") -> DataFrame:
    """Every line once: the key, ``fail_reason`` (null for a good line) and the seven cells (null for a reject).

    Narrow; the two tables are ``where fail_reason is null`` and ``is not null`` of it.
    """
    source = df.select(F.col(key).alias("line_key"), F.col(line).cast("string").alias("line_text"))
    key_type = dict(source.dtypes)["line_key"]
    schema = f"`{key}` {key_type}, fail_reason string, " + ", ".join(f"{f} string" for f in FIELDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False))
            edges = np.flatnonzero(np.diff(sizes // BUFFER_BYTES, prepend=0)) if len(sizes) else []
            for low, high in zip([0, *edges], [*edges, whole.num_rows], strict=True):
                batch = whole.slice(low, high - low)
                if not batch.num_rows:
                    continue
                reason, cells = split_lines(batch.column(1))
                names = pa.array([*REASONS, None], pa.string()).take(pa.array(np.where(reason < 0, len(REASONS), reason)))
                place = np.full(batch.num_rows, -1)
                good = reason < 0
                if len(cells["at"]):
                    place[cells["at"]] = np.arange(len(cells["at"]))
                index = pa.array(np.where(good, place, 0), pa.int64(), mask=~good)
                columns = [cells[f].take(index) if len(cells["at"]) else pa.nulls(batch.num_rows, pa.string()) for f in FIELDS]
                yield pa.RecordBatch.from_arrays([batch.column(0), names, *columns], [key, "fail_reason", *FIELDS])

    return source.mapInArrow(work, schema)


def rejects(df: DataFrame, key: str = "line_id", line: str = "raw_line") -> DataFrame:
    """The key and the reason of each line that can't be loaded."""
    return load_lines(df, key, line).where(F.col("fail_reason").isNotNull()).select(key, "fail_reason")


def loaded(df: DataFrame, key: str = "line_id", line: str = "raw_line") -> DataFrame:
    """The good lines with typed cells; a date without time counts as its midnight in UTC, an empty score is null."""
    rows = load_lines(df, key, line).where(F.col("fail_reason").isNull())
    return rows.select(
        key, "file_name", "tracking_id", F.col("revision").try_cast("decimal(38,0)").alias("revision"), F.try_to_timestamp("released").alias("released"),
        F.col("score").try_cast("double").alias("score"), "document", "vulnerabilities",
    )
