"""Deeply nested JSON text to linked flat rows.

A batch of documents is laid out as one byte buffer. Bitmaps of quotes, brackets and delimiters
are built over the whole buffer, string interiors are masked by the running parity of the quotes,
the nesting depth is the prefix sum of the brackets, and sorting the structural tokens by depth
puts every delimiter behind the bracket that owns it. Records are then addressed by token
arithmetic only; no document is parsed into objects.

Which records are listed is told by a *shape*: for each record kind the relative places of its
child records, such as ``{"": {"branches[]": "branch"}, "branch": {"branches[]": "branch",
"product": "product"}}``. ``name[]`` means each element of the array ``name``, a plain name the
object under it, dots lead through objects that aren't listed, and "" is the document.

Defined results: null and empty text, text whose quotes or brackets don't balance, and text whose
top is not an object give no rows. An element of a listed array counts whatever its type. Of a
repeated key the last that holds a fitting container counts. Columns of the input other than the
key and the text are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are laid out at once.
BUFFER_BYTES = 4 << 20
QUOTE, BACKSLASH, COMMA, COLON, BRACE, BRACKET, END_BRACE, END_BRACKET = (ord(c) for c in '"\\,:{[}]')

PRODUCT_TREE_SHAPE = {
    "": {"branches[]": "branch", "full_product_names[]": "full_product_name"},
    "branch": {"branches[]": "branch", "product": "product"},
    "product": {"product_identification_helper.model_numbers[]": "model_number"},
    "full_product_name": {"product_identification_helper.model_numbers[]": "model_number"},
}


def compiled(shape: dict[str, dict[str, str]]) -> tuple[list[tuple[int, bytes, bool, int]], list[str], dict[int, int]]:
    """Steps (state, key, to an array, next state), the kind of each state ("" if not listed), and the element state of each array state."""
    kinds, steps, elements = [""], [], {}
    record = {"": 0}
    for kind in [*shape, *(k for places in shape.values() for k in places.values())]:
        if kind not in record:
            record[kind] = len(kinds)
            kinds.append(kind)
    for owner, places in shape.items():
        for place, kind in places.items():
            state, names = record[owner], place.split(".")
            for i, name in enumerate(names):
                last, array = i == len(names) - 1, name.endswith("[]")
                key = name.removesuffix("[]").encode()
                found = next((t for s, k, a, t in steps if (s, k, a) == (state, key, array)), None)
                if found is None:
                    found = record[kind] if last and not array else len(kinds)
                    if not last or array:
                        kinds.append("")
                    steps.append((state, key, array, found))
                if array:
                    if last:
                        elements[found] = record[kind]
                    elif found not in elements:
                        elements[found] = len(kinds)
                        kinds.append("")
                state = elements[found] if array else found
    return steps, kinds, elements


class Layout:
    """Token tables of a buffer of documents."""

    def __init__(self, texts: list[bytes]):
        self.text = b"\n".join(texts) + b"\n"
        b = np.frombuffer(self.text, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        kind = np.int32 if len(b) < 1 << 31 else np.int64
        plain = np.maximum.accumulate(np.where(b == BACKSLASH, -1, np.arange(len(b), dtype=kind)))
        quotes = np.flatnonzero(b == QUOTE)
        before = np.where(quotes > 0, plain[quotes - 1], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
        doc_of = lambda at: np.searchsorted(starts, at, "right") - 1
        odd = np.bincount(doc_of(quotes), minlength=len(texts)) % 2 == 1
        quotes = quotes[~odd[doc_of(quotes)]]
        toggles = np.zeros(len(b), np.uint8)
        toggles[quotes] = 1
        inside = np.bitwise_and(np.cumsum(toggles, dtype=kind), 1).astype(bool)
        structural = np.zeros(256, bool)
        structural[[COMMA, COLON, BRACE, BRACKET, END_BRACE, END_BRACKET]] = True
        at = np.flatnonzero(structural[b] & ~inside)
        at = at[~odd[doc_of(at)]]
        step = np.zeros(256, np.int8)
        step[[BRACE, BRACKET]], step[[END_BRACE, END_BRACKET]] = 1, -1
        for _ in range(2):
            doc, delta = doc_of(at), step[b[at]].astype(np.int64)
            depth = np.cumsum(delta)
            bad = np.bincount(doc, weights=delta, minlength=len(texts)) != 0
            first = np.searchsorted(doc, np.arange(len(texts)))
            base = np.where(first > 0, np.concatenate([[0], depth])[np.minimum(first, len(depth))], 0)
            bad[doc[depth < base[doc]]] = True
            if not bad.any():
                break
            at = at[~bad[doc]]
        self.b, self.at, self.quotes, self.char, self.doc = b, at, quotes, b[at], doc
        opens, closes = delta == 1, delta == -1
        level = depth + closes
        order = np.argsort(level, kind="stable")
        rank = np.arange(len(order))
        leader = np.maximum.accumulate(np.where(opens[order], rank, 0)) if len(order) else rank
        owner = np.empty(len(order), np.int64)
        owner[order] = order[leader] if len(order) else leader
        self.level, self.owner = level, owner
        self.close = np.full(len(order), -1, np.int64)
        self.close[owner[closes]] = np.flatnonzero(closes)
        wrong = self.char[owner[closes]] + 2 != self.char[closes]
        self.bad_docs = np.zeros(len(texts), bool)
        self.bad_docs[doc[np.flatnonzero(closes)[wrong]]] = True
        self.wide = len(order) + 1
        self.open_keys = level[order][opens[order]] * self.wide + order[opens[order]]
        self.open_tokens = order[opens[order]]
        commas = (self.char == COMMA)[order]
        self.comma_keys = level[order][commas] * self.wide + order[commas]
        self.comma_tokens = order[commas]
        self.solid = np.concatenate([[0], np.cumsum(~np.isin(b, [9, 10, 13, 32]), dtype=kind)])

    def parents(self, tokens: np.ndarray) -> np.ndarray:
        return self.open_tokens[np.searchsorted(self.open_keys, (self.level[tokens] - 1) * self.wide + tokens) - 1]

    def places(self, tokens: np.ndarray, parents: np.ndarray) -> np.ndarray:
        """Index of a container among the elements of its parent."""
        level = self.level[parents] * self.wide
        return np.searchsorted(self.comma_keys, level + tokens) - np.searchsorted(self.comma_keys, level + parents)

    def named(self, tokens: np.ndarray, key: bytes) -> np.ndarray:
        """Whether the containers, which are members of objects, stand under the key."""
        colons = tokens - 1
        is_member = (colons >= 0) & (self.char[colons] == COLON)
        end = np.searchsorted(self.quotes, self.at[colons]) - 1
        is_member &= end >= 1
        start, stop = self.quotes[np.maximum(end - 1, 0)] + 1, self.quotes[np.maximum(end, 0)]
        hit = is_member & (stop - start == len(key))
        rows = np.flatnonzero(hit)
        hit[rows] = (self.b[start[rows][:, None] + np.arange(len(key))] == np.frombuffer(key, np.uint8)).all(axis=1)
        longer = np.flatnonzero(is_member & (stop - start > len(key)) & (stop - start <= 6 * len(key)))
        for i in longer:
            raw = self.text[start[i] : stop[i]]
            if b"\\" in raw:
                try:
                    hit[i] = json.loads(b'"' + raw + b'"').encode("utf-8", "replace") == key
                except ValueError:
                    pass
        return hit

    def sizes(self, arrays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements of each array, and the rank of its first comma."""
        level = self.level[arrays] * self.wide
        low, high = np.searchsorted(self.comma_keys, level + arrays), np.searchsorted(self.comma_keys, level + self.close[arrays])
        filled = self.solid[self.at[self.close[arrays]]] > self.solid[self.at[arrays] + 1]
        return np.where(filled, high - low + 1, 0), low


def records(texts: list[bytes], shape: dict[str, dict[str, str]], with_text: bool = True, alone: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of the text, [path, path of the parent, kind, text of the record]) of each listed record.

    With ``alone`` the text has an empty list in place of a list of further records, so that the texts
    of a tree are together no longer than the tree.
    """
    steps, kinds, elements = compiled(shape)
    x = Layout(texts)
    state = np.full(len(x.at), -1, np.int64)
    path, above = np.full(len(x.at), None, object), np.full(len(x.at), None, object)
    docs, out, spans, inner = [], [[], [], [], []], [], []

    def emit(doc, paths, parents, kind, starts, stops):
        docs.append(doc)
        out[0].append(paths)
        out[1].append(parents)
        out[2].append(np.full(len(doc), kind, object))
        if alone:
            spans.append((starts, stops))
        elif with_text:
            out[3].append(np.fromiter((x.text[a:z].strip().decode("utf-8", "replace") for a, z in zip(starts, stops, strict=True)), object, len(doc)))

    levels = x.level[x.open_tokens] if len(x.open_tokens) else np.empty(0, np.int64)
    bounds = np.searchsorted(levels, np.arange(1, (levels[-1] if len(levels) else 0) + 2))
    for depth in range(len(bounds) - 1):
        tokens = x.open_tokens[bounds[depth] : bounds[depth + 1]]
        tokens = tokens[~x.bad_docs[x.doc[tokens]]]
        if depth == 0:
            tokens = tokens[x.char[tokens] == BRACE]
            _, first = np.unique(x.doc[tokens], return_index=True)
            tokens = tokens[first]
            state[tokens], path[tokens], above[tokens] = 0, "", ""
            continue
        parents = x.parents(tokens)
        known = state[parents] >= 0
        tokens, parents = tokens[known], parents[known]
        if not len(tokens):
            break
        own = state[parents]
        for array, element in elements.items():
            rows = np.flatnonzero((own == array) & (x.char[tokens] == BRACE))
            if len(rows):
                t, p = tokens[rows], parents[rows]
                places = x.places(t, p).astype(str).astype(object)
                state[t], path[t] = element, path[p] + "/" + places
                above[t] = path[t] if kinds[element] else above[p]
        for at, key, array, after in steps:
            rows = np.flatnonzero((own == at) & (x.char[tokens] == (BRACKET if array else BRACE)))
            rows = rows[x.named(tokens[rows], key)]
            if not len(rows):
                continue
            _, last = np.unique(parents[rows][::-1], return_index=True)
            rows = rows[::-1][last]
            t, p = tokens[rows], parents[rows]
            state[t], path[t], above[t] = after, path[p] + ("/" + key.decode()), above[p]
            if kinds[after]:
                emit(x.doc[t], path[t], above[p], kinds[after], x.at[t], x.at[x.close[t]] + 1)
                above[t] = path[t]
            element = elements.get(after)
            if array and kinds[element]:
                if alone:
                    inner.append((x.at[t], x.at[x.close[t]] + 1))
                count, low = x.sizes(t)
                which = np.repeat(np.arange(len(t)), count)
                place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                starts = stops = None
                if with_text:
                    commas = x.at[x.comma_tokens] if len(x.comma_tokens) else np.zeros(1, np.int64)
                    edge = low[which] + place
                    starts = np.where(place == 0, x.at[t][which], commas[np.clip(edge - 1, 0, len(commas) - 1)]) + 1
                    stops = np.where(place == count[which] - 1, x.at[x.close[t]][which], commas[np.clip(edge, 0, len(commas) - 1)])
                emit(x.doc[t][which], path[t][which] + "/" + place.astype(str).astype(object), above[t][which], kinds[element], starts, stops)
    if not docs:
        return np.empty(0, np.int64), [np.empty(0, object)] * 4
    if alone:
        # the first list of records inside a record is its own, further ones lie inside that
        starts, stops = (np.concatenate([p[i] for p in spans]) for i in (0, 1))
        begin, end = (np.concatenate([p[i] for p in inner]) if inner else np.empty(0, np.int64) for i in (0, 1))
        order = np.argsort(begin)
        begin, end = np.append(begin[order], len(x.b) + 1), np.append(end[order], len(x.b) + 1)
        at = np.searchsorted(begin, starts)
        text = (x.text[a:b] + b"[]" + x.text[c:z] if b < z else x.text[a:z] for a, z, b, c in zip(starts, stops, begin[at], end[at], strict=True))
        out[3] = [np.fromiter((t.strip().decode("utf-8", "replace") for t in text), object, len(starts))]
    return np.concatenate(docs), [np.concatenate(c) if c else np.empty(0, object) for c in out]


def buffers(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are indexed together."""
    low = size = 0
    for high, raw in enumerate([*texts, None]):
        if high == len(texts) or (size and size + len(raw or b"") > BUFFER_BYTES):
            if high > low:
                yield low, high
            low, size = high, 0
        size += len(raw or b"")


def flatten_records(df: DataFrame, key: str, text: str, shape: dict[str, dict[str, str]] = PRODUCT_TREE_SHAPE, with_text: bool = True) -> DataFrame:
    """One row per listed record: the key, ``node_path`` (JSON pointer), ``parent_path``, ``node_kind`` and, if wanted, ``node_text``.

    ``parent_path`` is the pointer of the nearest listed record around it, "" if there is none.
    A narrow operation: rows never move between partitions.
    """
    source = df.select(F.col(key).alias("record_key"), F.col(text).cast("string").alias("record_text")).where(F.col("record_text").isNotNull())
    key_type = dict(source.dtypes)["record_key"]
    schema = f"`{key}` {key_type}, node_path string, parent_path string, node_kind string" + (", node_text string" if with_text else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for low, high in buffers(texts):
                which, columns = records(texts[low:high], shape, with_text)
                if len(which):
                    keys = batch.column(0).take(pa.array(which + low))
                    arrays = [pa.array(c, pa.string()) for c in columns[: 4 if with_text else 3]]
                    yield pa.RecordBatch.from_arrays([keys, *arrays], [key, "node_path", "parent_path", "node_kind", "node_text"][: 1 + len(arrays)])

    return source.mapInArrow(work, schema)
