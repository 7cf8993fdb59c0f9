"""Several values packed in one field, split by the dialect that describes the data in the fewest bits.

A dialect says which delimiters separate values in a field and whether its values are quoted. Each
field is parsed under every dialect its own characters allow, each parse is priced with code
lengths learnt from all fields, and the cheapest parse is kept. A value costs the lesser of the
code of a value seen elsewhere, ``log2(N / count)``, and the code of its words, where a word that
rarely opens a field is dear as the opening word of a value; a delimiter left inside a value costs
its literal bits. Connectors such as ``&`` and ``and`` first become part of a value where the words
around them go together elsewhere (as in *Power & Light*).

The counts are distributed aggregates over all fields, looked up by joins on key hashes; no
dictionary is collected or broadcast. All work is done once per distinct field text.

Defined results: null, empty and one-valued fields give no rows; empty pieces are neither listed
nor counted; enclosing quotes, blanks and numbering are taken off, nothing else is changed; text in
round brackets is never split; a piece that is only a legal form belongs to the piece before it;
repeated rows each give their own rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal forms that belong to the name before them.
LEGAL_FORMS = [
    "AB", "AG", "ApS", "A/S", "AS", "B.V.", "BV", "Co", "Co.", "Co. KG", "Co KG", "Company", "Corp", "Corp.", "Corporation", "GmbH", "GmbH & Co. KG",
    "GmbH & Co KG", "Inc", "Inc.", "Incorporated", "KG", "KGaA", "Limited", "LLC", "LLP", "Ltd", "Ltd.", "N.V.", "NV", "OHG", "Oy", "Oyj", "PLC", "Pty Ltd",
    "Pty Ltd.", "Pty. Ltd.", "S.A.", "S.A.S.", "S.p.A.", "S.r.l.", "SA", "SARL", "SAS", "SE", "SpA", "Srl", "UG",
]
# Words that join the last value to those before it.
CONNECTORS = ["and", "et", "sowie", "und"]

#: Bits that a delimiter costs when it stands inside a value; the others never do.
INSIDE_BITS = {",": 9.0, "/": 4.0, "+": 9.0, "&": 3.0, "word": 3.0}
ALWAYS = {";": ";", "|": "|", "\t": "tab", "\n": "line", "\r": "line"}
#: Bits of each further value, and of the opening of a value by a word never seen to open a field; and bits that a value of one letter costs on top.
VALUE_BITS, UNSEEN, LONE_LETTER = 2.0, 0.25, 12.0

_WORDS = "|".join(CONNECTORS)
_LEGAL = "|".join(re.escape(f) for f in sorted(LEGAL_FORMS, key=len, reverse=True))
LEGAL_NEXT = re.compile(rf"\s*(?:{_LEGAL})\.?(?=\s*(?:$|[;|\t\n\r,/+&\])\"']|\((?!\d)|\(?\d{{1,3}}[.)]\s|(?:{_WORDS})\s))", re.I)
LEGAL_TAIL = re.compile(rf"(?:[\s,]+(?:{_LEGAL}))+\.?\s*$", re.I)
LEGAL_HEAD = re.compile(rf"^\s*(?:{_LEGAL})\.?\s+", re.I)
SPECIAL = re.compile(rf"[;|\t\n\r,/\"'(]|(?:(?<=\s)|^)[+&](?=\s|$)|(?<=\s)(?:{_WORDS})(?=\s)", re.I)
NUMBER = re.compile(r"(?:^|(?<=[\s;,|/]))(?:\((\d{1,3})\)|(\d{1,3})[.)])\s+")
REMARK = re.compile(r"\([^()]*\)")
WORD_GAPS = re.compile(r"[\s,/+&]+")
BLANKS = re.compile(r"[\s​]+")
ODD_BLANKS = {0x200B: " ", 0xA0: " "}
#: Text that can hold more than one value; everything else is one value for sure.
CANDIDATE = r"(?i)[;|\t\n\r,/\"\[]|\s[+&]\s|\s(?:" + _WORDS + r")\s|(?:^|[\s])\(?\d{1,3}[.)]\s"


def normal(text: str) -> str:
    """What of a value is compared: lower case, without remarks, legal forms and odd blanks."""
    text = LEGAL_TAIL.sub("", REMARK.sub(" ", text.translate(ODD_BLANKS)))
    return BLANKS.sub(" ", LEGAL_HEAD.sub("", text)).strip(" .,;|/\"'[]").lower()


def keys_of(text: str) -> list[str]:
    """Keys under which a field is counted: the value, its words, its opening word, and words around connectors."""
    value = normal(text)
    words = value.split(" ")
    out = ["v" + value, "i" + words[0]]
    for k, word in enumerate(words):
        if word in ("&", "+") or word in CONNECTORS:
            if 0 < k < len(words) - 1:
                left, right = words[k - 1].strip(",\"'"), words[k + 1].strip(",\"'")
                out += [f"g{left} {right}", "l" + left, "r" + right]
        elif word:
            out.append("t" + word.strip(",;|/\"'"))
    return out


class Field:
    """The pieces of a field between its possible delimiters."""

    __slots__ = ("atoms", "gaps", "numbered")

    def __init__(self, text: str):
        body = text.strip()
        if body.startswith("[") and body.endswith("]"):
            body = body[1:-1]
        cuts = []  # (start, end, class)
        masked = REMARK.sub(lambda m: m.group() if m.group()[1:-1].isdigit() else "(" + "x" * (len(m.group()) - 2) + ")", body)
        numbers = [(m.start(), m.end(), int(m.group(1) or m.group(2))) for m in NUMBER.finditer(masked)]
        self.numbered = len(numbers) > 1 and not body[: numbers[0][0]].strip() and [n for _, _, n in numbers] == list(range(1, len(numbers) + 1))
        spans = [(a, z) for a, z, _ in numbers] if self.numbered else []
        if self.numbered:
            cuts += [(a, z, "number") for a, z in spans]
        at, start = 0, 0
        while m := SPECIAL.search(body, at):
            a, z, c = m.start(), m.end(), m.group()
            inside = next((e for b, e in spans if b <= a < e), None)
            if inside is not None:
                at = start = inside
                continue
            if c in "\"'":
                if not body[start:a].strip():
                    end = body.find(c, z)
                    after = body[end + 1 :].lstrip(" ")[:1] if end > 0 else "x"
                    if end > 0 and (after == "" or after in ";|\t\n\r,/+&(" or SPECIAL.match(body, end + 2)):
                        at = end + 1
                        start = at
                        continue
                at = z
            elif c == "(":
                end = body.find(")", z)
                at = end + 1 if end > 0 else z
            else:
                kind = ALWAYS.get(c) or (c if c in INSIDE_BITS else "word")
                legal = LEGAL_NEXT.match(body, z) if kind in (",", "&", "/") else None
                if legal:
                    at = legal.end()
                else:
                    cuts.append((a, z, kind))
                    at = start = z
        cuts.sort()
        self.atoms, self.gaps, low = [], [], 0
        for a, z, kind in cuts:
            self.atoms.append(body[low:a])
            self.gaps.append((kind, body[a:z]))
            low = z
        self.atoms.append(body[low:])

    def glue(self) -> list[tuple[int, str, str]]:
        """Gaps at connectors with the words on either side."""
        out = []
        for i, (kind, _) in enumerate(self.gaps):
            if kind in ("&", "word", "+"):
                left, right = normal(self.atoms[i]).split(" ")[-1], normal(self.atoms[i + 1]).split(" ")[0]
                if left and right:
                    out.append((i, left, right))
        return out

    def glued(self, which: set[int]) -> None:
        """Makes the gaps part of the values around them."""
        atoms, gaps = [self.atoms[0]], []
        for i, gap in enumerate(self.gaps):
            if i in which:
                atoms[-1] += gap[1] + self.atoms[i + 1]
            else:
                gaps.append(gap)
                atoms.append(self.atoms[i + 1])
        self.atoms, self.gaps = atoms, gaps

    def optional(self) -> list[str]:
        return sorted({k for k, _ in self.gaps if k in INSIDE_BITS})

    def parse(self, off: frozenset[str]) -> list[str]:
        """Values under the dialect that has the delimiters ``off`` inside values."""
        out = [self.atoms[0]]
        for (kind, text), atom in zip(self.gaps, self.atoms[1:], strict=True):
            if kind in off:
                out[-1] += text + atom
            else:
                out.append(atom)
        return [v for v in map(clean, out) if v]

    def dialects(self) -> list[frozenset[str]]:
        kinds = self.optional()
        return [frozenset(c) for n in range(len(kinds) + 1) for c in combinations(kinds, n)]


def clean(piece: str) -> str:
    """A piece without surrounding blanks, numbering, stray delimiters and enclosing quotes."""
    piece = piece.strip(" \t\r\n​\xa0")
    if len(piece) > 1 and piece[0] in "\"'" and piece[-1] == piece[0]:
        piece = piece[1:-1].strip(" \t\r\n​\xa0")
    return "" if not re.search(r"\w", piece) else piece


def lookups(field: Field) -> list[str]:
    """Keys whose counts the choice needs, in a fixed order without repeats."""
    keys: dict[str, None] = {}
    for _, left, right in field.glue():
        keys.update(dict.fromkeys([f"g{left} {right}", "l" + left, "r" + right, "t" + left, "t" + right]))
    for off in field.dialects():
        for piece in field.parse(off):
            value = normal(piece)
            word = value.split(" ")[0]
            keys.update(dict.fromkeys(["v" + value, "i" + word, "t" + word]))
    return list(keys)


def choose(field: Field, own: int, counts: dict[str, int], total: int) -> list[str]:
    """Values of the field under its cheapest dialect. own: rows that hold just this field text."""
    stuck = set()
    for i, left, right in field.glue():
        together = counts.get(f"g{left} {right}", 0) - own
        of_left, of_right = counts.get("t" + left, 0) - own, counts.get("t" + right, 0) - own
        before, after = counts.get("l" + left, 0) - own, counts.get("r" + right, 0) - own
        known_both = of_left > 2 * own + 2 and of_right > 2 * own + 2
        if (together >= 2 and together > 0.1 * min(of_left, of_right)) or (not known_both and (before > 0.5 * max(of_left, 2) or after > 0.5 * max(of_right, 2))):
            stuck.add(i)
    if stuck:
        field.glued(stuck)
    best, best_bits = [], math.inf
    scale = math.log2(max(total, 2))
    for off in field.dialects():
        bits = sum(INSIDE_BITS[k] for k, _ in field.gaps if k in off)
        values = field.parse(off)
        for value in values:
            key = normal(value)
            words = WORD_GAPS.split(key)
            seen = counts.get("v" + key, 0)
            if off and (seen <= 3 * own + 2 or len(words) == 1 and "/" not in key):
                seen = 0
            opens, all_of = counts.get("i" + words[0], 0), counts.get("t" + words[0], 0)
            rare = -math.log2((opens + UNSEEN) / (all_of + 1)) if all_of > own else 2.0
            by_words = scale * len(words) * 0.6 + max(0.0, rare)
            bits += VALUE_BITS + (LONE_LETTER if len(key) == 1 else 0.0) + min(by_words, scale - math.log2(seen) if seen > 0 else math.inf)
        if bits < best_bits - 1e-9:
            best, best_bits = values, bits
    return best


def unpacked(df: DataFrame, key: str, fields: list[str], least: int = 2) -> DataFrame:
    """One row per value of each field that holds at least ``least`` values: the key, ``field_name``, ``value_pos`` from 1, ``vendor_value``."""
    cells = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("cell")) for f in fields])).alias("x")).select(key, "x.field_name", "x.cell")
    cells = cells.where("cell is not null and cell != ''")
    texts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("own"))
    parsed = split_texts(texts).where(F.size("values") >= least)
    rows = cells.where(F.col("cell").rlike(CANDIDATE)).join(parsed, "cell")
    return rows.select(key, "field_name", F.posexplode("values").alias("p", "vendor_value")).select(key, "field_name", (F.col("p") + 1).cast("int").alias("value_pos"), "vendor_value")


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def split_texts(texts: DataFrame) -> DataFrame:
    """(cell, values) of each distinct text (cell, own) that may hold several values."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, int] = {}
            for cell, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in keys_of(cell):
                    sums[k] = sums.get(k, 0) + own
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["k", "n"])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [lookups(Field(c)) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.string()))], ["cell", "own", "keys"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for cell, own, total, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                field = Field(cell)
                keys = lookups(field)
                values.append(choose(field, own, {keys[p]: n for p, n in zip(places, counts, strict=True)}, total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.string()))], ["cell", "values"])

    counts = texts.mapInArrow(counted, "k string, n long").groupBy(key_hash(F.col("k")).alias("h")).agg(F.sum("n").alias("n"))
    asked = texts.where(F.col("cell").rlike(CANDIDATE)).mapInArrow(needed, "cell string, own long, keys array<string>")
    asked = asked.select("cell", "own", F.posexplode(F.transform("keys", key_hash)).alias("p", "h"))
    met = asked.join(counts, "h", "left").groupBy("cell", "own").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("p", "n"))).alias("met"))
    total = texts.agg(F.sum("own").alias("total"))  # one row
    ready = met.join(F.broadcast(total)).select("cell", "own", "total", F.col("met.p").alias("p"), F.col("met.n").alias("n"))
    return ready.mapInArrow(chosen, "cell string, values array<string>")
