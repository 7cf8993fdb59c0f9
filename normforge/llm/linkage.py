"""Matching product names to devices that share no key, by soft logic.

Which codes devices carry is read from the listings: the shapes of their type codes and article
numbers (digits, letters, places of separators) that at least ``SHARE`` of them have are looked for
in the names, whole or cut short, and codes of any other shape are looked for as they stand. Names
and devices so become type code, article number, loose codes, maker and family. Pairs become
candidates by equi-joins on a type code, a whole article number, a loose code, or the beginning of an
article number together with the family's number. For each candidate, weighted rules are grounded:

* the same type code, the same article number (or the part of it that is given), the same maker
  and the same family each speak for a match, and a different one against it (squared hinges);
* exclusivity: a name denotes one device, so the truth of matches with different devices sums to
  at most one (linear hinge);
* transitivity: listings of the same device are matched like the device (linear hinges).

The sum of these hinges is a convex problem, a hinge-loss Markov random field, solved by the
alternating direction method of multipliers until its residuals vanish. Names share no potential,
so the consensus falls apart by name and names are solved in parallel; what agrees on device and
evidence is exchangeable and shares one weighted variable, so a name's problem is as small as the
number of devices it may mean, however many listings these have. The truth value of a match, from
0 to 1, is its confidence.

Equal names and equal devices are each solved once and expanded afterwards. Codes are compared
with letters and digits that are misread for each other taken as one.

Defined results: names without a code, and null or empty names, match nothing; what a name merely
refers to (*replaces ...*, *not ...*, *compatible with ...*) is not what it denotes; pairs whose own
rules leave them below ``LEAST`` are false; repeated rows each match; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normforge.llm.canonical import words_of
from normforge.llm.names import Name, repaired, word_similarity
from normforge.session import stored

# How a name goes on when it refers to another device.
REFERS = re.compile(
    r"\b(?:ersetzt|ersatz f[uü]r|replaces|replacement for|replacing|remplace|compatible with|kompatibel (?:mit|zu)|compatible avec|instead of|anstelle|statt|not|nicht|sauf|except|pas|successor (?:of|to)|nachfolger|supersedes|see also|siehe)\b", re.I
)
#: Part of the listings that makes a shape of codes known, longest code whose shape is learnt, letters that a loose code has at least, and pieces between blanks at most.
SHARE, LONGEST, LOOSE, PIECES = 0.01, 24, 5, 4
#: Weights of the rules: type, article, part of an article, an article misread in a place or two beside the same type, maker, family; against a match: prior, type, article, maker, family; couplings.
FOR_TYPE, FOR_ARTICLE, FOR_PART, FOR_MISREAD, FOR_MAKER, FOR_FAMILY = 4.0, 5.0, 2.0, 1.0, 1.5, 1.5
PRIOR, NOT_CODE, NOT_MAKER, NOT_FAMILY = 1.2, 8.0, 2.0, 3.0
EXCLUSIVE, TRANSITIVE = 3.0, 1.0
#: Step size, most steps and residual at which the alternating directions end; confidence of a match, and truth by its own rules that a pair has at least.
RHO, STEPS, NEAR, SURE, LEAST = 2.0, 500, 1e-4, 0.5, 0.2
MISREAD = str.maketrans({"o": "0", "l": "1", "i": "1"})


def pattern(shape: str, least: int) -> str:
    """Regular expression of a shape that may end after ``least`` of its parts."""
    digit, letter, gap = "[0-9oli]", "[a-z]", "[-_.:/= ]?"
    parts = ["".join(digit if c == "D" else letter for c in part) for part in shape.split("/")]
    out = ""
    for k in range(len(parts) - 1, -1, -1):
        out = (gap if k else "") + parts[k] + out
        if k >= least:
            out = f"(?:{out})?"
    return out


SEPARATORS = re.compile(r"[-_.:/=\s]+")
#: What makes a code of few letters an article number rather than a word or a number.
MIXED = re.compile(r".*[a-z].*\d|.*\d.*[a-z]|\d{6,}", re.S)
#: What a text has that holds a loose code.
HINT = re.compile(r"[a-z][-_.:/=]?\d|\d[-_.:/= ]?[a-z]{1,4}[-_.:/= ]?\d|\d[a-z]|\d[-_.:/=][a-z0-9]|\d{6}|\d \d", re.I)
#: Pieces that may be one code: joined by separators, or by a blank where both have digits.
RUN = re.compile(r"[a-z0-9]+(?:(?:[-_.:/=]|(?<=[0-9]) (?=[a-z]{0,4}[0-9])|(?<=[0-9][a-z]) (?=[a-z]{0,4}[0-9]))[a-z0-9]+)*", re.I)


def code(text: str) -> str:
    return SEPARATORS.sub("", text).lower().translate(MISREAD)


def codelike(text: str) -> bool:
    """Whether a text as written can be a code of unknown shape: letters and at least two digits, or many digits."""
    plain = SEPARATORS.sub("", text).lower()
    return len(plain) >= LOOSE and sum(c.isdigit() for c in plain) >= 2 and bool(MIXED.match(plain))


def runs(text: str) -> Iterator[str]:
    """Up to PIECES neighbours of what stands between blanks."""
    parts = text.split(" ")
    for i in range(len(parts)):
        for n in range(1, min(PIECES, len(parts) - i) + 1):
            yield " ".join(parts[i : i + n])


class Shapes:
    """Patterns of the codes that listings have. Shapes are written with D a digit, A a letter, / where a separator may stand."""

    def __init__(self, types: tuple[str, ...], articles: tuple[str, ...]):
        never = "(?!)"
        of_types = "|".join(f"(?:{pattern(s, s.count('/') + 1)})" for s in sorted(types, key=len, reverse=True)) or never
        self.type = re.compile(rf"(?<![a-z0-9])(?:{of_types})(?![a-z0-9])", re.I)
        self.type_part = re.compile(f"(?:{'|'.join(f'(?:{pattern(s, 1)})' for s in types) or never})", re.I)
        self.article = re.compile(rf"(?<![a-z0-9])(?:{'|'.join(f'(?:{pattern(s, 1)})' for s in articles) or never})(?![a-z0-9])", re.I)
        self.each = [re.compile(rf"{pattern(s, 1)}(?![a-z0-9])", re.I) for s in articles]

    def articles(self, text: str) -> Iterator[str]:
        """Article numbers in a text, whole or cut short; at each place the longest that any shape allows."""
        at = 0
        while m := self.article.search(text, at):
            at = max(x.end() for s in self.each if (x := s.match(text, m.start())))
            yield text[m.start() : at]

    def mention(self, name: str | None) -> tuple[str, str, str]:
        """(type code, article number, loose codes) that a product name denotes, "" where it has none."""
        text = repaired(name or "")
        refers = REFERS.search(text)
        text = text[: refers.start()] if refers else text
        kind = article = where = ""
        for m in self.type.finditer(text):
            if sum(c.isdigit() for c in m.group()) >= 3:
                kind = code(m.group())
                text = text[: m.start()] + " | " + text[m.end() :]
                break
        for written in self.articles(text):
            found = code(written)
            if len(found) >= 4 and MIXED.match(found) and len(found) > len(article):
                article, where = found, written
        if where:
            text = text.replace(where, " | ")
        loose = set() if not HINT.search(text) else {code(run) for m in RUN.finditer(text) for run in runs(m.group()) if codelike(run)}
        return kind, article, " ".join(sorted(loose))

    def listing(self, kind: str | None, article: str | None) -> tuple[str, str, bool]:
        """(type code, article number, whether a shape is unknown) of a listed device; words are no codes."""
        k, a = (kind or "").strip().rstrip("-_.:/="), (article or "").strip()
        known_kind, known_article = bool(self.type.fullmatch(k)), bool(self.article.fullmatch(a))
        # a type code cut short says no more than a word
        k = code(k) if known_kind or (codelike(k) and not self.type_part.fullmatch(k)) else ""
        a = code(a) if known_article or codelike(a) else ""
        return k, a, bool((k and not known_kind) or (a and not known_article))


def shape(column: Column) -> Column:
    """Shape of a code as it is written."""
    letters = string.ascii_letters
    classes = F.translate(F.trim(column), string.digits + letters + "-_.:=\t ", "D" * 10 + "A" * len(letters) + "/" * 7)
    return F.regexp_replace(classes, "//+", "/")


def learnt(devices: DataFrame, columns: tuple[str, str]) -> Shapes:
    """Shapes that at least SHARE of the listings' codes have in each of the two columns, at most 1 / SHARE of each."""
    shapes = devices.select(F.posexplode(F.array(*[shape(F.col(c)) for c in columns])).alias("column", "s")).where("s is not null")
    # words, and codes with letters beyond the Latin ones, have no shape to learn
    coded = (F.translate("s", "AD/", "") == "") & F.col("s").contains("D") & (F.length("s") <= LONGEST)
    counted = shapes.groupBy("column", "s").agg(F.count(F.lit(1)).alias("n")).where(coded)
    counted = stored(counted.groupBy("column", F.trim("s", F.lit("/")).alias("s")).agg(F.sum("n").alias("n")))
    all_of = {r.column: r.n for r in counted.groupBy("column").agg(F.sum("n").alias("n")).collect()}  # two rows
    # of the ways to write a code, the most frequent one with separators
    joined = counted.groupBy("column", F.translate("s", "/", "").alias("letters")).agg(F.sum("n").alias("n"), F.max_by("s", F.struct(F.when(F.col("s").contains("/"), F.col("n")).otherwise(0), "s")).alias("s"))
    often = F.lit(False)
    for column, n in all_of.items():
        often = often | ((F.col("column") == column) & (F.col("n") >= SHARE * n))
    found = joined.where(often).select("column", "s", "n").collect()
    # what begins a more frequent shape is a code cut short
    whole = [r for r in found if not any(o.column == r.column and o.s != r.s and o.s.startswith(r.s) and (o.s[len(r.s)] == "/" or "/" not in o.s) and o.n > r.n for o in found)]
    return Shapes(*[tuple(sorted(r.s for r in whole if r.column == column)) for column in (0, 1)])


def whole_article(article: str) -> bool:
    return len(article) >= 9


@functools.lru_cache(100_000)
def maker_words(text: str | None) -> tuple[tuple[str, ...], tuple[bool, ...], bool]:
    name = Name(text)
    return tuple(name.words), tuple(name.short), name.host


@functools.lru_cache(200_000)
def same_maker(a: str | None, b: str | None) -> float:
    """1 the same, 0 another, -1 can't tell."""
    (x, xs, _), (y, ys, _) = maker_words(a), maker_words(b)
    if not x or not y:
        return -1.0
    for p, q in ((x, y), (y, x)):
        if len(p) == 1:
            joined = p[0]
            if len(joined) >= 8 and word_similarity(joined, "".join(q)) > 0.7:
                return 1.0
            if len(joined) <= 5 and not any(w.startswith(joined) for w in q):
                return -1.0  # an acronym
    hits = sum(max((word_similarity(w, v, s, t) for v, t in zip(y, ys, strict=True)), default=0.0) >= 0.7 for w, s in zip(x, xs, strict=True))
    return 1.0 if hits >= min(len(x), len(y)) else 0.5 if hits and max(len(x), len(y)) > 2 else 0.0


@functools.lru_cache(200_000)
def family_words(text: str | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words and numbers of a family."""
    words = [w for w, _ in words_of(text or "", "family")]
    return tuple(w for w in words if not w.isdigit() and len(w) > 1), tuple(w for w in words if w.isdigit() and len(w) in (3, 4))


@functools.lru_cache(200_000)
def same_family(a: str | None, b: str | None) -> float:
    (x, m), (y, n) = family_words(a), family_words(b)
    if not x or not y or not m or not n:
        return -1.0
    alike = any(word_similarity(w, v, True, True) >= 0.7 for w in x for v in y)
    return 1.0 if alike and set(m) & set(n) else 0.0


def near(a: str, b: str) -> bool:
    """Whether two articles may be one that was misread in a place or two."""
    return sum(x != y for x, y in zip(a, b, strict=False)) <= (2 if len(a) == len(b) else 1)


def evidence(p: tuple, q: tuple) -> tuple[float, float, str]:
    """Weights for and against a match of a name (type, article, loose codes, name, family, other family, maker, other maker) and a device (type, article, family, maker), and the article by which the device is told from others."""
    (kind, article, loose, name, family, family2, maker, maker2), (d_kind, d_article, d_family, d_maker) = p, q
    yes, no, told = 0.0, PRIOR, d_article
    others = loose.split(" ") if loose else ()
    if d_kind and (kind == d_kind or d_kind in others):
        yes += FOR_TYPE
    elif kind and d_kind and not kind.startswith(d_kind):
        no += NOT_CODE
    if d_article and d_article in others:
        yes += FOR_ARTICLE
    elif article and d_article:
        if article == d_article:
            yes += FOR_ARTICLE if whole_article(article) else FOR_PART
        elif (article.startswith(d_article) or d_article.startswith(article)) and not (whole_article(article) and whole_article(d_article)):
            yes += FOR_PART
            told = max(article, d_article, key=len)
        elif kind and kind == d_kind and near(article, d_article):
            yes += FOR_MISREAD
            told = article
        else:
            no += NOT_CODE
    by_maker = most((maker, maker2), d_maker, same_maker)
    by_family = most((family, family2, name), d_family, same_family)
    if by_maker >= 0:
        yes, no = yes + FOR_MAKER * by_maker, no + NOT_MAKER * (1 - by_maker)
    if by_family >= 0:
        yes, no = yes + FOR_FAMILY * by_family, no + NOT_FAMILY * (1 - by_family)
    return yes, no, told or article


def most(texts: tuple[str | None, ...], other: str | None, same) -> float:
    """The greatest likeness, -1 if none can be told."""
    top = -1.0
    for text in texts:
        if top < 1.0:
            top = max(top, same(text, other))
    return top


def solve(block: np.ndarray, device: np.ndarray, size: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """Truth of each candidate variable, which stands for ``size`` listings. block: its name; device: what tells its device from others of the block; both sorted by (block, device).

    Alternating directions over three groups of potentials, each with its own copy of the
    variables: the evidence, exclusivity per block, and transitivity between a variable and its device.
    A device's listings stand for it by their mean.
    """
    if not len(block):
        return np.zeros(0)
    new_block = np.r_[True, block[1:] != block[:-1]]
    starts, of = np.flatnonzero(new_block), np.cumsum(new_block) - 1
    group = np.cumsum(new_block | np.r_[True, device[1:] != device[:-1]]) - 1
    share = size / np.bincount(group, size)[group]
    norm = np.add.reduceat(share**2, starts)
    members = np.bincount(group)
    y = yes / (yes + no)
    whole = np.bincount(group, y * share)
    u1, u2, u3, u4 = np.zeros((4, len(y)))
    for _ in range(STEPS):
        x1 = (2 * share * yes + RHO * (y - u1)) / (2 * share * (yes + no) + RHO)
        v = y - u2
        over = np.add.reduceat(v * share, starts) - 1
        x2 = v - np.clip(over / norm, 0, EXCLUSIVE / RHO)[of] * share
        a, b = y - u3, whole[group] - u4
        move = np.clip((a - b) / 2, -TRANSITIVE * share / RHO, TRANSITIVE * share / RHO)
        x3, x4 = a - move, b + move
        before, whole_before = y, whole
        y = np.clip((x1 + u1 + x2 + u2 + x3 + u3) / 3, 0.0, 1.0)
        whole = np.bincount(group, x4 + u4) / members
        u1, u2, u3, u4 = u1 + x1 - y, u2 + x2 - y, u3 + x3 - y, u4 + x4 - whole[group]
        primal = max(np.abs(x1 - y).max(), np.abs(x2 - y).max(), np.abs(x3 - y).max(), np.abs(x4 - whole[group]).max())
        if primal < NEAR and RHO * max(np.abs(y - before).max(), np.abs(whole - whole_before).max()) < NEAR:
            break
    return y


def told_apart(found: list[tuple[str, str, int]]) -> list[str]:
    """Device of each (type code, article, listings) of a name: an article that is missing, cut short or misread is that of the device of its type with most listings that it can be."""
    out = []
    for kind, article, _ in found:
        same = [(n, a) for k, a, n in found if a and (k == kind or not k or not kind) and (a == article or (not article) or (len(a) > len(article) and a.startswith(article)) or (len(a) == len(article) and near(a, article)))]
        out.append(max(same)[1] if same else kind)
    return out


NAME_TEXTS, DEVICE_TEXTS = ["name", "family", "family2", "maker", "maker2"], ["family", "maker"]


def read_names(df: DataFrame, key: str, columns: dict[str, str], shapes: Shapes) -> DataFrame:
    """(row_key, m, kind, article, loose, texts) of each row that names a device, stored; m numbers equal namings."""
    source = df.select(F.col(key).alias("row_key"), *[F.col(columns[t]).cast("string").alias(t) for t in NAME_TEXTS]).where("name is not null and name != ''").withColumn("m", F.xxhash64(*NAME_TEXTS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mention = functools.lru_cache(100_000)(shapes.mention)
        for batch in batches:
            found = [mention(n) for n in batch.column(1).to_pylist()]
            read = [pa.array([f[i] for f in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *read], ["row_key", *NAME_TEXTS, "m", "kind", "article", "loose"]).filter(pa.array([any(f) for f in found], pa.bool_()))

    key_type = dict(source.dtypes)["row_key"]
    return stored(source.mapInArrow(work, f"row_key {key_type}, " + ", ".join(f"{t} string" for t in NAME_TEXTS) + ", m long, kind string, article string, loose string"))


def read_devices(df: DataFrame, key: str, columns: dict[str, str], shapes: Shapes) -> DataFrame:
    """(device_key, d, kind, article, odd, texts) of each device with a code, stored; d numbers equal listings."""
    texts = ["type", "number", *DEVICE_TEXTS]
    source = df.select(F.col(key).alias("device_key"), *[F.col(columns[t]).cast("string").alias(t) for t in texts]).withColumn("d", F.xxhash64(*texts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shapes.listing(k, a) for k, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            read = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], *read], ["device_key", *DEVICE_TEXTS, "d", "kind", "article", "odd"]).filter(pa.array([bool(f[0] or f[1]) for f in found], pa.bool_()))

    key_type = dict(source.dtypes)["device_key"]
    return stored(source.mapInArrow(work, f"device_key {key_type}, " + ", ".join(f"{t} string" for t in DEVICE_TEXTS) + ", d long, kind string, article string, odd boolean"))


def typed(names: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fills in the type code of namings (m) and listings (d) that only have an article number which occurs with just one type code anywhere."""
    seen = names.select("article", "kind").union(devices.select("article", "kind")).where("kind != '' and length(article) >= 9")
    one = seen.groupBy("article").agg(F.min("kind").alias("low"), F.max("kind").alias("high")).where("low = high").select("article", F.col("low").alias("known"))

    def filled(df: DataFrame) -> DataFrame:
        bare = df.where("kind = ''").join(one, "article", "left").withColumn("kind", F.coalesce("known", "kind")).drop("known")
        return df.where("kind != ''").unionByName(bare)

    return stored(filled(names)), stored(filled(devices))


def _numbers(*columns: str) -> Column:
    """Numbers of three or four digits in some texts, as families have."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.translate(F.lower(F.coalesce(F.col(c), F.lit(""))), "oli", "011"), F.lit(r"(?<![0-9])([0-9]{3,4})(?![0-9])"), 1) for c in columns])))


def candidates(names: DataFrame, devices: DataFrame, m: DataFrame, d: DataFrame) -> DataFrame:
    """(m, d) of namings and listings that share a type code, a whole article, a loose code, or the beginning of an article and the family's number."""

    def by_code(df: DataFrame, key: str, column: str, tag: str, least: int = 1) -> DataFrame:
        return df.where(F.length(column) >= least).select(key, F.xxhash64(F.lit(tag), F.col(column)).alias("h"))

    def by_start(df: DataFrame, key: str, *families: str) -> DataFrame:
        return df.where(F.length("article") >= 4).select(key, F.explode(_numbers(*families)).alias("number"), F.substring("article", 1, 4).alias("start")).select(key, F.xxhash64("start", "number").alias("h"))

    name_keys = by_code(m, "m", "kind", "t").unionByName(by_code(m, "m", "article", "a", 9))
    device_keys = by_code(d, "d", "kind", "t").unionByName(by_code(d, "d", "article", "a", 9))
    # codes whose shape isn't known stand in names as loose codes
    loose = names.where("loose != ''").select("m", F.explode(F.split("loose", " ")).alias("x")).select("m", F.xxhash64(F.lit("x"), F.col("x")).alias("h"))
    odd = devices.where("odd").select("d", F.explode(F.array("kind", "article")).alias("x")).where(F.length("x") >= LOOSE).select("d", F.xxhash64(F.lit("x"), F.col("x")).alias("h"))
    # a part of an article alone is weak, so it counts only where the name has no type code
    part = by_start(names.where("kind = '' and article != '' and length(article) < 9"), "m", "name", "family", "family2")
    begun = by_start(devices, "d", "family")
    met = name_keys.join(device_keys, "h").select("m", "d").unionByName(loose.join(odd, "h").select("m", "d")).unionByName(part.join(begun, "h").select("m", "d"))
    return stored(met.distinct())


def matches(names: DataFrame, devices: DataFrame) -> DataFrame:
    """(m, d, confidence) of every match between distinct namings (m, kind, article, loose, texts) and listings (d, kind, article, odd, texts)."""
    m, d = typed(names.select("m", "kind", "article").distinct(), devices.select("d", "kind", "article").distinct())
    met = candidates(names, devices, m, d)
    # only what met needs its texts, and each distinct text once
    texts = names.join(met.select("m").distinct(), "m", "left_semi").select("m", "loose", *NAME_TEXTS).dropDuplicates(["m"]).join(m, "m")
    listed = devices.join(met.select("d").distinct(), "d", "left_semi").select("d", *DEVICE_TEXTS).dropDuplicates(["d"]).join(d, "d")
    listed = listed.select("d", *[F.col(c).alias(f"d_{c}") for c in ("kind", "article", *DEVICE_TEXTS)])
    fields = ["kind", "article", "loose", *NAME_TEXTS]
    pairs = met.join(listed, "d").join(texts, "m").select("m", "d", *fields, "d_kind", "d_article", "d_family", "d_maker")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[2:]]
            split = len(fields)
            found = [evidence(row[:split], row[split:]) for row in zip(*columns, strict=True)]
            device = [f"{k or p}/{f[2]}" for p, k, f in zip(columns[0], columns[split], found, strict=True)]
            table = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(device, pa.string()), pa.array([f[0] for f in found], pa.float32()), pa.array([f[1] for f in found], pa.float32())], ["m", "d", "device", "yes", "no"])
            yield table.filter(pa.array([f[0] >= LEAST * (f[0] + f[1]) for f in found], pa.bool_()))

    weighed = stored(pairs.mapInArrow(weigh, "m long, d long, device string, yes float, no float"))
    counted = weighed.groupBy("m", "device", "yes", "no").agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.groupBy("m").agg(F.collect_list(F.struct("device", "yes", "no", "n")).alias("found"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, found in enumerate(batch.column(1).to_pylist()):
                split = [(*x["device"].split("/", 1), x["n"]) for x in found]
                rows += [(at, told, x["device"], x["yes"], x["no"], x["n"]) for x, told in zip(found, told_apart(split), strict=True)]
            rows.sort(key=lambda r: (r[0], r[1], r[2], r[3], r[4]))
            block, told, device, yes, no, n = (np.array(c) for c in zip(*rows, strict=True)) if rows else [np.zeros(0)] * 6
            truth = solve(block, told, n, yes, no)
            sure = np.flatnonzero(truth >= SURE)
            take = pa.array(block[sure].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(device[sure].tolist(), pa.string()), pa.array(yes[sure], pa.float32()), pa.array(no[sure], pa.float32()), pa.array(truth[sure], pa.float64())],
                ["m", "device", "yes", "no", "confidence"],
            )

    truths = blocks.mapInArrow(settle, "m long, device string, yes float, no float, confidence double")
    return weighed.join(truths, ["m", "device", "yes", "no"]).select("m", "d", "confidence")


def linked(names: DataFrame, name_key: str, name_columns: dict[str, str], devices: DataFrame, device_key: str, device_columns: dict[str, str]) -> DataFrame:
    """(name key, device key, confidence) of every row pair that is one device.

    name_columns: name, family, family2, maker, maker2; device_columns: type, number, family, maker.
    """
    shapes = learnt(devices, (device_columns["type"], device_columns["number"]))
    rows, listed = read_names(names, name_key, name_columns, shapes), read_devices(devices, device_key, device_columns, shapes)
    found = matches(rows, listed)
    return found.join(rows.select("row_key", "m"), "m").join(listed.select("device_key", "d"), "d").select(F.col("row_key").alias(name_key), F.col("device_key").alias(device_key), "confidence")
