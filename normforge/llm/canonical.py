"""Mapping freely typed values to the entries of a reference list.

Every distinct word of the values is repaired once: it is joined by edit distance to the words of
the reference list, its abbreviations and run-together names. A value is then scored against each
entry that shares a repaired word by soft TF-IDF, where generic words (legal forms, lines of
business, regions) weigh little and words found nowhere in the list weigh most, so that a name that
merely shares a word with an entry stays apart.

An entry of a name is also known by its short name and by its words run together, each a word of its own. Of a
family, numbers must all be given, and words that stand beside a family don't count against it.

The index of a reference list is broadcast for at most about ``INDEX_ROWS`` entries; a longer list
is cut into such blocks by hash. The weights of words are those of the whole list, the repairs of a
word are gathered from all blocks, every value is scored against every block, and the best entry of
all blocks is taken, so that blocks change nothing but the size of a broadcast.

Defined results: values equal to a listed name, null and empty values, and values said to hold
several names give no rows; every other value gives one row, with id 0 if it means no entry. On
ties the entry that shares more generic words wins, then the smaller id. Repeated rows each give
their own row; an empty reference list maps every value to 0.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normforge.llm.names import GENERIC, Name, budget, folded, osa, repaired, shortened
from normforge.session import stored

#: Entries up to which the reference list is broadcast as an index.
INDEX_ROWS = 50_000
#: Weight of generic words, and the least score of a match.
GENERIC_WEIGHT, LEAST = 0.12, 0.745
NUMBER = re.compile(r"^(\d+)$")
GLUED_NUMBER = re.compile(r"^([a-z]{3,}?)([0-9][0-9o]{1,4}|[0-9o]*[0-9][0-9o]*)$")
FAMILY_FILLER = frozenset("series serie familie family fam line devices device the gruppe gamme baureihe".split())


def words_of(text: str, kind: str) -> list[tuple[str, bool]]:
    """(word, written as an abbreviation) of a value; numbers are kept whole."""
    if kind == "name":
        name = Name(text)
        out = list(zip(name.words, name.short, strict=True))
        return out + [(g, False) for g in name.generic]
    out = []
    for piece in re.split(r"[\s,;/\\|_\-\"()\[\]]+", repaired(text).strip()):
        low = folded(piece).strip(":'")
        dotted, low = low.endswith("."), low.strip(".")
        if not low or low in FAMILY_FILLER:
            continue
        glued = GLUED_NUMBER.match(low)
        if glued and not low.isdigit():
            out += [(glued.group(1), False), (glued.group(2).replace("o", "0"), False)]
        elif re.fullmatch(r"[0-9o]*[0-9][0-9o]*", low):
            out.append((low.replace("o", "0"), False))
        else:
            out.append((low, dotted))
    return out


def readings(text: str, short: str | None, kind: str) -> list[list[str]]:
    """Words of an entry, then its other names, each one word."""
    if kind != "name":
        return [[w for w, _ in words_of(text, kind)]]
    name = Name(text)
    words = name.words or name.generic
    others = ["".join(words), "".join(reversed(words))] if len(words) > 1 else []
    return [words, *([w] for w in dict.fromkeys([*others, *([folded(short)] if short else [])]) if [w] != words)]


class Index:
    """A block of a reference list by its words.

    entries: (id, name, short name). weights: idf of the words of the block, if it isn't the whole list.
    """

    def __init__(self, entries: list[tuple[int, str, str | None]], kind: str, weights: dict[str, float] | None = None, total: int | None = None):
        self.kind = kind
        self.words: list[list[str]] = []  # of each reading
        self.ids: list[int] = []
        self.generic: list[set[str]] = []
        self.posting: dict[str, list[int]] = defaultdict(list)
        self.own: set[str] = set()  # words of names as they are listed
        for entry, text, short in entries:
            generic = set(Name(text).generic) if kind == "name" else set()
            for k, words in enumerate(readings(text, short, kind)):
                for w in set(words):
                    self.posting[w].append(len(self.words))
                self.words.append(words)
                self.ids.append(entry)
                self.generic.append(generic)
                if k == 0:
                    self.own.update(words)
        n = max(len(entries) if total is None else total, 1)
        self.top = math.log(n + 1) + 1
        self.idf = {w: math.log(n / min(len(p), n)) + 1 for w, p in self.posting.items()} if weights is None else weights
        self.near: dict[str, list[str]] = defaultdict(list)
        self.starts: dict[str, list[str]] = defaultdict(list)
        for w in self.posting:
            if NUMBER.match(w):
                continue
            for key in shortened(w, budget(w)):
                self.near[key].append(w)
            if w in self.own:
                for k in range(1, len(w)):
                    self.starts[w[:k]].append(w)

    def repair(self, word: str) -> list[tuple[str, float, float]]:
        """Words of the block that the word may stand for, with their likeness and weight."""
        if NUMBER.match(word):
            return [(word, 1.0, self.idf[word])] if word in self.posting else []
        out: dict[str, float] = {}
        if word in self.posting:
            out[word] = 1.0
        limit = budget(word)
        if limit:
            for key in shortened(word, limit):
                for w in self.near.get(key, ()):
                    if w not in out:
                        most = min(limit, budget(w))
                        d = osa(word, w, most)
                        if d <= most and (w in self.own or d == 0 or len(w) > 7):
                            out[w] = 1.0 - 0.8 * d / max(len(word), len(w))
        for w in self.starts.get(word, ()):
            if w not in out:
                out[w] = 0.86 if len(word) >= 3 else 0.8 if len(word) == 2 else 0.78
        return [(w, s, self.idf[w]) for w, s in out.items()]

    def best(self, words: list[str], short: list[bool], repairs: list[list[tuple[str, float, float]]], generic: set[str]) -> tuple[int, float]:
        """Id of the entry of the block that the repaired words mean, 0 if none, and its score."""
        if not words:
            return 0, 0.0
        scores = self._scores(words, short, repairs, generic)
        joined = "".join(words)
        if len(words) > 1 and joined in self.posting:  # a name typed apart
            scores += self._scores([joined], [False], [[(joined, 1.0, self.idf[joined])]], generic)
        top = max(scores, key=lambda x: (round(x[0], 6), x[1], x[2]), default=None)
        return (-top[2], round(top[0], 6) + 1e-7 * top[1]) if top and top[0] >= LEAST else (0, 0.0)

    def _scores(self, words, short, repairs, generic) -> list[tuple[float, float, int]]:
        """Soft TF-IDF of every reading that shares a repaired word."""
        found: dict[int, dict[int, tuple[float, str, float]]] = defaultdict(dict)
        for at, options in enumerate(repairs):
            for w, s, idf in options:
                if s < 0.85 and w.startswith(words[at]) and not short[at]:
                    continue
                for e in self.posting.get(w, ()):
                    if s > found[e].get(at, (0, "", 0))[0]:
                        found[e][at] = (s, w, idf)
        weight = [max((idf for w, _, idf in o), default=self.top) for o in repairs]
        out = []
        for e, hits in found.items():
            theirs = math.sqrt(sum(self.idf[w] ** 2 for w in self.words[e]))
            dot, used = 0.0, set()
            for _, (s, w, idf) in sorted(hits.items(), key=lambda h: -h[1][0]):
                if w not in used:
                    used.add(w)
                    dot += s * idf**2
            counted = range(len(words))
            if self.kind == "family":
                given = [w for w in self.words[e] if not NUMBER.match(w)]
                if any(NUMBER.match(w) and w not in used for w in self.words[e]) or (given and not used.intersection(given)):
                    continue
                counted = [at for at in counted if at in hits or (NUMBER.match(words[at]) and not any(NUMBER.match(w) for w in self.words[e]))]
            mine = math.sqrt(sum(weight[at] ** 2 for at in counted)) if self.kind != "family" else math.sqrt(sum((hits[at][2] if at in hits else weight[at]) ** 2 for at in counted))
            out.append((dot / (mine * theirs), GENERIC_WEIGHT * len(generic & self.generic[e]), -self.ids[e]))
        return out


def _entries(reference: DataFrame, id_col: str, name_col: str, short_col: str | None) -> DataFrame:
    short = F.col(short_col) if short_col else F.lit(None).cast("string")
    return reference.where(F.col(name_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(name_col).alias("name"), short.alias("short"))


OPTIONS = "array<struct<w: string, s: double, i: double>>"


def indexes(entries: DataFrame, kind: str) -> list:
    """Broadcast indexes of the blocks of a reference list."""
    context, total = entries.sparkSession.sparkContext, entries.count()
    blocks = max(1, -(-total // INDEX_ROWS))
    if blocks == 1:
        return [context.broadcast(Index([(r.id, r.name, r.short) for r in entries.orderBy("id").collect()], kind))]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, w) for i, n, s in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in {w for r in readings(n, s, kind) for w in r}]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([w for _, w in pairs], pa.string())], ["id", "w"])

    held = stored(entries.mapInArrow(words, "id long, w string"))
    counted = stored(held.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    out = []
    for k in range(blocks):
        inside = F.pmod(F.xxhash64("id"), F.lit(blocks)) == k
        # about INDEX_ROWS entries and the weights of their words
        weights = {r.w: math.log(total / min(r.n, total)) + 1 for r in held.where(inside).select("w").distinct().join(counted, "w").collect()}
        out.append(context.broadcast(Index([(r.id, r.name, r.short) for r in entries.where(inside).orderBy("id").collect()], kind, weights, total)))
    return out


def meanings(values: DataFrame, entries: DataFrame, kind: str) -> DataFrame:
    """(cell, canonical_id) of each distinct value (cell)."""
    blocks = indexes(entries, kind)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, places, words, short = [], [], [], []
            for cell in batch.column(0).to_pylist():
                for at, (word, dotted) in enumerate(words_of(cell, kind)):
                    cells.append(cell), places.append(at), words.append(word), short.append(dotted)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(places, pa.int32()), pa.array(words, pa.string()), pa.array(short, pa.bool_())], ["cell", "at", "word", "short"])

    words = values.select("cell").mapInArrow(split, "cell string, at int, word string, short boolean")
    distinct = words.select("word").distinct()

    def repairing(index):
        def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                options = [[{"w": w, "s": s, "i": i} for w, s, i in index.value.repair(word)] for word in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(options, pa.list_(pa.struct([("w", pa.string()), ("s", pa.float64()), ("i", pa.float64())])))], ["word", "options"])

        return repair

    fixed = distinct.mapInArrow(repairing(blocks[0]), f"word string, options {OPTIONS}")
    if len(blocks) > 1:
        distinct = stored(distinct)
        fixed = distinct.mapInArrow(repairing(blocks[0]), f"word string, options {OPTIONS}")
        for index in blocks[1:]:
            fixed = fixed.union(distinct.mapInArrow(repairing(index), f"word string, options {OPTIONS}"))
        # a word may stand in several blocks
        fixed = fixed.groupBy("word").agg(F.array_distinct(F.flatten(F.collect_list("options"))).alias("options"))
    joined = words.join(fixed, "word", "left").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("at", "word", "short", "options"))).alias("w"))
    joined = stored(joined) if len(blocks) > 1 else joined

    def scoring(index):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.column(1).to_pylist():
                    own = [x for x in row if kind != "name" or x["word"] not in GENERIC]
                    if not own and kind == "name" and len(row) == 1:
                        own = row
                    options = [[(o["w"], o["s"], o["i"]) for o in x["options"] or ()] for x in own]
                    out.append(index.value.best([x["word"] for x in own], [x["short"] for x in own], options, {x["word"] for x in row} & GENERIC))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i for i, _ in out], pa.int64()), pa.array([x for _, x in out], pa.float64())], ["cell", "canonical_id", "score"])

        return score

    found = [joined.mapInArrow(scoring(index), "cell string, canonical_id long, score double") for index in blocks]
    if len(found) == 1:
        return found[0].select("cell", "canonical_id")
    return reduce(DataFrame.union, found).groupBy("cell").agg(F.max_by("canonical_id", F.struct("score", -F.col("canonical_id"))).alias("canonical_id"))


def map_to_entries(df: DataFrame, key: str, field: str, reference: DataFrame, id_col: str, name_col: str, kind: str, short_col: str | None = None, not_single: DataFrame | None = None) -> DataFrame:
    """(key, field_name, canonical_id) of every value that isn't exactly a listed name.

    kind: ``name`` for names of organisations, ``family`` for a word with a number.
    not_single: texts (cell) that hold several names and are left out.
    """
    entries = _entries(reference, id_col, name_col, short_col)
    rows = df.select(F.col(key), F.col(field).cast("string").alias("cell")).where("cell is not null and cell != ''")
    rows = rows.join(entries.select(F.col("name").alias("cell")).distinct(), "cell", "left_anti")
    if not_single is not None:
        rows = rows.join(not_single.select("cell").distinct(), "cell", "left_anti")
    meant = meanings(rows.select("cell").distinct(), entries, kind)
    return rows.join(meant, "cell", "left").select(key, F.lit(field).alias("field_name"), F.coalesce("canonical_id", F.lit(0)).cast("long").alias("canonical_id"))
