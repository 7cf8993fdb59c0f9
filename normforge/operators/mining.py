"""Attributes found in free text by patterns and by edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normforge.functions.text import strip
from normforge.session import stored
from normforge.sources.config import MinerConfig

#: Pieces of corpus words up to which a filter has 64 bits for each; it has 16 MB then, and no more beyond.
PIECES = 2_000_000
#: Letters of texts that are hashed at once.
LETTERS = 1 << 20
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _rules(config: MinerConfig, category: str, vendor: str) -> list[tuple[bool, tuple[str, ...]]]:
    """(is a list, patterns) by vendor, in order, without empty ones."""
    rules = config.patterns[category]
    return [(not isinstance(p, str), (p,) if isinstance(p, str) else tuple(p)) for v, p in rules.items() if p and (not vendor or v == vendor)]


def match_attribute(c: Column, config: MinerConfig, category: str, vendor: str = "") -> Column:
    """Text found for a category; null if none.

    Vendors in order. A single pattern ends the search if anything is found by then; a list ends
    at its first hit but lets later vendors go on, whose hits win; once something is found, a
    later list tries only its first pattern.
    """
    result, stop = F.lit(None).cast("string"), F.lit(False)

    def hit(p: str) -> Column:
        return F.when(c.rlike(f"(?iu){p}"), F.regexp_extract(c, f"(?iu){p}", 0))

    def folded(first: Column, any_of: Column, is_list: bool):
        def step(x: Column) -> Column:
            found = F.when(x["r"].isNull(), any_of).otherwise(F.coalesce(first, x["r"])) if is_list else F.coalesce(first, x["r"])
            return F.struct(F.when(x["s"], x["r"]).otherwise(found).alias("r"), (x["s"] | (F.lit(False) if is_list else found.isNotNull())).alias("s"))

        return step

    # an ordered fold written out, because literal patterns are compiled once
    state = F.struct(result.alias("r"), stop.alias("s"))
    for is_list, patterns in _rules(config, category, vendor):
        state = F.transform(F.array(state), folded(hit(patterns[0]), F.coalesce(*map(hit, patterns)), is_list))[0]
    return state["r"]


def match(df: DataFrame, column: str, config: MinerConfig, vendor: str = "", strip_target: bool = False, out: str = "found") -> DataFrame:
    """Adds a map from category to the text found; empty finds are left out."""
    c = strip(F.col(column)) if strip_target else F.col(column)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), match_attribute(c, config, k, vendor).alias("value")) for k in config.patterns])
    return df.withColumn(out, F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))))


def match_fuzzy(df: DataFrame, column: str, config: MinerConfig, max_errors: int = 1, vendor: str = "", strip_target: bool = False, out: str = "found") -> DataFrame:
    """As ``match``, with up to ``max_errors`` edits in a hit, the fewest first."""
    if max_errors <= 0:
        return match(df, column, config, vendor, strip_target, out)
    rules = {k: _rules(config, k, vendor) for k in config.patterns}

    @F.pandas_udf("map<string,string>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        ready = {k: [(is_list, [[regex.compile(f"(?:{p}){{e<={e}}}", regex.I) for e in range(max_errors + 1)] for p in patterns]) for is_list, patterns in r] for k, r in rules.items()}

        def search(levels, text):
            return next((m.group() for level in levels if (m := level.search(text))), None)

        def one(text: str | None) -> dict[str, str] | None:
            if text is None:
                return None
            out = {}
            for category, vendors in ready.items():
                result = None
                for is_list, patterns in vendors:
                    for levels in patterns:
                        found = search(levels, text)
                        result = found if found is not None else result
                        if result is not None:
                            break
                    if result is not None and not is_list:
                        break
                if result:
                    out[category] = result
            return out

        for series in texts:
            yield series.map(one)

    c = strip(F.col(column)) if strip_target else F.col(column)
    return df.withColumn(out, find(c))


def similar_windows(text: Column, word: Column, threshold: float) -> Column:
    """array of (pos, part, sim): windows of the word's length in the text that are alike enough."""
    n = F.length(word)
    span = F.length(text) - n + 1
    starts = F.when((span < 1) | (n < 1), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(span, F.lit(1))))
    parts = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.substring(text, i, n).alias("part")))
    scored = F.transform(parts, lambda x: F.struct(x["pos"].alias("pos"), x["part"].alias("part"), (1 - F.levenshtein(x["part"], word) / n).alias("sim")))
    return F.filter(scored, lambda x: x["sim"] >= threshold)


def corpus_cells(corpus: DataFrame, config: MinerConfig, vendor: str = "") -> DataFrame:
    """(row_pos, col_pos, attribute, word) of the filled cells of the search columns."""
    if vendor:
        corpus = corpus.where(F.col(config.vendor_column) == vendor)
    cells = [F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("attribute"), F.col(c).cast("string").alias("word")) for i, c in enumerate(config.search_columns)]
    return corpus.select("row_pos", F.inline(F.array(*cells))).where("word is not null and word != ''")


class Letters:
    """The letters of some texts one after the other; the hash of any stretch of them takes constant time."""

    def __init__(self, texts: list[str]):
        codes = np.array(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.uint64)
        self.texts, self.sizes = texts, np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.at = np.arange(len(codes)) - self.first[self.owner]
        powers, self.back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), b, np.uint64)))) for b in (_BASE, _INVERSE))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(codes + np.uint64(1)) * powers[:-1])))

    def hashes(self, starts: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + n] - self.sums[starts]) * self.back[starts]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _salted(hashes: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    return _mixed(hashes + np.asarray(salt, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _portions(sizes: list[int]) -> Iterator[slice]:
    """Slices of texts that have about ``LETTERS`` letters together; a longer text stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total + n > LETTERS and i > begin:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


class Filter:
    """A bit for each hash: tells most of those that no table of hashes has, and none that it has."""

    def __init__(self, log: int, bits: bytes):
        self.shift, self.bits = np.uint64(64 - log), np.frombuffer(bits, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> self.shift).astype(np.int64)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0

    @staticmethod
    def of(hashes: DataFrame, count: int) -> tuple[int, bytes]:
        """For the column h; of fixed size, however many there are."""
        log = max(15, (64 * max(1, min(count, PIECES)) - 1).bit_length())
        slot = F.shiftrightunsigned("h", 64 - log)
        slots = hashes.select(F.shiftright(slot, 15).cast("int").alias("bucket"), slot.bitwiseAND(32767).alias("bit")).repartition("bucket")
        bits = bytearray((1 << log) // 8)
        for r in slots.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
            bits[r.bucket * 4096 : r.bucket * 4096 + len(r.bits)] = r.bits
        return log, bytes(bits)


def _word_pieces(words: DataFrame, attributes: list[str]) -> DataFrame:
    """(h, attribute, word, row_pos, edits, ahead): the edits + 1 pieces of each word and where they start in it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters(batch.column(1).to_pylist())
            edits, sizes = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 4))
            row = np.repeat(np.arange(batch.num_rows), edits + 1)
            ahead = (np.arange(len(row)) - np.repeat(np.cumsum(edits + 1) - edits - 1, edits + 1)) * sizes[row]
            inside = ahead + sizes[row] <= letters.sizes[row]
            row, ahead = row[inside], ahead[inside]
            salt = np.array([attributes.index(a) for a in batch.column(0).to_pylist()], np.int64)
            hashes = _salted(letters.hashes(letters.first[row] + ahead, sizes[row]), salt[row])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *[batch.column(i).take(at) for i in range(4)], pa.array(ahead.astype(np.int32))], ["h", "attribute", "word", "row_pos", "edits", "ahead"])

    kind = dict(words.dtypes)["row_pos"]
    return words.select("attribute", "word", "row_pos", "edits", "piece_len").mapInArrow(cut, f"h long, attribute string, word string, row_pos {kind}, edits int, ahead int")


def match_levenshtein(df: DataFrame, key: str, column: str, corpus: DataFrame, config: MinerConfig, threshold: float = 0.85, vendor: str = "", strip_target: bool = False) -> DataFrame:
    """(key, attribute, value, similarity): for each attribute the most similar window, the first corpus row on ties.

    Equal corpus words are compared once. Words that a text holds as they stand are most similar, so
    only the attributes for which it holds none go on. A window within the threshold shares a piece of
    the word with it, word cut into k + 1 pieces for k edits, and there the piece is shifted by k letters
    at most. So texts and words meet by equi-joins, on words and then on hashes of pieces, instead of
    all pairs, and only the windows that a shared piece allows are compared.

    Texts have far more substrings than any corpus has pieces, so each is held against a ``Filter`` of
    the corpus before it is shuffled. The filter has a fixed size and is all that is broadcast.
    """
    spark, attributes = df.sparkSession, list(config.search_columns)
    n = F.length("word")
    edits = F.floor((1 - F.lit(threshold)) * n + 1e-9).cast("int")
    size = F.greatest(F.floor(n / (edits + 1)), F.lit(1)).cast("int")
    words = stored(corpus_cells(corpus, config, vendor).groupBy("attribute", "word").agg(F.min("row_pos").alias("row_pos")).select("attribute", "word", "row_pos", edits.alias("edits"), size.alias("piece_len")).where("edits >= 0"))
    text = strip(F.col(column)) if strip_target else F.col(column)
    texts = df.select(F.col(key).alias("_key"), text.alias("_text")).where("_text is not null and _text != ''")
    key_type = dict(texts.dtypes)["_key"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(_salted(letters.hashes(letters.first, letters.sizes), 0).view(np.int64))], ["h"])

    # no more lengths than the longest word has letters
    sizes = words.groupBy(n.alias("n"), "piece_len", "edits").count().collect()
    lengths, piece_lengths = sorted({r.n for r in sizes}), sorted({r.piece_len for r in sizes if r.edits})
    known = spark.sparkContext.broadcast(Filter.of(words.select("word").mapInArrow(whole, "h long"), sum(r["count"] for r in sizes)))

    def as_they_stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = Filter(*known.value)
        for batch in batches:
            every = batch.column(1).to_pylist()
            for portion in _portions([len(t) for t in every]):
                letters, found = Letters(every[portion]), {}
                room = letters.sizes[letters.owner] - letters.at
                for k in lengths:
                    starts = np.flatnonzero(room >= k)
                    starts = starts[among.holds(_salted(letters.hashes(starts, k), 0))]
                    for o, at in zip(letters.owner[starts].tolist(), letters.at[starts].tolist(), strict=True):
                        found.setdefault((o, letters.texts[o][at : at + k]), at + 1)  # the first place of equal ones
                rows = pa.array([portion.start + o for o, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([w for _, w in found], pa.string()), pa.array(found.values(), pa.int32())], ["_key", "word", "pos"])

    held = texts.mapInArrow(as_they_stand, f"_key {key_type}, word string, pos int").join(words.select("attribute", "word", "row_pos").hint("merge"), "word").where(F.lit(1.0) >= threshold)
    held = stored(held.groupBy("_key", "attribute").agg(F.max_by("word", F.struct(-F.col("row_pos"), -F.col("pos"), "word")).alias("part")))

    near = words.where("edits > 0")
    pieces = _word_pieces(near, attributes)
    ready = spark.sparkContext.broadcast(Filter.of(pieces.select("h"), sum(r["count"] * (r.edits + 1) for r in sizes if r.edits)))
    done = held.groupBy(F.col("_key").alias("_held")).agg(F.collect_set("attribute").alias("done")).hint("merge")
    missing = F.filter(F.array(*[F.when(~F.coalesce(F.array_contains("done", a), F.lit(False)), F.lit(i)) for i, a in enumerate(attributes)]), lambda i: i.isNotNull())
    open_texts = texts.join(done, F.col("_key").eqNullSafe(F.col("_held")), "left").select("_key", "_text", missing.alias("missing")).where("size(missing) > 0")

    def shared_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = Filter(*ready.value)
        for batch in batches:
            every, wanted = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for portion in _portions([len(t) for t in every]):
                letters = Letters(every[portion])
                room = letters.sizes[letters.owner] - letters.at
                for i in range(len(attributes)):
                    asked = np.fromiter((i in m for m in wanted[portion]), bool)[letters.owner]
                    for k in piece_lengths:
                        starts = np.flatnonzero(asked & (room >= k))
                        hashes = _salted(letters.hashes(starts, k), i)
                        kept = among.holds(hashes)
                        starts = starts[kept]
                        rows = pa.array(letters.owner[starts] + portion.start)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hashes[kept].view(np.int64)), pa.array((letters.at[starts] + 1).astype(np.int32))], ["_key", "_text", "h", "at"])

    met = open_texts.mapInArrow(shared_pieces, f"_key {key_type}, _text string, h long, at int").join(pieces.hint("merge"), "h")
    starts = F.sequence(F.col("at") - F.col("ahead") - F.col("edits"), F.col("at") - F.col("ahead") + F.col("edits"))
    places = met.select("_key", "_text", "attribute", "word", "row_pos", "edits", F.explode(starts).alias("pos")).where((F.col("pos") >= 1) & (F.col("pos") + n - 1 <= F.length("_text")))
    part = F.substring(F.col("_text"), F.col("pos"), n)
    between = F.call_function("levenshtein", part, F.col("word"), F.col("edits"))  # -1 if there are more edits than allowed
    scored = places.select("_key", "attribute", "word", "row_pos", "pos", part.alias("part"), between.alias("d"), n.alias("n")).where("d >= 0")
    windows = scored.select("_key", "attribute", "word", "row_pos", "pos", "part", (1 - F.col("d") / F.col("n")).alias("sim")).where(F.col("sim") >= threshold)
    best = windows.groupBy("_key", "attribute").agg(F.max_by(F.struct("part", "sim"), F.struct("sim", -F.col("row_pos"), -F.col("pos"), "word")).alias("b")).select("_key", "attribute", "b.part", "b.sim")
    return held.select("_key", "attribute", "part", F.lit(1.0).alias("sim")).unionByName(best).select(F.col("_key").alias(key), "attribute", strip(F.col("part")).alias("value"), F.col("sim").alias("similarity"))
