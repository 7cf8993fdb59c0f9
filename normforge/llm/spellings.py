"""Variant spellings of names, linked into the entities they mean.

The names a row is typed with, read into their own words, are its *profile*. Work on spelling is
done once per distinct word, of which there are far fewer than names:

1. MinHash banding over the padded q-grams of each distinct word, the number of bands following from
   the collision curve and the recall wanted at a likeness, finds words that are spelt alike. An
   abbreviated word meets the words it may begin, also with one letter mistyped.
2. Every word stands under the heaviest words it is alike with, its *heads*; two alike words that
   share no head get a head of their own. So two words are alike only if they share a head.
3. Names meet if their heads agree in two words (in the only word, if there is one): each name
   shows its rarest word together with each of its others, which is enough for two names whose words
   all match. Names run together are cut into known words first; an initial meets the words it begins.
4. Names that met are verified by Monge–Elkan similarity in both directions and clustered into
   stars: the heaviest profile of a neighbourhood becomes its centre.

Every bucket is compared completely; one of over ``SMALL_BUCKET`` members is dealt into parts of
about ``PART`` and each part meets each, so that no task has all pairs of a frequent name. All
tables stay distributed, joins of growing tables are shuffled, and lineage is cut by written tables.

Defined results: rows that name nobody (null, empty, placeholders) are in no cluster; equal
spellings are one profile and so always together; where a row has a name written in full, its
abbreviations are not used, as they fit more organisations; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normforge.llm.names import Name, osa, shortened, word_similarity
from normforge.session import stored

#: Letters of a q-gram, rows of a band, and the recall wanted at a likeness: of two words of eight letters, 0.5 has one with a swap and 0.39 one with two letters changed.
Q, ROWS, RECALL, LIKENESS = 2, 4, 0.95, 0.45
#: Least Monge–Elkan similarity of a link, and least similarity of any word of it.
LINK, WORD = 0.8, 0.6
#: Similarity of an initial with a word it begins: two initials alone make no link.
INITIAL = 0.79
#: Members of a bucket compared in one piece, and of a part of a larger one.
SMALL_BUCKET, PART = 1_024, 512
#: Letters of the beginnings that abbreviated words may have, those from which one may be mistyped, and of the words that a name may be run together from.
BEGINNINGS, MISTYPED, PIECES = (3, 9), 6, (3, 24)
#: Pairs are made from parts of a cluster of so many rows.
PART_ROWS = 2_000


def bands(likeness: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed so that the collision curve 1 - (1 - s^r)^b reaches the recall at the likeness."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - likeness**rows)))


BANDS = bands(LIKENESS)
_random = np.random.default_rng(20240229)
_A, _B = _random.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64), _random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64)
_SEEDS = _random.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
Form = tuple[str, tuple[str, ...], tuple[bool, ...]]


@functools.lru_cache(65_536)
def _gram(gram: str) -> int:
    return zlib.crc32(gram.encode())


def grams(words: Iterable[str]) -> set[int]:
    """Hashes of the padded q-grams of each word."""
    out = set()
    for w in words:
        padded = "#" * (Q - 1) + w + "#" * (Q - 1)
        out.update(_gram(padded[i : i + Q]) for i in range(len(padded) - Q + 1))
    return out


def band_keys(word: str) -> np.ndarray:
    """Hash of each band of the MinHash signature."""
    x = np.fromiter(grams([word]), np.uint64)
    least = ((x[:, None] * _A + _B) % np.uint64(4294967291)).min(axis=0).reshape(BANDS, ROWS)
    mixed = (least * _SEEDS).sum(axis=1)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def forms(vendor: str | None, modified: str | None) -> list[Form]:
    """Distinct (kind, sorted words, cut short) of the two fields. kinds: full, glued, cut, initial, one."""
    out: list[Form] = []
    for text in (vendor, modified):
        name = Name(text)
        pairs = list(zip(name.words, name.short, strict=True))
        if not pairs:
            continue
        sizes = [len(w) for w, _ in pairs]
        if len(pairs) == 1:
            kind = "glued" if sizes[0] >= 9 else "one"
        elif min(sizes) == 1:
            kind = "initial"
        elif any(s for _, s in pairs) or max(sizes) <= 6:
            kind = "cut"
        else:
            kind = "full"
        if kind in ("cut", "initial"):
            pairs = [(w, s or len(w) == 1 or (kind == "cut" and max(sizes) <= 6)) for w, s in pairs]
        pairs.sort()
        form = (kind, tuple(w for w, _ in pairs), tuple(s for _, s in pairs))
        if form not in out:
            out.append(form)
    best = [f for f in out if f[0] == "full"] or [f for f in out if f[0] in ("glued", "cut", "initial")]
    known = [f for f in out if f[0] == "glued" and len(f[1][0]) >= 13]
    return sorted(best + [k for k in known if k not in best]) or out


def written(profile: list[Form]) -> str:
    return "|".join(f"{k}/{' '.join(w)}/{''.join('1' if s else '0' for s in short)}" for k, w, short in profile)


def read(text: str) -> list[Form]:
    parts = (f.split("/") for f in text.split("|"))
    return [(k, tuple(w.split(" ")), tuple(s == "1" for s in short)) for k, w, short in parts]


@functools.lru_cache(200_000)
def alike(a: str, b: str, a_short: bool, b_short: bool) -> float:
    """Similarity of two words; an abbreviation has one letter mistyped at most."""
    if a == b or not (a_short or b_short):
        return word_similarity(a, b)
    top = 0.0
    for x, y, short in ((a, b, a_short), (b, a, b_short)):
        if short and y.startswith(x):
            top = max(top, 0.86 if len(x) >= BEGINNINGS[0] else INITIAL)
        elif short and len(x) >= MISTYPED and min(osa(x, y[: len(x) + k], 1) for k in (0, -1, 1)) <= 1:
            top = max(top, 0.8)
    return top


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...], a_short: tuple[bool, ...], b_short: tuple[bool, ...]) -> float:
    """Least of the two directed means of each word's best match; 0 if any word has no match."""
    best = []
    for x, s in zip(a, a_short, strict=True):
        row = [alike(x, y, s, t) for y, t in zip(b, b_short, strict=True)]
        if max(row) < WORD:
            return 0.0
        best.append(row)
    forth, back = [max(r) for r in best], [max(c) for c in zip(*best, strict=True)]
    return 0.0 if min(forth + back) < WORD else min(sum(forth) / len(forth), sum(back) / len(back))


def likeness(p: list[Form], q: list[Form]) -> float:
    """Best similarity between the forms of two profiles."""
    top = 0.0
    for kind, a, s in p:
        for other, b, t in q:
            if "glued" in (kind, other) and (len(a) == 1 or len(b) == 1):
                joined, rest = ("".join(a), b) if len(a) == 1 else ("".join(b), a)
                as_found = tuple(sorted(rest, key=lambda w: joined.find(w[:3])))
                for order in {rest, rest[::-1], as_found}:
                    d = osa(joined, "".join(order), 3)
                    if d <= 3:
                        top = max(top, 1 - 0.9 * d / len(joined))
            else:
                top = max(top, monge_elkan(a, b, s, t))
    return top


def profiles(df: DataFrame, key: str, fields: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(row_key, p) of each row that names somebody, and (p, form, weight) of each distinct profile."""
    source = df.select(F.col(key).alias("row_key"), *[F.col(f).cast("string") for f in fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [written(forms(a, b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["row_key", "form"]).filter(pa.array([bool(f) for f in found], pa.bool_()))

    key_type = dict(source.dtypes)["row_key"]
    rows = stored(source.mapInArrow(parse, f"row_key {key_type}, form string").withColumn("p", F.xxhash64("form")))
    return rows.select("row_key", "p"), stored(rows.groupBy("p").agg(F.first("form").alias("form"), F.count(F.lit(1)).alias("weight")))


def _runs(batches: Iterator[pa.RecordBatch], limit: int, large: bool) -> Iterator[pa.RecordBatch]:
    """Whole buckets of at most ``limit`` members without repeated ones, or else the rows of larger buckets; rows come sorted by h, side and key."""
    held, over = None, None
    for batch in batches:
        if over is not None:
            same = pc.equal(batch.column(0), over)
            if large:
                yield batch.filter(same)
            batch = batch.filter(pc.invert(same))
        if not batch.num_rows:
            continue
        over = None
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        other = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in batch.columns]
        batch = batch.filter(pa.array(np.concatenate(([True], np.logical_or.reduce(other)))))
        h = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sizes = np.diff(np.append(starts, len(h)))
        last, held = int(starts[-1]), None
        if sizes[-1] > limit:
            over, last = batch.column(0)[last], len(h)
        else:
            held = batch.slice(last)
        kept = np.repeat((sizes > limit) == large, sizes)[:last]
        if kept.any():
            yield batch.slice(0, last).filter(pa.array(kept))
    if held is not None and not large:
        yield held


def met(members: DataFrame, key: str) -> DataFrame:
    """Pairs (key, other_key) that share a bucket h, the smaller key first; side 0, which all members have without the column, meets 0, and 1 meets 2.

    The members are shuffled once, by h. Small buckets are compared where they stand; only the
    members of large ones go on, dealt into parts.
    """
    limit, other, kind = SMALL_BUCKET, f"other_{key}", dict(members.dtypes)[key]
    sided = "side" in members.columns
    placed = members.select("h", *["side"] * sided, key).repartition("h").sortWithinPartitions("h", *["side"] * sided, key).select("h", (F.col("side") if sided else F.lit(0)).cast("int").alias("side"), key)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, limit, False):
            h, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.append(starts, len(h)))
            for n in np.unique(sizes[sizes > 1]).tolist():
                i, j = np.triu_indices(n, 1)
                same = starts[sizes == n]
                step = max(1, 200_000 // len(i))
                for k in range(0, len(same), step):
                    left, right = ((same[k : k + step, None] + x).ravel() for x in (i, j))
                    meet = (side[left] == side[right]) & (side[left] == 0) | (side[left] == 1) & (side[right] == 2)
                    a, b = (batch.column(2).take(pa.array(x[meet])) for x in (left, right))
                    yield pa.RecordBatch.from_arrays([a, b], [key, other])

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _runs(batches, limit, True)

    small = placed.mapInArrow(within, f"{key} {kind}, {other} {kind}")
    dealt = placed.mapInArrow(beyond, f"h long, side int, {key} {kind}").distinct()
    # a window, as filters of the sides don't go below it, so both sides read the same exchange
    sized = dealt.withColumn("parts", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("h")) / PART).cast("int"))
    left = sized.where("side < 2").select("h", key, "side", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"))
    right = sized.where("side != 1").select("h", F.col(key).alias(other), F.col("side").alias("other_side"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    large = left.join(right.hint("merge"), ["h", "part"]).where("(side = 0 and other_side = 0) or (side = 1 and other_side = 2)").select(key, other)
    return small.unionByName(large).where(F.col(key) != F.col(other)).select(F.least(key, other).alias(key), F.greatest(key, other).alias(other))


def _lists(kept: DataFrame) -> DataFrame:
    """(p, form, weight, kind, words) of each form of each profile; an abbreviated word ends with a dot."""
    out = kept.withColumn("f", F.explode(F.split("form", r"\|"))).withColumn("f", F.split("f", "/"))
    dotted = F.zip_with(F.split(F.col("f")[1], " "), F.split(F.col("f")[2], ""), lambda w, s: F.when(s == "1", F.concat(w, F.lit("."))).otherwise(w))
    return out.select("p", "form", "weight", F.col("f")[0].alias("kind"), dotted.alias("words"))


def covers(text: str, found: list[tuple[int, int, int]]) -> list[list[str]]:
    """Ways to cut a run-together name into known words (start, letters, weight): all with the fewest words, else the heaviest known beginning or end and its rest."""
    at: dict[int, list[tuple[int, int]]] = {}
    for start, size, weight in found:
        if size < len(text):
            at.setdefault(start, []).append((start + size, weight))
    ways: dict[int, list[list[str]]] = {0: [[]]}
    while ways and len(text) not in ways:
        after: dict[int, list[list[str]]] = {}
        for start, sofar in ways.items():
            for end, _ in at.get(start, ()):
                after.setdefault(end, []).extend([*w, text[start:end]] for w in sofar)
        ways = after
    if len(text) in ways:
        return ways[len(text)]
    rest = len(text) - PIECES[0]
    heads = [(w, end) for end, w in at.get(0, ()) if end <= rest]
    tails = [(w, -start) for start, ends in at.items() for end, w in ends if end == len(text) and start >= PIECES[0]]
    return [[text[:k], text[k:]] for k in sorted({abs(max(some)[1]) for some in (heads, tails) if some})]


def cut_apart(lists: DataFrame) -> DataFrame:
    """(g, words) of names run together, cut into words that stand in full names."""
    least, most = PIECES
    known = lists.where("kind = 'full'").select("weight", F.explode("words").alias("w")).groupBy("w").agg(F.sum("weight").alias("weight")).where(F.length("w").between(least, most))
    glued = lists.where("kind = 'glued'").select(F.col("words")[0].alias("g")).distinct()
    starts = glued.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("g") - least)))
    longest = F.least(F.lit(most), F.length("g") - F.col("start"))
    pieces = starts.withColumn("size", F.explode(F.sequence(F.lit(least), longest))).select("g", "start", "size", F.substring("g", F.col("start") + 1, F.col("size")).alias("w"))
    found = pieces.join(known.hint("merge"), "w").groupBy("g").agg(F.collect_list(F.struct("start", "size", "weight")).alias("found"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = [(g, way) for g, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for way in covers(g, [(x["start"], x["size"], x["weight"]) for x in f])]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in ways], pa.string()), pa.array([w for _, w in ways], pa.list_(pa.string()))], ["g", "words"])

    return stored(found.mapInArrow(work, "g string, words array<string>"))


def dictionary(lists: DataFrame, apart: DataFrame) -> DataFrame:
    """(w, weight) of every word."""
    pieces = apart.select(F.lit(0).cast("long").alias("weight"), F.explode("words").alias("w"))
    return stored(lists.select("weight", F.explode("words").alias("w")).unionByName(pieces).groupBy("w").agg(F.sum("weight").alias("weight")))


def spelt_alike(words: DataFrame) -> DataFrame:
    """(u, v), u < v, of words in full within the edits that word_similarity allows."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.concatenate([band_keys(w) for w in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], ["h", "w"])

    members = words.where((F.length("w") >= 3) & ~F.col("w").endswith(".")).select("w").mapInArrow(banded, "h long, w string")
    u, v = F.col("w"), F.col("other_w")
    limit = F.when(F.least(F.length(u), F.length(v)) < 5, 1).otherwise(2)
    edits = F.levenshtein(u, v, 4)
    # a swap of neighbours is two of these edits and leaves the letters as they are
    odd = F.size(F.array_except(F.split(u, ""), F.split(v, ""))) + F.size(F.array_except(F.split(v, ""), F.split(u, "")))
    pairs = met(members, "w").where(F.abs(F.length(u) - F.length(v)) <= limit).select("w", "other_w", edits.alias("edits"), limit.alias("most")).where("edits between 0 and 2 * most")
    pairs = pairs.where((F.col("edits") <= F.col("most")) | (odd <= 2 * (2 * F.col("most") - F.col("edits")))).select("w", "other_w", (F.col("edits") <= F.col("most")).alias("sure")).distinct()

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [s or word_similarity(a, b) >= WORD for a, b, s in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield batch.select([0, 1]).rename_columns(["u", "v"]).filter(pa.array(same, pa.bool_()))

    return stored(pairs.mapInArrow(swapped, "u string, v string"))


def begun(words: DataFrame) -> DataFrame:
    """(u, v) of words u that may be abbreviations of v, or that v may be typed with its last letters left out."""
    low, high = BEGINNINGS

    def keyed(own: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, texts = [], []
                for w in batch.column(0).to_pylist():
                    text = w.rstrip(".")
                    if own:
                        found = shortened(text, 1) if text != w and len(text) >= MISTYPED else {text}
                    else:
                        starts = [text[:n] for n in range(low, min(high, len(text)) + 1)]
                        found = {s for start in starts for s in (shortened(start, 1) if len(start) >= MISTYPED - 1 else (start,))}
                    keys += found
                    texts += [w] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in keys], pa.int64()), pa.array(texts, pa.string())], ["h", "w"])

        return work

    text = F.rtrim(F.col("w"), F.lit("."))
    left = words.where(F.length(text).between(low, high - 1)).select("w").mapInArrow(keyed(True), "h long, w string").withColumnRenamed("w", "u")
    right = words.where(F.length(text) >= low).select("w").mapInArrow(keyed(False), "h long, w string").withColumnRenamed("w", "v")
    x, y, short = F.rtrim(F.col("u"), F.lit(".")), F.rtrim(F.col("v"), F.lit(".")), F.col("u").endswith(".")
    pairs = left.join(right.hint("merge"), "h").where("u != v").select("u", "v", x.alias("x"), y.alias("y"), short.alias("short")).distinct()
    near = [F.levenshtein("x", F.substring("y", F.lit(1), F.length("x") + F.lit(k)), 1) >= 0 for k in (0, 1, -1)]
    swapped = (F.levenshtein("x", F.substring("y", F.lit(1), F.length("x")), 2) >= 0) & (F.array_sort(F.split("x", "")) == F.array_sort(F.split(F.substring("y", F.lit(1), F.length("x")), "")))
    mistyped = F.col("short") & (F.length("x") >= MISTYPED) & (near[0] | near[1] | near[2] | swapped)
    # words in full on both sides that are spelt alike are found by their bands
    return stored(pairs.where(F.col("y").startswith(F.col("x")) | mistyped).select("u", "v"))


def headed(words: DataFrame, same: DataFrame, starts: DataFrame) -> DataFrame:
    """(w, weight, heads, begins): hashes of the heads of every word, and of those of the words it may begin.

    The words of a pair of ``same`` share one of their heads; the words of a pair of ``starts`` share
    one of the begins of the first and the heads of the second.
    """
    both = same.unionByName(same.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(words.select(F.col("w").alias("u"), F.col("w").alias("v")))
    weighed = both.join(words.select(F.col("w").alias("v"), "weight").hint("merge"), "v")
    heads = stored(weighed.groupBy("u").agg(F.max(F.struct("weight", "v"))["v"].alias("v")).select("v").distinct())

    def shown(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.join(heads.hint("merge"), "v", "left_semi").groupBy("u").agg(F.collect_set(F.xxhash64("v")).alias(name))

    none = F.array().cast("array<long>")
    own = shown(both, "heads").join(shown(starts, "begins").hint("merge"), "u", "left").withColumn("begins", F.coalesce("begins", none))
    own = stored(own)
    theirs = own.select(F.col("u").alias("v"), F.col("heads").alias("v_heads")).hint("merge")
    head = F.xxhash64("u", "v").alias("head")

    def apart(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.join(own.hint("merge"), "u").join(theirs, "v").where(~F.arrays_overlap(name, "v_heads"))

    as_head = F.struct(head, F.lit(True).alias("is_head"))
    extra = apart(same, "heads").select(F.explode(F.array("u", "v")).alias("u"), as_head.alias("x"))
    begun = F.explode(F.array(F.struct("u", F.struct(head, F.lit(False).alias("is_head")).alias("x")), F.struct(F.col("v").alias("u"), as_head.alias("x"))))
    extra = extra.unionByName(apart(starts, "begins").select(begun.alias("y")).select("y.u", "y.x"))
    extra = extra.groupBy("u").agg(F.collect_set("x").alias("extra"))

    def of(is_head: bool) -> Column:
        return F.transform(F.filter(F.coalesce("extra", F.array().cast("array<struct<head:long,is_head:boolean>>")), lambda x: x["is_head"] == F.lit(is_head)), lambda x: x["head"])

    out = own.join(extra.hint("merge"), "u", "left").select(F.col("u").alias("w"), F.concat("heads", of(True)).alias("heads"), F.concat("begins", of(False)).alias("begins"))
    return out.join(words.select("w", "weight").hint("merge"), "w")


def _pair(x: Column, y: Column) -> Column:
    return F.xxhash64(F.least(x, y), F.greatest(x, y))


def _crossed(item: Column, other: Column, letters: int, heads: str, tag: str) -> Column:
    """The heads of either word with the first letters of the other one."""

    def keys(headed: Column, begun: Column) -> Column:
        return F.transform(headed[heads], lambda x: F.xxhash64(F.lit(tag), F.substring(begun["text"], 1, letters), x))

    return F.concat(keys(item, other), keys(other, item))


def buckets(lists: DataFrame, apart: DataFrame, heads: DataFrame) -> DataFrame:
    """(h, side, p) of each bucket of each profile, some more than once; side 0 meets 0, and 1 meets 2.

    The rarest word goes together with each other word. Names meet by the heads of both words
    (side 0). An abbreviated name (side 1), whose words begin many, meets others (side 2) by the
    heads of one word and the first letters of the other.
    """
    cut = lists.where("kind = 'glued'").select("p", F.col("words")[0].alias("g")).join(apart.hint("merge"), "g").select("p", F.lit(False).alias("short"), "words")
    named = lists.select("p", F.col("kind").isin("cut", "initial").alias("short"), "words").unionByName(cut).withColumn("words", F.array_sort(F.array_distinct("words")))
    word = named.select("p", "short", F.concat_ws(" ", "words").alias("list"), F.explode("words").alias("w"))
    # a letter alone has no heads and is never the rarest word
    text, none = F.rtrim(F.col("w"), F.lit(".")), F.array().cast("array<long>")
    letter = F.length(text) == 1
    known = heads.select("w", text.alias("text"), F.when(letter, F.lit(1 << 60)).otherwise(F.col("weight")).alias("weight"), F.when(letter, none).otherwise(F.col("heads")).alias("heads"), F.when(letter, none).otherwise(F.array_union("heads", "begins")).alias("begins"))
    items = word.join(known.hint("merge"), "w").groupBy("p", "short", "list").agg(F.array_sort(F.collect_list(F.struct("weight", "text", "heads", "begins"))).alias("items"))
    first, rest = F.col("items")[0], F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(1)))
    one = F.size("items") == 1
    single = F.transform(first["heads"], lambda x: F.xxhash64(F.lit("1"), x))
    paired = F.flatten(F.transform(rest, lambda o: F.flatten(F.transform(first["heads"], lambda x: F.transform(o["heads"], lambda y: _pair(x, y))))))
    few = F.exists("items", lambda x: F.length(x["text"]) < BEGINNINGS[0])

    def crossed(letters: int, heads: str, tag: str = "#") -> Column:
        return F.flatten(F.transform(rest, lambda o: _crossed(first, o, letters, heads, tag)))

    # an initial meets other abbreviations by keys of their own
    begun = F.concat(F.when(few, F.concat(crossed(1, "begins"), crossed(1, "begins", "."))).otherwise(none), crossed(BEGINNINGS[0], "begins"))
    waiting = F.concat(crossed(1, "heads"), crossed(BEGINNINGS[0], "heads"), F.when(F.col("short") & ~few, crossed(1, "begins", ".")).otherwise(none))
    keys = (F.when(one, single).otherwise(paired), F.when(one | ~F.col("short"), none).otherwise(begun), F.when(one, none).otherwise(waiting))
    sides = items.select("p", F.posexplode(F.array(*keys)).alias("side", "keys"))
    return sides.select("p", "side", F.explode(F.array_distinct("keys")).alias("h"))


def _verified(pairs: DataFrame) -> DataFrame:
    """(p, q, sim) of the candidate pairs (p, q, form, other)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Form]] = {}

        def form(text: str) -> list[Form]:
            if text not in known:
                if len(known) > 100_000:
                    known.clear()
                known[text] = read(text)
            return known[text]

        for batch in batches:
            sims = [likeness(form(a), form(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["p", "q", "sim"])

    return pairs.mapInArrow(work, "p long, q long, sim double")


def links(kept: DataFrame) -> DataFrame:
    """(p, q, sim) of every verified candidate pair, p < q."""
    lists = _lists(kept)
    apart = cut_apart(lists)
    words = dictionary(lists, apart)
    heads = headed(words, spelt_alike(words), begun(words))
    pairs = stored(met(buckets(lists, apart, heads), "p").select("p", F.col("other_p").alias("q")).distinct())
    forms = kept.select("p", "form").hint("merge")
    pairs = pairs.join(forms, "p").join(forms.select(F.col("p").alias("q"), F.col("form").alias("other")).hint("merge"), "q").select("p", "q", "form", "other")
    return stored(_verified(pairs).where(F.col("sim") >= LINK))


def stars(kept: DataFrame, linked: DataFrame) -> DataFrame:
    """(p, center) of every profile.

    Rank is the summed weight of a profile and what it is linked with, abbreviated profiles behind
    all others, as they fit several organisations. In each round the profiles that outrank all their
    free neighbours become centres and take those neighbours.
    """
    both = linked.union(linked.select(F.col("q").alias("p"), F.col("p").alias("q"), "sim"))
    reach = both.join(kept.select(F.col("p").alias("q"), "weight").hint("merge"), "q").groupBy("p").agg(F.sum(F.col("weight") * F.col("sim")).alias("reach"))
    whole = F.col("form").rlike(r"(^|\|)(full|glued|one)/").alias("whole")
    nodes = stored(kept.select("p", "weight", whole).join(reach.hint("merge"), "p", "left").select("p", "whole", (F.coalesce("reach", F.lit(0.0)) + F.col("weight")).alias("rank"), F.col("reach").isNull().alias("alone")))
    rank = F.struct("whole", "rank", -F.col("p")).alias("rank")
    ranks = nodes.where("not alone").select("p", rank)
    edges = stored(both.join(ranks.hint("merge"), "p").join(ranks.select(F.col("p").alias("q"), F.col("rank").alias("q_rank")).hint("merge"), "q"))
    done = [nodes.where("alone").select("p", F.col("p").alias("center"))]
    while not edges.isEmpty():
        # what every free profile's best free neighbour is decides who is a centre
        tops = edges.groupBy("p").agg(F.max("q_rank").alias("top"), F.first("rank").alias("rank"))
        centers = stored(tops.where("rank > top").select("p"))
        taken = edges.join(centers.select(F.col("p").alias("q")).hint("merge"), "q", "left_semi").groupBy("p").agg(F.max(F.struct("sim", "q_rank", "q"))["q"].alias("center"))
        settled = stored(taken.union(centers.select("p", F.col("p").alias("center"))))
        done.append(settled)
        left = edges.join(settled.select("p").hint("merge"), "p", "left_anti")
        # a profile whose neighbours are all taken stands alone
        free = stored(left.join(settled.select(F.col("p").alias("q"), F.lit(True).alias("gone")).hint("merge"), "q", "left"))
        edges = free.where("gone is null").drop("gone")
        lone = free.groupBy("p").agg(F.count("gone").alias("gone"), F.count(F.lit(1)).alias("n")).where("gone = n").select("p", F.col("p").alias("center"))
        done.append(lone)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def clusters(df: DataFrame, key: str, fields: tuple[str, str]) -> DataFrame:
    """(row_key, cluster) of every row that names somebody."""
    rows, kept = profiles(df, key, fields)
    return rows.join(stars(kept, links(kept)).hint("merge"), "p").select("row_key", F.col("center").alias("cluster"))


def row_pairs(grouped: DataFrame, left: str, right: str) -> DataFrame:
    """Each pair of rows of a cluster, smaller key first; large clusters are made in parts."""
    sizes = grouped.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    sized = grouped.join(sizes.hint("merge"), "cluster")
    a = sized.select("cluster", F.col("row_key").alias(left), F.pmod(F.xxhash64("row_key"), F.col("parts")).cast("int").alias("part"))
    b = sized.select("cluster", F.col("row_key").alias(right), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b.hint("merge"), ["cluster", "part"]).where(F.col(left) < F.col(right)).select(left, right)
