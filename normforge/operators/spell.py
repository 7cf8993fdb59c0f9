"""Word frequencies of a corpus, and spelling candidates by edits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normforge.functions.text import strip

WORD = r"(?U)\w[\w']*\w|\w"


def frequencies(df: DataFrame, whole: Sequence[str] = (), by_blank: Sequence[str] = (), by_word: Sequence[str] = (), checker: str | None = None) -> DataFrame:
    """(checker, word, cnt) of cells taken whole, split at white space, and split into words; checkers are all and, if named, each value of a column."""
    keys = [F.lit("all")] + ([F.col(checker).cast("string")] if checker else [])
    cells = [strip(F.col(c).cast("string")) for c in whole]
    lists = [F.array(c) for c in cells] + [F.split(strip(F.col(c).cast("string")), r"(?U)\s+") for c in by_blank] + [F.regexp_extract_all(F.col(c).cast("string"), F.lit(WORD), F.lit(0)) for c in by_word]
    words = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
    rows = df.select(F.explode(F.array(*keys)).alias("checker"), words.alias("ws")).where("checker is not null").select("checker", F.explode("ws").alias("word"))
    return rows.where("word is not null and word != ''").groupBy("checker", "word").agg(F.count(F.lit(1)).alias("cnt"))


def _deletions(word: str, edits: int) -> set[str]:
    out = level = {word}
    for _ in range(edits):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def edits_between(a: str, b: str, limit: int = 2) -> int:
    """Inserted, deleted, replaced and swapped letters between two words (swaps of neighbours, further edits allowed inside), or limit + 1."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    big = len(a) + len(b)
    rows = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        rows[i + 1][1] = i
    for j in range(len(b) + 1):
        rows[1][j + 1] = j
    last: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            rows[i + 1][j + 1] = min(rows[i][j] + (x != y), rows[i + 1][j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return min(rows[len(a) + 1][len(b) + 1], limit + 1)


def candidates(words: DataFrame, dictionary: DataFrame, column: str = "word") -> DataFrame:
    """(word, candidate, cnt, distance): the known words of the nearest tier within two edits.

    Words meet the dictionary by the keys of their deletion neighbourhoods, an equi-join; words of
    n letters have about n * n / 2 keys.
    """

    def keys(name: str):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, key = [], []
                for w in batch.column(0).to_pylist():
                    own = _deletions(w, 2)
                    word += [w] * len(own)
                    key += own
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(key, pa.string())], [name, "k"])

        return work

    asked = words.select(F.col(column).cast("string").alias("word")).where("word is not null").distinct()
    known = dictionary.select(F.col("word").alias("candidate"), "cnt")
    left = asked.mapInArrow(keys("word"), "word string, k string").select("word", F.xxhash64("k").alias("h"))
    right = known.select("candidate").mapInArrow(keys("candidate"), "candidate string, k string").select("candidate", F.xxhash64("k").alias("h"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [edits_between(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.int32())], ["word", "candidate", "distance"])

    pairs = left.join(right, "h").select("word", "candidate").distinct().mapInArrow(measured, "word string, candidate string, distance int").where("distance <= 2")
    least = F.min("distance").over(Window.partitionBy("word"))
    return pairs.withColumn("least", least).where("distance = least").drop("least").join(known, "candidate").select("word", "candidate", "cnt", "distance")


def best(words: DataFrame, dictionary: DataFrame, column: str = "word") -> DataFrame:
    """(word, best): the most frequent candidate, the first by spelling on ties; '' if there is none."""
    found = candidates(words, dictionary, column).groupBy("word").agg(F.min(F.struct((-F.col("cnt")).alias("n"), "candidate")).alias("m"))
    asked = words.select(F.col(column).cast("string").alias("word")).where("word is not null").distinct()
    return asked.join(found, "word", "left").select("word", F.coalesce("m.candidate", F.lit("")).alias("best"))


def best_split(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """(column, best): every word of a text replaced by its best candidate; '' if any has none."""
    texts = df.select(F.col(column).alias("_t")).where("_t is not null").distinct()
    tokens = texts.select("_t", F.posexplode(F.filter(F.split("_t", r"(?U)\s+"), lambda x: x != "")).alias("pos", "word"))
    fixed = tokens.join(best(tokens, dictionary), "word").groupBy("_t").agg(F.sort_array(F.collect_list(F.struct("pos", "best"))).alias("w"))
    answer = F.when(F.exists("w", lambda x: x["best"] == ""), "").otherwise(F.array_join(F.col("w.best"), " "))
    return texts.join(fixed, "_t", "left").select(F.col("_t").alias(column), F.coalesce(answer, F.lit("")).alias("best"))
