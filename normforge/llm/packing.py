"""Filling containers of fixed capacity with texts of varying length.

Only a histogram of lengths, bounded by the capacity, reaches the driver; a plan is made on it and
each text finds its place in the plan by its rank among the texts of its length.

``bucket_plan`` is the method of optimal length buckets: dynamic programming over the histogram
chooses the bucket boundaries that minimise padding, and token-budget batches are formed inside
each bucket. Batches of like lengths leave the room of one text open where two of them don't fit,
so where room counts, ``fit_plan`` is used instead: best fit decreasing on the histogram, with as
many containers at a time filled alike as the counts allow.

A text larger than the capacity is split into full containers and a rest that is packed like any
other text; no other text is split.

Defined results: null and empty texts have no tokens and need no container (``container_no`` is
null); equal lengths are ranked by key; repeated rows each take their own place; empty tables give
no containers; a capacity below 1 or null gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which the texts of one length are ranked, and the number of length buckets.
RANK_PARTS, BUCKETS = 32, 12
PLACES = "container_name string, container_no long, token_offset long"


def pieces(lengths: DataFrame, containers: DataFrame, key: str) -> DataFrame:
    """(container_name, capacity, key, piece, token_from, n_tokens): texts larger than the capacity in full pieces and a rest."""
    sized = lengths.crossJoin(F.broadcast(containers.where("capacity_tokens > 0").select("container_name", F.col("capacity_tokens").cast("long").alias("capacity"))))
    count = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1))
    parts = sized.select("container_name", "capacity", key, F.col("n_tokens").alias("whole"), F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    return parts.select("container_name", "capacity", key, "piece", start.alias("token_from"), F.least(F.col("capacity"), F.col("whole") - start).alias("n_tokens"))


def ranked(items: DataFrame, group: list[str], key: str) -> DataFrame:
    """Adds ``place``, the rank from 0 within the group; a group is ranked in parts, so none is sorted by one task."""
    items = items.withColumn("part", F.pmod(F.xxhash64(key, "piece"), F.lit(RANK_PARTS)).cast("int"))
    counts = items.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*group, "part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*group, "part").orderBy(key, "piece")) - 1
    return items.withColumn("inside", inside).join(starts, [*group, "part"]).withColumn("place", F.col("start") + F.col("inside")).drop("part", "start", "inside")


def fit_plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length the (first rank, texts per container, first container, offset) of its runs, in rank order."""
    left = {n: c for n, c in counts.items() if 0 < n <= capacity and c > 0}
    lengths = sorted(left)
    used = dict.fromkeys(left, 0)
    plan: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in left}
    container = 0
    while lengths:
        room, pattern = capacity, []
        at = len(lengths)
        while room > 0 and at > 0:
            at = bisect.bisect_right(lengths, room, 0, at)
            if not at:
                break
            n = lengths[at - 1]
            take = min(room // n, left[n])
            pattern.append((n, take))
            room -= n * take
            at -= 1
        times = min(left[n] // take for n, take in pattern)
        offset = 0
        for n, take in pattern:
            plan[n].append((used[n], take, container, offset))
            offset += n * take
            used[n] += take * times
            left[n] -= take * times
            if not left[n]:
                lengths.pop(bisect.bisect_left(lengths, n))
        container += times
    return plan


def length_buckets(counts: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper ends of the length buckets with the least padding, by dynamic programming over the histogram."""
    lengths = np.array(sorted(n for n, c in counts.items() if n > 0 and c > 0), np.int64)
    if not len(lengths):
        return []
    number = np.concatenate([[0], np.cumsum([counts[int(n)] for n in lengths])])
    tokens = np.concatenate([[0], np.cumsum([int(n) * counts[int(n)] for n in lengths])])
    m = len(lengths)
    best = lengths * number[1:] - tokens[1:]  # one bucket up to each end
    choice = [np.zeros(m, np.int64)]
    for _ in range(1, min(buckets, m)):
        now, cut_at = best.copy(), np.zeros(m, np.int64)
        for j in range(1, m):
            cost = best[:j] + lengths[j] * (number[j + 1] - number[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(cost.argmin())
            if cost[i] < now[j]:
                now[j], cut_at[j] = cost[i], i + 1
        best = now
        choice.append(cut_at)
    ends, j = [], m - 1
    for cut_at in reversed(choice):
        ends.append(int(lengths[j]))
        if not cut_at[j]:
            break
        j = int(cut_at[j]) - 1
    return ends[::-1]


def histogram(items: DataFrame) -> dict[tuple[str, int], dict[int, int]]:
    """Count of each length by container; at most ``capacity`` numbers each."""
    out: dict[tuple[str, int], dict[int, int]] = {}
    for r in items.where("n_tokens > 0").groupBy("container_name", "capacity", "n_tokens").agg(F.count(F.lit(1)).alias("c")).collect():
        out.setdefault((r.container_name, r.capacity), {})[r.n_tokens] = r.c
    return out


def packed(lengths: DataFrame, containers: DataFrame, key: str) -> DataFrame:
    """(container_name, container_no, token_offset, key, piece, token_from, n_tokens): the place of every text, by best fit.

    lengths: (key, n_tokens), read twice, so it should be cheap to read.
    """
    items = pieces(lengths, containers, key)
    plans = {name: {n: tuple(np.array(x) for x in zip(*runs, strict=True)) for n, runs in fit_plan(counts, capacity).items()} for (name, capacity), counts in histogram(items).items()}
    shared = lengths.sparkSession.sparkContext.broadcast(plans)
    placed = ranked(items.where("n_tokens > 0"), ["container_name", "n_tokens"], key)
    source = placed.select("container_name", key, "piece", "token_from", "n_tokens", F.col("place").cast("long").alias("place"))
    key_type = dict(source.dtypes)[key]
    names = ["container_name", "container_no", "token_offset", key, "piece", "token_from", "n_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, offset = [], []
            for name, n, place in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                first, per, container, start = shared.value[name][n]
                i = int(np.searchsorted(first, place, "right")) - 1
                at, slot = divmod(place - int(first[i]), int(per[i]))
                number.append(int(container[i]) + at)
                offset.append(int(start[i]) + slot * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int64()), pa.array(offset, pa.int64()), *batch.columns[1:5]], names)

    schema = f"container_name string, container_no long, token_offset long, `{key}` {key_type}, piece int, token_from long, n_tokens long"
    nothing = items.where("n_tokens <= 0").select("container_name", F.lit(None).cast("long").alias("container_no"), F.lit(None).cast("long").alias("token_offset"), key, "piece", "token_from", "n_tokens")
    return source.mapInArrow(work, schema).unionByName(nothing)


def bucketed(lengths: DataFrame, containers: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(container_name, bucket_end, batch_no, key, piece, n_tokens): token-budget batches inside the optimal length buckets.

    A batch holds as many texts of a bucket as fit when each is padded to the end of the bucket.
    """
    items = pieces(lengths, containers, key).where("n_tokens > 0")
    ends = {name: length_buckets(counts, buckets) for (name, _), counts in histogram(items).items()}
    rows = [(name, end, [0, *e][i] + 1) for name, e in ends.items() for i, end in enumerate(e)]
    table = lengths.sparkSession.createDataFrame(rows, "container_name string, bucket_end long, bucket_from long")
    inside = (F.col("n_tokens") >= F.col("bucket_from")) & (F.col("n_tokens") <= F.col("bucket_end"))
    held = items.join(F.broadcast(table.withColumnRenamed("container_name", "of")), inside & (F.col("container_name") == F.col("of"))).drop("of", "bucket_from")
    placed = ranked(held, ["container_name", "bucket_end"], key)
    return placed.select("container_name", "bucket_end", F.floor(F.col("place") / F.floor(F.col("capacity") / F.col("bucket_end"))).alias("batch_no"), key, "piece", "n_tokens")


def fill(places: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_name, containers, tokens, fill) of a packing."""
    used = places.where("container_no is not null").groupBy("container_name").agg((F.max("container_no") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(F.broadcast(containers), "container_name").select("container_name", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
