import itertools
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from normforge.llm import packing as P

CONTAINERS = [("s", 10), ("l", 64)]


def test_every_text_has_its_place(spark):
    lengths = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 25, 200, 0, 7, 7, 7, 3, 3]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long").repartition(3)
    boxes = spark.createDataFrame(CONTAINERS, "container_name string, capacity_tokens int")
    rows = P.packed(df, boxes, "doc_id").collect()
    for name, capacity in CONTAINERS:
        mine, used = [r for r in rows if r.container_name == name], defaultdict(list)
        assert Counter({r.doc_id: 0 for r in mine}).keys() == set(range(len(lengths)))
        for r in mine:
            if r.container_no is not None:
                used[r.container_no].append((r.token_offset, r.token_offset + r.n_tokens))
            else:
                assert lengths[r.doc_id] == 0
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
        for i, n in enumerate(lengths):
            parts = sorted((r.piece, r.token_from, r.n_tokens) for r in mine if r.doc_id == i)
            assert sum(p[2] for p in parts) == n and (len(parts) == 1 or n > capacity)
        assert sorted(used) == list(range(len(used)))
    assert P.packed(df.limit(0), boxes, "doc_id").count() == 0
    assert {r.container_name for r in P.fill(P.packed(df, boxes, "doc_id"), boxes).collect()} == {"s", "l"}


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1, max_size=12))
def test_plan_places_all_and_stays_near_the_bound(counts):
    plan, room, firsts = P.fit_plan(counts, 30), defaultdict(list), defaultdict(int)
    for n, runs in plan.items():
        ends = [r[0] for r in runs[1:]] + [counts[n]]
        for (first, per, container, offset), end in zip(runs, ends, strict=True):
            assert first == firsts[n] and (end - first) % per == 0
            firsts[n] = end
            for k in range(end - first):
                room[container + k // per].append((offset + k % per * n, offset + k % per * n + n))
    assert all(firsts[n] == c for n, c in counts.items())
    for spans in room.values():
        spans.sort()
        assert spans[-1][1] <= 30 and all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
    assert len(room) <= 11 / 9 * -(-sum(n * c for n, c in counts.items()) // 30) * 1.5 + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 9), min_size=1, max_size=7), st.integers(1, 4))
def test_buckets_have_the_least_padding(counts, k):
    lengths = sorted(counts)

    def padding(ends):
        return sum((min(e for e in ends if e >= n) - n) * c for n, c in counts.items())

    best = min(padding((*c, lengths[-1])) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
    assert padding(P.length_buckets(counts, k)) == best


def test_batches(spark):
    df = spark.createDataFrame([(i, 1 + i % 9) for i in range(100)], "doc_id long, n_tokens long")
    boxes = spark.createDataFrame(CONTAINERS, "container_name string, capacity_tokens int")
    rows = P.bucketed(df, boxes, "doc_id", 3).collect()
    size = Counter((r.container_name, r.bucket_end, r.batch_no) for r in rows)
    assert len(rows) == 200 and all(n * end <= dict(CONTAINERS)[name] for (name, end, _), n in size.items())
