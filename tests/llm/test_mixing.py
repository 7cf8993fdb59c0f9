import math

import numpy as np

from normforge.llm import mixing as M


def table(spark, sources):
    rows, i = [], 0
    for name, n in sources:
        for k in range(n):
            rows.append((i, name, 20 + (k * 37) % 180))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_shares_and_caps(spark):
    df = table(spark, [("a", 900), (" A", 100), ("b", 400), ("tiny", 60), (None, 20), ("other", 20)])
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("tiny", 0.2, 5), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    used = M.uses(df, targets, "doc_id")
    rows = used.collect()
    caps = {"a": 1, "b": 2, "tiny": 5}
    assert len(rows) == df.count() and all(0 <= r.uses <= caps.get(r.source, 0) for r in rows)
    got = {r.source: r.actual_share for r in M.shares(used, targets).collect()}
    assert abs(got["a"] - 0.5) < 0.01 and abs(got["b"] - 0.3) < 0.01 and abs(got["tiny"] - 0.2) < 0.01 and got["none"] == 0


def test_a_missing_source_leaves_the_others_their_proportions(spark):
    df = table(spark, [("a", 300), ("b", 300)])
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.4, 2), ("gone", 0.2, 9)], "source string, target_share double, max_repeats int")
    got = {r.source: r.actual_share for r in M.shares(M.uses(df, targets, "doc_id"), targets).collect()}
    assert abs(got["a"] - 0.5) < 0.02 and abs(got["b"] - 0.5) < 0.02 and got["gone"] == 0


def test_beyond_the_caps_every_text_is_used_to_its_cap(spark):
    df = table(spark, [("a", 50), ("b", 50)])
    targets = spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 2)], "source string, target_share double, max_repeats int")
    rows = M.uses(df, targets, "doc_id", total=1e6).collect()
    assert all(r.uses == 2 for r in rows)


def bisected(f, low=-60.0, high=60.0):
    """Where the decreasing function f is 0."""
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


def test_multipliers_agree_with_another_solver(spark):
    """Nested bisection on the same optimality conditions, over sources whose lengths differ so that all constraints bind."""
    rng = np.random.default_rng(1)
    sizes = {"long": rng.integers(200, 3000, 150), "short": rng.integers(5, 60, 400), "mixed": rng.integers(5, 2000, 200)}
    df = spark.createDataFrame([(i, s, int(n)) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("long", 0.5, 2), ("short", 0.1, 4), ("mixed", 0.4, 3)], "source string, target_share double, max_repeats int")
    p = M.solved(df, M.plan(df, targets))
    mean = p["long"]["mean"]

    def rates(s, l_source, l_length):
        return p[s]["cap"] / (1 + np.exp(-(p[s]["even"] + l_source + l_length * (np.log(sizes[s]) - mean))))

    def sources(l_length):
        return {s: bisected(lambda x, s=s: p[s]["want"] - (rates(s, x, l_length) * sizes[s]).sum()) for s in sizes}

    def missed(l_length):
        found = sources(l_length)
        return -sum((rates(s, found[s], l_length) * n * (np.log(n) - mean)).sum() for s, n in sizes.items()) - M.SOFT * sum(v["want"] for v in p.values()) * l_length

    l_length = bisected(missed)
    assert abs(l_length) > 0.05 and abs(p["long"]["l_length"] - l_length) < 1e-5
    for s, x in sources(l_length).items():
        assert abs(x) > 0.05 and abs(p[s]["l"] - x) < 1e-5
    used = M.uses(df, targets, "doc_id").collect()
    tokens = sum(r.uses * r.n_tokens for r in used)
    assert all(abs(sum(r.uses * r.n_tokens for r in used if r.source == t.source) / tokens - t.target_share) < 0.01 for t in targets.collect())
    kept = sum(r.uses * r.n_tokens * math.log(r.n_tokens) for r in used) / tokens
    assert abs(kept - mean) < 0.03


def test_empty(spark):
    df = table(spark, [("a", 2)])
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert M.uses(df.limit(0), targets, "doc_id").count() == 0
    assert [r.uses for r in M.uses(df, targets.limit(0), "doc_id").collect()] == [0, 0]
