"""Mixing sources to target shares of the total size, by entropy balancing.

Each text gets a rate between 0 and the cap of its source. Wanted are the rates nearest to an even use
(``EVEN`` uses of each text, half the cap where that is less), in the sense of relative entropy per
token, under constraints that all sources share:

* every source gets its target tokens;
* the mean logarithm of a text's length, over the tokens of the mix, stays that of the corpus, so that
  a source of short notes doesn't shorten the whole. Where caps don't allow it, it is met as far as
  they do: the constraint is soft by ``SOFT``.

The solution tilts the even rates exponentially along the constraint functions x, one per source and
``z = log length - mean``: ``cap * sigmoid(even + l_source + l_length * z)``. The multipliers ``l`` solve
the convex dual by Newton steps; gradient and curvature are sums over all texts, one aggregate of one
row a source per step. Rates are then rounded to whole copies by a hash of the key, and what rounding
leaves over is taken away by moving each source's rounding point.

Defined results: sources are compared trimmed and in lower case; texts whose source is null or has
no target, and texts without tokens, are used 0 times; a source with a target but without texts
gets none, the others keep their proportions; without ``total`` the mix is as large as the caps
allow all targets to be met, but not larger than the tokens there are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Newton steps at most, relative error of the constraints at which they end, longest step of a multiplier, bins of the rounding point.
STEPS, NEAR, LONGEST_STEP, BINS = 40, 1e-9, 2.0, 4096
#: Even uses of a text, and softness of the constraint on lengths: part of the tokens by which it may miss for each unit of its multiplier.
EVEN, SOFT = 1.0, 1e-3
#: A source planned this near to its cap uses every text to the cap.
FULL = 0.999


def source_name(column: Column) -> Column:
    return F.lower(F.trim(column))


def _lookup(values: dict[str, float], of: Column) -> Column:
    """A number per source; there are as many as targets."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.try_element_at(F.create_map(*pairs), of) if pairs else F.lit(None).cast("double")


def plan(lengths: DataFrame, targets: DataFrame, total: float | None = None) -> dict[str, dict[str, float]]:
    """Per source: cap, wanted tokens, whether it is used to the cap, even log odds, multiplier; and the corpus' mean log length with its multiplier."""
    rows = {r.source: r for r in targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).where("source is not null").collect()}
    sums = (F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.ln("n_tokens")).alias("logs"))
    held = {r.source: r for r in lengths.where("n_tokens > 0").groupBy("source").agg(*sums).where(F.col("source").isin(list(rows))).collect()}
    live = sorted(s for s, r in rows.items() if s in held and (r.share or 0) > 0 and (r.cap or 0) > 0)
    if not live:
        return {}
    shares = sum(rows[s].share for s in live)
    most = min(rows[s].cap * held[s].tokens * shares / rows[s].share for s in live)
    size = min(most, float(sum(h.tokens for h in held.values()))) if total is None else total
    mean = sum(held[s].logs for s in live) / sum(held[s].tokens for s in live)
    out = {}
    for s in live:
        cap, want = float(rows[s].cap), size * rows[s].share / shares
        even = min(EVEN, cap / 2)
        out[s] = {"cap": cap, "want": want, "full": float(want >= FULL * cap * held[s].tokens), "even": math.log(even / (cap - even)), "l": 0.0, "mean": mean, "l_length": 0.0}
    return out


def rate(p: dict[str, dict[str, float]], source: Column, tokens: Column) -> Column:
    """Tilted rate of a text."""
    cap, full = (_lookup({s: v[k] for s, v in p.items()}, source) for k in ("cap", "full"))
    one = next(iter(p.values()), {"mean": 0.0, "l_length": 0.0})
    odds = _lookup({s: v["even"] + v["l"] for s, v in p.items()}, source) + one["l_length"] * (F.ln(tokens) - one["mean"])
    return F.when(tokens <= 0, 0.0).when(full > 0, cap).otherwise(F.coalesce(cap / (1 + F.exp(-odds)), F.lit(0.0)))


def solved(lengths: DataFrame, p: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """The plan with the multipliers that meet the constraints."""
    live = [s for s, v in p.items() if not v["full"]]
    if not live:
        return p
    mean, allowed = p[live[0]]["mean"], SOFT * sum(v["want"] for v in p.values())
    texts = lengths.where(F.col("source").isin(list(p)) & (F.col("n_tokens") > 0))
    n, z = F.col("n_tokens"), F.ln("n_tokens") - mean
    for _ in range(STEPS):
        cap = _lookup({s: v["cap"] for s, v in p.items()}, F.col("source"))
        bend = n * F.col("r") * (1 - F.col("r") / cap)
        sums = (F.sum(n * F.col("r")).alias("have"), F.sum(n * F.col("r") * z).alias("have_z"), F.sum(bend).alias("c"), F.sum(bend * z).alias("cz"), F.sum(bend * z * z).alias("czz"))
        got = {r.source: r for r in texts.withColumn("r", rate(p, F.col("source"), n)).groupBy("source").agg(*sums).collect()}
        gradient = np.array([p[s]["want"] - got[s].have for s in live] + [-sum(r.have_z for r in got.values()) - allowed * p[live[0]]["l_length"]])
        if max(abs(g) / w for g, w in zip(gradient, [p[s]["want"] for s in live] + [allowed / SOFT], strict=True)) < NEAR:
            break
        bent = np.diag([got[s].c for s in live] + [sum(got[s].czz for s in live) + allowed])
        bent[-1, :-1] = bent[:-1, -1] = [got[s].cz for s in live]
        step = np.linalg.solve(bent + 1e-12 * np.trace(bent) * np.eye(len(bent)), gradient)
        step *= min(1.0, LONGEST_STEP / np.abs(step).max())
        for s, move in zip(live, step[:-1], strict=True):
            p[s]["l"] += float(move)
        for v in p.values():
            v["l_length"] += float(step[-1])
    return p


def uses(lengths: DataFrame, targets: DataFrame, key: str, total: float | None = None) -> DataFrame:
    """(key, source, n_tokens, uses) of every text. lengths: (key, source, n_tokens), read once a step, so it should be cheap to read."""
    lengths = lengths.withColumn("source", source_name(F.col("source")))
    p = solved(lengths, plan(lengths, targets, total))
    unit = (F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)
    rated = lengths.withColumn("r", rate(p, F.col("source"), F.col("n_tokens"))).withColumn("low", F.floor("r")).withColumn("d", unit - (F.col("r") - F.col("low")))
    cap = F.coalesce(_lookup({s: v["cap"] for s, v in p.items()}, F.col("source")), F.lit(0.0))
    # tokens that rounding at each point would give; one number per source and bin
    base = {r.source: r.t for r in rated.where(F.col("source").isin(list(p))).groupBy("source").agg(F.sum(F.col("low") * F.col("n_tokens")).alias("t")).collect()}
    bins = rated.where(F.col("source").isin(list(p)) & (F.col("low") < cap) & (F.col("n_tokens") > 0)).groupBy("source", F.floor((F.col("d") + 1) / 2 * BINS).alias("b")).agg(F.sum("n_tokens").alias("t")).collect()
    points = dict.fromkeys(p, 0.0)
    for s, v in p.items():
        have, best = float(base.get(s) or 0), (abs(v["want"] - float(base.get(s) or 0)), -1.0)
        for b, t in sorted((r.b, r.t) for r in bins if r.source == s):
            have += t
            best = min(best, (abs(v["want"] - have), 2 * (b + 1) / BINS - 1))
        points[s] = best[1]
    up = (F.col("d") < _lookup(points, F.col("source"))) & (F.col("low") < cap) & (F.col("n_tokens") > 0)
    return rated.select(key, "source", "n_tokens", F.coalesce(F.least(F.col("low") + F.when(up, 1).otherwise(0), cap), F.lit(0)).cast("int").alias("uses"))


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, documents, actual_share) of every target."""
    got = used.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.count_if(F.col("uses") > 0).alias("documents"))
    whole = used.agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("whole"))
    wanted = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    out = F.broadcast(wanted).join(got, "source", "left").join(F.broadcast(whole))
    return out.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"))
