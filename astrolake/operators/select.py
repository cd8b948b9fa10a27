"""Frame selection: percent, relative, Otsu, utility, spread, budget.

All ranks are spread ranks (``functions.scan.ranked``); cut-offs that only need counts use
aggregates, so a session with a third of all frames never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from astrolake.functions.scan import attach, exact_quantiles, lag_by, ranked
from astrolake.session import cut

BINS = 256


def default_percent(total: Column) -> Column:
    return F.when(total <= 60, 70.0).when(total <= 300, 50.0).otherwise(30.0)


def by_sharpness(df: DataFrame, keys: list[str], **kw) -> DataFrame:
    return ranked(df, keys, "sharpness", "frame", desc=True, total="total", **kw)


def floor_count(total: Column, share: float = 0.10) -> Column:
    return F.least(total, F.greatest(F.lit(3), F.bround(total * share)))


def select_percent(df: DataFrame, keys: list[str], percent: float | None = None) -> DataFrame:
    r = by_sharpness(df, keys)
    p = F.lit(float(percent)) if percent else default_percent(F.col("total"))
    keep = F.greatest(F.lit(1), F.bround(F.col("total") * p / 100))
    return r.where(F.col("rk") <= keep)


def select_relative(df: DataFrame, keys: list[str], threshold: float = 0.75) -> DataFrame:
    """Within a share of the sharpest, never fewer than max(3, 10 %)."""
    best = df.groupBy(*keys).agg(F.max("sharpness").alias("best"))
    r = attach(by_sharpness(df, keys), cut(best), keys)
    return r.where((F.col("sharpness") >= threshold * F.col("best")) | (F.col("rk") <= floor_count(F.col("total")))).drop("best")


def otsu_threshold(df: DataFrame, keys: list[str]) -> DataFrame:
    """256-bin histogram split of the largest between-class variance; threshold is the bin centre."""
    rng = cut(df.groupBy(*keys).agg(F.min("sharpness").alias("lo"), F.max("sharpness").alias("hi"), F.count(F.lit(1)).alias("n")))
    b = F.least(F.floor((F.col("sharpness") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
    h = attach(df, rng, keys).where(F.col("hi") > F.col("lo")).groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / BINS
    h = h.withColumn("centre", centre)
    left = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    right = W.partitionBy(*keys).orderBy("bin").rowsBetween(1, W.unboundedFollowing)
    mass = F.col("c") * F.col("centre")
    h = h.select(*keys, "bin", "centre", F.sum("c").over(left).alias("w1"), F.sum("c").over(right).alias("w2"),
                 F.sum(mass).over(left).alias("m1"), F.sum(mass).over(right).alias("m2")).where(F.col("w2") > 0)
    d = F.col("m1") / F.col("w1") - F.col("m2") / F.col("w2")
    var = F.round(F.col("w1") * F.col("w2") * d * d, 6)
    best = h.groupBy(*keys).agg(F.max_by("centre", F.struct(var, -F.col("bin"))).alias("threshold"))
    return rng.join(best, keys, "left")


def select_otsu(df: DataFrame, keys: list[str]) -> DataFrame:
    """Otsu split with its small, uniform and calm-window exceptions."""
    t = cut(otsu_threshold(df, keys))
    r = attach(by_sharpness(df, keys), t, keys)
    n = F.col("total")
    spread = (F.col("hi") - F.col("lo")) / F.greatest("hi", F.lit(1e-6))
    reason = F.when(n < 4, "few").when(F.col("hi") - F.col("lo") < 1e-4, "uniform").when((n >= 5) & (spread < 0.06), "calm").otherwise("otsu")
    calm = F.least(n, F.greatest(F.lit(3), F.bround(n * 0.75)))
    keep = (
        F.when(reason.isin("few", "uniform"), F.lit(True)).when(reason == "calm", F.col("rk") <= calm)
        .otherwise((F.col("sharpness") >= F.col("threshold")) | (F.col("rk") <= floor_count(n))))
    return r.withColumn("reason", reason).where(keep).drop("lo", "hi", "n")


def select_utility(df: DataFrame, keys: list[str], alpha: float = 2.0, beta: float = 1.0) -> DataFrame:
    """Keep the k with the largest mean(q[:k])^alpha * sqrt(k/n)^beta, k within 10..95 percent."""
    rng = df.groupBy(*keys).agg(F.min("sharpness").alias("lo"), F.max("sharpness").alias("hi"))
    q = (F.col("sharpness") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6)
    r = by_sharpness(attach(df, cut(rng), keys), keys, running={"qs": q})
    n, k = F.col("total"), F.col("rk")
    u = F.pow(F.col("qs") / k, F.lit(alpha)) * F.pow(F.sqrt(k / n), F.lit(beta))
    lo_k = floor_count(n)
    hi_k = F.least(n, F.greatest(lo_k, F.bround(n * 0.95)))
    best = r.where((k >= lo_k) & (k <= hi_k)).groupBy(*keys).agg(F.max_by("rk", F.struct(F.round(u, 9), -F.col("rk"))).alias("best_k"))
    r = attach(r, cut(best), keys)
    small = (n < 4) | (F.col("hi") - F.col("lo") < 1e-4)
    return r.where(small | (k <= F.col("best_k"))).drop("lo", "hi", "qs")


def filter_frames(df: DataFrame, keys: list[str], best_percent: float = 80.0, min_roundness: float = 0.94) -> DataFrame:
    """Best share by weighted FWHM, and an absolute roundness floor."""
    r = ranked(df, keys, "wfwhm", "frame", total="total")
    return r.where((F.col("rk") <= F.floor(F.col("total") * best_percent / 100)) & (F.round("roundness", 9) >= min_roundness))


def flag_frames(df: DataFrame, keys: list[str], min_ratio: float = 0.2) -> DataFrame:
    """Signal against the P90 of the session; low frames lose their sharpness."""
    q = exact_quantiles(df, keys, "signal", {"p90": (0.9, "pL")})
    ratio = F.col("signal") / F.nullif(F.col("p90"), F.lit(0.0))
    flags = F.array_compact(F.array(
        F.when(ratio < min_ratio, "low_signal"), F.when(ratio < min_ratio / 4, "target_lost"), F.when(F.col("saturation") > 0.07, "clipping")))
    return attach(df, cut(q), keys).withColumn("ratio", ratio).withColumn("flags", F.array_join(flags, ",")).withColumn(
        "sharpness", F.when(ratio < min_ratio, 0.0).otherwise(F.col("sharpness"))).drop("p90")


def is_monotonic(df: DataFrame, keys: list[str], order: str, ts: str) -> DataFrame:
    """Are timestamps strictly increasing along the arrival order?"""
    l = lag_by(df.select(*keys, order, ts), keys, order, ts, "_prev")
    return l.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(ts) <= F.col("_prev")).alias("violations")
    ).withColumn("monotonic", F.col("violations") == 0)


def select_spread(df: DataFrame, keys: list[str], t: str, limit: int, bins: int = 10) -> DataFrame:
    """Round-robin over equal-width time bins, sharpest left in each bin first, up to ``limit``.

    No bin can give more than ``limit`` frames, so both rank filters keep only the group heads.
    """
    rng = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    b = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col(t) - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1))).otherwise(0)
    j = attach(df, cut(rng), keys).withColumn("bin", b.cast("int")).drop("_a", "_b")
    inner = W.partitionBy(*keys, "bin").orderBy(F.desc("sharpness"), "frame")
    j = j.withColumn("turn", F.row_number().over(inner)).where(F.col("turn") <= limit)
    outer = W.partitionBy(*keys).orderBy("turn", "bin")
    return j.withColumn("pick", F.row_number().over(outer)).where(F.col("pick") <= limit)


def within_budget(df: DataFrame, keys: list[str], size: str, fixed: float, free: float, factor: float = 1.25) -> DataFrame:
    """Longest prefix (sharpest first) whose estimated peak factor*(sum + fixed) fits."""
    r = by_sharpness(df, keys, running={"used": F.col(size)})
    return r.where(factor * (F.col("used") + fixed) <= free)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First k of every group; the rank filter lets each task drop all but its own group heads."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def recommend(df: DataFrame, keys: list[str], slack: float = 0.95) -> DataFrame:
    """Among candidates within 5 % of the best separation: least noise, then cost, then id."""
    best = df.groupBy(*keys).agg(F.max("separation").alias("best"))
    j = df.join(best, keys).where(F.col("separation") >= slack * F.col("best"))
    return j.groupBy(*keys).agg(F.min(F.struct("noise", "cost", "id")).alias("_m"), F.count(F.lit(1)).alias("eligible")).select(
        *keys, "eligible", "_m.noise", "_m.cost", "_m.id")


def accept_if_better(df: DataFrame, keys: list[str], noise_cap: float = 0.95, detail_floor: float = 0.97) -> DataFrame:
    """A candidate wins only with noise <= 0.95 x and detail >= 0.97 x the best so far."""
    best = df.groupBy(*keys).agg(F.min(F.struct("step", "noise", "detail")).alias("_b"))
    j = df.join(best, keys).where(F.col("step") > F.col("_b.step"))
    ok = (F.col("noise") <= noise_cap * F.col("_b.noise")) & (F.col("detail") >= detail_floor * F.col("_b.detail"))
    return j.select(*keys, "step", ok.alias("accepted"))


def shape_test(df: DataFrame, keys: list[str], order: str, value: str, flat: float = 0.2) -> DataFrame:
    """Shape of a response over a bounded parameter ladder: monotonic, saturating or step."""
    w = W.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(w)).where(F.col("_d").isNotNull())
    g = d.groupBy(*keys).agg(
        F.min("_d").alias("dmin"), F.max("_d").alias("dmax"), F.count(F.lit(1)).alias("steps"),
        F.min_by("_d", order).alias("first"), F.max_by("_d", order).alias("last"), F.sum(F.abs("_d")).alias("travel"), F.max(F.abs("_d")).alias("jump"))
    mono = (F.col("dmin") >= 0) | (F.col("dmax") <= 0)
    ratio = F.abs("last") / F.nullif(F.abs("first"), F.lit(0.0))
    shape = F.when(F.col("jump") >= 0.9 * F.col("travel"), "step").when(mono & (ratio <= flat), "saturating").when(mono, "monotonic").otherwise("irregular")
    return g.select(*keys, "steps", ratio.alias("end_ratio"), shape.alias("shape"))
