"""Distributed order statistics, ranks and prefix scans.

A plain ``Window.partitionBy(key)`` or an exact ``percentile`` puts a whole group into one
task.  When a single session (or source, or event type) can hold a third of all rows that
task never ends.  The helpers here give the same exact answers while a group is spread over
many tasks: a first pass collects bounded, partially aggregated sketches or per-chunk totals,
a second pass places every row relative to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from astrolake.session import cut, hold

#: groups up to this many rows are ranked whole; above it only the rows near a target rank are
SMALL_GROUP = 4096
#: half width of the rank band kept around each requested quantile
BAND = 0.001
#: accuracy of the sketch that places the band (its rank error is one fifth of the band)
SKETCH_ACCURACY = 5000
#: a per-group table up to this many rows (each under a kilobyte) is broadcast
BROADCAST_ROWS = 50_000
#: tasks a group is spread over when the per-group table is too large to broadcast
SALTS = 16
#: number of value cuts used to spread a ranked group over tasks
RANK_CUTS = 31


def _same(left: str, right: str, keys: list[str]) -> Column:
    conds = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, conds)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join that also matches null keys; ``right`` contributes its non-key columns."""
    if not keys:
        raise ValueError("join_on needs at least one key")
    extra = [c for c in right.columns if c not in keys]
    joined = left.alias("l").join(right.alias("r"), _same("l", "r", keys), how)
    return joined.select("l.*", *[F.col(f"r.{c}") for c in extra])


def attach(big: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Attach one kept row per group to all rows of the group without gathering any group.

    The row count of ``per_group`` is checked: a small one is broadcast and ``big`` does not move.
    Beyond the limit both sides are salted, the small one repeated per salt, so that a group with a
    third of all rows is spread over ``SALTS`` tasks and later aggregations still combine first.
    """
    if per_group.count() <= BROADCAST_ROWS:
        return join_on(big, F.broadcast(per_group), keys)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in big.columns]), F.lit(SALTS)).cast("int"))
    copies = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_on(salted, copies, [*keys, "_salt"]).drop("_salt")


def target_rank(n: Column, p: float, dialect: str) -> tuple[Column, Column, Column]:
    """(low rank, high rank, weight of high) for a quantile dialect.

    ``pL`` linear interpolation, ``pF`` floor index ``min(int(n*p), n-1)``,
    ``upper`` the upper of the two middle values.
    """
    if dialect == "pL":
        h = (n - 1) * F.lit(float(p))
        return F.floor(h), F.ceil(h), h - F.floor(h)
    if dialect == "pF":
        i = F.least(F.floor(n * F.lit(float(p))), n - 1)
        return i, i, F.lit(0.0)
    if dialect == "upper":
        i = F.floor(n / 2)
        return i, i, F.lit(0.0)
    raise ValueError(dialect)


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: Column | str,
    spec: dict[str, tuple[float, str]],
    count_as: str | None = None,
) -> DataFrame:
    """Exact quantiles of groups of any size, one row per group that has a value.

    Pass 1 sketches each group (bounded partial aggregates).  Pass 2 keeps individual values only
    inside narrow rank bands around the wanted ranks and collapses everything between the bands
    into one counted row, so what reaches the final window is a small fraction of the group.
    """
    keys = list(keys)
    col = F.col(value) if isinstance(value, str) else value
    base = df.select(*keys, col.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    probs = sorted({0.5 if d == "upper" else p for p, d in spec.values()})
    bounds = sorted({b for p in probs for b in (max(p - BAND, 0.0), min(p + BAND, 1.0))})
    at = {b: i for i, b in enumerate(bounds)}
    cuts = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [float(b) for b in bounds], SKETCH_ACCURACY).alias("_c"),
    )
    j = attach(base, cut(cuts), keys)
    v = F.col("_v")
    inside = F.col("_n") <= SMALL_GROUP
    for p in probs:
        lo, hi = at[max(p - BAND, 0.0)], at[min(p + BAND, 1.0)]
        low_ok = F.lit(True) if p - BAND <= 0 else v >= F.col("_c")[lo]
        high_ok = F.lit(True) if p + BAND >= 1 else v <= F.col("_c")[hi]
        inside = inside | (low_ok & high_ok)
    slot = reduce(lambda a, b: a + b, [(v > F.col("_c")[i]).cast("int") for i in range(len(bounds))])
    packed = (
        j.select(*keys, "_n", "_v", slot.alias("_s"), F.when(inside, v).alias("_r"))
        .groupBy(*keys, "_s", "_r")
        .agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_m"), F.first("_n").alias("_n"))
    )
    w = W.partitionBy(*keys).orderBy("_m").rowsBetween(W.unboundedPreceding, 0)
    ranked = packed.withColumn("_end", F.sum("_k").over(w)).withColumn("_start", F.col("_end") - F.col("_k"))
    n = F.col("_n")
    aggs = []
    for name, (p, dialect) in spec.items():
        lo, hi, _ = target_rank(n, p, dialect)
        for tag, r in (("lo", lo), ("hi", hi)):
            aggs.append(F.max(F.when((r >= F.col("_start")) & (r < F.col("_end")), F.col("_m"))).alias(f"_{name}_{tag}"))
    picked = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *aggs)
    outs = []
    for name, (p, dialect) in spec.items():
        _, _, t = target_rank(n, p, dialect)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * t).alias(name))
    if count_as:
        outs.append(n.alias(count_as))
    return picked.select(*keys, *outs)


def exact_median(df: DataFrame, keys: list[str], value: Column | str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: (0.5, "pL")})


def median_mad(df: DataFrame, keys: list[str], value: str, med: str = "med", mad: str = "mad") -> DataFrame:
    """Median and median absolute deviation of groups of any size."""
    m = cut(exact_median(df, keys, value, med))
    dev = attach(df.select(*keys, value), m, keys).withColumn("_d", F.abs(F.col(value) - F.col(med)))
    return join_on(m, exact_median(dev, keys, "_d", mad), keys)


def ranked(
    df: DataFrame,
    keys: list[str],
    value: str,
    tie: str,
    desc: bool = False,
    name: str = "rk",
    total: str | None = None,
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact 1-based rank by (value, tie) inside a group, plus optional running sums.

    Rows are spread over buckets cut at sketched quantiles of the value; a value frequent enough
    to be a cut gets its own bucket, cut again by the (numeric) tie breaker.  Bucket totals are
    prefix-summed, so no task sorts more than a slice of a group.
    """
    running = running or {}
    order = -F.col(value) if desc else F.col(value)
    src = df.withColumn("_v", order.cast("double"))
    probs = [i / (RANK_CUTS + 1) for i in range(1, RANK_CUTS + 1)]
    cuts = src.groupBy(*keys).agg(
        F.percentile_approx("_v", probs, 1000).alias("_cv"),
        F.percentile_approx(F.col(tie).cast("double"), probs, 1000).alias("_ct"),
    )
    cuts = cut(cuts)  # one row per group; kept so that the input is not sketched again by every reader
    j = attach(src, cuts, keys)
    # arrays are walked by short expressions, each once a row: written out they are too long to be compiled
    at = lambda c, keep: F.when(c.isNotNull(), F.size(keep))
    v, t = F.col("_v"), F.col(tie).cast("double")
    j = hold(j, "_ge", F.coalesce(at(v, F.filter("_cv", lambda c: v >= c)), F.lit(2 * RANK_CUTS)))
    j = hold(j, "_gt", F.coalesce(at(v, F.filter("_cv", lambda c: v > c)), F.lit(0)))
    j = hold(j, "_t", F.when(F.col("_ge") != F.col("_gt"), at(t, F.filter("_ct", lambda c: t >= c))).otherwise(0))
    j = j.withColumn("_b", F.col("_ge") + F.col("_gt")).drop("_cv", "_ct", "_ge", "_gt")
    for i, (rname, expr) in enumerate(running.items()):
        j = j.withColumn(f"_x{i}", expr)
    totals = j.groupBy(*keys, "_b", "_t").agg(
        F.count(F.lit(1)).alias("_k"), *[F.sum(f"_x{i}").alias(f"_s{i}") for i in range(len(running))]
    )
    before = W.partitionBy(*keys).orderBy("_b", "_t").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offs = totals.select(
        *keys, "_b", "_t",
        F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_off"),
        F.sum("_k").over(whole).alias("_all"),
        *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0.0)).alias(f"_o{i}") for i in range(len(running))],
    )
    offs = cut(offs)  # at most a few thousand rows per group
    bucket = W.partitionBy(*keys, "_b", "_t").orderBy("_v", tie)
    upto = bucket.rowsBetween(W.unboundedPreceding, 0)
    out = join_on(j, offs, [*keys, "_b", "_t"])
    cols = [F.col(c) for c in df.columns]
    cols.append((F.row_number().over(bucket) + F.col("_off")).cast("long").alias(name))
    if total:
        cols.append(F.col("_all").alias(total))
    for i, rname in enumerate(running):
        cols.append((F.sum(f"_x{i}").over(upto) + F.col(f"_o{i}")).alias(rname))
    return out.select(*cols)


def rank_by_id(df: DataFrame, keys: list[str], id_col: str, name: str = "rk", width: int = 100_000) -> DataFrame:
    """0-based position by a unique integer id inside a group; id ranges bound every window."""
    src = df.withColumn("_chunk", F.floor(F.col(id_col) / width))
    totals = src.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_k"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offs = totals.select(*keys, "_chunk", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_off"))
    inner = W.partitionBy(*keys, "_chunk").orderBy(id_col)
    out = join_on(src, offs, [*keys, "_chunk"])
    return out.select(*df.columns, (F.row_number().over(inner) - 1 + F.col("_off")).cast("long").alias(name))


def carry_last(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    name: str,
    width: int = 100_000,
    inclusive: bool = True,
) -> DataFrame:
    """Latest non-null ``value`` at or before each row (as-of scan along an integer order).

    Inside a chunk a row frame does it; between chunks only one carried value per chunk moves.
    """
    src = df.withColumn("_chunk", F.floor(F.col(order) / width))
    inner = W.partitionBy(*keys, "_chunk").orderBy(order)
    frame = inner.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    tails = src.where(F.col(value).isNotNull()).groupBy(*keys, "_chunk").agg(F.max_by(value, order).alias("_tail"))
    chunks = src.select(*keys, "_chunk").distinct()
    chunks = join_on(chunks, tails, [*keys, "_chunk"], "left")
    outer = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = chunks.select(*keys, "_chunk", F.last("_tail", True).over(outer).alias("_carry"))
    out = join_on(src.withColumn("_here", F.last(value, True).over(frame)), carry, [*keys, "_chunk"])
    return out.select(*df.columns, F.coalesce("_here", "_carry").alias(name))


def carry_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 100_000
) -> DataFrame:
    """Running sum along an integer order, chunk by chunk."""
    src = df.withColumn("_chunk", F.floor(F.col(order) / width)).withColumn("_x", value)
    inner = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    totals = src.groupBy(*keys, "_chunk").agg(F.sum("_x").alias("_k"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offs = totals.select(*keys, "_chunk", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_off"))
    out = join_on(src.withColumn("_here", F.coalesce(F.sum("_x").over(inner), F.lit(0))), offs, [*keys, "_chunk"])
    return out.select(*df.columns, (F.col("_here") + F.col("_off")).alias(name))


def lag_by(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 100_000
) -> DataFrame:
    """Value of the previous row along an integer order; chunk borders are bridged by one row each."""
    src = df.withColumn("_chunk", F.floor(F.col(order) / width))
    inner = W.partitionBy(*keys, "_chunk").orderBy(order)
    ends = src.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(value), F.col(order)).alias("_end"))
    outer = W.partitionBy(*keys).orderBy("_chunk")
    carry = ends.select(*keys, "_chunk", F.lag("_end").over(outer)[value].alias("_carry"))
    out = join_on(
        src.withColumn("_here", F.lag(value).over(inner)).withColumn("_first", F.row_number().over(inner) == 1),
        carry,
        [*keys, "_chunk"],
    )
    return out.select(*df.columns, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_here")).alias(name))


def carry_max(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 100_000) -> DataFrame:
    """Largest ``value`` strictly before each row along an integer order, chunk by chunk."""
    src = df.withColumn("_chunk", F.floor(F.col(order) / width))
    inner = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    tops = src.groupBy(*keys, "_chunk").agg(F.max(value).alias("_top"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = tops.select(*keys, "_chunk", F.max("_top").over(before).alias("_carry"))
    out = join_on(src.withColumn("_here", F.max(value).over(inner)), carry, [*keys, "_chunk"])
    return out.select(*df.columns, F.greatest("_here", "_carry").alias(name))
