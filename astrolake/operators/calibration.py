"""Calibration masters for light frames by several tolerances, some of which may be absent on both sides.

Lights and masters are reduced to their distinct settings, which meet in an equi join on a grid over all keys at once and on
which keys are present; so no table of lights times masters arises, and a setting shared by very many frames is matched once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from astrolake.functions.scan import join_on
from astrolake.session import cut, shuffled


def present(c: Column) -> Column:
    """A setting as a double; what is not a finite number counts as absent, and -0 as 0."""
    v = c.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v + F.lit(0.0))


def with_settings(df: DataFrame, tol: dict[str, float], optional: tuple[str, ...] = ()) -> DataFrame:
    """Settings as doubles, with ``_mask`` (which of them are there); null where one that is not optional is absent."""
    df = df.withColumns({k: present(F.col(k)) for k in tol})
    mask = reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), 1 << i).otherwise(0) for i, k in enumerate(tol)])
    needed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in tol if k not in optional], F.lit(True))
    return df.withColumn("_mask", F.when(needed, mask))


def _cell(value: Column, width: float) -> Column:
    """The grid cell of a value; without a tolerance each value has its own."""
    cell = F.floor(value / width) if width > 0 else F.xxhash64(value)
    return F.when(value.isNotNull(), cell).otherwise(F.lit(0).cast("long"))


def best_for_settings(light: DataFrame, master: DataFrame, exact: list[str], tol: dict[str, float], optional: tuple[str, ...] = ()) -> DataFrame:
    """For each distinct light setting (exact..., tol...) with a match: ``best`` (score, mname, mid), ``tied`` and ``candidates``.

    A master matches when every tolerance key is there on both sides and within its tolerance; an ``optional`` key may be absent,
    on both sides only.  The score sums the deviations in units of their tolerances (as they are where the tolerance is 0); the
    lowest score wins, then the smallest name, then the smallest mid.  ``tied`` says that another name has the same score.
    """
    keys = list(tol)
    lights = with_settings(light, tol, optional).where("_mask is not null").select(*exact, *keys, "_mask").distinct()
    masters = with_settings(master, tol, optional).where("_mask is not null").groupBy(*exact, *keys, "_mask").agg(
        F.min(F.struct("mname", "mid")).alias("m"), F.max("mname").alias("last"), F.count(F.lit(1)).alias("k"))
    masters = masters.select(*exact, *[F.col(k).alias(f"m_{k}") for k in keys], "_mask", "m", "last", "k")
    if len(keys) == 1 and tol[keys[0]] > 0 and keys[0] not in optional:
        lights, masters = cut(lights), cut(masters)
        span = lights.agg(F.max(F.abs(keys[0]))).first()[0] or 0.0
        slack = max(tol[keys[0]] * 2e-9, span * 1e-13)
        if CELL * slack <= tol[keys[0]] / CHUNKS:
            return _best_on_line(lights, masters, exact, keys[0], tol[keys[0]], slack)
    for k, width in tol.items():
        lights = lights.withColumn(f"_c_{k}", _cell(F.col(k), width))
        c = _cell(F.col(f"m_{k}"), width)
        near = F.when(F.col(f"m_{k}").isNull(), F.array(c)).otherwise(F.sequence(c - 1, c + 1)) if width > 0 else F.array(c)
        masters = masters.withColumn(f"_c_{k}", F.explode(near))
    j = lights.join(masters, [*exact, "_mask", *[f"_c_{k}" for k in keys]])
    deltas = {k: F.abs(F.col(k) - F.col(f"m_{k}")) for k in keys}
    j = j.where(reduce(lambda a, b: a & b, [d.isNull() | (d <= tol[k]) for k, d in deltas.items()], F.lit(True)))
    score = reduce(lambda a, b: a + b, [F.coalesce(d / tol[k] if tol[k] > 0 else d, F.lit(0.0)) for k, d in deltas.items()], F.lit(0.0))
    j = j.withColumn("score", F.round(score, 9))
    g = j.groupBy(*exact, *keys).agg(F.min(F.struct("score", "m.mname", "m.mid")).alias("best"), F.max(F.struct((-F.col("score")).alias("s"), "last")).alias("_last"), F.sum("k").alias("candidates"))
    return g.select(*exact, *keys, "best", (F.col("_last.last") != F.col("best.mname")).alias("tied"), "candidates")


#: runs of values a tolerance is cut into, and the width of a fine cell in units of the slack
CHUNKS, CELL = 16, 500


def _best_on_line(lights: DataFrame, masters: DataFrame, exact: list[str], key: str, tol: float, slack: float) -> DataFrame:
    """``best_for_settings`` for one tolerance: masters are counted and the nearest found along the line, so pairs do not grow with both tables.

    Candidates are a difference of running counts between the two ends of the tolerance, drawn in by ``slack`` (far above what doubles round
    off, and above half a unit of the rounded score).  Only masters within the slack of an end, or of the lowest score on either side, are paired and compared exactly.
    """
    lights, masters = lights.dropna(subset=[*exact, key]), masters.dropna(subset=exact)
    x, m, ends = F.col(key), F.col(f"m_{key}"), {"at": F.col(key), "lo": F.col(key) - tol + slack, "hi": F.col(key) + tol - slack}
    probes = lights.select(*exact, key, F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), v.alias("v")) for i, v in enumerate(ends.values(), 1)])).alias("p"))
    line = masters.select(*exact, m.alias("v"), F.lit(0).alias("kind"), "k", m.alias("here")).unionByName(probes.select(*exact, key, "p.kind", "p.v"), allowMissingColumns=True)
    line = line.withColumn("chunk", F.floor(F.col("v") / (tol / CHUNKS)))
    group, run = W.partitionBy(*exact), W.partitionBy(*exact, "chunk")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    sums = line.groupBy(*exact, "chunk").agg(F.sum("k").alias("k"), F.min("here").alias("first"), F.max("here").alias("last"))
    sums = sums.select(*exact, "chunk", F.sum("k").over(before(group.orderBy("chunk"))).alias("off"), F.last("last", True).over(before(group.orderBy("chunk"))).alias("left"),
                       F.last("first", True).over(before(group.orderBy(F.desc("chunk")))).alias("right"))
    # masters come before probes of the same value in both directions
    up, down = upto(run.orderBy("v", "kind")), upto(run.orderBy(F.desc("v"), "kind"))
    line = line.select("*", F.sum("k").over(up).alias("n"), F.last("here", True).over(up).alias("l"), F.last("here", True).over(down).alias("r")).where("kind > 0").join(shuffled(sums), [*exact, "chunk"])
    count = lambda i: F.max(F.when(F.col("kind") == i, F.coalesce("n", F.lit(0)) + F.coalesce("off", F.lit(0))))
    side = lambda here, carried: F.max(F.when(F.col("kind") == 1, F.coalesce(here, carried)))
    found = line.groupBy(*exact, key).agg(side("l", "left").alias("l"), side("r", "right").alias("r"), (count(3) - count(2)).alias("inner"))
    gap = lambda c: F.abs(x - c)
    score = lambda c: F.round(gap(c) / tol, 9)
    lowest = F.least(*[F.when(gap(F.col(c)) <= tol, score(F.col(c))) for c in "lr"])
    found = cut(found.withColumn("score", lowest).where("score is not null"))
    cell = lambda c: F.floor(c / (CELL * slack))
    seats = [x - tol, x + tol, x - tol * F.col("score"), x + tol * F.col("score")]
    met = found.select("*", F.explode(F.array_distinct(F.array(*[cell(p + d) for p in seats for d in (-2 * slack, 2 * slack)]))).alias("cell"))
    j = met.join(shuffled(masters.withColumn("cell", cell(m))), [*exact, "cell"]).where(gap(m) <= tol)
    lead, rim = score(m) == F.col("score"), (m > ends["hi"]) | (m <= ends["lo"])
    j = j.select(*exact, key, "score", "inner", F.when(lead, F.col("m")).alias("m"), F.when(lead, F.col("last")).alias("last"), F.when(rim, F.col("k")).otherwise(0).alias("k"))
    g = j.groupBy(*exact, key, "score", "inner").agg(F.min("m").alias("m"), F.max("last").alias("last"), F.sum("k").alias("rim"))
    return g.select(*exact, key, F.struct("score", "m.mname", "m.mid").alias("best"), (F.col("last") != F.col("m.mname")).alias("tied"), (F.col("inner") + F.col("rim")).alias("candidates"))


def match_by_tolerances(light: DataFrame, master: DataFrame, exact: list[str], tol: dict[str, float], optional: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """id, status, mid, score, candidates of every light; in strict form a tie is an error and names no master.

    Rows with equal ids are matched each by its own settings.  Lights keep their order of magnitude: one row in, one row out.
    """
    best = best_for_settings(light, master, exact, tol, optional)
    l = light.select("id", *exact, *[present(F.col(k)).alias(k) for k in tol])
    j = join_on(l, shuffled(best), [*exact, *tol], "left") if exact or tol else l
    tie = F.coalesce(F.col("tied"), F.lit(False)) & strict
    status = F.when(F.col("best").isNull(), "missing").when(tie, "tie").otherwise("matched")
    return j.select("id", status.alias("status"), F.when(~tie, F.col("best.mid")).alias("mid"), F.when(~tie, F.col("best.score")).alias("score"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def plan_by_tolerances(light: DataFrame, master: DataFrame, tol: dict[str, float], exposure: str, optional: tuple[str, ...] = (),
                       embedded: Column | None = None, flats: Column | None = None, allow_missing_dark: bool = False, strict: bool = False) -> DataFrame:
    """id, dark, flat, bias, reason of every light.  ``master`` has kind, filter, mid, mname and the settings.

    Darks match on all tolerances; flats and biases are shot at their own ``exposure``, so on all others.  A flat of another filter is none; flats without a
    label compete with those of the light's filter, and a light without a filter takes any.  ``embedded`` lights need no dark, lights
    not in ``flats`` no flat.  A light without its dark is refused (``no_dark``), or goes on as ``dark_waived`` if that is allowed.
    In strict form a flat without a label is not taken (``unlabelled_flat`` if it was the only kind), and masters of equal score make the plan ``ambiguous``.
    """
    embedded = F.lit(False) if embedded is None else F.coalesce(embedded, F.lit(False))
    flats = F.lit(True) if flats is None else F.coalesce(flats, F.lit(False))
    free = {k: v for k, v in tol.items() if k != exposure}
    label = F.nullif(F.upper(F.trim(F.col("filter"))), F.lit(""))
    lights = cut(light.withColumns({"filter": label, "_embedded": embedded, "_flats": flats}).select("id", "filter", "_embedded", "_flats", *[present(F.col(k)).alias(k) for k in tol]))
    kind = lambda k: master.where(F.col("kind") == k).withColumn("filter", label)
    free_keys, flat = list(free), kind("flat")

    def add(df: DataFrame, found: DataFrame, keys: list[str], name: str) -> DataFrame:
        return join_on(df, found.select(*keys, F.col("best").alias(name), F.col("tied").alias(f"{name}_tied")), keys, "left")

    j = add(lights, best_for_settings(lights, kind("dark"), [], tol, optional), list(tol), "dark")
    j = add(j, best_for_settings(lights, kind("bias"), [], free, optional), free_keys, "bias")
    j = add(j, best_for_settings(lights.where("filter is not null"), flat.where("filter is not null"), ["filter"], free, optional), ["filter", *free_keys], "same")
    j = add(j, best_for_settings(lights, flat.where("filter is null"), [], free, optional), free_keys, "bare")
    j = add(j, best_for_settings(lights.where("filter is null"), flat if not strict else flat.where("filter is not null"), [], free, optional), free_keys, "any")
    j = j.withColumn("any", F.when(F.col("filter").isNull(), F.col("any"))).withColumn("any_tied", F.col("any_tied") & F.col("filter").isNull())
    usable = F.coalesce("same", "any") if strict else F.least("same", "bare", "any")
    tied = F.lit(False)
    if strict:
        tied = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in (F.col("dark_tied") & ~F.col("_embedded"), F.col("bias_tied"), (F.coalesce("same_tied", "any_tied")) & F.col("_flats"))])
    j = j.withColumn("flat", F.when(F.col("_flats"), usable)).withColumn("dark", F.when(~F.col("_embedded"), F.col("dark"))).withColumn("_tied", tied)
    bare = F.lit(strict) & F.col("_flats") & F.col("flat").isNull() & F.col("bare").isNotNull()
    lost = ~F.col("_embedded") & F.col("dark").isNull()
    reason = F.when(F.col("_tied"), "ambiguous").when(lost & F.lit(not allow_missing_dark), "no_dark").when(bare, "unlabelled_flat").when(F.col("_embedded"), "embedded_dark").when(lost, "dark_waived").when(
        ~F.col("_flats"), "no_flats_made").when(F.col("flat").isNull(), "no_flat").when(F.col("bias").isNull(), "no_bias").otherwise("complete")
    shown = ~F.col("_tied")
    return j.select("id", *[F.when(shown, F.col(f"{c}.mid")).alias(c) for c in ("dark", "flat", "bias")], reason.alias("reason"))
