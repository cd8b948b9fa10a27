"""Gates and rules: long metric tables against constant threshold tables; three states kept apart.

``measured`` values are judged, ``unavailable`` (null) is never zero and never escalates, a missing
threshold is ``uncalibrated``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from astrolake.functions.scan import carry_last, exact_quantiles, join_on
from astrolake.operators.images import blocks, clamp, corner_region, pct, share
from astrolake.operators.joins import assign_apertures

# fixed values: fidelity gates (metric, code, degraded line, hard line, higher is worse)
FIDELITY = (
    ("bg_sigma", "BACKGROUND_NOISE_BOUNDED", None, None, True),
    ("noise_gain", "BACKGROUND_RELATIVE_NOISE_BOUNDED", 1.140661, 1.60, True),
    ("drift_p95", "HUE_PRESERVED", 0.004, 0.037926, True),
    ("chroma_retention", "SUBJECT_CHROMA_VISIBILITY_PRESERVED", 0.95, 0.85, False),
    ("chroma_noise_gain", "BACKGROUND_CHROMA_NOISE_BOUNDED", 1.02, 1.12, True),
)
ESCALATING = ("BACKGROUND_RELATIVE_NOISE_BOUNDED",)


def thresholds(spark: SparkSession, rows=FIDELITY) -> DataFrame:
    return spark.createDataFrame(list(rows), "metric string, code string, degraded double, hard double, higher boolean")


def evaluate_gates(metrics: DataFrame, keys: list[str], limits: DataFrame, names: list[str], escalating: tuple[str, ...] = ()) -> DataFrame:
    """Healthy rows vanish; the rest is degraded, warning/failed, unavailable or uncalibrated."""
    long = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(keys, names, "metric", "value")
    j = long.join(F.broadcast(limits), "metric")
    v, up = F.col("value"), F.col("higher")
    past = lambda line: F.when(up, v >= F.col(line)).otherwise(v <= F.col(line))
    esc = F.col("code").isin(*escalating) if escalating else F.lit(False)
    st = (
        F.when(v.isNull() | F.isnan(v), "unavailable").when(F.col("degraded").isNull() | F.col("hard").isNull(), "uncalibrated")
        .when(past("hard"), F.when(esc, "failed").otherwise("warning")).when(past("degraded"), "degraded"))
    out = j.withColumn("status", st).where(F.col("status").isNotNull())
    return out.select(*keys, "code", "status", "value", (esc & (F.col("status") == "failed")).alias("escalate"))


def display_metrics(rgb: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Per image: median, p1, non-positive share, corner ratio of the luminance."""
    g = rgb.groupBy(*keys).agg(F.median("l").alias("median"), pct("l", 0.01).alias("p1"), share(F.col("l") <= 0).alias("nonpositive"))
    c = rgb.withColumn("reg", corner_region(side, 2, 0)).where(F.col("reg").isNotNull()).groupBy(*keys, "reg").agg(F.avg("l").alias("m"))
    c = c.groupBy(*keys).agg((F.max("m") / F.nullif(F.min("m"), F.lit(0.0))).alias("corner_ratio"))
    return g.join(c, keys)


# fixed values: display gates (code, metric, limit, higher is worse, target type or null, stage)
DISPLAY = (
    ("BACKGROUND_CRUSHED", "p1", 1e-4, False, None), ("BACKGROUND_CRUSHED_SHARE", "nonpositive", 0.01, True, None),
    ("BACKGROUND_LOW", "median", 0.04, False, "emission_nebula"), ("BACKGROUND_LOW", "median", 0.025, False, "other"),
    ("BACKGROUND_TOO_BRIGHT", "median", 0.30, True, None), ("CORNER_NONUNIFORM", "corner_ratio", 3.0, True, None),
)


def quality_gates(metrics: DataFrame, keys: list[str], spark: SparkSession, dbe: Column, rules=DISPLAY) -> DataFrame:
    """Scalar gates by target type as a decision-table join; only triggered gates appear."""
    long = metrics.withColumn("dbe", dbe).unpivot([*keys, "target_type", "dbe"], ["median", "p1", "nonpositive", "corner_ratio"], "metric", "value")
    table = spark.createDataFrame(list(rules), "code string, metric string, limit double, higher boolean, only string")
    j = long.join(F.broadcast(table), "metric")
    group = F.when(F.col("target_type") == "emission_nebula", "emission_nebula").otherwise("other")
    hit = F.when(F.col("higher"), F.col("value") > F.col("limit")).when(F.col("code") == "BACKGROUND_CRUSHED", F.col("value") <= F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    out = j.where(hit & (F.col("only").isNull() | (F.col("only") == group)))
    return out.select(*keys, "code", "value", F.when((F.col("code") == "CORNER_NONUNIFORM") & F.col("dbe"), "failed").otherwise("warning").alias("status"))


def stage_gates(df: DataFrame) -> DataFrame:
    """Numbers can reject, never accept."""
    reasons = F.concat_ws(",", F.when(F.col("shadow_clip") >= 1e-4, "shadow_clip"), F.when(F.col("roundness") < 0.30, "roundness"))
    return df.withColumn("reasons", reasons).withColumn("verdict", F.when(reasons != "", "reject").otherwise("uncertain"))


def star_gates(px2: DataFrame, stars: DataFrame, keys: list[str], abs_dip: float = 0.1, rel_dip: float = 0.5, bloat: float = 1.5, burn: float = 0.25) -> DataFrame:
    """Ringing dip by annulus, bloat and core burn of the candidate around fixed parent centres."""
    a = assign_apertures(px2, stars, keys, 1.5, 1.5, 4.0)
    k = [*keys, "star"]
    ring = F.floor(F.col("dist")).cast("int")
    r = a.withColumn("ring", ring).groupBy(*k, "ring").agg(F.avg("pv").alias("p"), F.avg("cv").alias("c"), F.count(F.lit(1)).alias("n"), F.max("cv").alias("cm"))
    far = lambda col: F.max(F.when(F.col("ring") == 3, F.col(col)))
    bg = r.groupBy(*k).agg(far("c").alias("c_bg"), far("p").alias("p_bg"))
    j = r.join(bg, k)
    dip = F.when(F.col("ring").isin(1, 2), F.col("c_bg") - F.col("c"))
    g = j.groupBy(*k).agg(
        F.max(dip).alias("dip"), F.max_by("ring", F.struct(F.round(dip, 9), -F.col("ring"))).alias("dip_ring"), F.first("c_bg").alias("c_bg"), F.first("p_bg").alias("p_bg"),
        F.max(F.when(F.col("ring") == 0, F.col("cm"))).alias("core"), F.sum(F.when(F.col("ring") <= 1, F.col("n") * F.greatest(F.col("c") - F.col("c_bg"), F.lit(0.0)))).alias("c_flux"),
        F.sum(F.when(F.col("ring") <= 1, F.col("n") * F.greatest(F.col("p") - F.col("p_bg"), F.lit(0.0)))).alias("p_flux"))
    ringing = F.col("dip") >= F.greatest(F.lit(abs_dip), rel_dip * F.abs("c_bg"))
    swollen = (F.col("p_flux") > 0) & (F.col("c_flux") / F.nullif(F.col("p_flux"), F.lit(0.0)) > bloat)
    codes = F.concat_ws(",", F.when(ringing, "RINGING"), F.when(swollen, "BLOAT"), F.when(F.col("core") >= burn, "CORE_BURN"))
    return g.select(*k, "dip", F.when(F.col("dip").isNotNull(), F.col("dip_ring")).alias("dip_ring"), codes.alias("codes"))


def removal_damage(pair: DataFrame, keys: list[str], baseline: float = 0.0, min_px: int = 10, min_sep: float = 1.05) -> DataFrame:
    """Relative loss of the median on the pixels at or above the p75 of the original."""
    q = pair.groupBy(*keys).agg(pct("l", 0.75).alias("p75"), pct("l", 0.25).alias("p25"))
    s = pair.join(q, keys).where(F.col("l") >= F.col("p75"))
    g = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median("l").alias("mo"), F.median("cl").alias("ms"), F.first("p75").alias("p75"), F.first("p25").alias("p25"))
    damage = F.greatest(F.lit(0.0), F.abs(F.col("mo") - F.col("ms")) / F.nullif(F.col("mo"), F.lit(0.0)) - baseline)
    sep = F.col("p75") / F.nullif(F.col("p25"), F.lit(0.0))
    ok = (F.col("n") > min_px) & (sep >= min_sep)
    return g.select(*keys, "n", sep.alias("separation"), ok.alias("measurable"), F.when(ok, damage).alias("damage"))


# fixed values: removal profiles (name, damage limit, advisory multiplier); overrides may only tighten
REMOVAL_PROFILES = (("default", 0.10, 2.0), ("strict", 0.05, 1.5), ("open", None, 2.0))


def removal_gate(damage: DataFrame, profiles: DataFrame, override: Column) -> DataFrame:
    j = damage.join(F.broadcast(profiles), "profile", "left")
    limit = F.when(F.col("limit").isNotNull(), F.least(F.col("limit"), F.coalesce(override, F.col("limit"))))
    d = F.col("damage")
    st = (F.when(limit.isNull(), "uncalibrated").when(~F.col("measurable"), "advisory").when(d <= limit, "ok")
          .when(d <= limit * F.col("multiplier"), "advisory").otherwise("hard_failed"))
    return j.withColumn("state", st)


def starless_checks(rgb2: DataFrame, keys: list[str], black: float = 0.02, clip: float = 0.005, area: float = 1.10) -> DataFrame:
    """Median-luminance ratio, channel collapse and added near-black or clipped shares."""
    g = rgb2.groupBy(*keys).agg(
        F.median("l").alias("ml"), F.median("cl").alias("mc"),
        *[pct(c, 0.99).alias(f"p_{c}") for c in "rgb"], *[pct(f"c{c}", 0.99).alias(f"q_{c}") for c in "rgb"],
        (share(F.col("cl") <= 0.3) - share(F.col("l") <= 0.3)).alias("black_gain"), (share(F.col("cl") >= 0.7) - share(F.col("l") >= 0.7)).alias("clip_gain"))
    r = F.col("mc") / F.nullif(F.col("ml"), F.lit(0.0))
    lum = F.when((r < 0.1) | (r > 10), "failed").when((r < 0.5) | (r > 2), "warning").otherwise("passed")
    lost = F.concat_ws(",", *[F.when((F.col(f"p_{c}") > 0.5) & (F.col(f"q_{c}") < 0.8 * F.col(f"p_{c}")), F.lit(c)) for c in "rgb"])
    return g.select(*keys, r.alias("lum_ratio"), lum.alias("lum_status"), lost.alias("collapsed"), "black_gain", "clip_gain",
                    ((F.col("black_gain") <= black) & (F.col("clip_gain") <= clip)).alias("accept"))


def denoise_check(rgb2: DataFrame, keys: list[str], drift: float = 0.05, noise: float = 1.05) -> DataFrame:
    """Reject on mean drift, noise growth, detail retention out of bounds or non-finite values."""
    wx = W.partitionBy(*keys, "y").orderBy("x")
    j = rgb2.withColumn("_g", F.abs(F.col("l") - F.lag("l").over(wx))).withColumn("_h", F.abs(F.col("cl") - F.lag("cl").over(wx)))
    g = j.groupBy(*keys).agg(
        *[(F.avg(f"c{c}") / F.nullif(F.avg(c), F.lit(0.0)) - 1).alias(f"d_{c}") for c in "rgb"], (F.avg("cl") / F.nullif(F.avg("l"), F.lit(0.0)) - 1).alias("d_l"),
        (F.stddev_pop("cl") / F.nullif(F.stddev_pop("l"), F.lit(0.0))).alias("noise_ratio"), (F.sum("_h") / F.nullif(F.sum("_g"), F.lit(0.0))).alias("detail"),
        F.count_if(F.isnan("cl")).alias("bad"), F.min(F.least("cr", "cg", "cb")).alias("lo"), F.max(F.greatest("cr", "cg", "cb")).alias("hi"))
    worst = F.greatest(*[F.abs(f"d_{c}") for c in ("r", "g", "b", "l")])
    why = F.concat_ws(",", F.when(worst > drift, "drift"), F.when(F.col("noise_ratio") > noise, "noise"), F.when((F.col("detail") < 0.65) | (F.col("detail") > 1.25), "detail"),
                      F.when((F.col("lo") < 0) | (F.col("hi") > 1), "range"), F.when(F.col("bad") > 0, "non_finite"))
    return g.select(*keys, worst.alias("drift"), "noise_ratio", "detail", why.alias("reasons"), (why == "").alias("accepted"))


def fit_thresholds(labelled: DataFrame, metric: str, ceiling: float | None = None) -> DataFrame:
    """Gate lines from a labelled corpus, higher-is-worse and the mirrored lower-is-worse pair."""
    h = labelled.where(F.col("label") == "healthy")
    q = exact_quantiles(h, [metric], "value", {"p90": (0.9, "pL"), "p95": (0.95, "pL")}, count_as="n")
    d = labelled.where(F.col("label") == "degraded").groupBy(metric).agg(F.max("value").alias("dmax"), F.min("value").alias("dmin"))
    j = join_on(q, d, [metric], "left")
    hard = F.greatest(F.coalesce("dmax", F.lit(0.0)), F.col("p95") * 1.5)
    hard = F.least(hard, F.lit(ceiling)) if ceiling is not None else hard
    low = F.least(F.coalesce("dmin", F.lit(0.0)), F.col("p95") * 0.5)
    return j.select(
        metric, "n", hard.alias("hard"), F.when(F.col("p90") >= hard, hard * 0.75).otherwise(F.col("p90")).alias("degraded"),
        low.alias("hard_low"), F.when(F.col("p90") <= low, low * 1.25).otherwise(F.col("p90")).alias("degraded_low"), (F.col("n") < 3).alias("sparse"))


def squeeze_line(labelled: DataFrame, keys: list[str], relax: float = 1.0, p: float = 0.5) -> DataFrame:
    """Line between the healthy ceiling and the degraded floor; an empty interval is not lineable."""
    g = labelled.groupBy(*keys).agg(
        (F.max(F.when(F.col("label") == "healthy", F.col("value"))) * relax).alias("ceiling"), F.min(F.when(F.col("label") == "degraded", F.col("value"))).alias("floor"))
    q = exact_quantiles(labelled.where(F.col("label") == "degraded"), keys, "value", {"mid": (p, "pL")})
    j = join_on(g, q, keys, "left")
    ok = F.col("ceiling") <= F.col("floor")
    return j.select(
        *keys, "ceiling", "floor", F.when(ok, "lineable").otherwise("not_lineable").alias("status"), F.when(F.col("ceiling") > F.col("floor"), F.col("ceiling") - F.col("floor")).alias("crossing"),
        F.when(ok, F.least(F.greatest("mid", "ceiling"), F.col("floor"))).alias("line"))


def degraded_separation(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lightest degraded reading minus the healthy one must be positive."""
    g = df.groupBy(*keys).agg(F.max(F.when(F.col("ratio") == 0, F.col("value"))).alias("healthy"), F.min(F.when(F.col("ratio") > 0, F.col("value"))).alias("lightest"))
    d = F.col("lightest") - F.col("healthy")
    return g.withColumn("separation", d).withColumn("usable", F.coalesce(d > 0, F.lit(False)))


def jitter_strata(df: DataFrame, key: str) -> DataFrame:
    """Measurable and unmeasurable windows summarised apart; the pooled row is flagged misleading."""
    s = df.withColumn("stratum", F.explode(F.array(F.when(F.col("measurable"), "measurable").otherwise("unmeasurable"), F.lit("pooled"))))
    k = [key, "stratum"]
    q = exact_quantiles(s, k, "value", {"p50": (0.5, "pL"), "p95": (0.95, "pL")}, count_as="n")
    r = s.groupBy(*k).agg((F.max("value") - F.min("value")).alias("spread"))
    return q.join(r, k).withColumn("misleading", F.col("stratum") == "pooled")


# fixed values: perturbation ladder (kind, parameter)
LADDER = (("brightness", 0.9), ("brightness", 0.8), ("overshoot", 0.0471234567), ("gamma", 1.2), ("fill", 0.5))


def ladder(pair: DataFrame, keys: list[str], steps=LADDER) -> DataFrame:
    """Metric deltas of every perturbation step against the healthy state: loss, spread and mean."""
    lits = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(p)).alias("param")) for k, p in steps])
    x = pair.withColumn("s", F.explode(lits)).withColumn("kind", F.col("s.kind")).withColumn("param", F.col("s.param"))
    v, p = F.col("l"), F.col("param")
    bad = (F.when(F.col("kind") == "brightness", v * p).when(F.col("kind") == "overshoot", v + p * F.signum(v - 0.5))
           .when(F.col("kind") == "gamma", F.pow(F.greatest(v, F.lit(0.0)), p)).otherwise(F.greatest(v, p)))
    g = x.withColumn("w", bad).groupBy(*keys, "kind", "param").agg(
        (F.avg("w") - F.avg("l")).alias("d_mean"), (F.stddev_pop("w") - F.stddev_pop("l")).alias("d_spread"), F.avg(F.abs(F.col("w") - F.col("l"))).alias("d_abs"))
    moved = F.when(F.abs("d_mean") >= F.abs("d_spread"), "mean").otherwise("spread")
    return g.withColumn("moved", moved)


def corpus_verdict(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Passed, not applicable and failed members kept apart; failed wins, nothing applicable is not a pass."""
    g = rows.groupBy(*keys).agg(*[F.count_if(F.col("check") == c).alias(c) for c in ("passed", "not_applicable", "failed")])
    return g.withColumn("verdict", F.when(F.col("failed") > 0, "failed").when(F.col("passed") == 0, "not_applicable").otherwise("passed"))


def replay(labelled: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Counts a proposed line would give on the corpus, by label."""
    j = labelled.join(lines, key, "left")
    st = F.when(F.col("hard").isNull(), "uncalibrated").when(F.col("value") >= F.col("hard"), "reject").when(F.col("value") >= F.col("degraded"), "advisory").otherwise("accept")
    return j.groupBy(key, "label").agg(*[F.count_if(st == s).alias(s) for s in ("accept", "advisory", "reject", "uncalibrated")])


# fixed values: advice rules (decision, metric, threshold, above, confidence)
ADVICE = (
    ("neutralise_background", "cast", 0.02, True, "high"), ("reduce_noise", "noise", 0.12, True, "medium"), ("protect_core", "p99", 0.80, True, "high"),
    ("fit_gradient", "tilt", 0.05, True, "medium"), ("lift_background", "median", 0.45, False, "low"), ("stretch_more", "span", 0.55, False, "low"),
)


def advise(metrics: DataFrame, keys: list[str], spark: SparkSession, rules=ADVICE) -> DataFrame:
    """Decision rows with confidence and the metric they rest on, for every image at once."""
    names = sorted({r[1] for r in rules})
    long = metrics.select(*keys, *names).unpivot(keys, names, "metric", "value")
    t = spark.createDataFrame(list(rules), "decision string, metric string, threshold double, above boolean, confidence string")
    j = long.join(F.broadcast(t), "metric")
    return j.where(F.when(F.col("above"), F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))).select(
        *keys, "decision", "confidence", "metric", "value")


def advice_metrics(rgb: DataFrame, keys: list[str]) -> DataFrame:
    g = rgb.groupBy(*keys).agg(
        F.median("l").alias("median"), pct("l", 0.99).alias("p99"), (pct("l", 0.99) - pct("l", 0.01)).alias("span"), F.stddev_pop("l").alias("noise"),
        (F.greatest(F.avg("r"), F.avg("g"), F.avg("b")) - F.least(F.avg("r"), F.avg("g"), F.avg("b"))).alias("cast"),
        F.abs(F.avg(F.when(F.col("x") < 4, F.col("l"))) - F.avg(F.when(F.col("x") >= 4, F.col("l")))).alias("tilt"))
    return g


def recommend_params(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters from the diagnosis, clamped to their working ranges."""
    return metrics.select(
        *keys, clamp(F.col("noise") * 4, 0.1, 0.8).alias("denoise_strength"), clamp(0.25 / F.greatest("median", F.lit(0.05)), 0.5, 3.0).alias("stretch"),
        clamp(1 - F.col("cast") * 5, 0.6, 1.0).alias("saturation"), F.when(F.col("tilt") > 0.05, 2).otherwise(1).cast("int").alias("gradient_order"))


# fixed values: style profiles (target group, colour mode, profile, strength)
STYLES = (
    ("nebula", "narrowband", "hoo", 0.8), ("nebula", "broadband", "natural", 0.6), ("galaxy", "broadband", "soft_core", 0.5), ("galaxy", "narrowband", "ha_blend", 0.4),
    ("cluster", "broadband", "star_colour", 0.7), ("cluster", "narrowband", "star_colour", 0.5),
)


def choose_profile(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Profile by target group and colour mode; an override is bounded to +-0.2 of the profile."""
    t = spark.createDataFrame(list(STYLES), "group string, mode string, profile string, strength double")
    g = F.when(F.col("target_type").contains("cluster"), "cluster").when(F.col("target_type").contains("galaxy"), "galaxy").otherwise("nebula")
    j = df.withColumn("group", g).join(F.broadcast(t), ["group", "mode"], "left")
    s = F.col("strength")
    return j.withColumn("strength", F.when(F.col("override").isNull(), s).otherwise(F.least(F.greatest("override", s - 0.2), s + 0.2)))


def scene_features(rgb: DataFrame, keys: list[str], b: int = 2) -> DataFrame:
    """Density class, colour bias, saturation, bright share and the block-mean diffuse share."""
    mx, mn = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    g = rgb.groupBy(*keys).agg(
        share(F.col("l") > 0.7).alias("bright_ratio"), F.avg((mx - mn) / F.greatest(mx, F.lit(1e-6))).alias("saturation"), share(F.col("l") > 0.62).alias("coverage"),
        (F.avg("r") - (F.avg("g") + F.avg("b")) / 2).alias("red_bias"), (F.avg("b") - (F.avg("r") + F.avg("g")) / 2).alias("blue_bias"))
    bm = blocks(rgb, keys, b, F.avg("l"), "m")
    q = bm.groupBy(*keys).agg(pct("m", 0.75).alias("q"))
    diff = bm.join(q, keys).groupBy(*keys).agg(share(F.col("m") > F.col("q")).alias("diffuse"))
    dens = F.when(F.col("coverage") > 0.20, "very_dense").when(F.col("coverage") > 0.12, "dense").when(F.col("coverage") > 0.05, "moderate").otherwise("sparse")
    return g.join(diff, keys).withColumn("density", dens)


# fixed values: scene scores (label, base, terms of feature, weight and cap), and the least score that names a scene
SCENES = (
    ("emission_nebula", 0.35, (("red", 2.5, None), ("saturation", 0.45, None), ("diffuse", 3.0, 0.25), ("red_leads", 0.15, None))),
    ("reflection_nebula", 0.25, (("blue", 2.0, None), ("saturation", 0.35, None))),
    ("galaxy", 0.25, (("bright_ratio", 4.0, 0.25), ("thin", 0.15, None))),
    ("globular_cluster", 0.2, (("crowded", 0.35, None), ("thin", 0.05, None), ("coverage", 3.0, 0.25))),
    ("planetary_nebula", 0.18, (("bright_ratio", 6.0, 0.35), ("saturation", 0.2, None))),
    ("wide_field", 0.25, (("crowded", 0.18, None), ("thin", 0.05, None), ("dim", 1.0, None))),
)
SCENE_FROM, NO_SCENE = 0.35, 0.3


def classify_scene(f: DataFrame, keys: list[str]) -> DataFrame:
    """The scene of the table SCENES with the highest score between 0 and 1; unknown below SCENE_FROM; ties go to the earlier row."""
    crowded = F.coalesce(F.col("density").isin("dense", "very_dense"), F.lit(False)).cast("double")
    positive = lambda c: F.greatest(c, F.lit(0.0))
    feature = {c: F.col(c) for c in ("saturation", "diffuse", "bright_ratio", "coverage")} | {
        "red": positive(F.col("red_bias")), "blue": positive(F.col("blue_bias")), "dim": positive(0.12 - F.col("bright_ratio")), "crowded": crowded, "thin": 1 - crowded}
    feature["red_leads"] = F.coalesce(F.col("red_bias") > feature["blue"] + 0.02, F.lit(False)).cast("double")
    scored = []
    for rank, (label, score, terms) in enumerate(SCENES):
        score = F.lit(score)
        for name, weight, cap in terms:
            term = feature[name] * weight
            score = score + (term if cap is None else F.least(term, F.lit(cap)))
        scored.append(F.struct(F.round(clamp(score), 3).alias("score"), F.lit(-rank).alias("rank"), F.lit(label).alias("label")))
    named = F.col("_best.score") >= SCENE_FROM
    return f.withColumn("_best", F.array_max(F.array(*scored))).select(
        *keys, "density", F.when(named, F.col("_best.label")).otherwise("unknown_deep_sky").alias("scene"), F.when(named, F.col("_best.score")).otherwise(NO_SCENE).alias("confidence"))


def compare_acceptance(regs_px: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline against candidate: core must hold its median, background must not grow noisier."""
    g = regs_px.groupBy(*keys).agg(
        F.avg(F.when(F.col("region") == "core", F.col("pv"))).alias("core_b"), F.avg(F.when(F.col("region") == "core", F.col("cv"))).alias("core_c"),
        F.stddev_pop(F.when(F.col("region") == "bg", F.col("pv"))).alias("bg_b"), F.stddev_pop(F.when(F.col("region") == "bg", F.col("cv"))).alias("bg_c"))
    core_ok, bg_ok = F.col("core_c") >= F.col("core_b") - 0.01, F.col("bg_c") <= 1.05 * F.col("bg_b")
    return g.select(*keys, (F.col("core_c") - F.col("core_b")).alias("core_gain"), (F.col("bg_c") / F.nullif(F.col("bg_b"), F.lit(0.0))).alias("noise_ratio"),
                    F.when(core_ok & bg_ok, "accept").when(core_ok | bg_ok, "review").otherwise("reject").alias("verdict"))


# fixed values: log rules (code, severity, pattern, needs a success marker: before / after / none)
LOG_RULES = (("E_ABORT", "fatal", r"(?i)^error", "none"), ("W_RETRY", "warning", r"(?i)^signup", "after"), ("I_NOTE", "benign", r"(?i)^view", "before"))


def diagnose_log(log: DataFrame, key: str, marker: str = r"(?i)^purchase", width: int = 100_000) -> DataFrame:
    """Classified log lines; a warning with a later success marker is benign, a benign line without an earlier one warns.

    Markers before a line come from an as-of scan, markers after it from the last marker of the log.
    """
    m = log.withColumn("mark", F.when(F.col("text").rlike(marker), F.col("line")))
    last = m.groupBy(key).agg(F.max("mark").alias("last_mark"))
    m = carry_last(m, [key], "line", "mark", "prev_mark", width)
    rule = F.lit(None).cast("struct<code:string,sev:string,need:string>")
    for code, sev, pat, need in reversed(LOG_RULES):
        rule = F.when(F.col("text").rlike(pat), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("sev"), F.lit(need).alias("need"))).otherwise(rule)
    j = join_on(m.withColumn("r", rule).where(F.col("r").isNotNull()), last, [key])
    after = F.coalesce(F.col("last_mark") > F.col("line"), F.lit(False))
    before = F.coalesce(F.col("prev_mark") < F.col("line"), F.lit(False))
    sev = F.when((F.col("r.need") == "after") & after, "benign").when((F.col("r.need") == "before") & ~before, "warning").otherwise(F.col("r.sev"))
    return j.select(key, "line", F.col("r.code").alias("code"), sev.alias("severity"))


def context_findings(log: DataFrame, key: str, code: str, pattern: str, opener: str, closer: str, marker: str = r"(?i)^purchase", before: int = 5, after: int = 9) -> DataFrame:
    """Lines of ``pattern`` with their severity: benign between an ``opener`` and a ``closer`` and ahead of a success marker, else a warning.

    The opener must stand in the ``before`` lines before, the closer in the ``after`` lines after; ``line`` counts
    the lines of a log.  Findings visit the numbers of their neighbours, so logs meet line by line and a long log splits like short ones.
    """
    hits = log.where(F.col("text").rlike(pattern)).select(key, "line")

    def beside(text: str, first: int, last: int, name: str) -> DataFrame:
        near = hits.select(key, "line", F.explode(F.sequence(F.col("line") + first, F.col("line") + last)).alias("_at"))
        marks = log.where(F.col("text").rlike(text)).select(key, F.col("line").alias("_at"))
        return near.join(marks, [key, "_at"]).select(key, "line").distinct().withColumn(name, F.lit(True))

    last = log.groupBy(key).agg(F.max(F.when(F.col("text").rlike(marker), F.col("line"))).alias("last_mark"))
    found = join_on(hits, last, [key]).join(beside(opener, -before, -1, "opened"), [key, "line"], "left").join(beside(closer, 1, after, "closed"), [key, "line"], "left")
    benign = F.coalesce(F.col("opened") & F.col("closed") & (F.col("last_mark") > F.col("line")), F.lit(False))
    return found.select(key, "line", F.lit(code).alias("code"), F.when(benign, "benign").otherwise("warning").alias("severity"))


def assert_contract(df: DataFrame, key: str, required: list[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Violations: missing values, repeated keys, values out of range."""
    miss = [df.where(F.col(c).isNull()).select(F.lit("missing").alias("rule"), F.lit(c).alias("field"), F.col(key).cast("string").alias("key")) for c in required]
    rng = [df.where(~F.col(c).between(lo, hi)).select(F.lit("range").alias("rule"), F.lit(c).alias("field"), F.col(key).cast("string").alias("key")) for c, (lo, hi) in ranges.items()]
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate").alias("rule"), F.lit(key).alias("field"), F.col(key).cast("string").alias("key"))
    return reduce(DataFrame.unionByName, [*miss, *rng, dup])


# fixed values: region constraints (region, min, max)
LIMITS = (("bg", -0.05, 0.05), ("core", -0.10, 0.10), ("faint", -0.08, 0.08))


def check_constraints(stats: DataFrame, keys: list[str], spark: SparkSession, rows=LIMITS) -> DataFrame:
    """Largest relative excess over region limits per candidate; zero when all hold."""
    t = spark.createDataFrame(list(rows), "region string, mn double, mx double")
    j = stats.join(F.broadcast(t), "region")
    ex = F.greatest(F.col("mn") - F.col("value"), F.col("value") - F.col("mx"), F.lit(0.0)) / F.greatest(F.abs("mn"), F.abs("mx"), F.lit(1e-12))
    g = j.groupBy(*keys).agg(F.max(ex).alias("violation"))
    return g.withColumn("survives", F.col("violation") == 0)


def histogram_gate(rgb: DataFrame, keys: list[str], min_px: int = 1024) -> DataFrame:
    """Delivery histogram on 0..255 luminance (0.299/0.587/0.114); small frames are exempt."""
    l = 255 * clamp(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    g = rgb.withColumn("h", l).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.median("h").alias("median"), (pct("h", 0.99) - pct("h", 0.01)).alias("span"), share(F.col("h") >= 254).alias("clipped"))
    why = F.concat_ws(",", F.when(F.col("median") < 15, "too_dark"), F.when(F.col("median") > 100, "too_bright"), F.when(F.col("span") < 15, "flat"), F.when(F.col("clipped") > 0.05, "clipped"))
    return g.withColumn("reasons", why).withColumn("status", F.when(F.col("n") < min_px, "exempt").when(why == "", "passed").otherwise("failed"))


def evidence_conflicts(header: DataFrame, scene: DataFrame, review: DataFrame, keys: list[str]) -> DataFrame:
    """Three independent labels per image; disagreeing pairs are listed."""
    j = header.join(scene, keys, "full_outer").join(review, keys, "full_outer")
    pair = lambda a, b: F.when(F.col(a) != F.col(b), f"{a}/{b}")
    c = F.concat_ws(",", pair("header", "scene"), pair("header", "review"), pair("scene", "review"))
    return j.withColumn("conflicts", c).where(F.col("conflicts") != "")


def formula_audit(pairs: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Largest absolute error between stored and recomputed values per layer."""
    g = pairs.groupBy(*keys).agg(F.max(F.abs(F.col("stored") - F.col("again"))).alias("max_error"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("ok", F.col("max_error") <= tol)

