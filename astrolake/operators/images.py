"""Image statistics: robust summaries, clipping, noise, gradients, colour, regions and paired fidelity.

Statistics of single frames and images on whole arrays are in ``frame_stats``; here pixels are rows.
A frame is bounded by the sensor, so its pixels may meet in one group; anything that spans frames
(sessions, corpora) goes through the rank-band quantiles of ``functions.scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from astrolake.functions.scan import attach, exact_quantiles
from astrolake.session import cut
from astrolake.functions.tiles import MAD_TO_SIGMA, median_of

# fixed values: Rec. 709 luminance weights
LUMA = (0.2126, 0.7152, 0.0722)
# fixed values: percentiles of the image summary
PERCENTILES = (0.1, 1, 5, 10, 25, 50, 75, 90, 95, 99, 99.9)


def lum(r="r", g="g", b="b") -> Column:
    return LUMA[0] * F.col(r) + LUMA[1] * F.col(g) + LUMA[2] * F.col(b)


def with_luminance(rgb: DataFrame) -> DataFrame:
    return rgb.withColumn("l", lum())


def pct(col: str | Column, p: float) -> Column:
    return F.percentile(col, F.lit(float(p)))


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def approx_stats(px: DataFrame, keys: list[str], accuracy: int = 10000) -> DataFrame:
    """The sketch variant for groups without a size bound: one pass, bounded memory."""
    return px.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"),
        F.percentile_approx("v", [0.1, 0.5, 0.9], accuracy).alias("_p")
    ).select(*keys, "n", "mean", "sd", *[F.col("_p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def channel_stats(long: DataFrame, keys: list[str]) -> DataFrame:
    v = F.col("v")
    finite = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    fv = F.when(finite, v)
    return long.groupBy(*keys).agg(
        F.count_if(finite).alias("n_finite"), F.count_if(~finite).alias("n_bad"),
        share(fv <= 0).alias("shadow"), share(fv >= 1).alias("highlight"),
        share((fv > 0) & (fv <= 1e-4)).alias("near_black"),
        pct(fv, 0.01).alias("p01"), pct(fv, 0.5).alias("p50"), pct(fv, 0.99).alias("p99"))


def clipping(long: DataFrame, image: list[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Clipped shares per image and per channel, and the larger highlight pressure with its source."""
    per = long.groupBy(*image, "channel").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") <= low).alias("lo"), F.count_if(F.col("v") >= high).alias("hi"))
    agg = per.groupBy(*image).agg(
        (F.sum("lo") / F.sum("n")).alias("low_all"), (F.sum("hi") / F.sum("n")).alias("high_all"),
        F.max(F.col("hi") / F.col("n")).alias("high_channel"),
        F.max(F.struct((F.col("hi") / F.col("n")).alias("s"), F.col("channel"))).alias("_top"))
    return agg.select(
        *image, "low_all", "high_all", "high_channel", F.greatest("high_all", "high_channel").alias("pressure"),
        F.when(F.col("high_channel") > F.col("high_all"), F.col("_top.channel")).otherwise("aggregate").alias("source"))


def blocks(px: DataFrame, keys: list[str], b: int, agg: Column, name: str) -> DataFrame:
    return px.groupBy(*keys, F.floor(F.col("y") / b).alias("by"), F.floor(F.col("x") / b).alias("bx")).agg(agg.alias(name))


def robust_sigma(df: DataFrame, keys: list[str], value: str, name: str, med: str | None = None) -> DataFrame:
    """1.4826 * MAD of bounded groups."""
    m = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    out = df.join(m, keys).groupBy(*keys).agg(
        (MAD_TO_SIGMA * F.median(F.abs(F.col(value) - F.col("_m")))).alias(name),
        *([F.first("_m").alias(med)] if med else []))
    return out


def plane_sums(df: DataFrame, keys: list[str], z: str, x: Column, y: Column, w: Column | None = None) -> DataFrame:
    """Weighted normal equations of z = a + b*x + c*y solved in closed form per group."""
    w = F.lit(1.0) if w is None else w
    zc = F.col(z)
    s = df.select(*keys, w.alias("w"), x.alias("x_"), y.alias("y_"), zc.alias("z_"))
    c = lambda n: F.col(n)
    g = s.groupBy(*keys).agg(
        F.sum("w").alias("n"), F.sum(c("w") * c("x_")).alias("sx"), F.sum(c("w") * c("y_")).alias("sy"),
        F.sum(c("w") * c("x_") * c("x_")).alias("sxx"), F.sum(c("w") * c("x_") * c("y_")).alias("sxy"),
        F.sum(c("w") * c("y_") * c("y_")).alias("syy"), F.sum(c("w") * c("z_")).alias("sz"),
        F.sum(c("w") * c("x_") * c("z_")).alias("sxz"), F.sum(c("w") * c("y_") * c("z_")).alias("syz"),
        F.sum(c("w") * c("z_") * c("z_")).alias("szz"))
    return solve_plane(g, keys)


def solve_plane(g: DataFrame, keys: list[str]) -> DataFrame:
    """The plane of each row of sums (n, sx, sy, sxx, sxy, syy, sz, sxz, syz, szz)."""
    c = F.col
    # centred moments keep the 2x2 system well conditioned
    g = g.select(
        *keys, "n", (c("sx") / c("n")).alias("mx"), (c("sy") / c("n")).alias("my"), (c("sz") / c("n")).alias("mz"),
        (c("sxx") - c("sx") * c("sx") / c("n")).alias("cxx"), (c("sxy") - c("sx") * c("sy") / c("n")).alias("cxy"),
        (c("syy") - c("sy") * c("sy") / c("n")).alias("cyy"), (c("sxz") - c("sx") * c("sz") / c("n")).alias("cxz"),
        (c("syz") - c("sy") * c("sz") / c("n")).alias("cyz"), (c("szz") - c("sz") * c("sz") / c("n")).alias("czz"))
    det = c("cxx") * c("cyy") - c("cxy") * c("cxy")
    ok = det > 1e-9
    g = g.withColumn("b", F.when(ok, (c("cxz") * c("cyy") - c("cyz") * c("cxy")) / det))
    g = g.withColumn("c", F.when(ok, (c("cyz") * c("cxx") - c("cxz") * c("cxy")) / det))
    g = g.withColumn("a", c("mz") - c("b") * c("mx") - c("c") * c("my"))
    sse = F.greatest(c("czz") - c("b") * c("cxz") - c("c") * c("cyz"), F.lit(0.0))
    return g.select(
        *keys, "n", "a", "b", "c", F.sqrt(sse / c("n")).alias("rms"),
        F.when(c("czz") > 1e-12, 1 - sse / c("czz")).alias("r2"))


def fit_ratio_gradient(rgb: DataFrame, keys: list[str], side: int, b: int = 2, passes: int = 2) -> DataFrame:
    """Robust plane on ln(R/G) of block medians: plain fit, then Cauchy-reweighted passes."""
    g = rgb.groupBy(*keys, F.floor(F.col("y") / b).alias("by"), F.floor(F.col("x") / b).alias("bx")).agg(
        F.median("r").alias("r"), F.median("g").alias("g"))
    half = (side / b - 1) / 2
    g = g.select(
        *keys, ((F.col("bx") - half) / half).alias("px"), ((F.col("by") - half) / half).alias("py"),
        F.ln(F.greatest("r", F.lit(1e-6)) / F.greatest("g", F.lit(1e-6))).alias("z"))
    fit = plane_sums(g, keys, "z", F.col("px"), F.col("py"))
    for _ in range(passes):
        e = g.join(fit.select(*keys, "a", "b", "c", "rms"), keys)
        res = F.col("z") - F.col("a") - F.col("b") * F.col("px") - F.col("c") * F.col("py")
        u = res / F.greatest(F.col("rms"), F.lit(1e-9))
        fit = plane_sums(e, keys, "z", F.col("px"), F.col("py"), 1 / (1 + u * u))
    return fit


def corner_region(side: int, corner: int, centre: int) -> Column:
    y, x = F.col("y"), F.col("x")
    c0, c1 = (side - centre) // 2, (side + centre) // 2
    return (
        F.when((y < corner) & (x < corner), "tl").when((y < corner) & (x >= side - corner), "tr")
        .when((y >= side - corner) & (x < corner), "bl").when((y >= side - corner) & (x >= side - corner), "br")
        .when((y >= c0) & (y < c1) & (x >= c0) & (x < c1), "centre"))


# fixed values: the region contract used by the bound queries (half-open rectangles)
REGIONS = (("bg", "background", 0, 0, 4, 4), ("core", "core", 2, 2, 6, 6), ("faint", "faint", 4, 4, 8, 8), ("star", "stars", 4, 0, 8, 4))


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGIONS), "region string, role string, x0 int, y0 int, x1 int, y1 int")


def assign_regions(px: DataFrame, regs: DataFrame) -> DataFrame:
    """Pixel-in-rectangle join, half-open.

    Every rectangle is expanded to the unit tiles it covers, so the join is an equi join on the tile
    with the rectangle test as residual; a contract holds at most 64 rectangles and is broadcast.
    """
    size = 4
    tiles_of = F.explode(F.expr(
        f"flatten(transform(sequence(y0 div {size}, (y1 - 1) div {size}), a -> "
        f"transform(sequence(x0 div {size}, (x1 - 1) div {size}), b -> struct(a as ty, b as tx))))"))
    r = regs.select("*", tiles_of.alias("_t")).select("region", "role", "x0", "y0", "x1", "y1", "_t.ty", "_t.tx")
    p = px.withColumn("ty", F.expr(f"y div {size}")).withColumn("tx", F.expr(f"x div {size}"))
    j = p.join(F.broadcast(r), ["ty", "tx"])
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return j.where(inside).drop("ty", "tx", "x0", "y0", "x1", "y1")


def region_metrics(px: DataFrame, regs: DataFrame, keys: list[str], clip: float = 0.999) -> DataFrame:
    a = assign_regions(px, regs)
    g = a.groupBy(*keys, "region").agg(
        F.percentile("v", [0.1, 0.5, 0.9, 0.99]).alias("_p"), share(F.col("v") >= clip).alias("clip_ratio"), F.count(F.lit(1)).alias("n"))
    g = g.select(*keys, "region", "n", "clip_ratio", *[F.col("_p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90", "p99"))])
    bg = g.where(F.col("region") == "bg").select(*keys, F.col("p50").alias("_bg"))
    g = g.join(bg, keys, "left")
    return g.select(
        *keys, "region", "n", "p10", "p50", "p90", "p99", "clip_ratio", (F.col("p90") - F.col("p10")).alias("span"),
        ((F.col("p90") - F.col("p10")) / F.nullif(F.abs("p50"), F.lit(0.0))).alias("rel_contrast"),
        (F.col("p50") - F.col("_bg")).alias("above_bg"))


def region_profiles(px: DataFrame, regs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean profile along x and along y inside every region."""
    a = assign_regions(px, regs)
    fx = a.groupBy(*keys, "region", F.col("x").alias("i")).agg(F.avg("v").alias("m")).withColumn("axis", F.lit("x"))
    fy = a.groupBy(*keys, "region", F.col("y").alias("i")).agg(F.avg("v").alias("m")).withColumn("axis", F.lit("y"))
    return fx.unionByName(fy)


def paired_diff(px2: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("cv") - F.col("pv")
    return px2.withColumn("d", d).groupBy(*keys).agg(
        F.count_if(d > 0).alias("n_pos"), F.count_if(d < 0).alias("n_neg"),
        F.sum(F.greatest(d, F.lit(0.0))).alias("mass_pos"), F.sum(F.greatest(-d, F.lit(0.0))).alias("mass_neg"),
        F.max(F.abs(d)).alias("max_abs"), F.max_by(F.struct("y", "x"), F.struct(F.abs("d"), -F.col("y"), -F.col("x"))).alias("_at")
    ).withColumn("at_y", F.col("_at.y")).withColumn("at_x", F.col("_at.x")).drop("_at")


def endpoint_transitions(px2: DataFrame, keys: list[str], lo: float, hi: float, b: int = 4) -> DataFrame:
    """Endpoint pixels of parent and candidate: new, persisting, recovered; per pair and per grid tile."""
    t = px2.withColumn("p_end", (F.col("pv") <= lo) | (F.col("pv") >= hi)).withColumn("c_end", (F.col("cv") <= lo) | (F.col("cv") >= hi))
    over = F.greatest(F.col("cv") - hi, lo - F.col("cv"), F.lit(0.0))
    tile = F.concat_ws(":", F.floor(F.col("y") / b).cast("string"), F.floor(F.col("x") / b).cast("string"))
    per = t.groupBy(*keys, tile.alias("tile")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("p_end").alias("parent_n"), F.count_if("c_end").alias("candidate_n"),
        F.count_if(F.col("c_end") & ~F.col("p_end")).alias("new_n"), F.count_if(F.col("c_end") & F.col("p_end")).alias("kept_n"),
        F.count_if(~F.col("c_end") & F.col("p_end")).alias("recovered_n"), F.max(over).alias("overshoot"))
    sums = [F.sum(c).alias(c) for c in ("n", "parent_n", "candidate_n", "new_n", "kept_n", "recovered_n")]
    whole = per.groupBy(*keys).agg(*sums, F.max("overshoot").alias("overshoot")).withColumn("tile", F.lit("all"))
    return per.unionByName(whole).withColumn("new_rate", F.col("new_n") / F.col("n"))


def neutral_ranges(rgb2: DataFrame, regs: DataFrame) -> DataFrame:
    """Per image and region: spread of the three channel medians before and after."""
    a = assign_regions(rgb2, regs)
    cols = ["r", "g", "b", "cr", "cg", "cb"]
    g = a.groupBy("session", "img", "region").agg(*[F.median(c).alias(c) for c in cols])
    return g.select(
        "session", "img", "region",
        (F.greatest("r", "g", "b") - F.least("r", "g", "b")).alias("before"),
        (F.greatest("cr", "cg", "cb") - F.least("cr", "cg", "cb")).alias("after"))


def neutral_benefit(rgb2: DataFrame, regs: DataFrame) -> DataFrame:
    """Held-out neutral range of a session: median and p90 before and after, share improved and worsened."""
    r = neutral_ranges(rgb2, regs)
    shares = r.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("after") < F.col("before")).alias("improved"),
        share(F.col("after") > F.col("before")).alias("worsened"))
    q = {"med": (0.5, "pL"), "p90": (0.9, "pL")}
    b = exact_quantiles(r, ["session"], "before", {f"before_{k}": v for k, v in q.items()})
    c = exact_quantiles(r, ["session"], "after", {f"after_{k}": v for k, v in q.items()})
    return shares.join(b, "session").join(c, "session")


def neutral_coefficients(rgb: DataFrame, regs: DataFrame, keys: list[str], top: float = 0.98) -> DataFrame:
    """Gains that bring the channel signals to the smallest, when signals clear noise and saturation guards."""
    a = assign_regions(rgb, regs)
    per = a.groupBy(*keys, "region").agg(*[F.median(c).alias(c) for c in "rgb"])
    med = per.groupBy(*keys).agg(*[F.median(c).alias(f"sig_{c}") for c in "rgb"])
    sd = a.groupBy(*keys).agg(*[F.stddev_pop(c).alias(f"sd_{c}") for c in "rgb"])
    m = med.join(sd, keys)
    small = F.least("sig_r", "sig_g", "sig_b")
    guard = (F.greatest("sig_r", "sig_g", "sig_b") < top)
    for c in "rgb":
        guard = guard & (F.col(f"sig_{c}") > 5 * F.col(f"sd_{c}") / F.sqrt(F.lit(64.0)))
    return m.select(
        *keys, F.when(guard, "measured").otherwise("unavailable").alias("status"),
        *[F.when(guard, small / F.col(f"sig_{c}")).alias(f"gain_{c}") for c in "rgb"])


def bootstrap_index(rep: Column, i: Column, seed: int, n: Column) -> Column:
    """Deterministic resample index: a fixed integer mix, so retries and oracles agree."""
    return F.pmod(rep * 7919 + i * 104729 + rep * i * 31 + F.lit(seed), n)


def background_benefit(px2: DataFrame, regs: DataFrame, seed: int = 11, reps: int = 16, b: int = 2) -> DataFrame:
    """Change of the background span between parent and candidate with a paired block bootstrap.

    ROI level = median of its block medians, span = P90-P10 over ROIs; the verdict needs a change
    beyond max(3 * bootstrap deviation, 1e-6).
    """
    keys = ["session", "parent", "candidate"]
    a = assign_regions(px2, regs)
    bm = a.groupBy(*keys, "region", F.floor(F.col("y") / b).alias("by"), F.floor(F.col("x") / b).alias("bx")).agg(
        F.median("pv").alias("pm"), F.median("cv").alias("cm"))
    rois = bm.groupBy(*keys, "region").agg(
        F.sort_array(F.collect_list(F.struct("by", "bx", "pm", "cm"))).alias("blk"), F.median("pm").alias("p0"), F.median("cm").alias("c0"))

    def span(df: DataFrame, extra: list[str], p: str, c: str, name: str) -> DataFrame:
        return df.groupBy(*keys, *extra).agg(
            ((pct(c, 0.9) - pct(c, 0.1)) - (pct(p, 0.9) - pct(p, 0.1))).alias(name))

    n = F.size("blk").cast("long")
    r = rois.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draw = F.transform(
        F.sequence(F.lit(0), F.size("blk") - 1),
        lambda i: F.get(F.col("blk"), bootstrap_index(F.col("rep").cast("long"), i.cast("long"), seed, n).cast("int")))
    r = r.withColumn("d", draw).select(
        *keys, "rep", median_of(F.transform("d", lambda z: z["pm"])).alias("p"), median_of(F.transform("d", lambda z: z["cm"])).alias("c"))
    sd = span(r, ["rep"], "p", "c", "delta").groupBy(*keys).agg(F.stddev_samp("delta").alias("sd"))
    base = span(rois, [], "p0", "c0", "change").join(sd, keys)
    limit = F.greatest(3 * F.col("sd"), F.lit(1e-6))
    return base.select(
        *keys, "change", "sd",
        F.when(F.col("change") < -limit, "improved").when(F.col("change") > limit, "worsened").otherwise("unchanged").alias("verdict"))


def separation(means: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return means.groupBy(*keys).agg((pct(value, 0.75) / F.nullif(pct(value, 0.25), F.lit(0.0))).alias(name))


def screen_corpus(rgb: DataFrame, b: int = 2, window: int = 4, need: float = 1.30) -> DataFrame:
    """Subject separation of block-smoothed luminance; share of windows measurable decides the class."""
    keys = ["session", "img"]
    sm = blocks(with_luminance(rgb), keys, b, F.avg("l"), "m")
    whole = separation(sm, keys, "m", "sep")
    win = sm.withColumn("win", F.floor(F.col("by") * b / window) * 10 + F.floor(F.col("bx") * b / window))
    ws = separation(win, [*keys, "win"], "m", "wsep").groupBy(*keys).agg(share(F.col("wsep") >= need).alias("measurable_share"))
    s = F.col("measurable_share")
    return whole.join(ws, keys).withColumn("measurable", F.col("sep") >= need).withColumn(
        "grade", F.when(s >= 0.8, "strong").when(s >= 0.5, "usable").otherwise("weak"))


def black_corners(tiles: DataFrame, steps: int = 8, worst: float = 0.10, floor: float = 0.0) -> DataFrame:
    """Share of pixels at or below the floor on evenly stepped frames plus the last of a session.

    ``tiles`` carries the 0-based position ``rk``; the last position is one max per session.
    """
    last = tiles.groupBy("session").agg((F.max("rk") + 1).alias("n"))
    step = F.greatest(F.floor(F.col("n") / steps), F.lit(1))
    pick = attach(tiles, cut(last), ["session"]).where((F.col("rk") % step == 0) | (F.col("rk") == F.col("n") - 1))
    dark = F.size(F.filter("tile", lambda v: v <= floor)) / F.size("tile")
    return pick.select("session", dark.alias("s")).groupBy("session").agg(
        F.count(F.lit(1)).alias("checked"), F.max("s").alias("worst")).withColumn("failed", F.col("worst") > worst)


# fixed values: knots of the tone match
KNOTS = (0.01, 0.05, 0.15, 0.30, 0.50, 0.70, 0.85, 0.95, 0.99)


def tone_match(px2: DataFrame, keys: list[str], blend: float = 0.7) -> DataFrame:
    """Map parent values onto the candidate's nine quantile knots, piecewise linear, blended."""
    q = px2.groupBy(*keys).agg(F.percentile("pv", list(KNOTS)).alias("sx"), F.percentile("cv", list(KNOTS)).alias("sy"))

    def increasing(col: str) -> Column:
        first = F.get(F.col(col), F.lit(0))
        return F.aggregate(
            F.slice(col, 2, len(KNOTS) - 1), F.array(first),
            lambda acc, v: F.concat(acc, F.array(F.greatest(v, F.element_at(acc, -1) + 1e-6))))

    q = q.select(*keys, increasing("sx").alias("sx"), increasing("sy").alias("sy"))
    j = px2.join(q, keys)
    seg = sum(((F.col("pv") >= F.col("sx")[i]).cast("int") for i in range(1, len(KNOTS) - 1)), F.lit(0))
    j = j.withColumn("_s", seg)
    x0, x1 = F.get("sx", F.col("_s")), F.get("sx", F.col("_s") + 1)
    y0, y1 = F.get("sy", F.col("_s")), F.get("sy", F.col("_s") + 1)
    t = clamp((F.col("pv") - x0) / (x1 - x0))
    return j.withColumn("mapped", (1 - blend) * F.col("pv") + blend * (y0 + (y1 - y0) * t)).drop("sx", "sy", "_s")


def texture_stats(px: DataFrame, keys: list[str], b: int = 4) -> DataFrame:
    """Gradient kurtosis, dark-halo ratio on the edge mask, highlight index, texture SNR."""
    wx = W.partitionBy(*keys, "y").orderBy("x")
    wy = W.partitionBy(*keys, "x").orderBy("y")
    g = px.withColumn("gx", F.col("v") - F.lag("v").over(wx)).withColumn("gy", F.col("v") - F.lag("v").over(wy))
    g = g.withColumn("grad", F.hypot(F.coalesce("gx", F.lit(0.0)), F.coalesce("gy", F.lit(0.0))))
    bm = blocks(px, keys, b, F.avg("v"), "base")
    g = g.withColumn("by", F.floor(F.col("y") / b)).withColumn("bx", F.floor(F.col("x") / b)).join(bm, [*keys, "by", "bx"])
    q = g.groupBy(*keys).agg(
        pct("grad", 0.998).alias("g998"), pct("grad", 0.8).alias("g80"), pct("v", 0.9995).alias("top"),
        pct("v", 0.55).alias("v55"), pct("v", 0.20).alias("v20"))
    j = g.join(q, keys).withColumn("hp", F.abs(F.col("v") - F.col("base")))
    use = (F.col("grad") <= F.col("g998")) & (F.col("v") >= 0.08 * F.col("top")) & (F.col("v") <= 0.95 * F.col("top"))
    gg = F.when(use, F.col("grad"))
    edge = F.col("grad") >= F.col("g80")
    halo = F.when(edge, F.greatest(F.col("base") - F.col("v"), F.lit(0.0)))
    hi_hp, lo_hp = F.avg(F.when(F.col("v") > F.col("v55"), F.col("hp"))), F.avg(F.when(F.col("v") < F.col("v20"), F.col("hp")))
    out = j.groupBy(*keys).agg(
        (F.kurtosis(gg) + 3).alias("grad_kurtosis"),
        (F.sum(halo) / F.nullif(F.sum(F.when(edge, F.abs("base"))), F.lit(0.0))).alias("halo_ratio"),
        share(F.col("v") >= 0.98 * F.col("top")).alias("highlight_index"),
        (hi_hp / F.nullif(lo_hp, F.lit(0.0))).alias("texture_snr"))
    return out.withColumn("structured", F.coalesce(F.col("texture_snr") >= 1.7, F.lit(False)))


def range_health(px2: DataFrame, keys: list[str]) -> DataFrame:
    ps = [0.5, 0.99, 0.999]
    g = px2.groupBy(*keys).agg(F.percentile("pv", ps).alias("p"), F.percentile("cv", ps).alias("c"), F.max("cv").alias("top"))
    before, after = F.col("p")[1] - F.col("p")[0], F.col("c")[1] - F.col("c")[0]
    return g.select(
        *keys, before.alias("span_before"), after.alias("span_after"), F.col("c")[2].alias("p999"),
        (F.col("c")[2] / F.nullif(F.col("top"), F.lit(0.0))).alias("core_ratio"),
        (after < F.greatest(F.lit(0.02), 0.25 * before)).alias("collapsed"))


def starless_stats(px: DataFrame, keys: list[str], side: int, dark: float = 0.35, corner: int = 2) -> DataFrame:
    dim = px.groupBy(*keys).agg(pct("v", dark).alias("_cut"))
    nz = robust_sigma(px.join(dim, keys).where(F.col("v") <= F.col("_cut")), keys, "v", "noise")
    reg = px.withColumn("reg", corner_region(side, corner, 0)).where(F.col("reg").isNotNull())
    c = reg.groupBy(*keys, "reg").agg(F.avg("v").alias("m")).groupBy(*keys).agg((F.max("m") / F.nullif(F.min("m"), F.lit(0.0))).alias("corner_ratio"))
    return nz.join(c, keys)


def region_goals(rgb2: DataFrame, regs: DataFrame, keys: list[str], mask: float = 0.5) -> DataFrame:
    """Colour fractions of a region before and after, and the share of its pixels in the subject mask."""
    a = assign_regions(rgb2, regs).withColumn("l", lum())
    g = a.groupBy(*keys, "region").agg(
        *[F.median(c).alias(c) for c in ("r", "g", "b", "cr", "cg", "cb")], share(F.col("l") > mask).alias("mask_share"))
    t, ct = F.col("r") + F.col("g") + F.col("b"), F.col("cr") + F.col("cg") + F.col("cb")
    return g.select(
        *keys, "region", "mask_share", *[(F.col(c) / t).alias(f"before_{c}") for c in "rgb"],
        *[(F.col(f"c{c}") / ct).alias(f"after_{c}") for c in "rgb"])


def detail_energy(px: DataFrame, regs: DataFrame, keys: list[str], scales: tuple[int, ...] = (2, 4)) -> DataFrame:
    """Mean |v - block mean| per region and scale over the same in the background region."""
    s = px.withColumn("scale", F.explode(F.array(*[F.lit(k) for k in scales])))
    s = s.withColumn("by", F.floor(F.col("y") / F.col("scale"))).withColumn("bx", F.floor(F.col("x") / F.col("scale")))
    m = s.groupBy(*keys, "scale", "by", "bx").agg(F.avg("v").alias("m"))
    e = s.join(m, [*keys, "scale", "by", "bx"])
    a = assign_regions(e, regs).groupBy(*keys, "region", "scale").agg(F.avg(F.abs(F.col("v") - F.col("m"))).alias("energy"))
    floor = a.where(F.col("region") == "bg").select(*keys, "scale", F.col("energy").alias("floor"))
    return a.join(floor, [*keys, "scale"], "left").withColumn("over_floor", F.col("energy") / F.nullif(F.col("floor"), F.lit(0.0)))
