"""Cross-frame pixel stacks.

Frames stay one row with an array of pixels: frame-level statistics are map-only array
expressions, session-level scalars and per-pixel planes come back by equi joins on the session,
and pixels are exploded only for the aggregations that really cross frames.  Those aggregations
are sums and counts (combined before the shuffle) or rank-band quantiles, so a session holding a
third of all frames is spread like any other.  The small per-session results are checkpointed where
they are made, so that the frame table itself is never part of a repeated sub-plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from astrolake.functions.scan import attach, exact_median, exact_quantiles, median_mad
from astrolake.session import cut
from astrolake.functions.tiles import MAD_TO_SIGMA, doubles, median_of, quantile_of, sigma_of

SIDE = 8


def norm_exposure(tiles: DataFrame, t0: float = 60.0) -> DataFrame:
    """Scale every frame to the reference exposure: D * t0 / t."""
    k = F.lit(t0) / F.col("exposure")
    return tiles.withColumn("tile", F.transform(doubles(F.col("tile")), lambda v: v * k))


def align_sky(tiles: DataFrame) -> DataFrame:
    """Shift each frame so that its median equals the median of the anchor frame of its session.

    The anchor is the frame whose median lies nearest the session median of medians.
    Adds ``sky`` (own level) and ``b0`` (anchor level).
    """
    own = tiles.withColumn("sky", median_of(doubles(F.col("tile"))))
    levels = own.select("session", "frame", "sky")
    mid = exact_median(levels, ["session"], "sky", "mid")
    anchor = (
        attach(levels, cut(mid), ["session"])
        .groupBy("session")
        .agg(F.min_by("sky", F.struct(F.round(F.abs(F.col("sky") - F.col("mid")), 9), F.col("frame"))).alias("b0"))
    )
    anchor = cut(anchor)
    shift = F.col("sky") - F.col("b0")
    return attach(own, anchor, ["session"]).withColumn("tile", F.transform(doubles(F.col("tile")), lambda v: v - shift))


def frame_weights(aligned: DataFrame) -> DataFrame:
    """Frame noise sigma, clarity C = median FWHM / FWHM and snr S = median sigma / sigma."""
    t = doubles(F.col("tile"))
    own = aligned.withColumn("sigma", sigma_of(t))
    fw = exact_median(own, ["session"], "fwhm", "fwhm_mid")
    sg = exact_median(own, ["session"], "sigma", "sigma_mid")
    mids = cut(fw.join(sg, "session"))
    return (
        attach(own, mids, ["session"])
        .withColumn("clarity", F.col("fwhm_mid") / F.col("fwhm"))
        .withColumn("snr", F.col("sigma_mid") / F.col("sigma"))
        .drop("fwhm_mid", "sigma_mid")
    )


def explode_tile(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode("tile").alias("pos", "v"))


def reference_image(aligned: DataFrame, k: int = 8) -> DataFrame:
    """Per-pixel median of the k sharpest frames of a session."""
    w = W.partitionBy("session").orderBy("fwhm", "frame")
    sharp = aligned.select("session", "frame", "fwhm", "tile").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return explode_tile(sharp, "session").groupBy("session", "pos").agg(F.median("v").alias("ref"))


def window_max(df: DataFrame, keys: list[str], value: str, h: int, name: str) -> DataFrame:
    """Maximum over a (2h+1)^2 square as two separable range frames, by row and then by column."""
    along_x = W.partitionBy(*keys, "y").orderBy("x").rangeBetween(-h, h)
    along_y = W.partitionBy(*keys, "x").orderBy("y").rangeBetween(-h, h)
    return df.withColumn("_mx", F.max(value).over(along_x)).withColumn(name, F.max("_mx").over(along_y)).drop("_mx")


def with_yx(df: DataFrame) -> DataFrame:
    return df.withColumn("y", F.floor(F.col("pos") / SIDE).cast("int")).withColumn("x", (F.col("pos") % SIDE).cast("int"))


def detail_field(ref: DataFrame, h: int = 2, eps: float = 8.0, eta: float = 1.0) -> DataFrame:
    """R = clip(d / (local max d + eps*sigma), 0, 1)^eta with d the signal above the reference sky."""
    ref = cut(ref)
    stats = median_mad(ref, ["session"], "ref", "mu", "mad")
    d = attach(ref, cut(stats), ["session"]).withColumn("d", F.greatest(F.col("ref") - F.col("mu"), F.lit(0.0)))
    m = window_max(with_yx(d), ["session"], "d", h, "m")
    r = F.col("d") / (F.col("m") + eps * MAD_TO_SIGMA * F.col("mad"))
    return m.withColumn("detail", F.pow(F.least(F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(eta)))


def to_planes(pixels: DataFrame, cols: list[str]) -> DataFrame:
    """Gather per-pixel columns of a session into position-ordered arrays (bounded by the tile size)."""
    packed = pixels.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("pos", *cols))).alias("_p"))
    return packed.select("session", *[F.col(f"_p.{c}").alias(c) for c in cols])


def reject(
    weighted: DataFrame, detail: DataFrame, kappa: float = 3.5, gate: float = 1 / 3
) -> DataFrame:
    """Attach per-pixel planes and reject flags.

    A value is flagged when it departs from the cross-frame median by more than
    ``kappa*s + m*R*max(a - b0, 0)``; ``m`` is the session median over frames of the 99th percentile
    departure on detail pixels.  Pixels where more than ``gate`` of the frames are flagged beyond
    the count expected from noise are left alone.
    """
    long = explode_tile(weighted, "session", "frame")
    planes = median_mad(long, ["session", "pos"], "v", "a", "dev")
    planes = planes.join(detail.select("session", "pos", "detail"), ["session", "pos"])
    arrays = cut(to_planes(planes, ["a", "dev", "detail"]))
    f = attach(weighted, arrays, ["session"])
    b0 = F.col("b0")
    parts = F.arrays_zip("tile", "a", "detail")
    ratios = F.transform(
        F.filter(parts, lambda z: (z["detail"] > 0.5) & (z["a"] > b0)),
        lambda z: F.abs(z["tile"] - z["a"]) / (z["a"] - b0),
    )
    f = f.withColumn("p99", quantile_of(ratios, 0.99))
    m = exact_median(f, ["session"], "p99", "m")
    sessions = arrays.select("session").join(m, "session", "left")
    f = attach(f, cut(sessions.withColumn("m", F.coalesce("m", F.lit(0.0)))), ["session"])
    mm = F.col("m")
    flags = F.transform(
        F.arrays_zip("tile", "a", "dev", "detail"),
        lambda z: F.abs(z["tile"] - z["a"])
        > kappa * MAD_TO_SIGMA * z["dev"] + mm * z["detail"] * F.greatest(z["a"] - b0, F.lit(0.0)),
    )
    f = f.withColumn("flag", flags)
    expected = math.erfc(kappa / math.sqrt(2))
    counts = (
        f.select("session", F.posexplode("flag").alias("pos", "f"))
        .groupBy("session", "pos")
        .agg(F.sum(F.col("f").cast("int")).alias("c"), F.count(F.lit(1)).alias("n"))
    )
    allow = counts.withColumn("act", F.col("c") - F.col("n") * expected <= gate * F.col("n"))
    f = attach(f, cut(to_planes(allow, ["act"])), ["session"])
    return f.withColumn("flag", F.zip_with("flag", "act", lambda a, b: a & b)).drop("act")


def fused_weight(a_exp: float, b_exp: float, detail: Column) -> Column:
    return F.pow(F.col("clarity"), a_exp * detail) * F.pow(F.col("snr"), b_exp * (1 - detail))


def stack_weighted(flagged: DataFrame, a_exp: float = 20.0, b_exp: float = 2.0) -> DataFrame:
    """Weighted mean per pixel with W = C^(A*R) * S^(B*(1-R)), rejected values at weight zero.

    Also returns the effective frame count (sum W)^2 / sum W^2.
    """
    z = flagged.select(
        "session", "clarity", "snr", F.posexplode(F.arrays_zip("tile", "detail", "flag")).alias("pos", "z")
    )
    w = F.when(F.col("z.flag"), F.lit(0.0)).otherwise(fused_weight(a_exp, b_exp, F.col("z.detail")))
    z = z.select("session", "pos", F.col("z.tile").alias("v"), F.col("z.flag").alias("flag"), w.alias("w"))
    return with_yx(
        z.groupBy("session", "pos").agg(
            (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"),
            (F.pow(F.sum("w"), F.lit(2.0)) / F.sum(F.col("w") * F.col("w"))).alias("neff"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("flag").cast("int")).alias("rejected"),
        )
    )


def noise_step(stacked: DataFrame) -> DataFrame:
    """nu = sqrt(N/Neff) over its median across the pixels of the session."""
    s = stacked.withColumn("step", F.sqrt(F.col("n") / F.col("neff")))
    s = cut(s)
    mid = exact_median(s, ["session"], "step", "mid")
    return attach(s, cut(mid), ["session"]).withColumn("nu", F.col("step") / F.col("mid"))


def weighted_stack(tiles: DataFrame, k: int = 8) -> DataFrame:
    """The whole chain from raw tiles to the weighted stack."""
    w = frame_weights(align_sky(norm_exposure(tiles)))
    return stack_weighted(reject(w, detail_field(reference_image(w, k))))


def clamp_passes(px: DataFrame, keys: list[str], low: float, high: float, passes: int) -> DataFrame:
    """Winsorised values: a fixed number of clamp-to-[mean - low*sd, mean + high*sd] passes."""
    cur = px
    for _ in range(passes):
        st = cur.groupBy(*keys).agg(F.avg("v").alias("_mu"), F.stddev_pop("v").alias("_sd"))
        cur = cur.join(cut(st), keys).withColumn(
            "v", F.least(F.greatest(F.col("v"), F.col("_mu") - low * F.col("_sd")), F.col("_mu") + high * F.col("_sd"))
        ).drop("_mu", "_sd")
    return cur


def scale_frames(aligned: DataFrame) -> DataFrame:
    """Additive-with-scaling normalisation: bring each frame to the session's median level and spread."""
    t = doubles(F.col("tile"))
    own = aligned.withColumn("loc", median_of(t)).withColumn("scl", F.nullif(sigma_of(t), F.lit(0.0)))
    ref = cut(exact_median(own, ["session"], "loc", "loc0").join(exact_median(own, ["session"], "scl", "scl0"), "session"))
    j = attach(own, ref, ["session"])
    k, a, b = F.coalesce(F.col("scl0") / F.col("scl"), F.lit(1.0)), F.col("loc"), F.col("loc0")
    return j.withColumn("tile", F.transform(t, lambda v: (v - a) * k + b)).drop("loc", "scl", "loc0", "scl0")


def stack(tiles: DataFrame, low: float = 4.0, high: float = 3.0, passes: int = 2) -> DataFrame:
    """Plain stacks side by side: mean, median, winsorised and FWHM-weighted mean, clamp counts."""
    long = explode_tile(scale_frames(tiles), "session", "frame", "fwhm").withColumn("raw", F.col("v"))
    keys = ["session", "pos"]
    win = clamp_passes(long, keys, low, high, passes)
    wt = 1 / (F.col("fwhm") * F.col("fwhm"))
    agg = win.groupBy(*keys).agg(
        F.avg("raw").alias("mean"), F.avg("v").alias("winsor"),
        (F.sum(wt * F.col("v")) / F.sum(wt)).alias("weighted"),
        F.sum((F.col("raw") > F.col("v")).cast("int")).alias("n_high"),
        F.sum((F.col("raw") < F.col("v")).cast("int")).alias("n_low"),
    )
    med = exact_quantiles(long, keys, "raw", {"median": (0.5, "pL")})
    return with_yx(agg.join(med, keys))


def edge_coverage(px: DataFrame, keys: list[str], floor: float = 0.0) -> DataFrame:
    """First and last covered column of every pixel row."""
    hit = F.when(F.col("v") > floor, F.col("x"))
    return px.groupBy(*keys, "y").agg(F.min(hit).alias("lft"), F.max(hit).alias("rgt"), F.count(hit).alias("filled"))


def common_coverage(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Columns covered by every layer of a row and the share lost against the widest layer."""
    g = edges.groupBy(*keys, "y").agg(
        F.max("lft").alias("lft"), F.min("rgt").alias("rgt"),
        F.max(F.col("rgt") - F.col("lft") + 1).alias("widest"), F.count(F.lit(1)).alias("layers"),
    )
    width = F.greatest(F.col("rgt") - F.col("lft") + 1, F.lit(0))
    return g.withColumn("width", width).withColumn("loss_pct", 100.0 * (F.col("widest") - width) / F.col("widest"))


def trim_borders(px: DataFrame, keys: list[str], side: int, cap: float = 0.04, nsig: float = 2.5, ratio: float = 0.70) -> DataFrame:
    """How many outer rows and columns to drop per frame.

    A border line is bad while its median lies beyond ``nsig`` interior sigmas or below ``ratio`` of
    the interior median; the run of bad lines from the edge counts, up to ``cap`` of the side (one at least).
    """
    limit = max(1, int(side * cap))
    q = max(1, side // 4)
    core = px.where((F.col("y") >= q) & (F.col("y") < side - q) & (F.col("x") >= q) & (F.col("x") < side - q))
    mid = core.groupBy(*keys).agg(F.median("v").alias("mid"))
    sd = core.join(mid, keys).groupBy(*keys).agg((MAD_TO_SIGMA * F.median(F.abs(F.col("v") - F.col("mid")))).alias("sd"))
    lines = px.groupBy(*keys, "y").agg(F.median("v").alias("lm")).select(*keys, F.lit("row").alias("axis"), F.col("y").alias("i"), "lm")
    cols = px.groupBy(*keys, "x").agg(F.median("v").alias("lm")).select(*keys, F.lit("col").alias("axis"), F.col("x").alias("i"), "lm")
    both = lines.unionByName(cols).join(mid.join(sd, keys), keys)
    bad = (F.abs(F.col("lm") - F.col("mid")) > nsig * F.col("sd")) | (F.col("lm") < ratio * F.col("mid"))
    both = both.withColumn("good_i", F.when(~bad, F.col("i")))
    g = both.groupBy(*keys, "axis").agg(F.min("good_i").alias("first"), F.max("good_i").alias("last"))
    lo = F.least(F.coalesce(F.col("first"), F.lit(side)), F.lit(limit))
    hi = F.least(F.lit(side - 1) - F.coalesce(F.col("last"), F.lit(-1)), F.lit(limit))
    return g.select(*keys, "axis", lo.alias("trim_start"), hi.alias("trim_end"))


def stack_report(kept: DataFrame, declared: DataFrame) -> DataFrame:
    """Membership count against the declared count, and the FWHM gain of selection in percent."""
    got = kept.groupBy("session").agg(F.count(F.lit(1)).alias("kept"), F.avg("fwhm").alias("fwhm_after"))
    j = declared.join(got, "session", "left")
    return j.select(
        "session", "declared", F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.coalesce("kept", F.lit(0)) == F.col("declared")).alias("membership_ok"),
        "fwhm_before", "fwhm_after",
        ((F.col("fwhm_before") - F.col("fwhm_after")) / F.col("fwhm_before") * 100).alias("gain_pct"),
    )
