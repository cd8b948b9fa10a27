"""Frame statistics on whole tiles: a frame stays one row with its array, so no pixel is exploded or shuffled.

Tiles hold finite values, row by row; ``clean_finite`` makes them so.  A null or empty tile gives null statistics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.functions.tiles import (
    MAD_TO_SIGMA, block_at, correlation_of, doubles, indices, let, mean_of, median_of, n_blocks, quantile_at, quantile_of, rectangle, sigma_of, spread_of, square_around)
from astrolake.operators.images import LUMA, PERCENTILES, clamp, solve_plane
from astrolake.session import hold


def _per_frame(tiles: DataFrame, keys: list[str], body: Callable[[Column], Column]) -> DataFrame:
    """keys and the fields of the struct that ``body`` makes of the tile as doubles."""
    made = F.when(F.size("tile") > 0, let(doubles(F.col("tile")), body))
    return hold(tiles.select(*keys, "tile"), "_made", made).select(*keys, "_made.*")


def _with_tile(tiles: DataFrame, body: Callable[[Column], Column]) -> DataFrame:
    return tiles.withColumn("tile", F.when(F.size("tile") > 0, let(doubles(F.col("tile")), body)).otherwise(doubles(F.col("tile"))))


def normalize_robust(tiles: DataFrame) -> DataFrame:
    """``tiles`` at clip((v - p0.1) / (p99.9 - p0.1)); falls back to min/max, then to a span of one."""

    def body(t: Column) -> Column:
        def span(s: Column) -> Column:
            a, b, mn, mx = quantile_at(s, 0.001), quantile_at(s, 0.999), F.get(s, F.lit(0)), F.get(s, F.size(s) - 1)
            return F.struct(F.when(b > a, a).otherwise(mn).alias("lo"), F.when(b > a, b - a).when(mx > mn, mx - mn).otherwise(1.0).alias("span"))

        return let(let(F.sort_array(t), span), lambda m: F.transform(t, lambda v: clamp((v - m["lo"]) / m["span"])))

    return _with_tile(tiles, body)


def clean_finite(tiles: DataFrame) -> DataFrame:
    """``tiles`` with NaN and infinities replaced by the finite median of the frame (0 without one); counts ride along."""
    inf = float("inf")
    finite = lambda v: ~F.isnan(v) & (v < inf) & (v > -inf)
    t = F.coalesce("tile", F.array().cast("array<double>"))
    counted = tiles.select(
        "*", F.size(F.filter(t, lambda v: F.isnan(v))).alias("n_nan"), F.size(F.filter(t, lambda v: v == inf)).alias("n_posinf"), F.size(F.filter(t, lambda v: v == -inf)).alias("n_neginf"))
    return _with_tile(counted, lambda t: let(F.coalesce(median_of(F.filter(t, finite)), F.lit(0.0)), lambda m: F.transform(t, lambda v: F.when(finite(v), v).otherwise(m))))


def image_stats(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Range, mean, spread, percentiles and the shares at and near the ends of the range; the tile is sorted once."""
    names = [f"p{str(p).replace('.', '_')}" for p in PERCENTILES]

    def body(t: Column) -> Column:
        def ends(s: Column) -> Column:
            return F.struct(F.get(s, F.lit(0)).alias("mn"), F.get(s, F.size(s) - 1).alias("mx"), mean_of(s).alias("mean"), quantile_at(s, 0.5).alias("mid"))

        def rest(s: Column, m: Column) -> Column:
            part = lambda test: F.size(F.filter(s, test)) / F.size(s)
            near = (m["mx"] - m["mn"]) * 1e-5
            return F.struct(
                *[m[c].alias(c) for c in ("mn", "mx", "mean")],
                F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, v: a + (v - m["mean"]) * (v - m["mean"])) / F.size(s)).alias("sd"),
                *[quantile_at(s, p / 100).alias(n) for n, p in zip(names, PERCENTILES)],
                (MAD_TO_SIGMA * median_of(F.transform(s, lambda v: F.abs(v - m["mid"])))).alias("mad_sigma"),
                part(lambda v: v == m["mn"]).alias("min_ratio"), part(lambda v: v == m["mx"]).alias("max_ratio"),
                part(lambda v: v <= m["mn"] + near).alias("near_min"), part(lambda v: v >= m["mx"] - near).alias("near_max"))

        return let(F.sort_array(t), lambda s: let(ends(s), lambda m: rest(s, m)))

    return _per_frame(tiles, keys, body)


def block_spread(tiles: DataFrame, keys: list[str], width: int, b: int) -> DataFrame:
    """P95-P5 of block medians over the absolute sky level."""

    def body(t: Column) -> Column:
        medians = F.transform(indices(n_blocks(t, width, b)), lambda k: median_of(block_at(t, width, b, k)))
        return let(F.sort_array(medians), lambda m: F.struct((quantile_at(m, 0.95) - quantile_at(m, 0.05)).alias("spread"), median_of(t).alias("sky")))

    return _per_frame(tiles, keys, body).withColumn("rel_spread", F.col("spread") / F.nullif(F.abs("sky"), F.lit(0.0)))


def noise(tiles: DataFrame, keys: list[str], width: int, dark: float = 0.35, b: int = 4) -> DataFrame:
    """Robust sigma of the 3x3 high-pass residual over the darkest share, and its spread over blocks."""

    def body(t: Column) -> Column:
        residual = F.transform(indices(F.size(t)), lambda k: F.get(t, k) - median_of(square_around(t, width, k, 1)))
        in_dark = lambda r, cut: F.transform(F.filter(indices(F.size(t)), lambda k: F.get(t, k) <= cut), lambda k: F.get(r, k))
        by_block = lambda r: F.transform(indices(n_blocks(t, width, b)), lambda k: sigma_of(block_at(r, width, b, k)))
        whole = lambda r: let(quantile_of(t, dark), lambda cut: sigma_of(in_dark(r, cut)))
        return let(residual, lambda r: let(F.sort_array(by_block(r)), lambda s: F.struct(
            whole(r).alias("sigma"), quantile_at(s, 0.5).alias("block_median"), quantile_at(s, 0.9).alias("block_p90"))))

    return _per_frame(tiles, keys, body)


def fit_plane(tiles: DataFrame, keys: list[str], side: int, dark: float = 0.45) -> DataFrame:
    """Background plane on the darkest share of a square frame, coordinates scaled to -1..1."""
    half = (side - 1) / 2

    def body(t: Column) -> Column:
        def add(a: Column, k: Column) -> Column:
            x, y, z = (k % side - half) / half, (F.floor(k / side) - half) / half, F.get(t, k)
            terms = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y, "sz": z, "sxz": x * z, "syz": y * z, "szz": z * z}
            return F.struct(*[(a[n] + v).alias(n) for n, v in terms.items()])

        zero = F.struct(*[F.lit(0.0).alias(n) for n in ("n", "sx", "sy", "sxx", "sxy", "syy", "sz", "sxz", "syz", "szz")])
        return let(quantile_of(t, dark), lambda cut: F.aggregate(F.filter(indices(F.size(t)), lambda k: F.get(t, k) <= cut), zero, add))

    p = solve_plane(_per_frame(tiles, keys, body), keys)
    return p.withColumn("magnitude", F.hypot("b", "c")).withColumn("angle", F.degrees(F.atan2("c", "b")))


def corner_uniformity(tiles: DataFrame, keys: list[str], side: int, corner: int = 2, centre: int = 4) -> DataFrame:
    """Corner and centre medians; corners lifted by sky structure are exempt from the effective ratio."""
    far, mid = side - corner, (side - centre) // 2

    def body(t: Column) -> Column:
        medians = F.array(*[median_of(rectangle(t, side, y, x, corner, corner)) for y in (0, far) for x in (0, far)])
        inner = median_of(rectangle(t, side, mid, mid, centre, centre))
        base = F.struct(medians.alias("rm"), inner.alias("centre"), median_of(t).alias("med"), sigma_of(t).alias("sg"))

        def told(m: Column) -> Column:
            limit = F.greatest(m["med"] + 3 * m["sg"], 1.35 * m["med"])
            clean = F.filter(m["rm"], lambda v: v <= limit)
            return F.struct(
                m["centre"].alias("centre"), F.array_min(m["rm"]).alias("corner_min"), F.array_max(m["rm"]).alias("corner_max"),
                (F.array_max(m["rm"]) - F.array_min(m["rm"])).alias("corner_range"), (mean_of(m["rm"]) / F.nullif(m["centre"], F.lit(0.0))).alias("corner_to_centre"),
                F.size(F.filter(m["rm"], lambda v: v > limit)).alias("lifted"), (F.array_max(clean) - F.array_min(clean)).alias("clean_range"))

        return let(base, told)

    return _per_frame(tiles, keys, body)


def sky_noise(tiles: DataFrame, keys: list[str], side: int, corner: int = 2) -> DataFrame:
    """Sky level from the darkest corner (ties: first by name) with its robust deviation."""
    far = side - corner
    places = {"tl": (0, 0), "tr": (0, far), "bl": (far, 0), "br": (far, far)}

    def body(t: Column) -> Column:
        told = lambda name: lambda v: F.struct(median_of(v).alias("sky"), F.lit(name).alias("reg"), sigma_of(v).alias("sg"))
        return F.array_min(F.array(*[let(rectangle(t, side, y, x, corner, corner), told(n)) for n, (y, x) in places.items()]))

    return _per_frame(tiles, keys, body).withColumn("rel_noise", F.col("sg") / F.nullif(F.abs("sky"), F.lit(0.0)))


def _per_image(planes: DataFrame, keys: list[str], names: str, body: Callable[[Column], Column]) -> DataFrame:
    """keys and the fields of the struct that ``body`` makes of the image's pixels: structs of r, g, b, l and, with a candidate, cr, cg, cb, cl."""

    def pixel(z: Column) -> Column:
        one = lambda pre: [z[pre + c].alias(pre + c) for c in "rgb"] + [sum(w * z[pre + c] for w, c in zip(LUMA, "rgb")).alias(pre + "l")]
        return F.struct(*[f for pre in names.split(",") for f in one(pre)])

    zipped = F.arrays_zip(*[pre + c for pre in names.split(",") for c in "rgb"])
    made = F.when(F.size("r") > 0, let(F.transform(zipped, pixel), body))
    return hold(planes, "_made", made).select(*keys, "_made.*")


def _field(px: Column, name: str) -> Column:
    return F.transform(px, lambda z: z[name])


def color_stats(planes: DataFrame, keys: list[str], dark: float = 0.30) -> DataFrame:
    """Dark medians, upper percentiles, their ratios and the correlations of the channels."""

    def body(px: Column) -> Column:
        below = let(quantile_of(_field(px, "l"), dark), lambda cut: F.filter(px, lambda z: z["l"] <= cut))
        return let(below, lambda low: F.struct(
            *[median_of(_field(low, c)).alias(f"bg_{c}") for c in "rgb"], *[quantile_of(_field(px, c), 0.99).alias(f"p99_{c}") for c in "rgb"],
            *[correlation_of(_field(px, a), _field(px, b)).alias(f"corr_{a}{b}") for a, b in ("rg", "rb", "gb")]))

    g = _per_image(planes, keys, "", body)
    mean = (F.col("bg_r") + F.col("bg_g") + F.col("bg_b")) / 3
    top = F.greatest("p99_r", "p99_g", "p99_b")
    for c in "rgb":
        g = g.withColumn(f"ratio_{c}", F.col(f"bg_{c}") / F.nullif(mean, F.lit(0.0)))
    return g.withColumn("collapsed", F.concat_ws(",", *[F.when(F.col(f"p99_{c}") < 0.01 * top, F.lit(c)) for c in "rgb"]))


def match_gains(planes: DataFrame, keys: list[str], dark: float = 0.60, lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """Channel gains to the reference from dark medians, geometric mean one, bounded; and the p99 ratio."""

    def body(px: Column) -> Column:
        below = lambda l: let(quantile_of(_field(px, l), dark), lambda cut: F.filter(px, lambda z: z[l] <= cut))
        return let(below("l"), lambda a: let(below("cl"), lambda b: F.struct(
            *[median_of(_field(a, c)).alias(f"s_{c}") for c in "rgb"], *[median_of(_field(b, f"c{c}")).alias(f"t_{c}") for c in "rgb"],
            (quantile_of(_field(px, "cl"), 0.99) / F.nullif(quantile_of(_field(px, "l"), 0.99), F.lit(0.0))).alias("signal_ratio"))))

    g = _per_image(planes, keys, ",c", body)
    raw = {c: F.greatest(F.col(f"t_{c}"), F.lit(1e-6)) / F.greatest(F.col(f"s_{c}"), F.lit(1e-6)) for c in "rgb"}
    gm = F.cbrt(raw["r"] * raw["g"] * raw["b"])
    return g.select(*keys, "signal_ratio", *[clamp(raw[c] / gm, lo, hi).alias(f"gain_{c}") for c in "rgb"])


def fidelity_metrics(planes: DataFrame, keys: list[str], min_bg: int = 16, snr_floor: float = 0.25, gain_cap: float = 1.60) -> DataFrame:
    """Chromaticity drift, chroma retention and noise gains of a candidate against its reference."""

    def marked(z: Column, sky: Column) -> Column:
        tot, ctot = z["r"] + z["g"] + z["b"], z["cr"] + z["cg"] + z["cb"]
        drift = F.greatest(*[F.abs(z[f"c{c}"] / ctot - z[c] / tot) for c in "rgb"])
        return F.struct(
            z["l"].alias("l"), z["cl"].alias("cl"), (z["l"] <= sky["med"]).alias("dark"),
            ((z["l"] > sky["med"] + 3 * sky["sg"]) & (F.greatest(z["r"], z["g"], z["b"]) < 0.98)).alias("subject"),
            (F.greatest(z["r"], z["g"], z["b"]) - F.least(z["r"], z["g"], z["b"])).alias("ch"),
            (F.greatest(z["cr"], z["cg"], z["cb"]) - F.least(z["cr"], z["cg"], z["cb"])).alias("cch"),
            F.when((tot > 1e-6) & (ctot > 1e-6), drift).alias("drift"))

    def told(dark: Column, subject: Column) -> Column:
        return F.struct(
            F.size(dark).alias("n_bg"), quantile_of(F.array_compact(_field(subject, "drift")), 0.95).alias("drift_p95"),
            median_of(_field(subject, "ch")).alias("s_ch"), median_of(_field(subject, "cch")).alias("s_cch"),
            spread_of(_field(dark, "ch")).alias("b_ch"), spread_of(_field(dark, "cch")).alias("b_cch"),
            median_of(_field(dark, "l")).alias("m_l"), median_of(_field(dark, "cl")).alias("m_cl"),
            sigma_of(_field(dark, "l")).alias("sig"), sigma_of(_field(dark, "cl")).alias("csig"))

    def body(px: Column) -> Column:
        sky = let(_field(px, "l"), lambda l: F.struct(median_of(l).alias("med"), sigma_of(l).alias("sg")))
        pixels = let(sky, lambda m: F.transform(px, lambda z: marked(z, m)))
        return let(pixels, lambda p: let(F.filter(p, lambda z: z["dark"]), lambda a: let(F.filter(p, lambda z: z["subject"]), lambda b: told(a, b))))

    g = _per_image(planes, keys, ",c", body)
    ok = F.col("n_bg") >= min_bg
    snr, csnr = F.col("s_ch") / F.nullif(F.col("b_ch"), F.lit(0.0)), F.col("s_cch") / F.nullif(F.col("b_cch"), F.lit(0.0))
    rel, crel = F.col("sig") / F.nullif(F.abs("m_l"), F.lit(0.0)), F.col("csig") / F.nullif(F.abs("m_cl"), F.lit(0.0))
    return g.select(
        *keys, "n_bg", "drift_p95",
        F.when(ok & (snr > snr_floor), csnr / snr).alias("chroma_retention"),
        F.when(ok, F.col("b_cch") / F.nullif(F.col("b_ch"), F.lit(0.0))).alias("chroma_noise_gain"),
        F.when(ok & (rel > 0), F.least(crel / rel, F.lit(gain_cap))).alias("noise_gain"),
        F.when(ok, F.col("csig")).alias("bg_sigma"))
