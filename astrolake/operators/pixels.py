"""Pixel transforms: tone, palette, masks, layer arithmetic.  All are projections; only parameters aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.functions import tone as N
from astrolake.functions.tiles import doubles
from astrolake.operators.images import assign_regions, pct, robust_sigma


def read_pixels(tiles: DataFrame, scale: float, zero: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Stored tiles to pixel rows: scale*v + zero, optionally mapped from [low, high]."""
    z = tiles.select("session", "frame", F.posexplode(doubles(F.col("tile"))).alias("pos", "v"))
    v = F.col("v") * scale + zero
    if low is not None and high is not None:
        v = (v - low) / (high - low)
    return z.withColumn("v", v)


def mtf_params(px: DataFrame, keys: list[str], target: float = 0.25, k: float = 2.8) -> DataFrame:
    """Black point median - 2.8 sigma (floored at zero) and the midpoint that lifts the background to target."""
    s = robust_sigma(px, keys, "v", "sigma", "med")
    black = F.greatest(F.col("med") - k * F.col("sigma"), F.lit(0.0))
    bg = (F.col("med") - black) / (1 - black)
    return s.select(*keys, black.alias("black"), N.mtf_midpoint(bg, target).alias("midpoint"))


def tone_curves(px: DataFrame, keys: list[str]) -> DataFrame:
    """All closed-form curves side by side for values in 0..1."""
    q = px.groupBy(*keys).agg(pct("v", 0.01).alias("_a"), pct("v", 0.99).alias("_b"))
    v = F.col("v")
    return px.join(q, keys).select(
        *[c for c in px.columns], N.mtf(v, 0.2).alias("mtf"), N.mtf(N.mtf(v, 0.2), 0.8).alias("back"), N.asinh_curve(v, 20.0).alias("asinh"),
        N.clip01((v - F.col("_a")) / (F.col("_b") - F.col("_a"))).alias("linear"), N.ghs(N.clip01(v), 2.0, 4.0, 0.3, 0.05, 0.9).alias("ghs"))


def mtf_amplification(long: DataFrame, regs: DataFrame, keys: list[str], m: float) -> DataFrame:
    """Analytic slope at the region median and the span gain p10..p90, per region and channel."""
    g = assign_regions(long, regs).groupBy(*keys, "region", "channel").agg(F.median("v").alias("med"), pct("v", 0.1).alias("lo"), pct("v", 0.9).alias("hi"))
    gain = (N.mtf(F.col("hi"), m) - N.mtf(F.col("lo"), m)) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return g.select(*keys, "region", "channel", N.mtf_slope(F.col("med"), m).alias("slope"), gain.alias("span_gain"))


# fixed values: channel orders of the dual-band palettes
PALETTES = ("HOO", "HSO", "SHO", "OHS", "HOS", "OSH")


def palette(rgb: DataFrame, name: str, grey_below: float = 0.35) -> DataFrame:
    """H = R, O = (G+B)/2, S = (H+O)/2 in the named order; base luminance kept, dark background greyed."""
    if name not in PALETTES:
        raise ValueError(name)
    h, o = N.clip01(F.col("r")), N.clip01((F.col("g") + F.col("b")) * 0.5)
    bands = {"H": h, "O": o, "S": (h + o) * 0.5}
    base = sum((w * N.clip01(F.col(c)) for w, c in zip(N.LUMA, "rgb")), F.lit(0.0))
    m = [bands[c] for c in name]
    ml = sum((w * c for w, c in zip(N.LUMA, m)), F.lit(0.0))
    ratio = F.when(ml > 1e-6, base / ml).otherwise(1.0)
    out = [F.when(base < grey_below, base).otherwise(N.clip01(c * ratio)) for c in m]
    return rgb.select(*[c for c in rgb.columns if c not in "rgb"], *[c.alias(n) for c, n in zip(out, "rgb")])


def scnr(rgb: DataFrame) -> DataFrame:
    """Green neutralised to the mean of red and blue."""
    return rgb.withColumn("g", F.least("g", (F.col("r") + F.col("b")) / 2))


def saturate(rgb: DataFrame, k: float) -> DataFrame:
    l = sum((w * F.col(c) for w, c in zip(N.LUMA, "rgb")), F.lit(0.0))
    return rgb.select(*[c for c in rgb.columns if c not in "rgb"], *[N.clip01(l + k * (F.col(c) - l)).alias(c) for c in "rgb"])


def apply_gains(rgb: DataFrame, gains: dict[str, float]) -> DataFrame:
    return rgb.withColumns({c: N.clip01(F.col(c) * g) for c, g in gains.items()})


def range_mask(gray: Column, low: float, high: float, feather: float) -> Column:
    """Soft luminance range (pixel-wise part)."""
    g = N.clip01(gray)
    return N.smoothstep(low - feather, low + feather, g) * (1 - N.smoothstep(high - feather, high + feather, g))


def hue_mask(h: Column, low: float, high: float, feather: float) -> Column:
    """Soft hue interval on the unit circle; low > high wraps through zero."""
    span = lambda a, b: N.smoothstep(a - feather, a + feather, h) * (1 - N.smoothstep(b - feather, b + feather, h))
    return span(low, high) if low <= high else F.greatest(span(low, 1.0), span(0.0, high))


def masked(value: Column, changed: Column, mask: Column) -> Column:
    return value * (1 - mask) + changed * mask


def combine_layers(px2: DataFrame) -> DataFrame:
    """Additive recombination, residual and signed closure of two layers."""
    return px2.withColumn("sum", F.col("pv") + F.col("cv")).withColumn("residual", F.col("pv") - F.col("cv")).withColumn(
        "closure", F.col("residual") + F.col("cv") - F.col("pv"))


def chroma_blend(rgb2: DataFrame, strength: float = 0.6, eps: float = 1e-3) -> DataFrame:
    """Luminance-neutral correction: delta without its own luminance, scaled within the channel headroom."""
    d = {c: F.col(f"c{c}") - F.col(c) for c in "rgb"}
    dl = sum((w * d[c] for w, c in zip(N.LUMA, "rgb")), F.lit(0.0))
    j = rgb2.withColumns({f"d{c}": d[c] - dl for c in "rgb"})
    head = [F.when(F.col(f"d{c}") > 0, 1 - eps - F.col(c)).otherwise(F.col(c) - eps) / F.greatest(F.abs(f"d{c}"), F.lit(1e-12)) for c in "rgb"]
    ok = (F.least("r", "g", "b") > eps) & (F.greatest("r", "g", "b") < 1 - eps)
    w = F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(strength), *head))).otherwise(0.0)
    j = j.withColumn("weight", w)
    return j.select("session", "img", "y", "x", "weight", *[(F.col(c) + F.col("weight") * F.col(f"d{c}")).alias(c) for c in "rgb"])


def mix(rgb2: DataFrame, mask: Column) -> DataFrame:
    """Masked blend of a gentle and a faint layer, then H, 0.8 O + 0.2 H, O."""
    j = rgb2.withColumn("_m", mask)
    h = F.col("r") * F.col("_m") + F.col("cr") * (1 - F.col("_m"))
    o = F.col("g") * F.col("_m") + F.col("cg") * (1 - F.col("_m"))
    return j.select("session", "img", "y", "x", h.alias("r"), (0.8 * o + 0.2 * h).alias("g"), o.alias("b"))


