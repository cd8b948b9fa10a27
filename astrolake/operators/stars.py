"""Star tables: summaries, moments, spatial reports, thinning, layouts, regions of clipped pixels."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from astrolake.functions.scan import attach, exact_quantiles, join_on
from astrolake.functions.tiles import MAD_TO_SIGMA
from astrolake.operators.components import components
from astrolake.operators.images import clamp, pct, share
from astrolake.operators.joins import _neighbours, assign_apertures
from astrolake.operators.stack import window_max
from astrolake.session import cut, shuffled

FWHM = 2.35482  # fixed value: Gaussian sigma to FWHM


def star_summary(meas: DataFrame, keys: list[str]) -> DataFrame:
    return meas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), pct("fwhmx", 0.5).alias("fwhm_median"), F.avg("fwhmx").alias("fwhm_mean"),
        F.stddev_pop("fwhmx").alias("fwhm_sd"), pct(F.col("fwhmy") / F.col("fwhmx"), 0.5).alias("roundness"))


def eigen2(cxx: Column, cxy: Column, cyy: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues (major, minor) and axis angle in degrees of a symmetric 2x2 matrix."""
    root = F.sqrt((cxx - cyy) * (cxx - cyy) + 4 * cxy * cxy)
    return (cxx + cyy + root) / 2, (cxx + cyy - root) / 2, F.degrees(F.atan2(2 * cxy, cxx - cyy)) / 2


def star_moments(px: DataFrame, stars: DataFrame, keys: list[str], value: str = "v", r_in: float = 2.5, r0: float = 3.0, r1: float = 4.0) -> DataFrame:
    """Flux, centroid, covariance, FWHM axes, eccentricity and angle above the annulus median."""
    a = assign_apertures(px, stars, keys, r_in, r0, r1)
    k = [*keys, "star"]
    bg = a.where(F.col("zone") == "annulus").groupBy(*k).agg(F.median(value).alias("bg"))
    w = F.greatest(F.col(value) - F.col("bg"), F.lit(0.0))
    p = a.where(F.col("zone") == "aperture").join(bg, k).select(*k, "x", "y", w.alias("w"))
    m = p.groupBy(*k).agg(
        F.sum("w").alias("flux"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"),
        F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("w") * F.col("y") * F.col("y")).alias("syy")).where(F.col("flux") > 0)
    cx, cy = F.col("sx") / F.col("flux"), F.col("sy") / F.col("flux")
    m = m.withColumn("cx", cx).withColumn("cy", cy)
    big, small, ang = eigen2(F.col("sxx") / F.col("flux") - cx * cx, F.col("sxy") / F.col("flux") - cx * cy, F.col("syy") / F.col("flux") - cy * cy)
    big, small = F.greatest(big, F.lit(0.04)), F.greatest(small, F.lit(0.04))
    return m.select(*k, "flux", "cx", "cy", (FWHM * F.sqrt(big)).alias("fwhm_major"), (FWHM * F.sqrt(small)).alias("fwhm_minor"),
                    F.sqrt(1 - small / big).alias("eccentricity"), ang.alias("angle"))


def spatial_report(stars: DataFrame, matched: DataFrame, width: float, height: float) -> DataFrame:
    """3x3 coverage per cell and layer (and all cells together) with FWHM p05/median/p95."""
    c = lambda v, n: F.least(F.floor(F.col(v) / n * 3), F.lit(2)).cast("string")
    s = stars.join(shuffled(matched.select("id", F.lit(True).alias("hit"))), "id", "left")
    s = s.withColumn("cell", F.explode(F.array(F.concat(c("y", height), c("x", width)), F.lit("all"))))
    k = ["cell", "layer"]
    g = s.groupBy(*k).agg(F.count(F.lit(1)).alias("captured"), F.count_if(~F.col("sat")).alias("valid"), F.count_if("sat").alias("saturated"),
                          F.count_if(F.col("hit").isNull()).alias("unmatched"))
    q = exact_quantiles(s, k, "fwhm", {"p05": (0.05, "pL"), "med": (0.5, "pL"), "p95": (0.95, "pL")})
    return g.join(q, k)


def axial_mean(meas: DataFrame, keys: list[str]) -> DataFrame:
    """Mean direction of axes (period 180 degrees) weighted by elongation, with its concentration."""
    a, b = F.greatest("fwhmx", "fwhmy"), F.least("fwhmx", "fwhmy")
    w = (a - b) / (a + b)
    t = F.radians(2 * F.col("angle"))
    g = meas.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * F.cos(t)).alias("c"), F.sum(w * F.sin(t)).alias("s"))
    res = F.hypot("c", "s")
    st = F.when(F.col("w") <= 0, "not_applicable").when(res <= 1e-9 * F.col("w"), "degenerate").otherwise("measured")
    ok = st == "measured"
    return g.select(*keys, st.alias("status"), F.when(ok, F.degrees(F.atan2("s", "c")) / 2).alias("axis"), F.when(F.col("w") > 0, res / F.col("w")).alias("concentration"))


def paired_verdict(pairs: DataFrame, keys: list[str]) -> DataFrame:
    q = exact_quantiles(pairs, keys, "fwhm_ratio", {"ratio_med": (0.5, "pL"), "ratio_p90": (0.9, "pL")}, count_as="n")
    sh = exact_quantiles(pairs.withColumn("_s", F.abs("axis_shift")), keys, "_s", {"shift_p95": (0.95, "pL")})
    pk = exact_quantiles(pairs, keys, "peak_ratio", {"peak_p10": (0.1, "pL"), "peak_p90": (0.9, "pL")})
    j = join_on(join_on(q, sh, keys), pk, keys)
    bad = (F.col("n") >= 5) & ((F.col("ratio_med") > 1.50) | (F.col("ratio_p90") > 1.90))
    return j.withColumn("verdict", F.when(F.col("n") < 3, "insufficient").when(bad, "review").otherwise("stable"))


def star_layer_integrity(px2: DataFrame, stars: DataFrame, keys: list[str], session: str) -> DataFrame:
    """Retention of reference signal at fixed centres and central holes (new, pre-existing, uncertain)."""
    a = assign_apertures(px2, stars, keys, 1.5, 2.0, 3.5)
    k = [session, *keys, "star"]
    ap, an = F.col("zone") == "aperture", F.col("zone") == "annulus"
    mid = ap & (F.col("dist") < 0.5)
    g = a.groupBy(*k).agg(
        F.max(F.when(ap, F.col("pv"))).alias("p_peak"), F.max(F.when(ap, F.col("cv"))).alias("c_peak"),
        F.median(F.when(an, F.col("pv"))).alias("p_bg"), F.median(F.when(an, F.col("cv"))).alias("c_bg"),
        F.max(F.when(mid, F.col("pv"))).alias("p_mid"), F.max(F.when(mid, F.col("cv"))).alias("c_mid"))
    ph, ch = F.col("p_mid") < F.col("p_bg"), F.col("c_mid") < F.col("c_bg")
    ref = F.col("p_peak") - F.col("p_bg")
    g = g.withColumn("retention", F.when(ref > 0, (F.col("c_peak") - F.col("c_bg")) / ref)).withColumn(
        "hole", F.when(ch & ph, "pre_existing").when(ch & ~ph, "new").when(ch, "uncertain"))
    s = g.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hole") == "new").alias("new_holes"), F.count_if(F.col("hole") == "pre_existing").alias("old_holes"))
    q = exact_quantiles(g, [session], "retention", {"retention_p10": (0.1, "pL"), "retention_med": (0.5, "pL")})
    return s.join(q, session, "left").withColumn("status", F.when(F.col("n") < 3, "skipped").otherwise("measured"))


def stellar_ratios(rgb2: DataFrame, keys: list[str], full: str = "l", starless: str = "cl") -> DataFrame:
    """Share of flux in stars, and share of bright pixels (threshold falls to p99.5 on dim images)."""
    st = rgb2.groupBy(*keys).agg(F.max(full).alias("top"), pct(full, 0.995).alias("p995"))
    j = rgb2.join(st, keys)
    lim = F.when(F.col("top") <= 0.5, F.col("p995")).otherwise(0.85)
    return j.groupBy(*keys).agg(
        (F.sum(F.greatest(F.col(full) - F.col(starless), F.lit(0.0))) / F.nullif(F.sum(full), F.lit(0.0))).alias("flux_ratio"),
        share(F.col(full) > lim).alias("bright_ratio"))


def sample_coverage(pts: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """At least two samples per horizontal third, span >= 0.60 of the frame on both axes, twelve points."""
    third = F.least(F.floor(F.col("x") / width * 3), F.lit(2))
    g = pts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(third == i).alias(f"third{i}") for i in range(3)],
        ((F.max("x") - F.min("x")) / width).alias("span_x"), ((F.max("y") - F.min("y")) / height).alias("span_y"))
    ok = (F.col("n") >= 12) & (F.least("third0", "third1", "third2") >= 2) & (F.col("span_x") >= 0.60) & (F.col("span_y") >= 0.60)
    return g.withColumn("covered", ok)


def plane_geometry(pts: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """Rank and condition of the design [1, x, y] from the closed-form eigenvalues of its normal matrix."""
    x, y = 2 * F.col("x") / width - 1, 2 * F.col("y") / height - 1
    g = pts.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("a"), F.sum(y).alias("b"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"))
    n, a, b, xx, xy, yy = (F.col(c) for c in ("n", "a", "b", "xx", "xy", "yy"))
    q = (n + xx + yy) / 3
    p1 = a * a + b * b + xy * xy
    p2 = (n - q) * (n - q) + (xx - q) * (xx - q) + (yy - q) * (yy - q) + 2 * p1
    g = g.withColumn("q", q).withColumn("p", F.sqrt(p2 / 6))
    q, p = F.col("q"), F.col("p")
    det = ((n - q) * ((xx - q) * (yy - q) - xy * xy) - a * (a * (yy - q) - xy * b) + b * (a * xy - (xx - q) * b)) / (p * p * p)
    phi = F.acos(F.least(F.greatest(det / 2, F.lit(-1.0)), F.lit(1.0))) / 3
    g = g.withColumn("e0", q + 2 * p * F.cos(phi)).withColumn("e2", q + 2 * p * F.cos(phi + 2 * np.pi / 3))
    g = g.withColumn("e1", 3 * q - F.col("e0") - F.col("e2"))
    tol = F.col("e0") * 1e-10
    rank = sum(((F.col(e) > tol).cast("int") for e in ("e0", "e1", "e2")), F.lit(0))
    return g.select(*keys, rank.alias("rank"), F.when(F.col("e2") > tol, F.sqrt(F.col("e0") / F.col("e2"))).alias("condition"))


def detection_confidence(meas: DataFrame, keys: list[str], expect: float = 7.7) -> DataFrame:
    """Mean of keep-rate, roundness, size and density scores."""
    good = (F.col("fwhmx") > 0.5) & (F.col("fwhmx") < 4.5)
    g = meas.groupBy(*keys).agg(
        share(good).alias("keep"), F.avg(F.col("fwhmy") / F.col("fwhmx")).alias("round"), F.avg("fwhmx").alias("size"), F.count(F.lit(1)).alias("n"))
    size = clamp(1 - F.abs(F.col("size") - 2.5) / 2.7)
    dens = clamp(F.col("n") / expect)
    return g.select(*keys, "n", ((F.col("keep") + clamp(F.col("round")) + size + dens) / 4).alias("confidence"))


def channel_offsets(long: DataFrame, stars: DataFrame, keys: list[str], session: str) -> DataFrame:
    """Centroid of R and B against G per star; session median and robust spread of the shift."""
    m = star_moments(long, stars, [*keys, "channel"])
    w = m.groupBy(*keys, "star").pivot("channel", ["r", "g", "b"]).agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    parts = []
    for c in ("r", "b"):
        parts.append(w.select(session, F.lit(c).alias("channel"), (F.col(f"{c}_cx") - F.col("g_cx")).alias("dx"), (F.col(f"{c}_cy") - F.col("g_cy")).alias("dy")))
    long_off = parts[0].unionByName(parts[1]).where(F.col("dx").isNotNull() & F.col("dy").isNotNull())
    k = [session, "channel"]
    qx = exact_quantiles(long_off, k, "dx", {"dx_med": (0.5, "pL"), "dx_p10": (0.1, "pL"), "dx_p90": (0.9, "pL")}, count_as="n")
    qy = exact_quantiles(long_off, k, "dy", {"dy_med": (0.5, "pL")})
    return qx.join(qy, k).withColumn("spread", F.col("dx_p90") - F.col("dx_p10"))


TERMS = ("1", "x", "y", "xx", "xy", "yy")


def _term_cols() -> list[Column]:
    x, y = F.col("u"), F.col("w")
    return [F.lit(1.0), x, y, x * x, x * y, y * y]


def _solve_rows(batches):
    """Solve the 6x6 normal equations of every row (one row per group)."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            a = np.zeros((6, 6))
            a[np.triu_indices(6)] = r.a
            a = a + np.triu(a, 1).T
            out.append(np.linalg.lstsq(a, np.asarray(r.b), rcond=None)[0].tolist())
        yield pd.DataFrame({"g": pdf["g"], "coef": out})


def shape_field(stars: DataFrame, key: str, value: str, width: float, height: float, rounds: int = 3) -> DataFrame:
    """Quadratic field of a star measure over the frame with outlier rounds.

    Every round is one pass of normal-equation sums (combined before the shuffle); the 6x6 systems
    are solved one row per group inside tasks.  Residuals beyond 3.5 robust sigmas leave the next round.
    """
    cur = stars.select(F.col(key).alias("g"), (2 * F.col("x") / width - 1).alias("u"), (2 * F.col("y") / height - 1).alias("w"), F.col(value).cast("double").alias("z"))
    total = cur.groupBy("g").agg(F.count(F.lit(1)).alias("n_all"))
    coef = None
    for i in range(rounds):
        t = _term_cols()
        sums = [F.sum(t[a] * t[b]) for a in range(6) for b in range(a, 6)]
        rhs = [F.sum(c * F.col("z")) for c in t]
        s = cur.groupBy("g").agg(F.array(*sums).alias("a"), F.array(*rhs).alias("b"))
        coef = cut(s.mapInPandas(_solve_rows, "g string, coef array<double>"))
        fit = sum((F.col("coef")[j] * c for j, c in enumerate(_term_cols())), F.lit(0.0))
        res = attach(cur, coef, ["g"]).withColumn("res", F.col("z") - fit)
        if i + 1 < rounds:
            med = cut(exact_quantiles(res, ["g"], "res", {"m": (0.5, "pL")}))
            dev = cut(exact_quantiles(attach(res, med, ["g"]).withColumn("d", F.abs(F.col("res") - F.col("m"))), ["g"], "d", {"mad": (0.5, "pL")}))
            kept = attach(attach(res, med, ["g"]), dev, ["g"]).where(F.abs(F.col("res") - F.col("m")) <= 3.5 * MAD_TO_SIGMA * F.col("mad"))
            cur = cut(kept.select("g", "u", "w", "z"))
    cells = cur.join(total, "g").groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.first("n_all").alias("n_all"),
        (F.count_distinct(F.struct(F.floor((F.col("u") + 1) * 2), F.floor((F.col("w") + 1) * 2))) / 16).alias("coverage"))
    return coef.join(cells, "g").select(
        F.col("g").alias(key), "n", (F.col("n_all") - F.col("n")).alias("dropped"), "coverage", *[F.col("coef")[j].alias(f"c_{n}") for j, n in enumerate(TERMS)])


def star_colors(rgb: DataFrame, stars: DataFrame, keys: list[str]) -> DataFrame:
    """Aperture minus annulus medians per channel and the number of pixels at the end points."""
    a = assign_apertures(rgb, stars, keys, 1.5, 2.0, 3.5)
    ap, an = F.col("zone") == "aperture", F.col("zone") == "annulus"
    end = (F.least("r", "g", "b") <= 0.3) | (F.greatest("r", "g", "b") >= 0.7)
    return a.groupBy(*keys, "star").agg(
        *[(F.median(F.when(ap, F.col(c))) - F.median(F.when(an, F.col(c)))).alias(c) for c in "rgb"], F.count_if(ap & end).alias("endpoints"))


def local_maxima(px: DataFrame, keys: list[str], h: int, floor: float, k: int = 500) -> DataFrame:
    """Pixels equal to the maximum of their neighbourhood and above a floor; top k per frame."""
    m = window_max(px, keys, "v", h, "nm").where((F.col("v") == F.col("nm")) & (F.col("v") > floor))
    w = W.partitionBy(*keys).orderBy(F.desc("v"), "y", "x")
    return m.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def thin(stars: DataFrame, r: float) -> DataFrame:
    """Greedy minimum-separation thinning in brightness order (ties by id), as parallel rounds.

    In each round every undecided star without a brighter undecided neighbour is kept and its
    neighbours go.  Copies of one position collapse to their brightest first.
    """
    one = cut(stars.groupBy("x", "y").agg(F.max(F.struct(F.col("flux"), (-F.col("id")).alias("nid"))).alias("_m")).select(
        (-F.col("_m.nid")).alias("id"), "x", "y", F.col("_m.flux").alias("flux")))
    p = one.withColumn("cx", F.floor(F.col("x") / r)).withColumn("cy", F.floor(F.col("y") / r))
    q = one.select(F.col("id").alias("bid"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("flux").alias("bf"), _neighbours(F.col("x"), r).alias("cx"))
    q = q.withColumn("cy", _neighbours(F.col("by"), r))
    j = p.join(shuffled(q), ["cx", "cy"])
    brighter = (F.col("bf") > F.col("flux")) | ((F.col("bf") == F.col("flux")) & (F.col("bid") < F.col("id")))
    edges = cut(j.where(brighter & (F.round(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")), 9) < r)).select("id", "bid"))
    open_ids, kept = one.select("id"), None
    while True:  # the brightest undecided star is always decided
        blocked = edges.join(shuffled(open_ids.select(F.col("id").alias("bid"))), "bid").select("id").distinct()
        new = cut(open_ids.join(shuffled(blocked), "id", "left_anti"))
        kept = new if kept is None else kept.unionByName(new)
        gone = edges.join(shuffled(new.select(F.col("id").alias("bid"))), "bid").select("id").unionByName(new).distinct()
        open_ids = cut(open_ids.join(shuffled(gone), "id", "left_anti"))
        if open_ids.isEmpty():
            return one.join(shuffled(kept), "id", "left_semi")


def farthest(pts: DataFrame, n: int, batch: int = 64) -> DataFrame:
    """Farthest-point selection from the first point in (y, x, id) order; ties go to the smallest y, x, id.

    Every point keeps its distance to the nearest chosen one.  A round takes the ``batch`` points of largest distance
    to the driver and chooses among them as long as none outside can be farther, as distances only fall; then
    the table takes up what was chosen.  The driver holds the chosen points and one batch.  Points without
    coordinates take no part; it ends early once every point coincides with a chosen one.
    """
    if n < 1 or batch < 1:
        raise ValueError("n and batch must be at least 1")
    left = cut(pts.where("x is not null and y is not null").select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(float("inf")).alias("d")))
    order = lambda p: (-p["d"], p["y"], p["x"], p["id"])
    chosen: list[dict] = []
    while len(chosen) < n:
        near = [r.asDict() for r in left.orderBy(F.desc("d"), "y", "x", "id").limit(batch).collect()]
        bound = order(near[-1]) if len(near) == batch else None
        new: list[dict] = []
        while near and len(chosen) + len(new) < n:
            best = min(near, key=order)
            if best["d"] <= 0 or (bound is not None and order(best) > bound):
                break
            near.remove(best)
            new.append(best)
            for p in near:
                p["d"] = min(p["d"], _rounded(math.hypot(p["x"] - best["x"], p["y"] - best["y"])))
        if not new:
            break
        chosen += new
        if len(chosen) < n:
            left = cut(left.withColumn("d", F.least("d", *[F.round(F.hypot(F.col("x") - p["x"], F.col("y") - p["y"]), 9) for p in new])))
    return pts.sparkSession.createDataFrame([(k, p["id"], p["x"], p["y"]) for k, p in enumerate(chosen, 1)], "step int, id long, x double, y double")


def _rounded(v: float) -> float:
    """To nine places as ``F.round`` does it."""
    return float(Decimal(repr(v)).quantize(Decimal("1e-9"), ROUND_HALF_UP))


def best_per_cell(pts: DataFrame, size: float) -> DataFrame:
    """Best candidate of every grid cell by stability, distance to the cell centre, y, x."""
    cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    d = F.round(F.hypot(F.col("x") - (cx + 0.5) * size, F.col("y") - (cy + 0.5) * size), 9)
    g = pts.groupBy(cy.alias("cy"), cx.alias("cx")).agg(F.min(F.struct(F.col("stability"), d.alias("d"), F.col("y"), F.col("x"), F.col("id"))).alias("_m"))
    return g.select("cy", "cx", F.col("_m.id").alias("id"), F.col("_m.stability").alias("stability"), F.col("_m.d").alias("dist"))


def plateau(px2: DataFrame, keys: list[str], tol: float, level: float, warn: int = 25) -> DataFrame:
    """Flat pixels (all four neighbours within tol, above a level): new against the parent, or inherited."""
    wx, wy = W.partitionBy(*keys, "y").orderBy("x"), W.partitionBy(*keys, "x").orderBy("y")

    def flat(c: str) -> Column:
        parts = [F.abs(F.col(c) - f(c, 1).over(w)) for w in (wx, wy) for f in (F.lag, F.lead)]
        return (F.greatest(*[F.coalesce(p, F.lit(0.0)) for p in parts]) <= tol) & (F.col(c) >= level)

    f = px2.withColumn("pf", flat("pv")).withColumn("cf", flat("cv"))
    return f.groupBy(*keys).agg(
        F.count_if("cf").alias("area"), F.count_if(F.col("cf") & ~F.col("pf")).alias("new_area"), F.count_if(F.col("cf") & F.col("pf")).alias("inherited")
    ).withColumn("status", F.when(F.col("new_area") >= warn, "warning").otherwise("passed"))


def clipped_regions(px: DataFrame, key: str, level: float, side: int) -> DataFrame:
    """4-connected regions at or above a level: area, centroid, equivalent diameter."""
    c = px.where(F.col("v") >= level).select(key, "y", "x", (F.col(key) * (side * side) + F.col("y") * side + F.col("x")).cast("long").alias("id"))
    right = F.lead("x").over(W.partitionBy(key, "y").orderBy("x")) == F.col("x") + 1
    down = F.lead("y").over(W.partitionBy(key, "x").orderBy("y")) == F.col("y") + 1
    n = cut(c.withColumn("rt", right).withColumn("dn", down))
    edges = n.where("rt").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(n.where("dn").select(F.col("id").alias("a"), (F.col("id") + side).alias("b")))
    lab = components(n.select("id"), edges)
    return n.join(lab, "id").groupBy(key, F.col("label").alias("region")).agg(
        F.count(F.lit(1)).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.sqrt(4 * F.count(F.lit(1)) / np.pi).alias("diameter"))


def region_verdict(regions: DataFrame, key: str, warn: int, fail: int) -> DataFrame:
    g = regions.groupBy(key).agg(F.count(F.lit(1)).alias("regions"), F.max("area").alias("largest"), F.count_if(F.col("area") >= warn).alias("big"))
    return g.withColumn("verdict", F.when((F.col("largest") >= fail) | (F.col("big") >= 2), "failed").when(F.col("largest") >= warn, "warning").otherwise("passed"))


def flag_duplicates(meas: DataFrame, keys: list[str]) -> DataFrame:
    """Every occurrence of a repeated key: counts are combined first, then joined back."""
    n = meas.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)
    return join_on(meas, n, keys)


def locate_blocks(px: DataFrame, key: str, b: int, min_dist: float) -> DataFrame:
    """Block of highest detail energy and a second anchor at least ``min_dist`` blocks away."""
    e = px.groupBy(key, F.floor(F.col("y") / b).alias("by"), F.floor(F.col("x") / b).alias("bx")).agg(F.var_pop("v").alias("energy"))
    rank = F.struct(F.round("energy", 9), -F.col("by"), -F.col("bx"))
    top = e.groupBy(key).agg(F.max_by(F.struct("by", "bx", "energy"), rank).alias("a"))
    far = e.join(top, key).where(F.hypot(F.col("by") - F.col("a.by"), F.col("bx") - F.col("a.bx")) >= min_dist)
    second = far.groupBy(key).agg(F.max_by(F.struct("by", "bx"), rank).alias("s"))
    return top.join(second, key, "left").select(
        key, F.col("a.by").alias("ay"), F.col("a.bx").alias("ax"), F.col("a.energy").alias("energy"), F.col("s.by").alias("sy"), F.col("s.bx").alias("sx"))


def highlights(px2: DataFrame, keys: list[str], level: float) -> DataFrame:
    """Highlight samples of the candidate with the values before and after, numbered, with their box."""
    h = px2.where(F.col("cv") >= level)
    w = W.partitionBy(*keys).orderBy("y", "x")
    box = h.groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n"))
    return h.withColumn("i", F.row_number().over(w)).join(box, keys)
