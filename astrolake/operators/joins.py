"""Tolerance, proximity, overlap and pairing joins.

Nearness joins are equi joins on grid cells with an exact residual test.  Copies at one position
are collapsed (with their count) before the join, so a heap of identical rows cannot square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.functions.scan import join_on, rank_by_id
from astrolake.operators.calibration import match_by_tolerances
from astrolake.operators.components import components
from astrolake.session import cut, shuffled


def _neighbours(value: Column, size: float) -> Column:
    c = F.floor(value / size)
    return F.explode(F.sequence(c - 1, c + 1))


def match_masters(light: DataFrame, master: DataFrame, exact: list[str], tol: dict[str, float], strict: bool = False) -> DataFrame:
    """Best master per light: lowest score, then name.  Strict mode reports ties as an error.

    Distinct settings meet, not frames: a setting shared by very many lights is matched once.
    """
    return match_by_tolerances(light, master, exact, tol, strict=strict)


def best_by_key(light: DataFrame, master: DataFrame, on: list[str], name: str) -> DataFrame:
    """Lowest-named master sharing the key; masters are reduced to one per key before the join."""
    one = master.groupBy(*on).agg(F.min_by("mid", F.struct("mname", "mid")).alias(name))
    return join_on(light, one, on, "left")


def calibration_plan(light: DataFrame, master: DataFrame, tol: float, embedded: Column) -> DataFrame:
    """Dark within tolerance on all keys, flat by gain and filter (labelled before unlabelled), bias by gain."""
    kind = lambda k: master.where(F.col("kind") == k)
    dark = match_masters(light, kind("dark"), ["gain"], {"temp": tol}).select("id", F.col("mid").alias("dark"))
    j = light.join(dark, "id")
    j = best_by_key(j, kind("flat").where(F.col("filter").isNotNull()), ["gain", "filter"], "flat_f")
    j = best_by_key(j, kind("flat").where(F.col("filter").isNull()).drop("filter"), ["gain"], "flat_u")
    j = best_by_key(j, kind("bias").drop("filter"), ["gain"], "bias")
    flat = F.coalesce("flat_f", "flat_u")
    skip = embedded
    return j.select(
        "id", F.when(~skip, F.col("dark")).alias("dark"), flat.alias("flat"), F.col("bias"),
        F.when(skip, "embedded_dark").when(F.col("dark").isNull(), "no_dark").when(flat.isNull(), "no_flat").when(F.col("bias").isNull(), "no_bias").otherwise("complete").alias("reason"))


def positions(stars: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct positions with the number of copies and the smallest id."""
    return stars.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id"))


def near_edges(a: DataFrame, b: DataFrame, keys: list[str], r: float) -> DataFrame:
    """Position pairs within r (inclusive) sharing the keys; b visits the 3x3 cells around it."""
    pa = positions(a, keys).withColumn("cx", F.floor(F.col("x") / r)).withColumn("cy", F.floor(F.col("y") / r))
    pb = positions(b, keys).select(*keys, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("k").alias("bk"), F.col("id").alias("bid"))
    pb = pb.withColumn("cx", _neighbours(F.col("bx"), r)).withColumn("cy", _neighbours(F.col("by"), r))
    j = pa.join(shuffled(pb), [*keys, "cx", "cy"])
    d = F.round(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")), 9)
    return j.withColumn("dist", d).where(F.col("dist") <= r).drop("cx", "cy")


def _unique(e: DataFrame, keys: list[str]) -> DataFrame:
    one = F.min(F.struct("bid", "bx", "by", "id", "dist")).alias("_m")
    da = e.groupBy(*keys, "x", "y").agg(F.sum("bk").alias("deg_a"), one).where(F.col("deg_a") == 1).select(*keys, "_m.*")
    db = e.groupBy(*keys, "bx", "by").agg(F.sum("k").alias("deg_b")).where(F.col("deg_b") == 1)
    return da.join(shuffled(db), [*keys, "bx", "by"]).select(*keys, F.col("id").alias("id_a"), F.col("bid").alias("id_b"), "dist")


def match_unique(a: DataFrame, b: DataFrame, keys: list[str], r: float) -> DataFrame:
    """Pairs where each side has exactly one neighbour within r."""
    return _unique(cut(near_edges(a, b, keys, r)), keys)


def match_summary(a: DataFrame, b: DataFrame, keys: list[str], r: float) -> DataFrame:
    """Counts per key: unique, ambiguous and unmatched parents, saturated and duplicated positions."""
    e = cut(near_edges(a, b, keys, r))
    deg = e.select(*keys, "x", "y").distinct().withColumn("deg", F.lit(1))
    u = _unique(e, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_n"))
    pa = a.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("k"), F.count_if("sat").alias("sat_k"))
    j = pa.join(shuffled(deg), [*keys, "x", "y"], "left")
    g = j.groupBy(*keys).agg(
        F.sum("k").alias("n"), F.sum(F.when(F.col("deg").isNull(), F.col("k")).otherwise(0)).alias("unmatched"),
        F.sum("sat_k").alias("saturated"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("duplicates"))
    g = g.join(u, keys, "left").withColumn("unique_n", F.coalesce("unique_n", F.lit(0)))
    return g.withColumn("ambiguous", F.col("n") - F.col("unmatched") - F.col("unique_n"))


def unmatched(a: DataFrame, b: DataFrame, keys: list[str], r: float) -> DataFrame:
    """Rows of a without any neighbour in b."""
    hit = near_edges(a, b, keys, r).select(*keys, "x", "y").distinct()
    return a.join(shuffled(hit), [*keys, "x", "y"], "left_anti")


def paired_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per star measured on both sides: FWHM, axis and peak ratios."""
    side = lambda df, p: df.groupBy("star").agg(
        F.avg("fwhmx").alias(f"{p}_fwhm"), F.avg(F.col("fwhmy") / F.col("fwhmx")).alias(f"{p}_axis"), F.max("flux").alias(f"{p}_peak"))
    j = side(before, "b").join(side(after, "a"), "star")
    return j.select("star", (F.col("a_fwhm") / F.col("b_fwhm")).alias("fwhm_ratio"), (F.col("a_axis") - F.col("b_axis")).alias("axis_shift"),
                    (F.col("a_peak") / F.col("b_peak")).alias("peak_ratio"))


def assign_apertures(px: DataFrame, stars: DataFrame, keys: list[str], r_in: float, r0: float, r1: float, tile: int = 4) -> DataFrame:
    """Pixels inside a star's aperture or annulus: equi join on the tiles its outer circle touches."""
    lo = lambda c: F.floor((F.col(c) - r1) / tile)
    hi = lambda c: F.floor((F.col(c) + r1) / tile)
    s = stars.select(*keys, "star", F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(F.sequence(lo("x"), hi("x"))).alias("tx"), F.sequence(lo("y"), hi("y")).alias("_ty"))
    s = s.select(*keys, "star", "sx", "sy", "tx", F.explode("_ty").alias("ty"))
    p = px.withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))
    d = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    zone = F.when(d <= r_in, "aperture").when((d >= r0) & (d <= r1), "annulus")
    return p.join(s, [*keys, "tx", "ty"]).withColumn("dist", d).withColumn("zone", zone).where(F.col("zone").isNotNull()).drop("tx", "ty")


def pair_pixels(parent: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Pair pixels by position; unequal geometry makes the pair uncertain and withholds the difference."""
    j = parent.join(candidate, [*keys, "y", "x"], "full_outer")
    g = j.groupBy(*keys).agg(
        F.count("pv").alias("n_parent"), F.count("cv").alias("n_candidate"), F.count_if(F.col("pv").isNotNull() & F.col("cv").isNotNull()).alias("n_both"),
        F.avg(F.col("cv") - F.col("pv")).alias("_d"))
    same = (F.col("n_parent") == F.col("n_both")) & (F.col("n_candidate") == F.col("n_both"))
    return g.withColumn("status", F.when(same, "measured").otherwise("uncertain")).withColumn("mean_diff", F.when(same, F.col("_d"))).drop("_d")


def overlap_pairs(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of half-open rectangles that overlap, each found once.

    Both sides visit the cells they cover; a pair is kept only in the cell holding the lower corner
    of its intersection, so no distinct is needed.
    """
    cells = lambda p: [F.explode(F.sequence(F.floor(F.col(f"{p}x0") / size), F.floor(F.col(f"{p}x1") / size))).alias("cx"), "*"]
    rows = lambda p: F.explode(F.sequence(F.floor(F.col(f"{p}y0") / size), F.floor(F.col(f"{p}y1") / size))).alias("cy")
    ren = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in ("id", "x0", "y0", "x1", "y1")])
    ea = ren(a, "a").select(*cells("a")).select("*", rows("a"))
    eb = ren(b, "b").select(*cells("b")).select("*", rows("b"))
    j = ea.join(shuffled(eb), ["cx", "cy"])
    hit = (F.col("ax0") < F.col("bx1")) & (F.col("bx0") < F.col("ax1")) & (F.col("ay0") < F.col("by1")) & (F.col("by0") < F.col("ay1"))
    home = (F.floor(F.greatest("ax0", "bx0") / size) == F.col("cx")) & (F.floor(F.greatest("ay0", "by0") / size) == F.col("cy"))
    return j.where(hit & home).drop("cx", "cy")


def excluded(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Rectangles of a that touch nothing in b."""
    hit = overlap_pairs(a, b, size).select(F.col("aid").alias("id")).distinct()
    return a.join(hit, "id", "left_anti")


BOX = ["x0", "y0", "x1", "y1"]


def _whole_cells(boxes: DataFrame, u: float) -> DataFrame:
    """A row for every cell of side ``u`` that lies whole inside the rectangle."""
    def inside(lo: str, hi: str) -> Column:
        a, b = F.ceil(F.col(lo) / u), F.floor(F.col(hi) / u) - 1
        return F.when(a <= b, F.sequence(a, b))

    return boxes.withColumn("cx", F.explode(inside("x0", "x1"))).withColumn("cy", F.explode(inside("y0", "y1")))


def unclear_sky(sky: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """Ids of sky rectangles that overlap another sky rectangle or any of the others; a valid split has none.

    Equal rectangles are taken once, with their smallest and largest id.  Copies overlap each other, and so do all that hold one
    small cell whole: both are counted, not paired.  What is left open shares no such cell with any rectangle, so few of them are in
    one place, and only they are paired with the rest.
    """
    one = cut(sky.groupBy(*BOX).agg(F.min("id").alias("lo"), F.max("id").alias("hi")))
    rest = cut(others.groupBy(*BOX).agg(F.lit(True).alias("other")))
    held = _whole_cells(one.unionByName(rest, allowMissingColumns=True), size / 8)
    full = held.groupBy("cx", "cy").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.max("other").alias("o")).where("o or a < b").select("cx", "cy")
    crowded = held.where("lo is not null").join(shuffled(full), ["cx", "cy"], "left_semi").select(*BOX)
    copies = one.where("lo < hi and x0 < x1 and y0 < y1").select(*BOX)
    known = cut(crowded.unionByName(copies).distinct())
    ids = F.struct("lo", "hi")
    left = cut(one.join(shuffled(known), BOX, "left_anti").withColumn("id", ids))
    own = overlap_pairs(left, one.withColumn("id", ids), size).where("aid.lo <> bid.lo or aid.hi <> bid.hi")
    met = own.unionByName(overlap_pairs(left, rest.withColumn("id", F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))), size))
    found = known.unionByName(met.select(*[F.col(f"a{c}").alias(c) for c in BOX])).distinct()
    return sky.join(shuffled(found), BOX, "left_semi").select("id").distinct()


def nearest(subjects: DataFrame, refs: DataFrame, start: float, extent: float) -> DataFrame:
    """Exact nearest reference per subject, ties by id.

    Cells of growing size: a subject whose best neighbour in the surrounding 3x3 cells lies within one
    cell is settled, the rest go on with a cell four times as wide until the cell covers the extent.
    """
    todo = subjects.select("id", "x", "y")
    pr = refs.groupBy("x", "y").agg(F.min("id").alias("rid"))
    done = None
    size = start
    while True:
        p = todo.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
        q = pr.select("rid", F.col("x").alias("rx"), F.col("y").alias("ry"), _neighbours(F.col("x"), size).alias("cx"), F.col("y").alias("_y"))
        q = q.withColumn("cy", _neighbours(F.col("_y"), size)).drop("_y")
        d = F.round(F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")), 9)
        best = p.join(q, ["cx", "cy"]).groupBy("id").agg(F.min(F.struct(d.alias("d"), F.col("rid").alias("rid"))).alias("_m"))
        last = size >= extent
        hit = best.select("id", F.col("_m.rid").alias("ref"), F.col("_m.d").alias("dist"))
        if not last:
            hit = hit.where(F.col("dist") <= size)
        hit = cut(hit)
        done = hit if done is None else done.unionByName(hit)
        if last:
            return done
        todo = cut(todo.join(hit.select("id"), "id", "left_anti"))
        if todo.isEmpty():
            return done
        size *= 4


def wrap180(c: Column) -> Column:
    return F.pmod(c + 180, F.lit(360.0)) - 180


def sky_distance(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Small-field separation in degrees: RA wraps, scaled by the cosine of the mean declination."""
    return F.hypot(wrap180(ra1 - ra2) * F.cos(F.radians((dec1 + dec2) / 2)), dec1 - dec2)


def max_separation(panels: DataFrame, key: str, cell: float = 15.0) -> DataFrame:
    """Largest pairwise separation per group without all pairs.

    Cells are compared first: an upper bound per cell pair against the best separation of cell
    representatives leaves only the cell pairs that can hold the maximum.
    """
    p = panels.groupBy(key, "ra", "dec").agg(F.min("id").alias("id"))
    p = p.withColumn("cr", F.floor(F.col("ra") / cell)).withColumn("cd", F.floor(F.col("dec") / cell))
    c = cut(p.groupBy(key, "cr", "cd").agg(F.min("dec").alias("d0"), F.max("dec").alias("d1"), F.min(F.struct("id", "ra", "dec")).alias("rep")))
    ren = lambda df, s: df.select(key, *[F.col(n).alias(f"{n}{s}") for n in df.columns if n != key])
    j = ren(c, "_a").join(ren(c, "_b"), key).where((F.col("cr_a") < F.col("cr_b")) | ((F.col("cr_a") == F.col("cr_b")) & (F.col("cd_a") <= F.col("cd_b"))))
    gap = F.least(F.abs(wrap180((F.col("cr_a") - F.col("cr_b")) * cell)) + cell, F.lit(180.0))
    lo, hi = F.col("d0_a") + F.col("d0_b"), F.col("d1_a") + F.col("d1_b")
    coslim = F.when((lo <= 0) & (hi >= 0), 1.0).otherwise(F.greatest(F.cos(F.radians(lo / 2)), F.cos(F.radians(hi / 2))))
    ub = F.hypot(gap * coslim, F.greatest(F.col("d1_a") - F.col("d0_b"), F.col("d1_b") - F.col("d0_a")))
    lb = sky_distance(F.col("rep_a.ra"), F.col("rep_a.dec"), F.col("rep_b.ra"), F.col("rep_b.dec"))
    j = cut(j.select(key, "cr_a", "cd_a", "cr_b", "cd_b", ub.alias("ub"), lb.alias("lb")))
    keep = j.join(j.groupBy(key).agg(F.max("lb").alias("best")), key).where(F.col("ub") + 1e-9 >= F.col("best")).drop("ub", "lb", "best")
    q = keep.join(ren(p, "_a"), [key, "cr_a", "cd_a"]).join(ren(p, "_b"), [key, "cr_b", "cd_b"])
    sep = sky_distance(F.col("ra_a"), F.col("dec_a"), F.col("ra_b"), F.col("dec_b"))
    g = q.groupBy(key).agg(F.max(sep).alias("max_sep"))
    n = panels.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.join(g, key, "left").withColumn("max_sep", F.coalesce("max_sep", F.lit(0.0)))


def panel_edges(panels: DataFrame, width: float, height: float) -> DataFrame:
    """Panels whose footprints overlap (|dRA|*cos(mean Dec) < width and |dDec| < height).

    Copies of one position hang on their smallest id; only distinct positions are joined by cell.
    """
    star = panels.groupBy("ra", "dec").agg(F.min("id").alias("rep"))
    spokes = panels.join(star, ["ra", "dec"]).where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # within +-60 degrees of declination the RA reach is at most twice the width
    rw, n = 2 * width, int(360 // (2 * width))
    rc = F.floor(F.col("ra") / (360.0 / n))
    base = star.withColumn("cd", F.floor(F.col("dec") / height)).withColumn("cr", rc)
    there = star.select(
        F.col("rep").alias("rep_b"), F.col("ra").alias("ra_b"), F.col("dec").alias("dec_b"), _neighbours(F.col("dec"), height).alias("cd"),
        rc.alias("_c")).select("*", F.explode(F.array(F.pmod(F.col("_c") - 1, F.lit(n)), F.col("_c"), F.pmod(F.col("_c") + 1, F.lit(n)))).alias("cr"))
    assert rw <= 360.0 / n
    j = base.join(there, ["cr", "cd"]).where(F.col("rep") < F.col("rep_b"))
    near = (F.abs(wrap180(F.col("ra") - F.col("ra_b"))) * F.cos(F.radians((F.col("dec") + F.col("dec_b")) / 2)) < width) & (F.abs(F.col("dec") - F.col("dec_b")) < height)
    return spokes.unionByName(j.where(near).select(F.col("rep").alias("a"), F.col("rep_b").alias("b")))


def mosaic_groups(panels: DataFrame, width: float, height: float) -> DataFrame:
    """Panels connected by overlapping footprints form one mosaic, named by its smallest panel id."""
    lab = components(panels.select("id"), panel_edges(panels, width, height))
    return lab.select("id", F.col("label").alias("mosaic"))


def join_channels(long: DataFrame, keys: list[str]) -> DataFrame:
    """Layers aligned by pixel; only pixels every channel has survive, with the common rectangle."""
    w = long.groupBy(*keys, "y", "x").pivot("channel", ["r", "g", "b"]).agg(F.first("v"))
    full = w.where(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull())
    return full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.avg(F.col("r") + F.col("g") + F.col("b")).alias("mean_sum"))


def changed_sources(recorded: DataFrame, current: DataFrame, key: str) -> DataFrame:
    j = recorded.join(current, key, "full_outer")
    st = F.when(F.col("digest").isNull(), "removed").when(F.col("recorded").isNull(), "new").when(~F.col("digest").eqNullSafe(F.col("recorded")), "changed")
    return j.withColumn("state", st).where(F.col("state").isNotNull()).select(key, "state")


def match_positions(a: DataFrame, b: DataFrame, keys: list[str], tol: float = 1e-6) -> DataFrame:
    """Declared against observed positions in list order: equal counts and every offset within tol."""
    ra = rank_by_id(a, keys, "id").select(*keys, "rk", "x", "y")
    rb = rank_by_id(b, keys, "id").select(*keys, "rk", F.col("x").alias("bx"), F.col("y").alias("by"))
    j = ra.join(rb, [*keys, "rk"], "full_outer")
    ok = (F.abs(F.col("x") - F.col("bx")) <= tol) & (F.abs(F.col("y") - F.col("by")) <= tol)
    return j.groupBy(*keys).agg(
        F.count("x").alias("declared"), F.count("bx").alias("observed"), F.count_if(F.coalesce(~ok, F.lit(True))).alias("off")
    ).withColumn("same", F.col("off") == 0)


def polygon_edges(polygons: list[tuple[str, str, list[tuple[float, float]]]]) -> list[tuple]:
    """(polygon, mode, edge index, ax, ay, bx, by) rows of a constant polygon list."""
    return [
        (name, mode, i, *map(float, pts[i]), *map(float, pts[(i + 1) % len(pts)]))
        for name, mode, pts in polygons for i in range(len(pts))
    ]


def polygon_weights(grid: DataFrame, edges: list[tuple], feather: float) -> DataFrame:
    """Weight of every pixel centre against a constant list of polygon edges.

    Crossing parity decides inside, smoothstep(edge distance / feather) softens the rim; include
    polygons combine by max, exclude polygons by min.  The edges travel as a literal array.
    """
    names = ("poly", "mode", "i", "ax", "ay", "bx", "by")
    lits = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, e)]) for e in edges])
    j = grid.select("y", "x", F.explode(lits).alias("e")).select("y", "x", "e.*")
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    cross = ((F.col("ay") > cy) != (F.col("by") > cy)) & (
        cx < F.col("ax") + (cy - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.least(F.greatest(((cx - F.col("ax")) * dx + (cy - F.col("ay")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    dist = F.hypot(cx - F.col("ax") - t * dx, cy - F.col("ay") - t * dy)
    g = j.groupBy("y", "x", "poly", "mode").agg((F.count_if(cross) % 2).alias("odd"), F.min(dist).alias("dist"))
    u = F.least(F.col("dist") / feather, F.lit(1.0))
    g = g.withColumn("w", F.when(F.col("odd") == 1, u * u * (3 - 2 * u)).otherwise(0.0))
    return g.groupBy("y", "x").agg(
        F.least(
            F.coalesce(F.max(F.when(F.col("mode") == "include", F.col("w"))), F.lit(0.0)),
            F.coalesce(F.min(F.when(F.col("mode") == "exclude", 1 - F.col("w"))), F.lit(1.0))).alias("weight"))


def masked_mean(px: DataFrame, edges: list[tuple], feather: float) -> DataFrame:
    """Polygon-weighted mean per frame: weights are worked out once per position, then joined."""
    w = polygon_weights(px.select("y", "x").distinct(), edges, feather)
    return px.join(w, ["y", "x"]).groupBy("frame").agg(
        F.sum("weight").alias("area"), (F.sum(F.col("weight") * F.col("v")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("mean"))


def is_self_crossing(points: list[tuple[float, float]]) -> bool:
    """Does a (short, constant) polygon have two edges that properly cross?"""
    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    segs = [(points[i], points[(i + 1) % len(points)]) for i in range(len(points))]
    return any(
        turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0
        for i, (a, b) in enumerate(segs) for c, d in segs[i + 1:])
