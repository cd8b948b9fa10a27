"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolake import views as V
from astrolake.operators import calibration as K
from astrolake.operators import images as I
from astrolake.operators import joins as J
from astrolake.plans.registry import query

PAIRS = "tp AS (SELECT l.id, m.mid, m.mname, round(abs(l.temp - m.temp) / 200, 9) AS score FROM light l JOIN master m ON l.gain = m.gain AND abs(l.temp - m.temp) <= 200)"


@query("c01_match_masters", "i:id,mid,candidates s:status d:score", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, mname, mid) AS rn, count(*) OVER (PARTITION BY id) AS candidates FROM tp)
SELECT l.id, CASE WHEN r.mid IS NULL THEN 'missing' ELSE 'matched' END AS status, r.mid, r.score, coalesce(candidates, 0) AS candidates FROM light l LEFT JOIN r ON l.id = r.id AND rn = 1""")
def _(s, d):
    return J.match_masters(V.light(s, d), V.master(s, d), ["gain"], {"temp": 200.0})


# strict form on temperatures rounded to hundreds, so that ties occur
@query("c01_match_masters_strict", "i:id,mid,candidates s:status d:score", """WITH p AS (SELECT l.id, m.mid, m.mname, round(abs(round(l.temp / 100) * 100 - round(m.temp / 100) * 100) / 500, 9) AS score FROM light l JOIN master m
 ON l.gain = m.gain AND abs(round(l.temp / 100) * 100 - round(m.temp / 100) * 100) <= 500), r AS (SELECT *, min(score) OVER (PARTITION BY id) AS b, count(*) OVER (PARTITION BY id) AS candidates FROM p),
q AS (SELECT id, candidates, count(DISTINCT mname) AS ties, min(mid) AS mid, any_value(b) AS score FROM r WHERE score = b GROUP BY id, candidates)
SELECT l.id, CASE WHEN q.id IS NULL THEN 'missing' WHEN ties > 1 THEN 'tie' ELSE 'matched' END AS status, CASE WHEN ties = 1 THEN q.mid END AS mid, CASE WHEN ties = 1 THEN q.score END AS score, coalesce(candidates, 0) AS candidates
FROM light l LEFT JOIN q ON l.id = q.id""")
def _(s, d):
    r = F.round(F.col("temp") / 100) * 100
    return J.match_masters(V.light(s, d).withColumn("temp", r), V.master(s, d).withColumn("temp", r), ["gain"], {"temp": 500.0}, strict=True)


@query("c02_calibration_plan", "i:id,dark,flat,bias s:reason", """
WITH dk AS (SELECT l.id, m.mid, row_number() OVER (PARTITION BY l.id ORDER BY round(abs(l.temp - m.temp) / 1000, 9), mname, mid) AS rn FROM light l JOIN master m ON m.kind = 'dark' AND l.gain = m.gain AND abs(l.temp - m.temp) <= 1000),
fl AS (SELECT l.id, m.mid, row_number() OVER (PARTITION BY l.id ORDER BY m.filter IS NULL, mname, mid) AS rn FROM light l JOIN master m ON m.kind = 'flat' AND l.gain = m.gain AND (m.filter IS NULL OR m.filter = l.filter)),
bi AS (SELECT gain, arg_min(mid, (mname, mid)) AS mid FROM master WHERE kind = 'bias' GROUP BY gain),
z AS (SELECT l.id, l.id % 7 = 0 AS skip, dk.mid AS dark, fl.mid AS flat, bi.mid AS bias FROM light l LEFT JOIN dk ON l.id = dk.id AND dk.rn = 1 LEFT JOIN fl ON l.id = fl.id AND fl.rn = 1 LEFT JOIN bi ON l.gain = bi.gain)
SELECT id, CASE WHEN NOT skip THEN dark END AS dark, flat, bias, CASE WHEN skip THEN 'embedded_dark' WHEN dark IS NULL THEN 'no_dark' WHEN flat IS NULL THEN 'no_flat' WHEN bias IS NULL THEN 'no_bias' ELSE 'complete' END AS reason FROM z""")
def _(s, d):
    return J.calibration_plan(V.light(s, d), V.master(s, d), 1000.0, F.col("id") % 7 == 0)


# settings with gaps on both sides: three tolerance keys, of which gain and temperature may be absent
TOL = {"temp": 10.0, "gain": 3.0, "exposure": 0.5}
GAPS = """ls AS (SELECT id, CASE WHEN id % 5 <> 0 THEN round(temp / {0}) * {1} END AS temp, CASE WHEN id % 7 <> 0 THEN gain END AS gain, CASE WHEN id % 13 <> 0 THEN id % 2 * 60 END AS exposure, CASE WHEN id % 4 <> 0 THEN filter END AS filter FROM light),
ms AS (SELECT mid, mname, kind, filter, CASE WHEN mid % 5 <> 2 THEN round(temp / {0}) * {1} END AS temp, CASE WHEN mid % 7 <> 3 THEN gain END AS gain, CASE WHEN mid % 11 <> 5 THEN mid % 2 * 60 END AS exposure FROM master)"""


def settings(s, d, unit, scale):
    l, m = V.light(s, d), V.master(s, d)
    gap = lambda c, by, of, rest: F.when(F.col(c) % by != of, rest)
    temp = F.round(F.col("temp") / unit) * scale
    l = l.select("id", gap("id", 5, 0, temp).alias("temp"), gap("id", 7, 0, F.col("gain")).alias("gain"), gap("id", 13, 0, F.col("id") % 2 * 60).alias("exposure"), gap("id", 4, 0, F.col("filter")).alias("filter"))
    m = m.select("mid", "mname", "kind", "filter", gap("mid", 5, 2, temp).alias("temp"), gap("mid", 7, 3, F.col("gain")).alias("gain"), gap("mid", 11, 5, F.col("mid") % 2 * 60).alias("exposure"))
    return l, m


def _close(*keys):
    """All keys within tolerance; gain and temperature may be absent on both sides."""
    parts = [f"(abs(l.{k} - m.{k}) <= {TOL[k]}" + (f" OR (l.{k} IS NULL AND m.{k} IS NULL))" if k != "exposure" else ")") for k in keys]
    return " AND ".join(parts), "round(" + " + ".join(f"coalesce(abs(l.{k} - m.{k}) / {TOL[k]}::DOUBLE, 0)" for k in keys) + ", 9)"


ALL_ON, ALL_SCORE = _close("temp", "gain", "exposure")
FREE_ON, FREE_SCORE = _close("temp", "gain")


@query("c01_match_tolerances", "i:id,mid,candidates s:status d:score", f"""WITH {GAPS.format(100, 1)}, p AS (SELECT l.id, m.mid, mname, {ALL_SCORE} AS score FROM ls l JOIN ms m ON {ALL_ON}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, mname, mid) AS rn, count(*) OVER (PARTITION BY id) AS candidates FROM p)
SELECT l.id, CASE WHEN mid IS NULL THEN 'missing' ELSE 'matched' END AS status, mid, score, coalesce(candidates, 0) AS candidates FROM ls l LEFT JOIN r ON r.id = l.id AND rn = 1""")
def _(s, d):
    return K.match_by_tolerances(*settings(s, d, 100, 1), [], TOL, ("temp", "gain"))


# the strict form on coarse temperatures, so that ties occur
@query("c01_match_tolerances_strict", "i:id,mid,candidates s:status d:score", f"""WITH {GAPS.format(1000, 10)}, p AS (SELECT l.id, m.mid, mname, {ALL_SCORE} AS score FROM ls l JOIN ms m ON {ALL_ON}),
b AS (SELECT *, min(score) OVER (PARTITION BY id) AS best, count(*) OVER (PARTITION BY id) AS candidates FROM p), q AS (SELECT id, candidates, count(DISTINCT mname) AS ties, min(mid) AS mid, min(score) AS score FROM b WHERE score = best GROUP BY ALL)
SELECT l.id, CASE WHEN q.id IS NULL THEN 'missing' WHEN ties > 1 THEN 'tie' ELSE 'matched' END AS status, CASE WHEN ties = 1 THEN mid END AS mid, CASE WHEN ties = 1 THEN score END AS score, coalesce(candidates, 0) AS candidates FROM ls l LEFT JOIN q USING (id)""")
def _(s, d):
    return K.match_by_tolerances(*settings(s, d, 1000, 10), [], TOL, ("temp", "gain"), strict=True)


_FLAT = "m.kind = 'flat' AND (l.filter IS NULL OR m.filter IS NULL OR m.filter = l.filter)"


def _pick(name, on, score, kind):
    return f"""{name}_p AS (SELECT l.id, m.mid, m.mname, m.filter AS label, {score} AS score FROM ls l JOIN ms m ON {kind} AND {on}),
{name} AS (SELECT id, arg_min(mid, (score, mname, mid)) AS mid, count(DISTINCT mname) FILTER (WHERE score = best) AS ties FROM (SELECT *, min(score) OVER (PARTITION BY id) AS best FROM {name}_p) GROUP BY id)"""


PICKS = ", ".join([_pick("dk", ALL_ON, ALL_SCORE, "m.kind = 'dark'"), _pick("fl", FREE_ON, FREE_SCORE, _FLAT), _pick("bi", FREE_ON, FREE_SCORE, "m.kind = 'bias'"), _pick("fs", FREE_ON, FREE_SCORE, f"m.filter IS NOT NULL AND {_FLAT}")])


@query("c02_plan_tolerances", "i:id,dark,flat,bias s:reason", f"""WITH {GAPS.format(100, 1)}, {PICKS},
z AS (SELECT l.id, l.id % 6 = 0 AS emb, l.id % 9 <> 0 AS fm, dk.mid AS dark, fl.mid AS flat, bi.mid AS bias FROM ls l LEFT JOIN dk USING (id) LEFT JOIN fl USING (id) LEFT JOIN bi USING (id))
SELECT id, CASE WHEN NOT emb THEN dark END AS dark, CASE WHEN fm THEN flat END AS flat, bias, CASE WHEN emb THEN 'embedded_dark' WHEN dark IS NULL THEN 'dark_waived' WHEN NOT fm THEN 'no_flats_made' WHEN flat IS NULL THEN 'no_flat' WHEN bias IS NULL THEN 'no_bias' ELSE 'complete' END AS reason FROM z""")
def _(s, d):
    l, m = settings(s, d, 100, 1)
    return K.plan_by_tolerances(l, m, TOL, "exposure", ("temp", "gain"), F.col("id") % 6 == 0, F.col("id") % 9 != 0, allow_missing_dark=True)


@query("c02_plan_tolerances_strict", "i:id,dark,flat,bias s:reason", f"""WITH {GAPS.format(1000, 10)}, {PICKS},
z AS (SELECT l.id, dk.mid AS dark, fs.mid AS flat, bi.mid AS bias, coalesce(dk.ties > 1, false) OR coalesce(bi.ties > 1, false) OR coalesce(fs.ties > 1, false) AS tied, l.id IN (SELECT id FROM fl_p WHERE label IS NULL) AS bare FROM ls l LEFT JOIN dk USING (id) LEFT JOIN fs USING (id) LEFT JOIN bi USING (id))
SELECT id, CASE WHEN NOT tied THEN dark END AS dark, CASE WHEN NOT tied THEN flat END AS flat, CASE WHEN NOT tied THEN bias END AS bias,
CASE WHEN tied THEN 'ambiguous' WHEN dark IS NULL THEN 'no_dark' WHEN flat IS NULL AND bare THEN 'unlabelled_flat' WHEN flat IS NULL THEN 'no_flat' WHEN bias IS NULL THEN 'no_bias' ELSE 'complete' END AS reason FROM z""")
def _(s, d):
    l, m = settings(s, d, 1000, 10)
    return K.plan_by_tolerances(l, m, TOL, "exposure", ("temp", "gain"), strict=True)


EDGES = "ed AS (SELECT a.id AS ia, b.id AS ib, a.layer, a.sat, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9) AS dist FROM stars_a a JOIN stars_b b ON a.layer = b.layer AND abs(a.x - b.x) <= 1.01 AND abs(a.y - b.y) <= 1.01 AND round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9) <= 1)"
UNIQ = f"{EDGES}, un AS (SELECT layer, ia AS id_a, ib AS id_b, dist FROM ed QUALIFY count(*) OVER (PARTITION BY ia) = 1 AND count(*) OVER (PARTITION BY ib) = 1)"


@query("c03_match_unique", "s:layer i:id_a,id_b d:dist", f"WITH {UNIQ} SELECT * FROM un")
def _(s, d):
    return J.match_unique(V.stars_a(s, d), V.stars_b(s, d), ["layer"], 1.0)


@query("c03_match_summary", "s:layer i:n,unique_n,unmatched,ambiguous,saturated,duplicates", f"""WITH {UNIQ}, c AS (SELECT layer, x, y, count(*) AS k FROM stars_a GROUP BY ALL)
SELECT layer, count(*) AS n, count(*) FILTER (WHERE id IN (SELECT id_a FROM un)) AS unique_n, count(*) FILTER (WHERE id NOT IN (SELECT ia FROM ed)) AS unmatched, n - unique_n - unmatched AS ambiguous,
 count(*) FILTER (WHERE sat) AS saturated, count(*) FILTER (WHERE k > 1) AS duplicates FROM stars_a JOIN c USING (layer, x, y) GROUP BY layer""")
def _(s, d):
    return J.match_summary(V.stars_a(s, d), V.stars_b(s, d), ["layer"], 1.0)


@query("c04_unmatched", "s:side,layer i:id", f"""WITH {EDGES} SELECT 'parent' AS side, layer, id FROM stars_a WHERE id NOT IN (SELECT ia FROM ed) UNION ALL SELECT 'candidate', layer, id FROM stars_b WHERE id NOT IN (SELECT ib FROM ed)""")
def _(s, d):
    a, b = V.stars_a(s, d), V.stars_b(s, d)
    one = J.unmatched(a, b, ["layer"], 1.0).select(F.lit("parent").alias("side"), "layer", "id")
    return one.unionByName(J.unmatched(b, a, ["layer"], 1.0).select(F.lit("candidate").alias("side"), "layer", "id"))


PROF = """bs AS (SELECT star, avg(fwhmx) AS f, avg(fwhmy / fwhmx) AS ax, max(flux) AS p FROM meas WHERE layer = 'A' GROUP BY star), af AS (SELECT star, avg(fwhmx) AS f, avg(fwhmy / fwhmx) AS ax, max(flux) AS p FROM meas WHERE layer = 'R' GROUP BY star),
pp AS (SELECT star, af.f / bs.f AS fwhm_ratio, af.ax - bs.ax AS axis_shift, af.p / bs.p AS peak_ratio FROM bs JOIN af USING (star))"""


def profiles(s, d):
    m = V.meas(s, d)
    return J.paired_profiles(m.where("layer = 'A'"), m.where("layer = 'R'"))


@query("c05_paired_profiles", "i:star d:fwhm_ratio,axis_shift,peak_ratio", f"WITH {PROF} SELECT * FROM pp")
def _(s, d):
    return profiles(s, d)


STARS_IN = "si AS (SELECT vec_id AS frame, 0 AS star, vec_id % 8 AS sx, (vec_id * 3) % 8 AS sy FROM embeddings UNION ALL SELECT vec_id, 1, (vec_id * 5 + 2) % 8, (vec_id + 4) % 8 FROM embeddings)"
AP = f"""{STARS_IN}, ap AS (SELECT p.frame, star, y, x, v, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS dist, CASE WHEN sqrt(pow(x - sx, 2) + pow(y - sy, 2)) <= 1.5 THEN 'aperture' WHEN sqrt(pow(x - sx, 2) + pow(y - sy, 2)) BETWEEN 2 AND 3.5 THEN 'annulus' END AS zone
 FROM px p JOIN si ON p.frame = si.frame)"""


def stars_in_frames(s, d):
    t = V.tiles(s, d)
    k = F.col("frame")
    one = t.select("frame", F.lit(0).alias("star"), (k % 8).alias("x"), (k * 3 % 8).alias("y"))
    return one.unionByName(t.select("frame", F.lit(1).alias("star"), ((k * 5 + 2) % 8).alias("x"), ((k + 4) % 8).alias("y")))


@query("c07_assign_apertures", "i:frame,star,y,x s:zone d:dist", f"WITH {AP} SELECT * FROM ap WHERE zone IS NOT NULL")
def _(s, d):
    return J.assign_apertures(V.px(s, d), stars_in_frames(s, d), ["frame"], 1.5, 2.0, 3.5)


@query("c08_pair_pixels", "i:parent,candidate,n_parent,n_candidate,n_both s:status d:mean_diff", """
WITH z AS (SELECT parent, candidate, y, x, pv, CASE WHEN candidate % 10 = 0 AND y = 7 THEN NULL ELSE cv END AS cv FROM px2)
SELECT parent, candidate, count(pv) AS n_parent, count(cv) AS n_candidate, count(cv) AS n_both, CASE WHEN count(cv) = count(*) THEN 'measured' ELSE 'uncertain' END AS status, CASE WHEN count(cv) = count(*) THEN avg(cv - pv) END AS mean_diff FROM z GROUP BY ALL""")
def _(s, d):
    p = V.px2(s, d)
    k = ["parent", "candidate"]
    cand = p.where(~((F.col("candidate") % 10 == 0) & (F.col("y") == 7))).select(*k, "y", "x", "cv")
    return J.pair_pixels(p.select(*k, "y", "x", "pv"), cand, k)


RECTS = """ra AS (SELECT p_partkey AS id, p_partkey * 37 % 500 AS x0, p_partkey * 53 % 500 AS y0, x0 + 3 + p_size % 7 AS x1, y0 + 3 + p_size % 5 AS y1 FROM part),
rb AS (SELECT s_suppkey AS id, s_suppkey * 71 % 500 AS x0, s_suppkey * 29 % 500 AS y0, x0 + 8 AS x1, y0 + 6 AS y1 FROM supplier)"""


def rects(s, d):
    p, k = V.table(s, d, "part"), F.col("p_partkey")
    a = p.select(k.alias("id"), (k * 37 % 500).alias("x0"), (k * 53 % 500).alias("y0"), (k * 37 % 500 + 3 + F.col("p_size") % 7).alias("x1"), (k * 53 % 500 + 3 + F.col("p_size") % 5).alias("y1"))
    k = F.col("s_suppkey")
    b = V.table(s, d, "supplier").select(k.alias("id"), (k * 71 % 500).alias("x0"), (k * 29 % 500).alias("y0"), (k * 71 % 500 + 8).alias("x1"), (k * 29 % 500 + 6).alias("y1"))
    return a, b


@query("c09_overlaps", "i:aid,bid", f"WITH {RECTS} SELECT ra.id AS aid, rb.id AS bid FROM ra JOIN rb ON ra.x0 < rb.x1 AND rb.x0 < ra.x1 AND ra.y0 < rb.y1 AND rb.y0 < ra.y1")
def _(s, d):
    return J.overlap_pairs(*rects(s, d), 16.0)


@query("c09_excluded", "i:id", f"WITH {RECTS} SELECT id FROM ra WHERE NOT EXISTS (SELECT 1 FROM rb WHERE ra.x0 < rb.x1 AND rb.x0 < ra.x1 AND ra.y0 < rb.y1 AND rb.y0 < ra.y1)")
def _(s, d):
    return J.excluded(*rects(s, d), 16.0)


@query("h05_unclear_sky", "i:id", f"""WITH {RECTS} SELECT id FROM ra WHERE EXISTS (SELECT 1 FROM rb WHERE ra.x0 < rb.x1 AND rb.x0 < ra.x1 AND ra.y0 < rb.y1 AND rb.y0 < ra.y1)
 OR EXISTS (SELECT 1 FROM ra o WHERE o.id <> ra.id AND ra.x0 < o.x1 AND o.x0 < ra.x1 AND ra.y0 < o.y1 AND o.y0 < ra.y1)""")
def _(s, d):
    return J.unclear_sky(*rects(s, d), 16.0)


@query("c10_nearest", "i:id,ref d:dist", f"""WITH {RECTS}, c AS (SELECT ra.id, rb.id AS ref, round(sqrt(pow(ra.x0 - rb.x0, 2) + pow(ra.y0 - rb.y0, 2)), 9) AS dist FROM ra, rb)
SELECT id, ref, dist FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, ref) = 1""")
def _(s, d):
    a, b = rects(s, d)
    pt = lambda r: r.select("id", F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"))
    return J.nearest(pt(a), pt(b), 8.0, 512.0)


SEP = "sqrt(pow(((a.ra - b.ra + 180) - 360 * floor((a.ra - b.ra + 180) / 360) - 180) * cos(radians((a.dec + b.dec) / 2)), 2) + pow(a.dec - b.dec, 2))"


@query("c11_max_separation", "i:target,n d:max_sep", f"""WITH m AS (SELECT a.target, max({SEP}) AS s FROM panels a JOIN panels b ON a.target = b.target AND a.id < b.id GROUP BY a.target)
SELECT p.target, count(*) AS n, coalesce(any_value(s), 0) AS max_sep FROM panels p LEFT JOIN m ON p.target = m.target GROUP BY p.target""")
def _(s, d):
    return J.max_separation(V.panels(s, d), "target")


@query("c12_mosaic_groups", "i:id,mosaic", f"""WITH RECURSIVE eg AS (SELECT a.id AS a, b.id AS b FROM panels a JOIN panels b ON a.id <> b.id AND abs(a.dec - b.dec) < 4
 AND abs((a.ra - b.ra + 180) - 360 * floor((a.ra - b.ra + 180) / 360) - 180) * cos(radians((a.dec + b.dec) / 2)) < 6),
rc(id, root) AS (SELECT id, id FROM panels UNION SELECT eg.b, rc.root FROM rc JOIN eg ON rc.id = eg.a WHERE eg.b > rc.root)
SELECT id, min(root) AS mosaic FROM rc GROUP BY id""")
def _(s, d):
    return J.mosaic_groups(V.panels(s, d), 6.0, 4.0)


@query("c14_join_channels", "i:session,img,n,x0,x1,y0,y1 d:mean_sum", """WITH z AS (SELECT session, img, y, x, r, g, CASE WHEN (img + y) % 5 = 0 THEN NULL ELSE b END AS b FROM rgb)
SELECT session, img, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(r + g + b) AS mean_sum FROM z WHERE b IS NOT NULL GROUP BY ALL""")
def _(s, d):
    long = V.rgb_long(s, d).where(~((F.col("channel") == "b") & ((F.col("img") + F.col("y")) % 5 == 0)))
    return J.join_channels(long, ["session", "img"])


@query("c16_changed_sources", "i:doc_id s:state", """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 13 = 0 THEN 'new' ELSE 'changed' END AS state FROM documents
WHERE doc_id % 143 <> 0 AND (doc_id % 11 = 0 OR doc_id % 13 = 0 OR (doc_id % 7 = 0))""")
def _(s, d):
    t = V.docs(s, d)
    rec = t.where("doc_id % 13 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("recorded"))
    cur = t.where("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    return J.changed_sources(rec, cur, "doc_id")


@query("c21_match_positions", "s:brand i:declared,observed,off b:same", """
WITH a AS (SELECT brand, x, y, row_number() OVER (PARTITION BY brand ORDER BY id) AS rk FROM stars_a), b AS (SELECT brand, x + CASE WHEN id % 97 = 0 THEN 0.5 ELSE 1e-9 END AS x, y, row_number() OVER (PARTITION BY brand ORDER BY id) AS rk FROM stars_a WHERE id % 501 <> 500)
SELECT brand, count(a.x) AS declared, count(b.x) AS observed, count(*) FILTER (WHERE coalesce(NOT (abs(a.x - b.x) <= 1e-6 AND abs(a.y - b.y) <= 1e-6), true)) AS off, off = 0 AS same FROM a FULL JOIN b USING (brand, rk) GROUP BY brand""")
def _(s, d):
    a = V.stars_a(s, d)
    b = a.where("id % 501 <> 500").withColumn("x", F.col("x") + F.when(F.col("id") % 97 == 0, 0.5).otherwise(1e-9))
    return J.match_positions(a, b, ["brand"])


# fixed values: the polygons of the bound query
POLYGONS = [("p", "include", [(0.5, 0.5), (7.2, 1.0), (6.0, 7.5), (1.0, 6.0)]), ("q", "include", [(4.0, 4.0), (7.9, 4.2), (7.5, 7.9)]), ("h", "exclude", [(2.5, 2.5), (4.6, 2.4), (4.5, 4.7), (2.4, 4.4)])]


@query("c22_polygon_weights", "i:frame d:area,mean", f"""
WITH e AS (SELECT * FROM (VALUES {', '.join(f"('{p}', '{m}', {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)" for p, m, _, ax, ay, bx, by in J.polygon_edges(POLYGONS))}) t(poly, mode, ax, ay, bx, by_)),
g AS (SELECT DISTINCT y, x FROM px), z AS (SELECT y, x, poly, mode, x + 0.5::DOUBLE AS cx, y + 0.5::DOUBLE AS cy, ax, ay, bx, by_, least(greatest(((x + 0.5::DOUBLE - ax) * (bx - ax) + (y + 0.5::DOUBLE - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)), 0), 1) AS t FROM g, e),
w AS (SELECT y, x, poly, mode, count(*) FILTER (WHERE (ay > cy) <> (by_ > cy) AND cx < ax + (cy - ay) * (bx - ax) / (by_ - ay)) % 2 AS odd, least(min(sqrt(pow(cx - ax - t * (bx - ax), 2) + pow(cy - ay - t * (by_ - ay), 2))) / 1.5, 1) AS u FROM z GROUP BY ALL),
v AS (SELECT y, x, mode, CASE WHEN odd = 1 THEN u * u * (3 - 2 * u) ELSE 0 END AS w FROM w),
f AS (SELECT y, x, least(coalesce(max(w) FILTER (WHERE mode = 'include'), 0), coalesce(min(1 - w) FILTER (WHERE mode = 'exclude'), 1)) AS weight FROM v GROUP BY ALL)
SELECT frame, sum(weight) AS area, sum(weight * v) / sum(weight) AS mean FROM px JOIN f USING (y, x) GROUP BY frame""")
def _(s, d):
    if any(J.is_self_crossing(pts) for _, _, pts in POLYGONS):
        raise ValueError("self-crossing polygon refused")
    return J.masked_mean(V.px(s, d), J.polygon_edges(POLYGONS), 1.5)
