"""Star table, layout and pixel-region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolake import views as V
from astrolake.operators import images as I
from astrolake.operators import joins as J
from astrolake.operators import sets as T
from astrolake.operators import stars as S
from astrolake.plans.image_queries import CLUM, LUM, q
from astrolake.plans.join_queries import AP, PROF, STARS_IN, UNIQ, profiles, rects, stars_in_frames
from astrolake.plans.registry import query

P = ["parent", "candidate"]


@query("d26_star_summary", "i:frame,n d:fwhm_median,fwhm_mean,fwhm_sd,roundness", """SELECT frame, count(*) AS n, median(fwhmx) AS fwhm_median, avg(fwhmx) AS fwhm_mean, stddev_pop(fwhmx) AS fwhm_sd, median(fwhmy / fwhmx) AS roundness FROM meas GROUP BY frame""")
def _(s, d):
    return S.star_summary(V.meas(s, d), ["frame"])


MOM = f"""{STARS_IN}, dd AS (SELECT p.session, p.frame, star, y, x, v, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS dist FROM px p JOIN si ON p.frame = si.frame),
bg AS (SELECT frame, star, median(v) AS bg FROM dd WHERE dist BETWEEN 3 AND 4 GROUP BY ALL), w AS (SELECT frame, star, x, y, greatest(v - bg, 0) AS w FROM dd JOIN bg USING (frame, star) WHERE dist <= 2.5),
m AS (SELECT frame, star, sum(w) AS flux, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * x * x) / sum(w) AS xx, sum(w * x * y) / sum(w) AS xy, sum(w * y * y) / sum(w) AS yy FROM w GROUP BY ALL HAVING sum(w) > 0),
c AS (SELECT *, xx - cx * cx AS a, xy - cx * cy AS b, yy - cy * cy AS c FROM m), e AS (SELECT *, greatest((a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2, 0.04) AS l1, greatest((a + c - sqrt(pow(a - c, 2) + 4 * b * b)) / 2, 0.04) AS l2 FROM c)"""


@query("d27_star_moments", "i:frame,star d:flux,cx,cy,fwhm_major,fwhm_minor,eccentricity,angle", f"""WITH {MOM} SELECT frame, star, flux, cx, cy, 2.35482 * sqrt(l1) AS fwhm_major, 2.35482 * sqrt(l2) AS fwhm_minor, sqrt(1 - l2 / l1) AS eccentricity,
 degrees(atan2(2 * b, a - c)) / 2 AS angle FROM e""")
def _(s, d):
    return S.star_moments(V.px(s, d), stars_in_frames(s, d), ["frame"])


@query("d28_spatial_report", "s:cell,layer i:captured,valid,saturated,unmatched d:p05,med,p95", f"""WITH {UNIQ}, z AS (SELECT *, concat(least(CAST(floor(y / 40 * 3) AS BIGINT), 2), least(CAST(floor(x / 51 * 3) AS BIGINT), 2)) AS c, id IN (SELECT id_a FROM un) AS hit FROM stars_a)
SELECT coalesce(c, 'all') AS cell, layer, count(*) AS captured, count(*) FILTER (WHERE NOT sat) AS valid, count(*) FILTER (WHERE sat) AS saturated, count(*) FILTER (WHERE NOT hit) AS unmatched,
 {q('fwhm', .05)} AS p05, median(fwhm) AS med, {q('fwhm', .95)} AS p95 FROM z GROUP BY GROUPING SETS ((c, layer), (layer))""")
def _(s, d):
    u = J.match_unique(V.stars_a(s, d), V.stars_b(s, d), ["layer"], 1.0).select(F.col("id_a").alias("id"))
    return S.spatial_report(V.stars_a(s, d), u, 51.0, 40.0)


@query("d29_axial_mean", "s:layer,profile,status d:axis,concentration", """WITH z AS (SELECT layer, profile, (fwhmx - fwhmy) / (fwhmx + fwhmy) AS w, radians(2.0::DOUBLE * (star * 7 % 180)) AS t FROM meas),
g AS (SELECT layer, profile, sum(w) AS w, sum(w * cos(t)) AS c, sum(w * sin(t)) AS s FROM z GROUP BY ALL)
SELECT layer, profile, 'measured' AS status, degrees(atan2(s, c)) / 2 AS axis, sqrt(c * c + s * s) / w AS concentration FROM g""")
def _(s, d):
    return S.axial_mean(V.meas(s, d).withColumn("angle", F.col("star") * 7 % 180), ["layer", "profile"])


@query("d30_paired_verdict", "i:field,n s:verdict d:ratio_med,ratio_p90,shift_p95,peak_p10,peak_p90", f"""WITH {PROF} SELECT star % 20 AS field, count(*) AS n, median(fwhm_ratio) AS ratio_med, {q('fwhm_ratio', .9)} AS ratio_p90, {q('abs(axis_shift)', .95)} AS shift_p95,
 {q('peak_ratio', .1)} AS peak_p10, {q('peak_ratio', .9)} AS peak_p90, CASE WHEN n < 3 THEN 'insufficient' WHEN n >= 5 AND (ratio_med > 1.5 OR ratio_p90 > 1.9) THEN 'review' ELSE 'stable' END AS verdict FROM pp GROUP BY field""")
def _(s, d):
    return S.paired_verdict(profiles(s, d).withColumn("field", F.col("star") % 20), ["field"])


@query("d31_star_layer_integrity", "i:session,n,new_holes,old_holes s:status d:retention_p10,retention_med", f"""WITH {STARS_IN}, z AS (SELECT session, parent, star, pv, cv, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS r FROM px2 JOIN si ON parent = frame),
g AS (SELECT session, parent, star, max(pv) FILTER (WHERE r <= 1.5) AS pp, max(cv) FILTER (WHERE r <= 1.5) AS cp, median(pv) FILTER (WHERE r BETWEEN 2 AND 3.5) AS pb, median(cv) FILTER (WHERE r BETWEEN 2 AND 3.5) AS cb,
 max(pv) FILTER (WHERE r < 0.5) AS pm, max(cv) FILTER (WHERE r < 0.5) AS cm FROM z GROUP BY ALL), h AS (SELECT *, CASE WHEN pp > pb THEN (cp - cb) / (pp - pb) END AS ret FROM g)
SELECT session, count(*) AS n, count(*) FILTER (WHERE cm < cb AND NOT pm < pb) AS new_holes, count(*) FILTER (WHERE cm < cb AND pm < pb) AS old_holes, {q('ret', .1)} AS retention_p10, median(ret) AS retention_med,
 CASE WHEN n < 3 THEN 'skipped' ELSE 'measured' END AS status FROM h GROUP BY session""")
def _(s, d):
    st = stars_in_frames(s, d).withColumnRenamed("frame", "parent")
    return S.star_layer_integrity(V.px2(s, d), st, ["parent"], "session")


@query("d32_stellar_ratios", "i:session,img d:flux_ratio,bright_ratio", f"""WITH z AS (SELECT session, img, {LUM} AS l, {CLUM} AS cl FROM rgb2), t AS (SELECT session, img, CASE WHEN max(l) <= 0.5 THEN {q('l', .995)} ELSE 0.85 END AS lim FROM z GROUP BY ALL)
SELECT session, img, sum(greatest(l - cl, 0)) / sum(l) AS flux_ratio, avg((l > lim)::INT) AS bright_ratio FROM z JOIN t USING (session, img) GROUP BY ALL""")
def _(s, d):
    r = V.rgb2(s, d).withColumn("l", I.lum()).withColumn("cl", I.lum("cr", "cg", "cb"))
    return S.stellar_ratios(r, ["session", "img"])


@query("d33_sample_coverage", "s:brand i:n,third0,third1,third2 d:span_x,span_y b:covered", """SELECT brand, count(*) AS n, count(*) FILTER (WHERE least(floor(x / 51 * 3), 2) = 0) AS third0, count(*) FILTER (WHERE least(floor(x / 51 * 3), 2) = 1) AS third1, count(*) FILTER (WHERE least(floor(x / 51 * 3), 2) = 2) AS third2,
 (max(x) - min(x)) / 51 AS span_x, (max(y) - min(y)) / 40 AS span_y, n >= 12 AND least(third0, third1, third2) >= 2 AND span_x >= 0.6 AND span_y >= 0.6 AS covered FROM stars_a GROUP BY brand""")
def _(s, d):
    return S.sample_coverage(V.stars_a(s, d), ["brand"], 51.0, 40.0)


@query("d07_plane_geometry", "s:brand i:rank d:condition", """WITH z AS (SELECT brand, 2 * x / 51 - 1 AS x, 2 * y / 40 - 1 AS y FROM stars_a), g AS (SELECT brand, count(*)::DOUBLE AS n, sum(x) AS a, sum(y) AS b, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM z GROUP BY brand),
c AS (SELECT brand, n + xx + yy AS t, n * xx + n * yy + xx * yy - a * a - b * b - xy * xy AS m, n * (xx * yy - xy * xy) - a * (a * yy - xy * b) + b * (a * xy - xx * b) AS det FROM g),
k AS (SELECT *, t * t / 9 - m / 3 AS s, t * t * t / 27 - t * m / 6 + det / 2 AS r FROM c), e AS (SELECT *, acos(least(greatest(r / pow(s, 1.5), -1), 1)) / 3 AS phi FROM k),
v AS (SELECT brand, t / 3 + 2 * sqrt(s) * cos(phi) AS e0, t / 3 + 2 * sqrt(s) * cos(phi + 2 * pi() / 3) AS e2 FROM e)
SELECT brand, 3 AS rank, sqrt(e0 / e2) AS condition FROM v""")
def _(s, d):
    return S.plane_geometry(V.stars_a(s, d), ["brand"], 51.0, 40.0)


@query("d34_detection_confidence", "i:frame,n d:confidence", """WITH g AS (SELECT frame, avg((fwhmx > 0.5 AND fwhmx < 4.5)::INT) AS k, avg(fwhmy / fwhmx) AS r, avg(fwhmx) AS z, count(*) AS n FROM meas GROUP BY frame)
SELECT frame, n, (k + least(greatest(r, 0), 1) + least(greatest(1 - abs(z - 2.5) / 2.7, 0), 1) + least(n / 7.7::DOUBLE, 1)) / 4 AS confidence FROM g""")
def _(s, d):
    return S.detection_confidence(V.meas(s, d), ["frame"])


@query("d43_channel_offsets", "i:session,n s:channel d:dx_med,dx_p10,dx_p90,dy_med,spread", f"""
WITH st AS (SELECT DISTINCT session, img, 0 AS star, img % 8 AS sx, img * 3 % 8 AS sy FROM rgb UNION ALL SELECT DISTINCT session, img, 1, (img * 5 + 2) % 8, (img + 4) % 8 FROM rgb),
dd AS (SELECT p.session, p.img, channel, star, y, x, v, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS r FROM rgb_long p JOIN st ON p.session = st.session AND p.img = st.img),
bg AS (SELECT session, img, channel, star, median(v) AS bg FROM dd WHERE r BETWEEN 3 AND 4 GROUP BY ALL), w AS (SELECT dd.session, dd.img, dd.channel, dd.star, x, y, greatest(v - bg, 0) AS w FROM dd JOIN bg USING (session, img, channel, star) WHERE r <= 2.5),
c AS (SELECT session, img, channel, star, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy FROM w GROUP BY ALL HAVING sum(w) > 0),
o AS (SELECT a.session, a.channel, a.cx - g.cx AS dx, a.cy - g.cy AS dy FROM c a JOIN c g ON a.session = g.session AND a.img = g.img AND a.star = g.star AND g.channel = 'g' AND a.channel <> 'g')
SELECT session, channel, count(*) AS n, median(dx) AS dx_med, {q('dx', .1)} AS dx_p10, {q('dx', .9)} AS dx_p90, median(dy) AS dy_med, dx_p90 - dx_p10 AS spread FROM o GROUP BY ALL""")
def _(s, d):
    long = V.rgb_long(s, d)
    k = F.col("img")
    base = long.select("session", "img", "channel").distinct()
    st = base.select("session", "img", "channel", F.lit(0).alias("star"), (k % 8).alias("x"), (k * 3 % 8).alias("y")).unionByName(
        base.select("session", "img", "channel", F.lit(1).alias("star"), ((k * 5 + 2) % 8).alias("x"), ((k + 4) % 8).alias("y")))
    return S.channel_offsets(long, st, ["session", "img"], "session")


@query("d44_shape_field", "s:layer i:n,dropped d:coverage,c_1,c_x,c_y,c_xx,c_xy,c_yy")
def _(s, d):
    return S.shape_field(V.stars_a(s, d), "layer", "fwhm", 51.0, 40.0)


@query("d45_star_colors", "i:session,img,star,endpoints d:r,g,b", """
WITH st AS (SELECT DISTINCT session, img, 0 AS star, img % 8 AS sx, img * 3 % 8 AS sy FROM rgb),
z AS (SELECT p.*, star, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS q FROM rgb p JOIN st ON p.session = st.session AND p.img = st.img)
SELECT session, img, star, median(r) FILTER (WHERE q <= 1.5) - median(r) FILTER (WHERE q BETWEEN 2 AND 3.5) AS r, median(g) FILTER (WHERE q <= 1.5) - median(g) FILTER (WHERE q BETWEEN 2 AND 3.5) AS g,
 median(b) FILTER (WHERE q <= 1.5) - median(b) FILTER (WHERE q BETWEEN 2 AND 3.5) AS b, count(*) FILTER (WHERE q <= 1.5 AND (least(r, g, b) <= 0.3 OR greatest(r, g, b) >= 0.7)) AS endpoints FROM z GROUP BY session, img, star""")
def _(s, d):
    r = V.rgb(s, d)
    k = F.col("img")
    st = r.select("session", "img").distinct().select("session", "img", F.lit(0).alias("star"), (k % 8).alias("x"), (k * 3 % 8).alias("y"))
    return S.star_colors(r, st, ["session", "img"])


@query("f10_local_maxima", "i:frame,y,x,rn d:v", """SELECT a.frame, a.y, a.x, any_value(a.v) AS v, row_number() OVER (PARTITION BY a.frame ORDER BY any_value(a.v) DESC, a.y, a.x) AS rn FROM px a JOIN px b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
GROUP BY a.frame, a.y, a.x HAVING any_value(a.v) = max(b.v) AND any_value(a.v) > 0.1""")
def _(s, d):
    return S.local_maxima(V.px(s, d), ["frame"], 1, 0.1)


@query("f11_thin_stars", "i:id d:x,y,flux")
def _(s, d):
    return S.thin(V.stars_a(s, d).withColumn("flux", F.col("fwhm")), 1.5)


def _farthest_sql(n: int) -> str:
    """Step by step: the farthest point, then each point's distance to the nearest chosen one."""
    parts = ["d0 AS (SELECT id, x, y, 'inf'::DOUBLE AS d FROM stars_a)"]
    for k in range(1, n + 1):
        parts.append(f"s{k} AS MATERIALIZED (SELECT id, x, y FROM d{k - 1} WHERE d > 0 ORDER BY d DESC, y, x, id LIMIT 1)")
        parts.append(f"d{k} AS MATERIALIZED (SELECT p.id, p.x, p.y, least(p.d, round(sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)), 9)) AS d FROM d{k - 1} p, s{k} s)")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT {k} AS step, id, x, y FROM s{k}" for k in range(1, n + 1))


@query("f12_farthest_points", "i:step,id d:x,y", _farthest_sql(8))
def _(s, d):
    return S.farthest(V.stars_a(s, d), 8)


@query("f13_best_per_cell", "i:cy,cx,id d:stability,dist", """WITH z AS (SELECT *, floor(y / 5) AS cy, floor(x / 5) AS cx, round(sqrt(pow(x - (floor(x / 5) + 0.5) * 5, 2) + pow(y - (floor(y / 5) + 0.5) * 5, 2)), 9) AS dist FROM stars_a)
SELECT cy, cx, id, fwhm AS stability, dist FROM z QUALIFY row_number() OVER (PARTITION BY cy, cx ORDER BY fwhm, dist, y, x, id) = 1""")
def _(s, d):
    return S.best_per_cell(V.stars_a(s, d).withColumn("stability", F.col("fwhm")), 5.0)


@query("f15_plateau", "i:parent,candidate,area,new_area,inherited s:status", """WITH n AS (SELECT parent, candidate, a.y, a.x, any_value(a.pv) AS pv, any_value(a.cv) AS cv, max(abs(a.pv - b.pv)) AS dp, max(abs(a.cv - b.cv)) AS dc FROM px2 a JOIN px2 b USING (parent, candidate) WHERE abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL)
SELECT parent, candidate, count(*) FILTER (WHERE dc <= 0.15 AND cv >= 0) AS area, count(*) FILTER (WHERE dc <= 0.15 AND cv >= 0 AND NOT (dp <= 0.15 AND pv >= 0)) AS new_area, count(*) FILTER (WHERE dc <= 0.15 AND cv >= 0 AND dp <= 0.15 AND pv >= 0) AS inherited,
 CASE WHEN new_area >= 5 THEN 'warning' ELSE 'passed' END AS status FROM n GROUP BY ALL""")
def _(s, d):
    return S.plateau(V.px2(s, d), P, 0.15, 0.0, 5)


REGS = """c AS (SELECT frame, y, x, frame * 64 + y * 8 + x AS id FROM px WHERE v >= 0.12), eg AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.frame = b.frame AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
rc(id, root) AS (SELECT id, id FROM c UNION SELECT eg.b, rc.root FROM rc JOIN eg ON rc.id = eg.a WHERE eg.b > rc.root OR true),
lb AS (SELECT id, min(root) AS region FROM rc GROUP BY id),
rg AS (SELECT frame, region, count(*) AS area, avg(x) AS cx, avg(y) AS cy, sqrt(4 * count(*) / pi()) AS diameter FROM c JOIN lb USING (id) GROUP BY ALL)"""


def _regions(s, d):
    return S.clipped_regions(V.px(s, d), "frame", 0.12, V.SIDE)


@query("f16_clipped_regions", "i:frame,region,area d:cx,cy,diameter", f"WITH RECURSIVE {REGS} SELECT * FROM rg")
def _(s, d):
    return _regions(s, d)


@query("f16_region_verdict", "i:frame,regions,largest,big s:verdict", f"""WITH RECURSIVE {REGS} SELECT frame, count(*) AS regions, max(area) AS largest, count(*) FILTER (WHERE area >= 5) AS big, CASE WHEN largest >= 9 OR big >= 2 THEN 'failed' WHEN largest >= 5 THEN 'warning' ELSE 'passed' END AS verdict FROM rg GROUP BY frame""")
def _(s, d):
    return S.region_verdict(_regions(s, d), "frame", 5, 9)


@query("f20_flag_duplicates", "i:frame,line,star,occurrences", "SELECT frame, line, star, occurrences FROM (SELECT *, count(*) OVER (PARTITION BY frame, line) AS occurrences FROM meas) WHERE occurrences > 1")
def _(s, d):
    return S.flag_duplicates(V.meas(s, d), ["frame", "line"])


@query("f22_locate_blocks", "i:frame,ay,ax,sy,sx d:energy", """WITH e AS (SELECT frame, y // 2 AS by_, x // 2 AS bx, var_pop(v) AS en FROM px GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(en, 9) DESC, by_, bx) AS rn FROM e), t AS (SELECT frame, by_ AS ay, bx AS ax, en AS energy FROM r WHERE rn = 1),
s AS (SELECT e.frame, by_ AS sy, bx AS sx, row_number() OVER (PARTITION BY e.frame ORDER BY round(en, 9) DESC, by_, bx) AS rn FROM e JOIN t ON e.frame = t.frame WHERE sqrt(pow(by_ - ay, 2) + pow(bx - ax, 2)) >= 2)
SELECT t.*, s.sy, s.sx FROM t LEFT JOIN s ON t.frame = s.frame AND rn = 1""")
def _(s, d):
    return S.locate_blocks(V.px(s, d), "frame", 2, 2.0)


@query("f23_highlights", "i:parent,candidate,y,x,i,n,y0,y1,x0,x1 d:pv,cv", """SELECT parent, candidate, y, x, pv, cv, row_number() OVER (w ORDER BY y, x) AS i, count(*) OVER w AS n, min(y) OVER w AS y0, max(y) OVER w AS y1, min(x) OVER w AS x0, max(x) OVER w AS x1 FROM px2 WHERE cv >= 0.2 WINDOW w AS (PARTITION BY parent, candidate)""")
def _(s, d):
    return S.highlights(V.px2(s, d), P, 0.2)


@query("h02_key_diff", "i:key s:side", """SELECT doc_id AS key, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(s, d):
    k = lambda t: V.table(s, d, t).select(F.col("doc_id").alias("key"))
    return T.key_diff(k("documents"), k("labels"), "key")


@query("h03_label_sets", "i:target s:label,state", """WITH m AS (SELECT DISTINCT target, filter AS label FROM frames WHERE frame % 3 <> 0), b AS (SELECT DISTINCT target, filter AS label FROM frames WHERE frame % 3 <> 1)
SELECT target, label, CASE WHEN b.target IS NULL THEN 'missing' WHEN m.target IS NULL THEN 'extra' ELSE 'common' END AS state FROM m FULL JOIN b USING (target, label)""")
def _(s, d):
    f = V.frames(s, d).withColumn("label", F.col("filter"))
    return T.label_sets(f.where("frame % 3 <> 0"), f.where("frame % 3 <> 1"), ["target"])


@query("h04_snapshot_diff", "s:state i:n", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 10 = 1 THEN 'removed' WHEN doc_id % 10 = 2 THEN 'changed' END AS state FROM documents) WHERE state IS NOT NULL GROUP BY state""")
def _(s, d):
    t = V.docs(s, d)
    old = t.where("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    new = t.where("doc_id % 10 <> 1").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return T.snapshot_diff(old, new, "doc_id")


@query("h05_check_split", "s:brand i:fit,val,shared,left_out b:valid", """SELECT brand, count(*) FILTER (WHERE id % 3 <> 0 OR id % 250 = 0) AS fit, count(*) FILTER (WHERE id % 3 = 0) AS val, count(*) FILTER (WHERE id % 3 = 0 AND id % 250 = 0) AS shared, 0 AS left_out,
 shared = 0 AND fit >= 3 AND val >= 3 AS valid FROM stars_a GROUP BY brand""")
def _(s, d):
    p = V.stars_a(s, d)
    return T.check_split(p.withColumn("in_fit", (F.col("id") % 3 != 0) | (F.col("id") % 250 == 0)).withColumn("in_val", F.col("id") % 3 == 0), ["brand"])
