"""Image statistic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolake import views as V
from astrolake.operators import frame_stats as FS
from astrolake.operators import images as I
from astrolake.plans.registry import query

SIDE = V.SIDE
K = ["session", "img"]
LUM = "0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b"
CLUM = "0.2126::DOUBLE * cr + 0.7152::DOUBLE * cg + 0.0722::DOUBLE * cb"
REG = """reg AS (SELECT * FROM (VALUES ('bg','background',0,0,4,4),('core','core',2,2,6,6),('faint','faint',4,4,8,8),('star','stars',4,0,8,4)) t(region, role, x0, y0, x1, y1))"""
IN = "x >= x0 AND x < x1 AND y >= y0 AND y < y1"
CORNER = """CASE WHEN y < 2 AND x < 2 THEN 'tl' WHEN y < 2 AND x >= 6 THEN 'tr' WHEN y >= 6 AND x < 2 THEN 'bl' WHEN y >= 6 AND x >= 6 THEN 'br'
 WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 THEN 'centre' END"""


def q(col: str, p: float) -> str:
    return f"quantile_cont({col}, {p})"


def px(s, d):
    return V.px(s, d)


@query("b08_luminance", "i:session,img,y,x d:l", f"SELECT session, img, y, x, {LUM} AS l FROM rgb")
def _(s, d):
    return I.with_luminance(V.rgb(s, d))


@query("b09_normalize_robust", "i:frame,y,x d:u", f"""
WITH s AS (SELECT frame, {q('v', 0.001)} AS a, {q('v', 0.999)} AS b, min(v) AS mn, max(v) AS mx FROM px GROUP BY frame),
t AS (SELECT frame, CASE WHEN b > a THEN a ELSE mn END AS lo, CASE WHEN b > a THEN b ELSE mx END AS hi FROM s)
SELECT frame, y, x, least(greatest((v - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 0), 1) AS u FROM px JOIN t USING (frame)""")
def _(s, d):
    return V.pixels(FS.normalize_robust(V.tiles(s, d)), "frame").withColumnRenamed("v", "u")


# every 17th pixel of a frame reads as NaN and every 19th as +Inf: defects derived from position
@query("b10_clean_finite", "i:frame,y,x,n_nan,n_posinf,n_neginf d:v", """
WITH z AS (SELECT frame, y, x, (y * 8 + x + frame) % 17 = 0 AS nn, (y * 8 + x + frame) % 19 = 0 AS pi, v FROM px),
m AS (SELECT frame, median(v) FILTER (WHERE NOT nn AND NOT pi) AS md, count(*) FILTER (WHERE nn) AS n_nan,
             count(*) FILTER (WHERE pi AND NOT nn) AS n_posinf, 0 AS n_neginf FROM z GROUP BY frame)
SELECT frame, y, x, n_nan, n_posinf, n_neginf, CASE WHEN nn OR pi THEN md ELSE v END AS v FROM z JOIN m USING (frame)""")
def _(s, d):
    bad = lambda v, pos: F.when((pos + F.col("frame")) % 17 == 0, float("nan")).when((pos + F.col("frame")) % 19 == 0, float("inf")).otherwise(v)
    t = V.tiles(s, d).withColumn("tile", F.transform(F.col("tile").cast("array<double>"), bad))
    return V.pixels(FS.clean_finite(t), "frame", "n_nan", "n_posinf", "n_neginf")


@query("d01_image_stats", "i:frame d:mn,mx,mean,sd,p0_1,p1,p5,p10,p25,p50,p75,p90,p95,p99,p99_9,mad_sigma,min_ratio,max_ratio,near_min,near_max", f"""
WITH o AS (SELECT frame, min(v) AS mn, max(v) AS mx, avg(v) AS mean, stddev_pop(v) AS sd,
 {', '.join(f"{q('v', p / 100)} AS p{str(p).replace('.', '_')}" for p in I.PERCENTILES)} FROM px GROUP BY frame),
t AS (SELECT frame, 1.4826 * median(abs(v - p50)) AS mad_sigma, avg((v = mn)::INT) AS min_ratio, avg((v = mx)::INT) AS max_ratio,
 avg((v <= mn + (mx - mn) * 1e-5)::INT) AS near_min, avg((v >= mx - (mx - mn) * 1e-5)::INT) AS near_max FROM px JOIN o USING (frame) GROUP BY frame)
SELECT * FROM o JOIN t USING (frame)""")
def _(s, d):
    return FS.image_stats(V.tiles(s, d), ["frame"])


@query("d02_channel_stats", "i:session,img,n_finite,n_bad s:channel d:shadow,highlight,near_black,p01,p50,p99", f"""
SELECT session, img, channel, count(*) AS n_finite, 0 AS n_bad, avg((v <= 0)::INT) AS shadow, avg((v >= 1)::INT) AS highlight,
 avg((v > 0 AND v <= 1e-4)::INT) AS near_black, {q('v', .01)} AS p01, median(v) AS p50, {q('v', .99)} AS p99 FROM rgb_long GROUP BY ALL""")
def _(s, d):
    return I.channel_stats(V.rgb_long(s, d), [*K, "channel"])


@query("d03_clipping", "i:session,img s:source d:low_all,high_all,high_channel,pressure", """
WITH p AS (SELECT session, img, channel, avg((v <= 0.25)::INT) AS lo, avg((v >= 0.75)::INT) AS hi FROM rgb_long GROUP BY ALL),
a AS (SELECT session, img, avg((v <= 0.25)::INT) AS low_all, avg((v >= 0.75)::INT) AS high_all FROM rgb_long GROUP BY ALL),
g AS (SELECT session, img, max(hi) AS high_channel, max(channel) FILTER (WHERE hi = mh) AS top
      FROM (SELECT *, max(hi) OVER (PARTITION BY session, img) AS mh FROM p) GROUP BY ALL)
SELECT session, img, low_all, high_all, high_channel, greatest(high_all, high_channel) AS pressure,
 CASE WHEN high_channel > high_all THEN top ELSE 'aggregate' END AS source FROM a JOIN g USING (session, img)""")
def _(s, d):
    return I.clipping(V.rgb_long(s, d), K, 0.25, 0.75)


@query("d04_block_spread", "i:frame d:spread,sky,rel_spread", f"""
WITH b AS (SELECT frame, y // 2 AS by_, x // 2 AS bx, median(v) AS bm FROM px GROUP BY ALL)
SELECT frame, spread, sky, spread / nullif(abs(sky), 0) AS rel_spread
FROM (SELECT frame, {q('bm', .95)} - {q('bm', .05)} AS spread FROM b GROUP BY frame) JOIN (SELECT frame, median(v) AS sky FROM px GROUP BY frame) USING (frame)""")
def _(s, d):
    return FS.block_spread(V.tiles(s, d), ["frame"], SIDE, 2)


@query("d05_noise", "i:frame d:sigma,block_median,block_p90", f"""
WITH h AS (SELECT a.frame, a.y, a.x, any_value(a.v) AS v, any_value(a.v) - median(b.v) AS res FROM px a JOIN px b
 ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.frame, a.y, a.x),
c AS (SELECT frame, {q('v', .35)} AS c FROM h GROUP BY frame),
dk AS (SELECT h.* FROM h JOIN c USING (frame) WHERE v <= c),
m AS (SELECT frame, median(res) AS m FROM dk GROUP BY frame),
w AS (SELECT frame, 1.4826 * median(abs(res - m)) AS sigma FROM dk JOIN m USING (frame) GROUP BY frame),
bm AS (SELECT frame, y // 4 AS by_, x // 4 AS bx, median(res) AS m FROM h GROUP BY ALL),
bs AS (SELECT h.frame, by_, bx, 1.4826 * median(abs(res - m)) AS bs FROM h JOIN bm ON h.frame = bm.frame AND y // 4 = by_ AND x // 4 = bx GROUP BY ALL)
SELECT frame, sigma, median(bs) AS block_median, {q('bs', .9)} AS block_p90 FROM w JOIN bs USING (frame) GROUP BY frame, sigma""")
def _(s, d):
    return FS.noise(V.tiles(s, d), ["frame"], SIDE)


@query("d06_fit_plane", "i:frame d:a,b,c,rms,r2,magnitude,angle", f"""
WITH c AS (SELECT frame, {q('v', .45)} AS c FROM px GROUP BY frame),
z AS (SELECT frame, (x - 3.5::DOUBLE) / 3.5 AS u, (y - 3.5::DOUBLE) / 3.5 AS w, v FROM px JOIN c USING (frame) WHERE v <= c),
m AS (SELECT frame, avg(u) AS mu, avg(w) AS mw, avg(v) AS mv FROM z GROUP BY frame),
s AS (SELECT frame, count(*) AS n, any_value(mu) AS mu, any_value(mw) AS mw, any_value(mv) AS mv, sum((u-mu)*(u-mu)) AS uu, sum((u-mu)*(w-mw)) AS uw,
  sum((w-mw)*(w-mw)) AS ww, sum((u-mu)*(v-mv)) AS uv, sum((w-mw)*(v-mv)) AS wv, sum((v-mv)*(v-mv)) AS vv FROM z JOIN m USING (frame) GROUP BY frame),
f AS (SELECT *, (uv*ww - wv*uw) / (uu*ww - uw*uw) AS b, (wv*uu - uv*uw) / (uu*ww - uw*uw) AS c FROM s),
e AS (SELECT f.frame, sum(pow(v - (mv + b*(u-mu) + c*(w-mw)), 2)) AS sse FROM f JOIN z USING (frame) GROUP BY f.frame)
SELECT frame, mv - b*mu - c*mw AS a, b, c, sqrt(sse / n) AS rms, 1 - sse / vv AS r2, sqrt(b*b + c*c) AS magnitude, degrees(atan2(c, b)) AS angle
FROM f JOIN e USING (frame)""")
def _(s, d):
    return FS.fit_plane(V.tiles(s, d), ["frame"], SIDE)


def _plane_sql(src: str, w: str, name: str) -> str:
    return f"""{name}m AS (SELECT session, img, sum({w}) AS n, sum({w}*u)/sum({w}) AS mu, sum({w}*t)/sum({w}) AS mt, sum({w}*z)/sum({w}) AS mz FROM {src} GROUP BY ALL),
{name}s AS (SELECT session, img, any_value(n) AS n, any_value(mu) AS mu, any_value(mt) AS mt, any_value(mz) AS mz, sum({w}*(u-mu)*(u-mu)) AS uu, sum({w}*(u-mu)*(t-mt)) AS ut,
 sum({w}*(t-mt)*(t-mt)) AS tt, sum({w}*(u-mu)*(z-mz)) AS uz, sum({w}*(t-mt)*(z-mz)) AS tz, sum({w}*(z-mz)*(z-mz)) AS zz FROM {src} JOIN {name}m USING (session, img) GROUP BY ALL),
{name}c AS (SELECT *, (uz*tt - tz*ut) / (uu*tt - ut*ut) AS b, (tz*uu - uz*ut) / (uu*tt - ut*ut) AS c FROM {name}s),
{name} AS (SELECT session, img, mz - b*mu - c*mt AS a, b, c, sqrt(greatest(zz - b*uz - c*tz, 0) / n) AS rms FROM {name}c)"""


def _rew(src: str, fit: str, name: str) -> str:
    return f"""{name} AS (SELECT session, img, u, t, z, 1 / (1 + pow((z - a - b*u - c*t) / greatest(rms, 1e-9), 2)) AS wt FROM {src} JOIN {fit} USING (session, img))"""


@query("d08_ratio_gradient", "i:session,img d:a,b,c,rms", f"""
WITH g AS (SELECT session, img, (x // 2 - 1.5::DOUBLE) / 1.5 AS u, (y // 2 - 1.5::DOUBLE) / 1.5 AS t, ln(greatest(median(r), 1e-6) / greatest(median(g), 1e-6)) AS z
 FROM rgb GROUP BY session, img, y // 2, x // 2), {_plane_sql('g', '1', 'f0')}, {_rew('g', 'f0', 'g1')}, {_plane_sql('g1', 'wt', 'f1')},
 {_rew('g', 'f1', 'g2')}, {_plane_sql('g2', 'wt', 'f2')} SELECT * FROM f2""")
def _(s, d):
    return I.fit_ratio_gradient(V.rgb(s, d), K, SIDE)


@query("d09_corner_uniformity", "i:frame,lifted d:centre,corner_min,corner_max,corner_range,corner_to_centre,clean_range", f"""
WITH m AS (SELECT frame, median(v) AS med FROM px GROUP BY frame),
g AS (SELECT frame, any_value(med) AS med, 1.4826 * median(abs(v - med)) AS sg FROM px JOIN m USING (frame) GROUP BY frame),
r AS (SELECT frame, reg, median(v) AS rm FROM (SELECT frame, v, {CORNER} AS reg FROM px) WHERE reg IS NOT NULL GROUP BY frame, reg),
z AS (SELECT r.*, greatest(med + 3*sg, 1.35*med) AS lim FROM r JOIN g USING (frame))
SELECT frame, max(rm) FILTER (WHERE reg = 'centre') AS centre, min(rm) FILTER (WHERE reg <> 'centre') AS corner_min, max(rm) FILTER (WHERE reg <> 'centre') AS corner_max,
 corner_max - corner_min AS corner_range, avg(rm) FILTER (WHERE reg <> 'centre') / nullif(centre, 0) AS corner_to_centre,
 count(*) FILTER (WHERE reg <> 'centre' AND rm > lim) AS lifted,
 max(rm) FILTER (WHERE reg <> 'centre' AND rm <= lim) - min(rm) FILTER (WHERE reg <> 'centre' AND rm <= lim) AS clean_range FROM z GROUP BY frame""")
def _(s, d):
    return FS.corner_uniformity(V.tiles(s, d), ["frame"], SIDE)


@query("d10_color_stats", "i:session,img s:collapsed d:bg_r,bg_g,bg_b,p99_r,p99_g,p99_b,ratio_r,ratio_g,ratio_b,corr_rg,corr_rb,corr_gb", f"""
WITH l AS (SELECT *, {LUM} AS l FROM rgb), c AS (SELECT session, img, {q('l', .3)} AS c FROM l GROUP BY ALL),
g AS (SELECT session, img, median(r) FILTER (WHERE l <= c) AS bg_r, median(g) FILTER (WHERE l <= c) AS bg_g, median(b) FILTER (WHERE l <= c) AS bg_b,
 {q('r', .99)} AS p99_r, {q('g', .99)} AS p99_g, {q('b', .99)} AS p99_b, corr(r, g) AS corr_rg, corr(r, b) AS corr_rb, corr(g, b) AS corr_gb
 FROM l JOIN c USING (session, img) GROUP BY ALL)
SELECT *, 3 * bg_r / (bg_r + bg_g + bg_b) AS ratio_r, 3 * bg_g / (bg_r + bg_g + bg_b) AS ratio_g, 3 * bg_b / (bg_r + bg_g + bg_b) AS ratio_b,
 concat_ws(',', CASE WHEN p99_r < 0.01 * greatest(p99_r, p99_g, p99_b) THEN 'r' END, CASE WHEN p99_g < 0.01 * greatest(p99_r, p99_g, p99_b) THEN 'g' END,
 CASE WHEN p99_b < 0.01 * greatest(p99_r, p99_g, p99_b) THEN 'b' END) AS collapsed FROM g""")
def _(s, d):
    return FS.color_stats(V.rgb_planes(s, d), K)


@query("c06_assign_regions", "i:frame,y,x s:region,role d:v", f"WITH {REG} SELECT frame, y, x, region, role, v FROM px JOIN reg ON {IN}")
def _(s, d):
    return I.assign_regions(px(s, d), I.regions(s))


@query("d11_region_metrics", "i:frame,n s:region d:p10,p50,p90,p99,clip_ratio,span,rel_contrast,above_bg", f"""
WITH {REG}, g AS (SELECT frame, region, count(*) AS n, {q('v', .1)} AS p10, median(v) AS p50, {q('v', .9)} AS p90, {q('v', .99)} AS p99,
 avg((v >= 0.25)::INT) AS clip_ratio FROM px JOIN reg ON {IN} GROUP BY ALL)
SELECT g.*, p90 - p10 AS span, (p90 - p10) / nullif(abs(p50), 0) AS rel_contrast, p50 - max(CASE WHEN region = 'bg' THEN p50 END) OVER (PARTITION BY frame) AS above_bg FROM g""")
def _(s, d):
    return I.region_metrics(px(s, d), I.regions(s), ["frame"], 0.25)


@query("d11_region_profiles", "i:frame,i s:region,axis d:m", f"""
WITH {REG} SELECT frame, region, 'x' AS axis, x AS i, avg(v) AS m FROM px JOIN reg ON {IN} GROUP BY ALL
UNION ALL SELECT frame, region, 'y', y, avg(v) FROM px JOIN reg ON {IN} GROUP BY ALL""")
def _(s, d):
    return I.region_profiles(px(s, d), I.regions(s), ["frame"])


@query("d12_paired_diff", "i:parent,candidate,n_pos,n_neg,at_y,at_x d:mass_pos,mass_neg,max_abs", """
SELECT parent, candidate, count(*) FILTER (WHERE cv > pv) AS n_pos, count(*) FILTER (WHERE cv < pv) AS n_neg,
 sum(greatest(cv - pv, 0)) AS mass_pos, sum(greatest(pv - cv, 0)) AS mass_neg, max(abs(cv - pv)) AS max_abs,
 arg_max(y, (abs(cv - pv), -y, -x)) AS at_y, arg_max(x, (abs(cv - pv), -y, -x)) AS at_x FROM px2 GROUP BY ALL""")
def _(s, d):
    return I.paired_diff(V.px2(s, d), ["parent", "candidate"])


@query("d13_endpoint_transitions", "i:parent,candidate,n,parent_n,candidate_n,new_n,kept_n,recovered_n s:tile d:overshoot,new_rate", """
WITH t AS (SELECT *, pv <= -0.2 OR pv >= 0.2 AS pe, cv <= -0.2 OR cv >= 0.2 AS ce, greatest(cv - 0.2, -0.2 - cv, 0) AS ov, concat(y // 4, ':', x // 4) AS tl FROM px2)
SELECT parent, candidate, coalesce(tl, 'all') AS tile, count(*) AS n, count(*) FILTER (WHERE pe) AS parent_n, count(*) FILTER (WHERE ce) AS candidate_n,
 count(*) FILTER (WHERE ce AND NOT pe) AS new_n, count(*) FILTER (WHERE ce AND pe) AS kept_n, count(*) FILTER (WHERE pe AND NOT ce) AS recovered_n, max(ov) AS overshoot,
 new_n / n AS new_rate FROM t GROUP BY GROUPING SETS ((parent, candidate), (parent, candidate, tl))""")
def _(s, d):
    return I.endpoint_transitions(V.px2(s, d), ["parent", "candidate"], -0.2, 0.2)


@query("d14_neutral_benefit", "i:session,n d:improved,worsened,before_med,before_p90,after_med,after_p90", f"""
WITH {REG}, m AS (SELECT session, img, region, median(r) AS r, median(g) AS g, median(b) AS b, median(cr) AS cr, median(cg) AS cg, median(cb) AS cb FROM rgb2 JOIN reg ON {IN} GROUP BY ALL),
z AS (SELECT session, greatest(r, g, b) - least(r, g, b) AS f, greatest(cr, cg, cb) - least(cr, cg, cb) AS t FROM m)
SELECT session, count(*) AS n, avg((t < f)::INT) AS improved, avg((t > f)::INT) AS worsened, median(f) AS before_med, {q('f', .9)} AS before_p90, median(t) AS after_med, {q('t', .9)} AS after_p90 FROM z GROUP BY session""")
def _(s, d):
    return I.neutral_benefit(V.rgb2(s, d), I.regions(s))


@query("d15_neutral_coefficients", "i:session,img s:status d:gain_r,gain_g,gain_b", f"""
WITH {REG}, p AS (SELECT session, img, region, median(r) AS r, median(g) AS g, median(b) AS b FROM rgb JOIN reg ON {IN} GROUP BY ALL),
m AS (SELECT session, img, median(r) AS r, median(g) AS g, median(b) AS b FROM p GROUP BY ALL),
e AS (SELECT session, img, stddev_pop(r) AS er, stddev_pop(g) AS eg, stddev_pop(b) AS eb FROM rgb JOIN reg ON {IN} GROUP BY ALL),
z AS (SELECT *, greatest(r, g, b) < 0.98 AND r > 5 * er / 8 AND g > 5 * eg / 8 AND b > 5 * eb / 8 AS ok FROM m JOIN e USING (session, img))
SELECT session, img, CASE WHEN ok THEN 'measured' ELSE 'unavailable' END AS status, CASE WHEN ok THEN least(r, g, b) / r END AS gain_r,
 CASE WHEN ok THEN least(r, g, b) / g END AS gain_g, CASE WHEN ok THEN least(r, g, b) / b END AS gain_b FROM z""")
def _(s, d):
    return I.neutral_coefficients(V.rgb(s, d), I.regions(s), K)


@query("d16_background_benefit", "i:parent,candidate s:verdict d:change,sd", f"""
WITH {REG}, bm AS (SELECT parent, candidate, region, median(pv) AS pm, median(cv) AS cm, row_number() OVER (PARTITION BY parent, candidate, region ORDER BY y // 2, x // 2) - 1 AS i,
  count(*) OVER (PARTITION BY parent, candidate, region) AS n FROM px2 JOIN reg ON {IN} GROUP BY parent, candidate, region, y // 2, x // 2),
d AS (SELECT b.parent, b.candidate, b.region, rep, c.pm, c.cm FROM bm b, range(16) t(rep), bm c
  WHERE c.parent = b.parent AND c.candidate = b.candidate AND c.region = b.region AND c.i = (rep * 7919 + b.i * 104729 + rep * b.i * 31 + 11) % b.n),
r AS (SELECT parent, candidate, region, rep, median(pm) AS p, median(cm) AS c FROM d GROUP BY ALL),
s AS (SELECT parent, candidate, rep, {q('c', .9)} - {q('c', .1)} - {q('p', .9)} + {q('p', .1)} AS delta FROM r GROUP BY ALL),
v AS (SELECT parent, candidate, stddev_samp(delta) AS sd FROM s GROUP BY ALL),
o AS (SELECT parent, candidate, region, median(pm) AS p, median(cm) AS c FROM bm GROUP BY ALL),
b AS (SELECT parent, candidate, {q('c', .9)} - {q('c', .1)} - {q('p', .9)} + {q('p', .1)} AS change FROM o GROUP BY ALL)
SELECT parent, candidate, change, sd, CASE WHEN change < -greatest(3 * sd, 1e-6) THEN 'improved' WHEN change > greatest(3 * sd, 1e-6) THEN 'worsened' ELSE 'unchanged' END AS verdict
FROM b JOIN v USING (parent, candidate)""")
def _(s, d):
    return I.background_benefit(V.px2(s, d), I.regions(s))


FIDELITY = f"""l AS (SELECT *, {LUM} AS l, {CLUM} AS cl, r + g + b AS t, cr + cg + cb AS ct FROM rgb2),
md AS (SELECT session, img, median(l) AS med FROM l GROUP BY ALL),
sk AS (SELECT session, img, any_value(med) AS med, 1.4826 * median(abs(l - med)) AS sg FROM l JOIN md USING (session, img) GROUP BY ALL),
z AS (SELECT l.*, l > med + 3 * sg AND greatest(r, g, b) < 0.98 AS sub, l <= med AS dark, greatest(r, g, b) - least(r, g, b) AS ch, greatest(cr, cg, cb) - least(cr, cg, cb) AS cch,
 CASE WHEN l > med + 3 * sg AND greatest(r, g, b) < 0.98 AND t > 1e-6 AND ct > 1e-6 THEN greatest(abs(cr/ct - r/t), abs(cg/ct - g/t), abs(cb/ct - b/t)) END AS drift FROM l JOIN sk USING (session, img)),
g AS (SELECT session, img, count(*) FILTER (WHERE dark) AS n_bg, {q('drift', .95)} AS drift_p95, median(ch) FILTER (WHERE sub) AS s_ch, median(cch) FILTER (WHERE sub) AS s_cch,
 stddev_pop(ch) FILTER (WHERE dark) AS b_ch, stddev_pop(cch) FILTER (WHERE dark) AS b_cch, median(l) FILTER (WHERE dark) AS m_l, median(cl) FILTER (WHERE dark) AS m_cl FROM z GROUP BY ALL),
dv AS (SELECT session, img, 1.4826 * median(abs(l - m_l)) AS sig, 1.4826 * median(abs(cl - m_cl)) AS csig FROM z JOIN g USING (session, img) WHERE dark GROUP BY ALL),
fid AS (SELECT session, img, n_bg, drift_p95, CASE WHEN n_bg >= 16 AND s_ch / nullif(b_ch, 0) > 0.25 THEN (s_cch / nullif(b_cch, 0)) / (s_ch / nullif(b_ch, 0)) END AS chroma_retention,
 CASE WHEN n_bg >= 16 THEN b_cch / nullif(b_ch, 0) END AS chroma_noise_gain,
 CASE WHEN n_bg >= 16 AND sig / nullif(abs(m_l), 0) > 0 THEN CASE WHEN m_cl = 0 THEN NULL ELSE least((csig / abs(m_cl)) / (sig / abs(m_l)), 1.6) END END AS noise_gain,
 CASE WHEN n_bg >= 16 THEN csig END AS bg_sigma FROM g JOIN dv USING (session, img))"""


@query("d17_fidelity_metrics", "i:session,img,n_bg d:drift_p95,chroma_retention,chroma_noise_gain,noise_gain,bg_sigma", f"WITH {FIDELITY} SELECT * FROM fid")
def _(s, d):
    return FS.fidelity_metrics(V.rgb2_planes(s, d), K)


@query("d18_screen_corpus", "i:session,img d:sep,measurable_share b:measurable s:grade", f"""
WITH m AS (SELECT session, img, y // 2 AS by_, x // 2 AS bx, avg({LUM}) AS m FROM rgb GROUP BY ALL),
w AS (SELECT session, img, {q('m', .75)} / {q('m', .25)} AS sep FROM m GROUP BY ALL),
v AS (SELECT session, img, by_ // 2 AS wy, bx // 2 AS wx, {q('m', .75)} / {q('m', .25)} AS sep FROM m GROUP BY ALL),
s AS (SELECT session, img, avg((sep >= 1.3)::INT) AS measurable_share FROM v GROUP BY ALL)
SELECT session, img, sep, measurable_share, sep >= 1.3 AS measurable, CASE WHEN measurable_share >= 0.8 THEN 'strong' WHEN measurable_share >= 0.5 THEN 'usable' ELSE 'weak' END AS grade
FROM w JOIN s USING (session, img)""")
def _(s, d):
    return I.screen_corpus(V.rgb(s, d))


@query("d25_black_corners", "i:session,checked d:worst b:failed", """
WITH n AS (SELECT session, count(*) AS n FROM frank GROUP BY session),
p AS (SELECT f.session, f.frame FROM frank f JOIN n USING (session) WHERE rk % greatest(n // 8, 1) = 0 OR rk = n - 1),
s AS (SELECT session, frame, avg((v <= -0.2)::INT) AS s FROM px JOIN p USING (session, frame) GROUP BY ALL)
SELECT session, count(*) AS checked, max(s) AS worst, max(s) > 0.1 AS failed FROM s GROUP BY session""")
def _(s, d):
    return I.black_corners(V.ranked_tiles(s, d), floor=-0.2)


@query("d35_sky_noise", "i:frame s:reg d:sky,sg,rel_noise", f"""
WITH r AS (SELECT frame, y, x, v, {CORNER} AS reg FROM px), m AS (SELECT frame, reg, median(v) AS sky FROM r WHERE reg <> 'centre' GROUP BY ALL),
g AS (SELECT frame, reg, any_value(sky) AS sky, 1.4826 * median(abs(v - sky)) AS sg FROM r JOIN m USING (frame, reg) GROUP BY ALL)
SELECT *, sg / nullif(abs(sky), 0) AS rel_noise FROM g QUALIFY row_number() OVER (PARTITION BY frame ORDER BY sky, reg) = 1""")
def _(s, d):
    return FS.sky_noise(V.tiles(s, d), ["frame"], SIDE)


@query("d36_tone_match", "i:parent,candidate,y,x d:mapped", f"""
WITH k AS (SELECT i, p FROM (VALUES {', '.join(f'({i}, {p})' for i, p in enumerate(I.KNOTS))}) t(i, p)),
s AS (SELECT parent, candidate, unnest(quantile_cont(pv, [{', '.join(map(str, I.KNOTS))}])) AS sx, unnest(quantile_cont(cv, [{', '.join(map(str, I.KNOTS))}])) AS sy, generate_subscripts(quantile_cont(pv, [{', '.join(map(str, I.KNOTS))}]), 1) - 1 AS i FROM px2 GROUP BY parent, candidate),
t AS (SELECT *, lead(sx) OVER w AS ex, lead(sy) OVER w AS ey FROM s WINDOW w AS (PARTITION BY parent, candidate ORDER BY i)),
j AS (SELECT p.parent, p.candidate, p.y, p.x, pv, sx, sy, ex, ey FROM px2 p JOIN t ON p.parent = t.parent AND p.candidate = t.candidate AND ex IS NOT NULL
 AND (pv >= sx OR i = 0) AND (pv < ex OR i = 7))
SELECT parent, candidate, y, x, 0.3 * pv + 0.7 * (sy + (ey - sy) * least(greatest((pv - sx) / (ex - sx), 0), 1)) AS mapped FROM j""")
def _(s, d):
    return I.tone_match(V.px2(s, d), ["parent", "candidate"])


@query("d37_match_gains", "i:session,img d:signal_ratio,gain_r,gain_g,gain_b", f"""
WITH l AS (SELECT *, {LUM} AS l, {CLUM} AS cl FROM rgb2), c AS (SELECT session, img, {q('l', .6)} AS k, {q('cl', .6)} AS ck FROM l GROUP BY ALL),
g AS (SELECT session, img, {', '.join(f"greatest(median({c}) FILTER (WHERE l <= k), 1e-6) AS s_{c}, greatest(median(c{c}) FILTER (WHERE cl <= ck), 1e-6) AS t_{c}" for c in 'rgb')},
 {q('cl', .99)} / {q('l', .99)} AS signal_ratio FROM l JOIN c USING (session, img) GROUP BY ALL),
h AS (SELECT *, cbrt(t_r / s_r * (t_g / s_g) * (t_b / s_b)) AS gm FROM g)
SELECT session, img, signal_ratio, {', '.join(f"least(greatest(t_{c} / s_{c} / gm, 0.5), 2) AS gain_{c}" for c in 'rgb')} FROM h""")
def _(s, d):
    return FS.match_gains(V.rgb2_planes(s, d), K)


# the sketched percentiles may be any value whose rank is near enough: stated as three truths next to the exact columns
@query("d38_approx_stats", "i:session,n d:mean,sd b:p10_near,p50_near,p90_near", """
SELECT session, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd, true AS p10_near, true AS p50_near, true AS p90_near FROM px GROUP BY session""")
def _(s, d):
    st = I.cut(I.approx_stats(px(s, d), ["session"], 10000))
    near = []
    for name, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)):
        slack = F.max("n") / 10000 + 1
        near.append(((F.count_if(F.col("v") < F.col(name)) <= p * F.max("n") + slack) & (F.count_if(F.col("v") <= F.col(name)) >= p * F.max("n") - slack)).alias(f"{name}_near"))
    return I.attach(px(s, d), st, ["session"]).groupBy("session").agg(*[F.max(c).alias(c) for c in ("n", "mean", "sd")], *near)


@query("d39_texture_stats", "i:frame d:grad_kurtosis,halo_ratio,highlight_index,texture_snr b:structured", f"""
WITH g AS (SELECT frame, y, x, v, sqrt(pow(coalesce(v - lag(v) OVER (PARTITION BY frame, y ORDER BY x), 0), 2) + pow(coalesce(v - lag(v) OVER (PARTITION BY frame, x ORDER BY y), 0), 2)) AS gr,
 avg(v) OVER (PARTITION BY frame, y // 4, x // 4) AS base FROM px),
q AS (SELECT frame, {q('gr', .998)} AS g998, {q('gr', .8)} AS g80, {q('v', .9995)} AS top, {q('v', .55)} AS v55, {q('v', .2)} AS v20 FROM g GROUP BY frame),
j AS (SELECT g.*, q.g998, q.g80, q.top, q.v55, q.v20, abs(v - base) AS hp, gr <= g998 AND v >= 0.08 * top AND v <= 0.95 * top AS u FROM g JOIN q USING (frame)),
m AS (SELECT frame, avg(gr) FILTER (WHERE u) AS mg FROM j GROUP BY frame),
o AS (SELECT frame, avg(pow(gr - mg, 4)) FILTER (WHERE u) / nullif(pow(avg(pow(gr - mg, 2)) FILTER (WHERE u), 2), 0) AS grad_kurtosis,
 sum(greatest(base - v, 0)) FILTER (WHERE gr >= g80) / nullif(sum(abs(base)) FILTER (WHERE gr >= g80), 0) AS halo_ratio, avg((v >= 0.98 * top)::INT) AS highlight_index,
 avg(hp) FILTER (WHERE v > v55) / nullif(avg(hp) FILTER (WHERE v < v20), 0) AS texture_snr FROM j JOIN m USING (frame) GROUP BY frame)
SELECT *, coalesce(texture_snr >= 1.7, false) AS structured FROM o""")
def _(s, d):
    return I.texture_stats(px(s, d), ["frame"])


@query("d40_range_health", "i:parent,candidate d:span_before,span_after,p999,core_ratio b:collapsed", f"""
SELECT parent, candidate, {q('pv', .99)} - {q('pv', .5)} AS span_before, {q('cv', .99)} - {q('cv', .5)} AS span_after, {q('cv', .999)} AS p999, p999 / nullif(max(cv), 0) AS core_ratio,
 span_after < greatest(0.02, 0.25 * span_before) AS collapsed FROM px2 GROUP BY parent, candidate""")
def _(s, d):
    return I.range_health(V.px2(s, d), ["parent", "candidate"])


@query("d41_starless_stats", "i:frame d:noise,corner_ratio", f"""
WITH c AS (SELECT frame, {q('v', .35)} AS c FROM px GROUP BY frame), dk AS (SELECT frame, v FROM px JOIN c USING (frame) WHERE v <= c),
m AS (SELECT frame, median(v) AS m FROM dk GROUP BY frame), n AS (SELECT frame, 1.4826 * median(abs(v - m)) AS noise FROM dk JOIN m USING (frame) GROUP BY frame),
r AS (SELECT frame, reg, avg(v) AS a FROM (SELECT frame, v, {CORNER} AS reg FROM px) WHERE reg <> 'centre' GROUP BY frame, reg)
SELECT frame, noise, max(a) / nullif(min(a), 0) AS corner_ratio FROM n JOIN r USING (frame) GROUP BY frame, noise""")
def _(s, d):
    return I.starless_stats(px(s, d), ["frame"], SIDE)


@query("d42_region_goals", "i:session,img s:region d:mask_share,before_r,before_g,before_b,after_r,after_g,after_b", f"""
WITH {REG}, g AS (SELECT session, img, region, {', '.join(f"median({c}) AS {c}" for c in ('r', 'g', 'b', 'cr', 'cg', 'cb'))}, avg(({LUM} > 0.5)::INT) AS mask_share FROM (SELECT * FROM rgb2 JOIN reg ON {IN}) GROUP BY session, img, region)
SELECT session, img, region, mask_share, {', '.join(f"{c} / (r + g + b) AS before_{c}, c{c} / (cr + cg + cb) AS after_{c}" for c in 'rgb')} FROM g""")
def _(s, d):
    return I.region_goals(V.rgb2(s, d), I.regions(s), K)


@query("d46_detail_energy", "i:frame,scale s:region d:energy,floor,over_floor", f"""
WITH {REG}, e AS (SELECT frame, y, x, sc AS scale, abs(v - avg(v) OVER (PARTITION BY frame, sc, y // sc, x // sc)) AS e FROM px, (VALUES (2), (4)) t(sc)),
a AS (SELECT frame, region, scale, avg(e) AS energy FROM e JOIN reg ON {IN} GROUP BY ALL)
SELECT a.*, b.energy AS floor, a.energy / nullif(b.energy, 0) AS over_floor FROM a LEFT JOIN a b ON a.frame = b.frame AND a.scale = b.scale AND b.region = 'bg'""")
def _(s, d):
    return I.detail_energy(px(s, d), I.regions(s), ["frame"])
