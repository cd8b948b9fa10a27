"""Tone, palette, mask, layer and array-function queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from astrolake import views as V
from astrolake.functions import tiles as A
from astrolake.functions import tone as N
from astrolake.operators import images as I
from astrolake.operators import pixels as P
from astrolake.plans.image_queries import CLUM, IN, LUM, REG, q
from astrolake.plans.registry import query

K = ["session", "img"]


def c01(e: str) -> str:
    return f"least(greatest({e}, 0), 1)"


def sm(lo: float, hi: float, e: str) -> str:
    t = c01(f"(({e}) - ({lo})) / ({hi - lo}::DOUBLE)")
    return f"(pow({t}, 2) * (3 - 2 * {t}))"


def mtf(x: str, m: str) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 0 WHEN {x} >= 1 THEN 1 ELSE ({m} - 1) * {x} / ((2 * {m} - 1) * {x} - {m}) END)"


@query("a13_read_pixels", "i:session,frame,pos d:v", "SELECT session, frame, y * 8 + x AS pos, (v * 2 + 1 - 0.2) / 1.8 AS v FROM px")
def _(s, d):
    return P.read_pixels(V.tiles(s, d), 2.0, 1.0, 0.2, 2.0)


def half(s, d):
    return V.px(s, d).withColumn("v", F.col("v") + 0.5)


def ghs_sql(x: str) -> str:
    d, b, sp, lp, hp = math.expm1(2.0), 4.0, 0.3, 0.05, 0.9
    base = lambda t: -math.expm1(-math.log1p(b * d * t) / b)
    slope = lambda t: d * math.exp(-(1 + b) / b * math.log1p(b * d * t))
    ql, qh, sl, sh = -base(sp - lp), base(hp - sp), slope(sp - lp), slope(hp - sp)
    q0, q1 = ql - sl * lp, qh + sh * (1 - hp)
    y = f"CASE WHEN {x} < {lp} THEN {ql}::DOUBLE + {sl}::DOUBLE * ({x} - {lp}) WHEN {x} > {hp} THEN {qh}::DOUBLE + {sh}::DOUBLE * ({x} - {hp}) ELSE sign({x} - {sp}) * (1 - exp(-ln(1 + {b * d}::DOUBLE * abs({x} - {sp})) / {b})) END"
    return c01(f"({y} - ({q0}::DOUBLE)) / ({q1 - q0}::DOUBLE)")


@query("b13_tone_curves", "i:frame,y,x d:mtf,back,asinh,linear,ghs", f"""WITH z AS (SELECT frame, y, x, v + 0.5 AS v FROM px), p AS (SELECT frame, {q('v', .01)} AS a, {q('v', .99)} AS b FROM z GROUP BY frame)
SELECT frame, y, x, {mtf('v', '0.2::DOUBLE')} AS mtf, {c01('v')} AS back, asinh(20 * v) / {math.asinh(20.0)}::DOUBLE AS asinh, {c01('(v - a) / (b - a)')} AS linear, {ghs_sql(c01('v'))} AS ghs FROM z JOIN p USING (frame)""")
def _(s, d):
    return P.tone_curves(half(s, d), ["frame"])


@query("b14_mtf_params", "i:frame d:black,midpoint", """WITH z AS (SELECT frame, v + 0.5 AS v FROM px), m AS (SELECT frame, median(v) AS med FROM z GROUP BY frame), g AS (SELECT frame, any_value(med) AS med, 1.4826 * median(abs(v - med)) AS sg FROM z JOIN m USING (frame) GROUP BY frame),
b AS (SELECT frame, greatest(med - 2.8 * sg, 0) AS black, med FROM g), x AS (SELECT *, (med - black) / (1 - black) AS x FROM b) SELECT frame, black, x * (0.25 - 1) / (2 * 0.25 * x - 0.25 - x) AS midpoint FROM x""")
def _(s, d):
    return P.mtf_params(half(s, d), ["frame"])


@query("b15_mtf_amplification", "i:session,img s:region,channel d:slope,span_gain", f"""WITH {REG}, g AS (SELECT session, img, region, channel, median(v) AS m, {q('v', .1)} AS lo, {q('v', .9)} AS hi FROM rgb_long JOIN reg ON {IN} GROUP BY ALL)
SELECT session, img, region, channel, 0.2 * 0.8 / pow(-0.6 * m - 0.2, 2) AS slope, ({mtf('hi', '0.2::DOUBLE')} - {mtf('lo', '0.2::DOUBLE')}) / (hi - lo) AS span_gain FROM g""")
def _(s, d):
    return P.mtf_amplification(V.rgb_long(s, d), I.regions(s), K, 0.2)


@query("b16_palette", "i:session,img,y,x d:r,g,b", f"""WITH z AS (SELECT session, img, y, x, {c01('r')} AS h, {c01('(g + b) * 0.5')} AS o, 0.2126::DOUBLE * {c01('r')} + 0.7152::DOUBLE * {c01('g')} + 0.0722::DOUBLE * {c01('b')} AS l FROM rgb), w AS (SELECT *, (h + o) * 0.5 AS s FROM z),
m AS (SELECT *, 0.2126::DOUBLE * s + 0.7152::DOUBLE * h + 0.0722::DOUBLE * o AS ml FROM w) SELECT session, img, y, x, CASE WHEN l < 0.35 THEN l ELSE {c01('s * l / ml')} END AS r, CASE WHEN l < 0.35 THEN l ELSE {c01('h * l / ml')} END AS g, CASE WHEN l < 0.35 THEN l ELSE {c01('o * l / ml')} END AS b FROM m""")
def _(s, d):
    return P.palette(V.rgb(s, d), "SHO")


@query("b17_color_adjust", "i:session,img,y,x d:r,g,b", f"""WITH z AS (SELECT session, img, y, x, r, least(g, (r + b) / 2) AS g, b FROM rgb), w AS (SELECT *, {LUM} AS l FROM z)
SELECT session, img, y, x, {c01(c01('l + 1.3 * (r - l)') + ' * 1.1')} AS r, {c01('l + 1.3 * (g - l)')} AS g, {c01(c01('l + 1.3 * (b - l)') + ' * 0.9')} AS b FROM w""")
def _(s, d):
    return P.apply_gains(P.saturate(P.scnr(V.rgb(s, d)), 1.3), {"r": 1.1, "b": 0.9})


HSV = """hs AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS c FROM rgb), hv AS (SELECT *, CASE WHEN c <= 0 THEN 0 WHEN mx = r THEN (g - b) / c - 6 * floor((g - b) / c / 6) WHEN mx = g THEN (b - r) / c + 2 ELSE (r - g) / c + 4 END / 6 AS h, CASE WHEN mx > 0 THEN c / mx ELSE 0 END AS s, mx AS v FROM hs)"""


@query("b18_masks", "i:session,img,y,x d:range_m,hue_m,blended", f"""WITH {HSV}, m AS (SELECT *, {LUM} AS l FROM hv), k AS (SELECT *, {sm(0.37, 0.43, c01('l'))} * (1 - {sm(0.67, 0.73, c01('l'))}) AS range_m, greatest({sm(0.85, 0.95, 'h')} * (1 - {sm(0.95, 1.05, 'h')}), {sm(-0.05, 0.05, 'h')} * (1 - {sm(0.05, 0.15, 'h')})) AS hue_m FROM m)
SELECT session, img, y, x, range_m, hue_m, l * (1 - range_m) + sqrt({c01('l')}) * range_m AS blended FROM k""")
def _(s, d):
    r = I.with_luminance(V.rgb(s, d))
    h, _, _ = N.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    r = r.withColumn("range_m", P.range_mask(F.col("l"), 0.4, 0.7, 0.03)).withColumn("hue_m", P.hue_mask(h, 0.9, 0.1, 0.05))
    return r.withColumn("blended", P.masked(F.col("l"), F.sqrt(N.clip01(F.col("l"))), F.col("range_m")))


@query("b19_combine_layers", "i:parent,candidate,y,x d:sum,residual,closure", "SELECT parent, candidate, y, x, pv + cv AS sum, pv - cv AS residual, 0.0 AS closure FROM px2")
def _(s, d):
    return P.combine_layers(V.px2(s, d))


@query("b23_chroma_blend", "i:session,img,y,x d:weight,r,g,b", f"""WITH d AS (SELECT session, img, y, x, r, g, b, cr - r - ({CLUM} - ({LUM})) AS dr, cg - g - ({CLUM} - ({LUM})) AS dg, cb - b - ({CLUM} - ({LUM})) AS db FROM rgb2),
w AS (SELECT *, CASE WHEN least(r, g, b) > 1e-3 AND greatest(r, g, b) < 1 - 1e-3 THEN greatest(0, least(0.6, {', '.join(f"CASE WHEN d{c} > 0 THEN 1 - 1e-3 - {c} ELSE {c} - 1e-3 END / greatest(abs(d{c}), 1e-12)" for c in 'rgb')})) ELSE 0 END AS weight FROM d)
SELECT session, img, y, x, weight, r + weight * dr AS r, g + weight * dg AS g, b + weight * db AS b FROM w""")
def _(s, d):
    return P.chroma_blend(V.rgb2(s, d))


@query("b24_mix", "i:session,img,y,x d:r,g,b", f"""WITH m AS (SELECT *, {sm(0.3, 0.7, LUM)} AS m FROM rgb2), z AS (SELECT session, img, y, x, r * m + cr * (1 - m) AS h, g * m + cg * (1 - m) AS o FROM m) SELECT session, img, y, x, h AS r, 0.8 * o + 0.2 * h AS g, o AS b FROM z""")
def _(s, d):
    return P.mix(V.rgb2(s, d), N.smoothstep(0.3, 0.7, I.lum()))


LIN = {c: f"CASE WHEN {c} > 0.04045 THEN pow(({c} + 0.055) / 1.055, 2.4) ELSE {c} / 12.92 END" for c in "rgb"}


def _f(i: int) -> str:
    t = f"(({N.XYZ[i][0]}::DOUBLE * lr + {N.XYZ[i][1]}::DOUBLE * lg + {N.XYZ[i][2]}::DOUBLE * lb) / {N.WHITE[i]}::DOUBLE)"
    return f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787::DOUBLE * {t} + {16 / 116}::DOUBLE END"


@query("i15_color_spaces", "i:session,img,y,x d:h,s,v,back_r,back_g,back_b,ll,la,lbb", f"""WITH {HSV}, l AS (SELECT *, {LIN['r']} AS lr, {LIN['g']} AS lg, {LIN['b']} AS lb FROM hv), f AS (SELECT *, {_f(0)} AS f0, {_f(1)} AS f1, {_f(2)} AS f2 FROM l)
SELECT session, img, y, x, h, s, v, r AS back_r, g AS back_g, b AS back_b, 116 * f1 - 16 AS ll, 500 * (f0 - f1) AS la, 200 * (f1 - f2) AS lbb FROM f""")
def _(s, d):
    r = V.rgb(s, d)
    h, sat, v = N.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    z = r.withColumn("h", h).withColumn("s", sat).withColumn("v", v)
    back = N.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v"))
    lab = N.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return z.select(*K, "y", "x", "h", "s", "v", *[c.alias(f"back_{n}") for c, n in zip(back, "rgb")], *[c.alias(n) for c, n in zip(lab, ("ll", "la", "lbb"))])


@query("i16_anscombe", "i:frame,y,x d:t,back", "SELECT frame, y, x, 2 * sqrt(greatest(v * 100 + 0.375, 0)) AS t, greatest(greatest(v * 100 + 0.375, 0) - 0.375, 0) AS back FROM px")
def _(s, d):
    v = F.col("v") * 100
    return V.px(s, d).select("frame", "y", "x", N.anscombe(v).alias("t"), N.inverse_anscombe(N.anscombe(v)).alias("back"))


@query("i13_robust_helpers", "i:frame d:med,sigma,p10,p90", f"""WITH m AS (SELECT frame, median(v) AS med, {q('v', .1)} AS p10, {q('v', .9)} AS p90 FROM px GROUP BY frame) SELECT frame, any_value(med) AS med, 1.4826 * median(abs(v - med)) AS sigma, any_value(p10) AS p10, any_value(p90) AS p90 FROM px JOIN m USING (frame) GROUP BY frame""")
def _(s, d):
    t = A.doubles(F.col("tile"))
    return V.tiles(s, d).select("frame", A.median_of(t).alias("med"), A.sigma_of(t).alias("sigma"), A.quantile_of(t, 0.1).alias("p10"), A.quantile_of(t, 0.9).alias("p90"))


@query("i19_array_functions", "i:frame,n_high s:flags d:roi_median,top,dot", f"""WITH a AS (SELECT frame, median(v) FILTER (WHERE y = 0) AS roi_median, max(v) AS top, count(*) FILTER (WHERE v > 0.15) AS n_high, min(v) AS lo FROM px GROUP BY frame),
t AS (SELECT a.frame, sum(a.v * b.v) AS dot FROM px a JOIN px b ON a.frame = b.frame AND a.y = 0 AND b.y = 7 AND a.x = b.x GROUP BY a.frame)
SELECT a.frame, roi_median, top, n_high, dot, concat_ws(',', CASE WHEN top > 0.3 THEN 'bright' END, CASE WHEN lo < -0.3 THEN 'dark' END) AS flags FROM a JOIN t USING (frame)""")
def _(s, d):
    t = A.doubles(F.col("tile"))
    z = V.tiles(s, d).select("frame", t.alias("t"))
    dot = F.aggregate(F.zip_with(F.slice("t", 1, 8), F.slice("t", 57, 8), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return z.select("frame", A.median_of(F.slice("t", 1, 8)).alias("roi_median"), F.array_max("t").alias("top"), F.size(F.filter("t", lambda v: v > 0.15)).alias("n_high"), dot.alias("dot"),
                    F.concat_ws(",", F.when(F.array_max("t") > 0.3, "bright"), F.when(F.array_min("t") < -0.3, "dark")).alias("flags"))


@query("i20_map_functions", "i:id s:deltas d:total", """SELECT id, concat('gain=', CAST(round(gain * 2) AS BIGINT), ',temp=', CAST(round(temp * 2) AS BIGINT)) AS deltas, gain * 2 + temp * 2 AS total FROM light""")
def _(s, d):
    m = F.map_from_entries(F.array(F.struct(F.lit("gain").alias("k"), F.col("gain").cast("double").alias("v")), F.struct(F.lit("temp").alias("k"), F.col("temp").alias("v"))))
    z = V.light(s, d).select("id", F.transform_values(m, lambda k, v: v * 2).alias("m"))
    txt = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"]).cast("long").cast("string"))), ",")
    return z.select("id", txt.alias("deltas"), F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("i21_smoothstep", "i:frame,y,x d:s,c,p", f"SELECT frame, y, x, {sm(-0.2, 0.2, 'v')} AS s, {c01('v')} AS c, v * 255 / 1.7::DOUBLE AS p FROM px")
def _(s, d):
    v = F.col("v")
    return V.px(s, d).select("frame", "y", "x", N.smoothstep(-0.2, 0.2, v).alias("s"), N.clip01(v).alias("c"), (v * 255 / 1.7).alias("p"))
