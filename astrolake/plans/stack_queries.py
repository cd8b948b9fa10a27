"""Pixel-stack queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolake import views as V
from astrolake.functions.scan import ranked
from astrolake.operators import stack as S
from astrolake.plans.registry import query

# Frame level bindings: exposure and FWHM follow from the frame id.
SQL_BASE = """
fr AS (SELECT label AS session, vec_id AS frame, 60.0::DOUBLE + 30 * (vec_id % 3) AS exposure,
              2.0::DOUBLE + (vec_id % 11) / 10.0::DOUBLE AS fwhm FROM embeddings),
e1 AS (SELECT session, frame, y * 8 + x AS pos, v * (60.0::DOUBLE / exposure) AS v, fwhm FROM px JOIN fr USING (session, frame)),
lv AS (SELECT session, frame, median(v) AS sky FROM e1 GROUP BY ALL),
md AS (SELECT session, median(sky) AS mid FROM lv GROUP BY ALL),
an AS (SELECT session, arg_min(sky, (round(abs(sky - mid), 9), frame)) AS b0 FROM lv JOIN md USING (session) GROUP BY ALL),
e2 AS (SELECT session, frame, pos, v - (sky - b0) AS v, fwhm, sky, b0 FROM e1 JOIN lv USING (session, frame) JOIN an USING (session)),
sg AS (SELECT session, frame, any_value(fwhm) AS fwhm, any_value(b0) AS b0, 1.4826 * median(abs(v - m)) AS sigma
       FROM e2 JOIN (SELECT session, frame, median(v) AS m FROM e2 GROUP BY ALL) USING (session, frame) GROUP BY ALL),
wt AS (SELECT session, frame, sigma, b0, fwhm, (median(fwhm) OVER (PARTITION BY session)) / fwhm AS clarity,
              (median(sigma) OVER (PARTITION BY session)) / sigma AS snr FROM sg)
"""
SQL_REF = """,
sharp AS (SELECT session, frame FROM fr QUALIFY row_number() OVER (PARTITION BY session ORDER BY fwhm, frame) <= 8),
rf AS (SELECT session, pos, median(v) AS ref FROM e2 JOIN sharp USING (session, frame) GROUP BY ALL)
"""
SQL_DETAIL = """,
rs AS (SELECT session, mu, median(abs(ref - mu)) AS mad FROM rf JOIN (SELECT session, median(ref) AS mu FROM rf GROUP BY ALL) USING (session) GROUP BY ALL),
dd AS (SELECT session, pos, pos // 8 AS y, pos % 8 AS x, greatest(ref - mu, 0) AS d, mad FROM rf JOIN rs USING (session)),
dt AS (SELECT a.session, a.pos, least(greatest(any_value(a.d) / (max(b.d) + 8 * 1.4826 * any_value(a.mad)), 0), 1) AS detail
       FROM dd a JOIN dd b ON a.session = b.session AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL)
"""
SQL_REJECT = """,
pa AS (SELECT session, pos, median(v) AS a FROM e2 GROUP BY ALL),
pd AS (SELECT session, pos, any_value(a) AS a, median(abs(v - a)) AS dev FROM e2 JOIN pa USING (session, pos) GROUP BY ALL),
al AS (SELECT session, frame, pos, v, b0, a, dev, detail FROM e2 JOIN pd USING (session, pos) JOIN dt USING (session, pos)),
p9 AS (SELECT session, frame, quantile_cont(abs(v - a) / (a - b0), 0.99) AS p99 FROM al WHERE detail > 0.5 AND a > b0 GROUP BY ALL),
mm AS (SELECT session, median(p99) AS m FROM p9 GROUP BY ALL),
f0 AS (SELECT al.*, coalesce(m, 0) AS m, abs(v - a) > 3.5 * 1.4826 * dev + coalesce(m, 0) * detail * greatest(a - b0, 0) AS f
       FROM al LEFT JOIN mm USING (session)),
fc AS (SELECT session, pos, (count(*) FILTER (WHERE f)) - count(*) * 0.00046525815807105017 <= count(*) / 3.0::DOUBLE AS act FROM f0 GROUP BY ALL),
fl AS (SELECT session, frame, pos, v, detail, f AND act AS flag FROM f0 JOIN fc USING (session, pos))
"""
SQL_STACK = """,
ww AS (SELECT session, frame, pos, v, flag, CASE WHEN flag THEN 0 ELSE pow(clarity, 20 * detail) * pow(snr, 2 * (1 - detail)) END AS w
       FROM fl JOIN wt USING (session, frame)),
st AS (SELECT session, pos // 8 AS y, pos % 8 AS x, sum(w * v) / sum(w) AS value, pow(sum(w), 2) / sum(w * w) AS neff,
              count(*) AS n, count(*) FILTER (WHERE flag) AS rejected FROM ww GROUP BY session, pos)
"""


def frames_with_exposure(spark, d):
    return (
        V.tiles(spark, d)
        .withColumn("exposure", F.lit(60.0) + 30 * (F.col("frame") % 3))
        .withColumn("fwhm", F.lit(2.0) + (F.col("frame") % 11) / 10)
    )


def _weights(spark, d):
    return S.frame_weights(S.align_sky(S.norm_exposure(frames_with_exposure(spark, d))))


@query("e01_norm_exposure", "i:session,frame,pos d:v",
       "SELECT session, frame, y * 8 + x AS pos, v * (60.0::DOUBLE / (60 + 30 * (frame % 3))) AS v FROM px")
def _(spark, d):
    return S.explode_tile(S.norm_exposure(frames_with_exposure(spark, d)), "session", "frame")


@query("e02_align_sky", "i:session,frame,pos d:v,sky,b0", f"WITH {SQL_BASE} SELECT * FROM e2")
def _(spark, d):
    t = S.align_sky(S.norm_exposure(frames_with_exposure(spark, d)))
    return S.explode_tile(t, "session", "frame", "sky", "b0")


@query("e03_frame_weights", "i:session,frame d:sigma,clarity,snr", f"WITH {SQL_BASE} SELECT * FROM wt")
def _(spark, d):
    return _weights(spark, d)


@query("e04_reference_image", "i:session,pos d:ref", f"WITH {SQL_BASE}{SQL_REF} SELECT * FROM rf")
def _(spark, d):
    return S.reference_image(_weights(spark, d))


@query("e05_detail_field", "i:session,pos d:detail", f"WITH {SQL_BASE}{SQL_REF}{SQL_DETAIL} SELECT * FROM dt")
def _(spark, d):
    return S.detail_field(S.reference_image(_weights(spark, d)))


@query("e06_reject", "i:session,frame,pos b:flag", f"WITH {SQL_BASE}{SQL_REF}{SQL_DETAIL}{SQL_REJECT} SELECT * FROM fl")
def _(spark, d):
    w = _weights(spark, d)
    f = S.reject(w, S.detail_field(S.reference_image(w)))
    return f.select("session", "frame", F.posexplode("flag").alias("pos", "flag"))


@query("e07_weighted_stack", "i:session,y,x,n,rejected d:value",
       f"WITH {SQL_BASE}{SQL_REF}{SQL_DETAIL}{SQL_REJECT}{SQL_STACK} SELECT * FROM st")
def _(spark, d):
    return S.weighted_stack(frames_with_exposure(spark, d))


@query("e08_effective_frames", "i:session,y,x d:neff,nu",
       f"""WITH {SQL_BASE}{SQL_REF}{SQL_DETAIL}{SQL_REJECT}{SQL_STACK}
       SELECT session, y, x, neff, sqrt(n / neff) / (median(sqrt(n / neff)) OVER (PARTITION BY session)) AS nu FROM st""")
def _(spark, d):
    return S.noise_step(S.weighted_stack(frames_with_exposure(spark, d)))


@query("e09_plain_stacks", "i:session,y,x,n_high,n_low d:mean,median,winsor,weighted", """
WITH fr AS (SELECT session, frame, 2.0::DOUBLE + (frame % 11) / 10.0::DOUBLE AS fwhm, median(v) AS loc FROM px GROUP BY ALL),
s AS (SELECT session, frame, nullif(1.4826 * median(abs(v - loc)), 0) AS scl FROM px JOIN fr USING (session, frame) GROUP BY ALL),
r AS (SELECT session, median(loc) AS loc0, median(scl) AS scl0 FROM fr JOIN s USING (session, frame) GROUP BY ALL),
z AS (SELECT session, frame, y, x, fwhm, (v - loc) * coalesce(scl0 / scl, 1) + loc0 AS raw
      FROM px JOIN fr USING (session, frame) JOIN s USING (session, frame) JOIN r USING (session)),
c1 AS (SELECT *, least(greatest(raw, (avg(raw) OVER p) - 4 * (stddev_pop(raw) OVER p)), (avg(raw) OVER p) + 3 * (stddev_pop(raw) OVER p)) AS v1
       FROM z WINDOW p AS (PARTITION BY session, y, x)),
c2 AS (SELECT *, least(greatest(v1, (avg(v1) OVER p) - 4 * (stddev_pop(v1) OVER p)), (avg(v1) OVER p) + 3 * (stddev_pop(v1) OVER p)) AS v
       FROM c1 WINDOW p AS (PARTITION BY session, y, x))
SELECT session, y, x, avg(raw) AS mean, median(raw) AS median, avg(v) AS winsor, sum(v / (fwhm * fwhm)) / sum(1 / (fwhm * fwhm)) AS weighted,
       count(*) FILTER (WHERE raw > v) AS n_high, count(*) FILTER (WHERE raw < v) AS n_low
FROM c2 GROUP BY session, y, x""")
def _(spark, d):
    return S.stack(frames_with_exposure(spark, d))


@query("e10_common_coverage", "i:session,y,lft,rgt,width,layers d:loss_pct", """
WITH e AS (SELECT session, frame, y, min(x) FILTER (WHERE v > 0) AS l, max(x) FILTER (WHERE v > 0) AS r FROM px GROUP BY ALL),
g AS (SELECT session, y, max(l) AS lft, min(r) AS rgt, max(r - l + 1) AS widest, count(*) AS layers FROM e GROUP BY ALL)
SELECT session, y, lft, rgt, greatest(rgt - lft + 1, 0) AS width, layers,
       100.0::DOUBLE * (widest - greatest(rgt - lft + 1, 0)) / widest AS loss_pct FROM g""")
def _(spark, d):
    return S.common_coverage(S.edge_coverage(V.px(spark, d), ["session", "frame"]), ["session"])


@query("e11_trim_borders", "i:frame,trim_start,trim_end s:axis", """
WITH c AS (SELECT frame, median(v) AS mid FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY ALL),
s AS (SELECT frame, any_value(mid) AS mid, 1.4826 * median(abs(v - mid)) AS sd FROM px JOIN c USING (frame)
      WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY ALL),
l AS (SELECT frame, 'row' AS axis, y AS i, median(v) AS lm FROM px GROUP BY ALL
      UNION ALL SELECT frame, 'col', x, median(v) FROM px GROUP BY ALL),
b AS (SELECT frame, axis, i, abs(lm - mid) > 2.5 * sd OR lm < 0.70 * mid AS bad FROM l JOIN s USING (frame))
SELECT frame, axis, least(coalesce(min(i) FILTER (WHERE NOT bad), 8), 1) AS trim_start,
       least(7 - coalesce(max(i) FILTER (WHERE NOT bad), -1), 1) AS trim_end FROM b GROUP BY ALL""")
def _(spark, d):
    return S.trim_borders(V.px(spark, d), ["frame"], V.SIDE)


@query("e12_stack_report", "i:declared,kept s:session b:membership_ok d:fwhm_before,fwhm_after,gain_pct", """
WITH k AS (SELECT session, fwhm, row_number() OVER (PARTITION BY session ORDER BY wfwhm, frame) AS rk, count(*) OVER (PARTITION BY session) AS n FROM frames)
SELECT session, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS declared, count(*) FILTER (WHERE rk <= n * 0.7::DOUBLE) AS kept,
       kept = declared AS membership_ok, avg(fwhm) AS fwhm_before, avg(fwhm) FILTER (WHERE rk <= n * 0.7::DOUBLE) AS fwhm_after,
       (fwhm_before - fwhm_after) / fwhm_before * 100 AS gain_pct FROM k GROUP BY session, n""")
def _(spark, d):
    f = ranked(V.frame_catalogue(spark, d), ["session"], "wfwhm", "frame", total="n")
    declared = f.groupBy("session").agg(
        F.floor(F.count(F.lit(1)) * 0.7).alias("declared"), F.avg("fwhm").alias("fwhm_before"))
    return S.stack_report(f.where(F.col("rk") <= F.col("n") * 0.7), declared)
