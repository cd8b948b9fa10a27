"""Selection and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolake import views as V
from astrolake.operators import select as Q
from astrolake.plans.registry import query

S = ["session"]
SHARP = """sf AS (SELECT *, 1000 / wfwhm AS sharpness FROM frames),
rk AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY sharpness DESC, frame) AS rk, count(*) OVER (PARTITION BY session) AS n,
 max(sharpness) OVER (PARTITION BY session) AS hi, min(sharpness) OVER (PARTITION BY session) AS lo FROM sf),
fl AS (SELECT *, least(n, greatest(3, round_even(n * 0.1::DOUBLE, 0))) AS mink FROM rk)"""


def sharp(s, d):
    return V.frame_catalogue(s, d).withColumn("sharpness", 1000 / F.col("wfwhm"))


@query("f01_select_percent", "s:session i:frame,rk d:sharpness", f"""WITH {SHARP}
SELECT * FROM rk WHERE rk <= greatest(1, round_even(n * (CASE WHEN n <= 60 THEN 70 WHEN n <= 300 THEN 50 ELSE 30 END)::DOUBLE / 100, 0))""")
def _(s, d):
    return Q.select_percent(sharp(s, d), S)


@query("f02_select_relative", "s:session i:frame,rk", f"WITH {SHARP} SELECT * FROM fl WHERE sharpness >= 0.75 * hi OR rk <= mink")
def _(s, d):
    return Q.select_relative(sharp(s, d), S)


OTSU = f"""{SHARP}, h AS (SELECT session, lo, hi, n, least(CAST(floor((sharpness - lo) / (hi - lo) * 256) AS BIGINT), 255) AS bin, count(*) AS c FROM rk WHERE hi > lo GROUP BY ALL),
hc AS (SELECT *, lo + (bin + 0.5::DOUBLE) * (hi - lo) / 256 AS ctr FROM h),
cu AS (SELECT session, bin, ctr, sum(c) OVER l AS w1, sum(c) OVER r AS w2, sum(c * ctr) OVER l AS m1, sum(c * ctr) OVER r AS m2 FROM hc
 WINDOW l AS (PARTITION BY session ORDER BY bin ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY session ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
th AS (SELECT session, arg_max(ctr, (round(w1 * w2 * pow(m1 / w1 - m2 / w2, 2), 6), -bin)) AS th FROM cu WHERE w2 > 0 GROUP BY session)"""


@query("f03_select_otsu", "s:session,reason i:frame,rk d:threshold", f"""WITH {OTSU}, z AS (SELECT fl.*, th AS threshold, CASE WHEN n < 4 THEN 'few' WHEN hi - lo < 1e-4 THEN 'uniform' WHEN n >= 5 AND (hi - lo) / hi < 0.06 THEN 'calm' ELSE 'otsu' END AS reason FROM fl JOIN th USING (session))
SELECT * FROM z WHERE reason IN ('few', 'uniform') OR (reason = 'calm' AND rk <= greatest(3, round_even(n * 0.75::DOUBLE, 0))) OR (reason = 'otsu' AND (sharpness >= threshold OR rk <= mink))""")
def _(s, d):
    return Q.select_otsu(sharp(s, d), S)


@query("f04_select_utility", "s:session i:frame,rk,best_k", f"""WITH {SHARP}, u AS (SELECT *, pow(avg((sharpness - lo) / (hi - lo + 1e-6)) OVER (PARTITION BY session ORDER BY rk ROWS UNBOUNDED PRECEDING), 2) * sqrt(rk / n) AS u FROM fl),
b AS (SELECT session, arg_max(rk, (round(u, 9), -rk)) AS best_k FROM u WHERE rk >= mink AND rk <= greatest(mink, round_even(n * 0.95::DOUBLE, 0)) GROUP BY session)
SELECT * FROM fl JOIN b USING (session) WHERE rk <= best_k""")
def _(s, d):
    return Q.select_utility(sharp(s, d), S)


@query("f05_filter_frames", "s:session i:frame,rk", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY wfwhm, frame) AS rk, count(*) OVER (PARTITION BY session) AS n FROM frames)
SELECT * FROM r WHERE rk <= floor(n * 0.8::DOUBLE) AND round(roundness, 9) >= 0.94""")
def _(s, d):
    return Q.filter_frames(V.frame_catalogue(s, d), S)


@query("f06_flag_frames", "s:kind,flags i:id d:ratio,sharpness", """WITH q AS (SELECT kind, quantile_cont(value, 0.9) AS p FROM ev GROUP BY kind), z AS (SELECT id, ev.kind, value / p AS ratio, k FROM ev JOIN q ON ev.kind = q.kind)
SELECT id, kind, ratio, CASE WHEN ratio < 0.2 THEN 0 ELSE k END AS sharpness,
 concat_ws(',', CASE WHEN ratio < 0.2 THEN 'low_signal' END, CASE WHEN ratio < 0.05 THEN 'target_lost' END, CASE WHEN k / 1000.0::DOUBLE > 0.07 THEN 'clipping' END) AS flags FROM z""")
def _(s, d):
    e = V.ev(s, d).withColumn("signal", F.col("value")).withColumn("sharpness", F.col("k").cast("double")).withColumn("saturation", F.col("k") / 1000)
    return Q.flag_frames(e, ["kind"])


@query("f07_is_monotonic", "s:kind i:n,violations b:monotonic", """WITH l AS (SELECT kind, ts <= lag(ts) OVER (PARTITION BY kind ORDER BY id) AS bad FROM ev)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE bad) AS violations, violations = 0 AS monotonic FROM l GROUP BY kind""")
def _(s, d):
    return Q.is_monotonic(V.ev(s, d), ["kind"], "id", "ts")


@query("f08_select_spread", "s:kind i:frame,bin,turn,pick", """WITH z AS (SELECT kind, id AS frame, value AS sharpness, epoch_us(ts)::DOUBLE AS t, min(epoch_us(ts)::DOUBLE) OVER (PARTITION BY kind) AS a, max(epoch_us(ts)::DOUBLE) OVER (PARTITION BY kind) AS b FROM ev),
y AS (SELECT *, least(CAST(floor((t - a) / (b - a) * 10) AS BIGINT), 9) AS bin FROM z), x AS (SELECT *, row_number() OVER (PARTITION BY kind, bin ORDER BY sharpness DESC, frame) AS turn FROM y)
SELECT kind, frame, bin, turn, row_number() OVER (PARTITION BY kind ORDER BY turn, bin) AS pick FROM x QUALIFY pick <= 75""")
def _(s, d):
    e = V.ev(s, d).select("kind", F.col("id").alias("frame"), F.col("value").alias("sharpness"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    return Q.select_spread(e, ["kind"], "t", 75)


@query("f09_within_budget", "s:session i:frame d:used", f"""WITH {SHARP}, c AS (SELECT *, sum(nstars) OVER (PARTITION BY session ORDER BY rk ROWS UNBOUNDED PRECEDING) AS used FROM rk)
SELECT session, frame, used FROM c WHERE 1.25 * (used + 100) <= 6000""")
def _(s, d):
    return Q.within_budget(sharp(s, d), S, "nstars", 100.0, 6000.0)


@query("g03_top_k", "s:session,filter i:frame,rn d:fwhm", "SELECT session, filter, frame, fwhm, row_number() OVER (PARTITION BY session, filter ORDER BY fwhm, frame) AS rn FROM frames QUALIFY rn <= 5")
def _(s, d):
    return Q.top_k(V.frames(s, d), ["session", "filter"], [F.col("fwhm"), F.col("frame")], 5)


CAND = "cd AS (SELECT frame, line AS step, star AS id, fwhmx AS separation, tax AS noise, flux AS cost, fwhmy AS detail FROM meas)"


def candidates(s, d):
    return V.meas(s, d).select("frame", F.col("line").alias("step"), F.col("star").alias("id"), F.col("fwhmx").alias("separation"), F.col("tax").alias("noise"),
                               F.col("flux").alias("cost"), F.col("fwhmy").alias("detail"))


@query("f17_recommend", "i:frame,eligible,id d:noise,cost", f"""WITH {CAND}, e AS (SELECT *, max(separation) OVER (PARTITION BY frame) AS best FROM cd), k AS (SELECT * FROM e WHERE separation >= 0.95 * best)
SELECT frame, noise, cost, id, count(*) OVER (PARTITION BY frame) AS eligible FROM k QUALIFY row_number() OVER (PARTITION BY frame ORDER BY noise, cost, id) = 1""")
def _(s, d):
    return Q.recommend(candidates(s, d), ["frame"])


@query("f18_accept_if_better", "i:frame,step b:accepted", f"""WITH {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY step, noise, detail) AS rn FROM cd), b AS (SELECT frame, step AS s0, noise AS n0, detail AS d0 FROM r WHERE rn = 1)
SELECT frame, step, noise <= 0.95 * n0 AND detail >= 0.97 * d0 AS accepted FROM cd JOIN b USING (frame) WHERE step > s0""")
def _(s, d):
    return Q.accept_if_better(candidates(s, d), ["frame"])


@query("f14_shape_test", "i:frame,steps d:end_ratio s:shape", """WITH m AS (SELECT frame, line, avg(fwhmx) AS v FROM meas GROUP BY ALL), l AS (SELECT frame, line, v - lag(v) OVER (PARTITION BY frame ORDER BY line) AS d FROM m),
g AS (SELECT frame, count(*) AS steps, min(d) AS mn, max(d) AS mx, arg_min(d, line) AS f, arg_max(d, line) AS l, sum(abs(d)) AS tr, max(abs(d)) AS jp FROM l WHERE d IS NOT NULL GROUP BY frame)
SELECT frame, steps, abs(l) / nullif(abs(f), 0) AS end_ratio, CASE WHEN jp >= 0.9 * tr THEN 'step' WHEN (mn >= 0 OR mx <= 0) AND end_ratio <= 0.2 THEN 'saturating' WHEN mn >= 0 OR mx <= 0 THEN 'monotonic' ELSE 'irregular' END AS shape FROM g""")
def _(s, d):
    m = V.meas(s, d).groupBy("frame", "line").agg(F.avg("fwhmx").alias("v"))
    return Q.shape_test(m, ["frame"], "line", "v")
