"""Gate and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolake import views as V
from astrolake.operators import frame_stats as FS
from astrolake.operators import frames as R
from astrolake.operators import gates as G
from astrolake.operators import images as I
from astrolake.plans.image_queries import CLUM, CORNER, FIDELITY, IN, LUM, REG, q
from astrolake.plans.frame_queries import TARGET_SQL, targets
from astrolake.plans.join_queries import STARS_IN, stars_in_frames
from astrolake.plans.registry import query

K = ["session", "img"]
P = ["parent", "candidate"]
GATE_SQL = " UNION ALL ".join(
    f"""SELECT session, img, '{code}' AS code, CASE WHEN {m} IS NULL THEN 'unavailable' {"" if hard is None else f"WHEN {m} {'>=' if up else '<='} {hard} THEN '{'failed' if code in G.ESCALATING else 'warning'}' WHEN {m} {'>=' if up else '<='} {deg} THEN 'degraded'"} {"ELSE 'uncalibrated'" if hard is None else ""} END AS status, {m} AS value FROM fid"""
    for m, code, deg, hard, up in G.FIDELITY)


@query("k01_evaluate_gates", "i:session,img s:code,status d:value b:escalate", f"WITH {FIDELITY}, gt AS ({GATE_SQL}) SELECT *, status = 'failed' AS escalate FROM gt WHERE status IS NOT NULL")
def _(s, d):
    m = FS.fidelity_metrics(V.rgb2_planes(s, d), K)
    return G.evaluate_gates(m, K, G.thresholds(s), [r[0] for r in G.FIDELITY], G.ESCALATING)


def lrgb(s, d):
    return I.with_luminance(V.rgb(s, d))


def pair(s, d):
    return V.rgb2(s, d).withColumn("l", I.lum()).withColumn("cl", I.lum("cr", "cg", "cb"))


PAIR = f"pr AS (SELECT *, {LUM} AS l, {CLUM} AS cl FROM rgb2)"
LRGB = f"lr AS (SELECT *, {LUM} AS l FROM rgb)"


@query("k02_quality_gates", "i:session,img s:code,status d:value", f"""WITH {LRGB}, c AS (SELECT session, img, max(m) / nullif(min(m), 0) AS cr FROM (SELECT session, img, reg, avg(l) AS m FROM (SELECT *, {CORNER} AS reg FROM lr) WHERE reg <> 'centre' GROUP BY ALL) GROUP BY ALL),
m AS (SELECT session, img, median(l) AS md, {q('l', .01)} AS p1, avg((l <= 0)::INT) AS np FROM lr GROUP BY ALL), z AS (SELECT m.*, cr, session % 2 = 0 AS em, img % 2 = 0 AS dbe FROM m JOIN c USING (session, img))
SELECT session, img, 'BACKGROUND_CRUSHED' AS code, p1 AS value, 'warning' AS status FROM z WHERE p1 <= 1e-4 UNION ALL SELECT session, img, 'BACKGROUND_CRUSHED_SHARE', np, 'warning' FROM z WHERE np > 0.01
UNION ALL SELECT session, img, 'BACKGROUND_LOW', md, 'warning' FROM z WHERE md < CASE WHEN em THEN 0.04 ELSE 0.025 END UNION ALL SELECT session, img, 'BACKGROUND_TOO_BRIGHT', md, 'warning' FROM z WHERE md > 0.3
UNION ALL SELECT session, img, 'CORNER_NONUNIFORM', cr, CASE WHEN dbe THEN 'failed' ELSE 'warning' END FROM z WHERE cr > 3""")
def _(s, d):
    m = G.display_metrics(lrgb(s, d), K, V.SIDE).withColumn("target_type", F.when(F.col("session") % 2 == 0, "emission_nebula").otherwise("galaxy"))
    return G.quality_gates(m, K, s, F.col("img") % 2 == 0)


@query("k03_stage_gates", "i:frame s:reasons,verdict", """WITH g AS (SELECT frame, avg((tax <= 0)::INT) AS sc, min(fwhmy / fwhmx) - 0.62 AS ro FROM meas GROUP BY frame)
SELECT frame, concat_ws(',', CASE WHEN sc >= 1e-4 THEN 'shadow_clip' END, CASE WHEN ro < 0.3 THEN 'roundness' END) AS reasons, CASE WHEN sc >= 1e-4 OR ro < 0.3 THEN 'reject' ELSE 'uncertain' END AS verdict FROM g""")
def _(s, d):
    g = V.meas(s, d).groupBy("frame").agg(I.share(F.col("tax") <= 0).alias("shadow_clip"), (F.min(F.col("fwhmy") / F.col("fwhmx")) - 0.62).alias("roundness"))
    return G.stage_gates(g)


@query("k04_star_gates", "i:parent,candidate,star,dip_ring s:codes d:dip", f"""WITH {STARS_IN}, z AS (SELECT parent, candidate, star, pv, cv, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS r FROM px2 JOIN si ON parent = frame),
g AS (SELECT parent, candidate, star, CAST(floor(r) AS INT) AS ring, avg(pv) AS p, avg(cv) AS c, count(*) AS n, max(cv) AS cm FROM z WHERE r <= 4 GROUP BY ALL),
b AS (SELECT parent, candidate, star, max(c) FILTER (WHERE ring = 3) AS cb, max(p) FILTER (WHERE ring = 3) AS pb FROM g GROUP BY ALL), j AS (SELECT *, CASE WHEN ring IN (1, 2) THEN cb - c END AS dp FROM g JOIN b USING (parent, candidate, star)),
o AS (SELECT parent, candidate, star, max(dp) AS dip, arg_max(ring, (round(dp, 9), -ring)) FILTER (WHERE dp IS NOT NULL) AS dip_ring, any_value(cb) AS cb, max(cm) FILTER (WHERE ring = 0) AS core, sum(n * greatest(c - cb, 0)) FILTER (WHERE ring <= 1) AS cf, sum(n * greatest(p - pb, 0)) FILTER (WHERE ring <= 1) AS pf FROM j GROUP BY ALL)
SELECT parent, candidate, star, dip, dip_ring, concat_ws(',', CASE WHEN dip >= greatest(0.1, 0.5 * abs(cb)) THEN 'RINGING' END, CASE WHEN pf > 0 AND cf / pf > 1.5 THEN 'BLOAT' END, CASE WHEN core >= 0.25 THEN 'CORE_BURN' END) AS codes FROM o""")
def _(s, d):
    px2 = V.px2(s, d)
    st = stars_in_frames(s, d).withColumnRenamed("frame", "parent").join(px2.select(*P).distinct(), "parent")
    return G.star_gates(px2, st, P)


@query("k05_removal_gate", "i:session,img,n s:profile,state d:separation,damage b:measurable", f"""WITH {PAIR}, t AS (SELECT session, img, {q('l', .75)} AS ua, {q('l', .25)} AS ub FROM pr GROUP BY ALL),
g AS (SELECT session, img, count(*) AS n, median(l) AS mo, median(cl) AS ms, any_value(ua / ub) AS separation FROM pr JOIN t USING (session, img) WHERE l >= ua GROUP BY ALL),
m AS (SELECT session, img, n, separation, n > 10 AND separation >= 1.05 AS measurable, CASE WHEN n > 10 AND separation >= 1.05 THEN abs(mo - ms) / mo END AS damage, CASE img % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'strict' ELSE 'open' END AS profile FROM g),
l AS (SELECT *, CASE profile WHEN 'default' THEN least(0.10, 0.10 + (session - 5) * 0.01) WHEN 'strict' THEN least(0.05, 0.10 + (session - 5) * 0.01) END AS lim, CASE profile WHEN 'strict' THEN 1.5 ELSE 2 END AS mu FROM m)
SELECT *, CASE WHEN lim IS NULL THEN 'uncalibrated' WHEN NOT measurable THEN 'advisory' WHEN damage <= lim THEN 'ok' WHEN damage <= lim * mu THEN 'advisory' ELSE 'hard_failed' END AS state FROM l""")
def _(s, d):
    prof = s.createDataFrame(list(G.REMOVAL_PROFILES), "profile string, limit double, multiplier double")
    m = G.removal_damage(pair(s, d), K)
    m = m.withColumn("profile", F.when(F.col("img") % 3 == 0, "default").when(F.col("img") % 3 == 1, "strict").otherwise("open"))
    return G.removal_gate(m, prof, F.lit(0.10) + (F.col("session") - 5) * 0.01)


@query("k06_starless_checks", "i:session,img s:lum_status,collapsed d:lum_ratio,black_gain,clip_gain b:accept", f"""WITH {PAIR}, g AS (SELECT session, img, median(cl) / median(l) AS lum_ratio, {', '.join(f"{q(c, .99)} AS p_{c}, {q('c' + c, .99)} AS q_{c}" for c in 'rgb')},
 avg((cl <= 0.3)::INT) - avg((l <= 0.3)::INT) AS black_gain, avg((cl >= 0.7)::INT) - avg((l >= 0.7)::INT) AS clip_gain FROM pr GROUP BY ALL)
SELECT session, img, lum_ratio, CASE WHEN lum_ratio < 0.1 OR lum_ratio > 10 THEN 'failed' WHEN lum_ratio < 0.5 OR lum_ratio > 2 THEN 'warning' ELSE 'passed' END AS lum_status,
 concat_ws(',', {', '.join(f"CASE WHEN p_{c} > 0.5 AND q_{c} < 0.8 * p_{c} THEN '{c}' END" for c in 'rgb')}) AS collapsed, black_gain, clip_gain, black_gain <= 0.02 AND clip_gain <= 0.005 AS accept FROM g""")
def _(s, d):
    return G.starless_checks(pair(s, d), K)


@query("k07_denoise_check", "i:session,img s:reasons d:drift,noise_ratio,detail b:accepted", f"""WITH {PAIR}, z AS (SELECT *, abs(l - lag(l) OVER w) AS g_, abs(cl - lag(cl) OVER w) AS h_ FROM pr WINDOW w AS (PARTITION BY session, img, y ORDER BY x)),
g AS (SELECT session, img, greatest({', '.join(f"abs(avg(c{c}) / avg({c}) - 1)" for c in ('r', 'g', 'b', 'l'))}) AS drift, stddev_pop(cl) / stddev_pop(l) AS noise_ratio, sum(h_) / sum(g_) AS detail, min(least(cr, cg, cb)) AS lo, max(greatest(cr, cg, cb)) AS hi FROM z GROUP BY ALL)
SELECT session, img, drift, noise_ratio, detail, concat_ws(',', CASE WHEN drift > 0.05 THEN 'drift' END, CASE WHEN noise_ratio > 1.05 THEN 'noise' END, CASE WHEN detail < 0.65 OR detail > 1.25 THEN 'detail' END, CASE WHEN lo < 0 OR hi > 1 THEN 'range' END) AS reasons, reasons = '' AS accepted FROM g""")
def _(s, d):
    return G.denoise_check(pair(s, d), K)


FIT = f"""h AS (SELECT lang, count(*) AS n, {q('value', .9)} AS p90, {q('value', .95)} AS p95 FROM labelled WHERE label = 'healthy' GROUP BY lang), dg AS (SELECT lang, max(value) AS dmax, min(value) AS dmin FROM labelled WHERE label = 'degraded' GROUP BY lang),
ft AS (SELECT lang, n, least(greatest(coalesce(dmax, 0), p95 * 1.5), 20000) AS hard, CASE WHEN p90 >= hard THEN hard * 0.75 ELSE p90 END AS degraded, least(coalesce(dmin, 0), p95 * 0.5) AS hard_low, CASE WHEN p90 <= hard_low THEN hard_low * 1.25 ELSE p90 END AS degraded_low, n < 3 AS sparse FROM h LEFT JOIN dg USING (lang))"""


@query("k08_fit_thresholds", "s:lang i:n d:hard,degraded,hard_low,degraded_low b:sparse", f"WITH {FIT} SELECT * FROM ft")
def _(s, d):
    return G.fit_thresholds(V.labelled(s, d), "lang", 20000.0)


@query("k09_squeeze_line", "s:lang,status d:ceiling,floor,crossing,line", f"""WITH g AS (SELECT lang, max(value) FILTER (WHERE label = 'healthy') AS ceiling, min(value) FILTER (WHERE label = 'degraded') AS floor, median(value) FILTER (WHERE label = 'degraded') AS mid FROM labelled GROUP BY lang)
SELECT lang, ceiling, floor, CASE WHEN ceiling <= floor THEN 'lineable' ELSE 'not_lineable' END AS status, CASE WHEN ceiling > floor THEN ceiling - floor END AS crossing, CASE WHEN ceiling <= floor THEN least(greatest(mid, ceiling), floor) END AS line FROM g""")
def _(s, d):
    return G.squeeze_line(V.labelled(s, d), ["lang"])


@query("k10_degraded_separation", "i:frame d:healthy,lightest,separation b:usable", """WITH g AS (SELECT frame, max(fwhmx) FILTER (WHERE line % 3 = 0) AS healthy, min(fwhmx) FILTER (WHERE line % 3 > 0) AS lightest FROM meas GROUP BY frame) SELECT *, lightest - healthy AS separation, coalesce(lightest > healthy, false) AS usable FROM g""")
def _(s, d):
    return G.degraded_separation(V.meas(s, d).withColumn("ratio", F.col("line") % 3).withColumn("value", F.col("fwhmx")), ["frame"])


@query("k11_jitter_strata", "i:session,n s:stratum d:p50,p95,spread b:misleading", f"""WITH w AS (SELECT session, frame, y // 4 AS wy, x // 4 AS wx, avg(v) AS value, max(v) - min(v) >= 0.6 AS m FROM px GROUP BY ALL), z AS (SELECT session, value, CASE WHEN m THEN 'measurable' ELSE 'unmeasurable' END AS st FROM w)
SELECT session, coalesce(st, 'pooled') AS stratum, count(*) AS n, median(value) AS p50, {q('value', .95)} AS p95, max(value) - min(value) AS spread, st IS NULL AS misleading FROM z GROUP BY GROUPING SETS ((session, st), (session))""")
def _(s, d):
    w = V.px(s, d).groupBy("session", "frame", F.floor(F.col("y") / 4).alias("wy"), F.floor(F.col("x") / 4).alias("wx")).agg(F.avg("v").alias("value"), (F.max("v") - F.min("v") >= 0.6).alias("measurable"))
    return G.jitter_strata(w, "session")


@query("k12_ladder", "i:session,img s:kind,moved d:param,d_mean,d_spread,d_abs", f"""WITH {LRGB}, s AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {p}::DOUBLE)" for k, p in G.LADDER)}) t(kind, param)),
w AS (SELECT session, img, kind, param, l, CASE kind WHEN 'brightness' THEN l * param WHEN 'overshoot' THEN l + param * sign(l - 0.5) WHEN 'gamma' THEN pow(greatest(l, 0), param) ELSE greatest(l, param) END AS w FROM lr, s),
g AS (SELECT session, img, kind, param, avg(w) - avg(l) AS d_mean, stddev_pop(w) - stddev_pop(l) AS d_spread, avg(abs(w - l)) AS d_abs FROM w GROUP BY ALL) SELECT *, CASE WHEN abs(d_mean) >= abs(d_spread) THEN 'mean' ELSE 'spread' END AS moved FROM g""")
def _(s, d):
    return G.ladder(lrgb(s, d), K)


@query("k13_corpus_verdict", "s:source,verdict i:passed,not_applicable,failed", """WITH g AS (SELECT source, count(*) FILTER (WHERE value >= 100 AND (label = 'healthy' OR flagged)) AS passed, count(*) FILTER (WHERE value < 100) AS not_applicable, count(*) FILTER (WHERE value >= 100 AND NOT (label = 'healthy' OR flagged)) AS failed FROM labelled GROUP BY source)
SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN passed = 0 THEN 'not_applicable' ELSE 'passed' END AS verdict FROM g""")
def _(s, d):
    c = F.when(F.col("value") < 100, "not_applicable").when((F.col("label") == "healthy") | F.col("flagged"), "passed").otherwise("failed")
    return G.corpus_verdict(V.labelled(s, d).withColumn("check", c), ["source"])


@query("k14_replay", "s:lang,label i:accept,advisory,reject,uncalibrated", f"""WITH {FIT} SELECT lang, label, count(*) FILTER (WHERE value < hard AND value < degraded) AS accept, count(*) FILTER (WHERE value < hard AND value >= degraded) AS advisory, count(*) FILTER (WHERE value >= hard) AS reject,
 count(*) FILTER (WHERE hard IS NULL) AS uncalibrated FROM labelled LEFT JOIN ft USING (lang) GROUP BY ALL""")
def _(s, d):
    return G.replay(V.labelled(s, d), G.fit_thresholds(V.labelled(s, d), "lang", 20000.0), "lang")


ADV = f"""{LRGB}, am AS (SELECT session, img, median(l) AS median, {q('l', .99)} AS p99, {q('l', .99)} - {q('l', .01)} AS span, stddev_pop(l) AS noise, greatest(avg(r), avg(g), avg(b)) - least(avg(r), avg(g), avg(b)) AS cast_,
 abs(avg(l) FILTER (WHERE x < 4) - avg(l) FILTER (WHERE x >= 4)) AS tilt FROM lr GROUP BY ALL)"""


@query("k15_advise", "i:session,img s:decision,confidence,metric d:value", f"""WITH {ADV} SELECT session, img, 'neutralise_background' AS decision, 'high' AS confidence, 'cast' AS metric, cast_ AS value FROM am WHERE cast_ > 0.02
UNION ALL SELECT session, img, 'reduce_noise', 'medium', 'noise', noise FROM am WHERE noise > 0.12 UNION ALL SELECT session, img, 'protect_core', 'high', 'p99', p99 FROM am WHERE p99 > 0.8 UNION ALL SELECT session, img, 'fit_gradient', 'medium', 'tilt', tilt FROM am WHERE tilt > 0.05
UNION ALL SELECT session, img, 'lift_background', 'low', 'median', median FROM am WHERE median < 0.45 UNION ALL SELECT session, img, 'stretch_more', 'low', 'span', span FROM am WHERE span < 0.55""")
def _(s, d):
    return G.advise(G.advice_metrics(lrgb(s, d), K), K, s)


@query("k16_recommend_params", "i:session,img,gradient_order d:denoise_strength,stretch,saturation", f"""WITH {ADV} SELECT session, img, least(greatest(noise * 4, 0.1), 0.8) AS denoise_strength, least(greatest(0.25 / greatest(median, 0.05), 0.5), 3) AS stretch, least(greatest(1 - cast_ * 5, 0.6), 1) AS saturation, CASE WHEN tilt > 0.05 THEN 2 ELSE 1 END AS gradient_order FROM am""")
def _(s, d):
    return G.recommend_params(G.advice_metrics(lrgb(s, d), K), K)


@query("k17_choose_profile", "i:id s:profile d:strength", f"""WITH {TARGET_SQL}, zz AS (SELECT id, CASE WHEN target_type LIKE '%cluster%' THEN 'cluster' WHEN target_type LIKE '%galaxy%' THEN 'galaxy' ELSE 'nebula' END AS grp, CASE WHEN id % 2 = 0 THEN 'narrowband' ELSE 'broadband' END AS mode, CASE WHEN p_size % 4 = 0 THEN p_size / 50.0::DOUBLE END AS ov FROM tt),
st AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', '{c}', {e}::DOUBLE)" for a, b, c, e in G.STYLES)}) t(grp, mode, profile, s)) SELECT id, profile, CASE WHEN ov IS NULL THEN s ELSE least(greatest(ov, s - 0.2), s + 0.2) END AS strength FROM zz JOIN st USING (grp, mode)""")
def _(s, d):
    t = R.with_target_type(targets(s, d), R.target_catalogue(s)).withColumn("mode", F.when(F.col("id") % 2 == 0, "narrowband").otherwise("broadband"))
    return G.choose_profile(t.withColumn("override", F.when(F.col("p_size") % 4 == 0, F.col("p_size") / 50)), s)


SCENE = f"""{LRGB}, sf AS (SELECT session, img, avg((l > 0.7)::INT) AS br, avg((greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1e-6)) AS sat, avg((l > 0.62)::INT) AS cov, avg(r) - (avg(g) + avg(b)) / 2 AS red, avg(b) - (avg(r) + avg(g)) / 2 AS blue FROM lr GROUP BY ALL),
bm AS (SELECT session, img, avg(l) AS m FROM lr GROUP BY session, img, y // 2, x // 2), bq AS (SELECT session, img, {q('m', .75)} AS q FROM bm GROUP BY ALL), df AS (SELECT session, img, avg((m > q)::INT) AS diffuse FROM bm JOIN bq USING (session, img) GROUP BY ALL),
sd AS (SELECT *, CASE WHEN cov > 0.20 THEN 'very_dense' WHEN cov > 0.12 THEN 'dense' WHEN cov > 0.05 THEN 'moderate' ELSE 'sparse' END AS density, cov > 0.12 AS dn FROM sf JOIN df USING (session, img)),
sl AS (SELECT session, img, density, unnest([{{'s': round(least(greatest(e, 0), 1), 3), 'o': 0, 'n': 'emission_nebula'}}, {{'s': round(least(greatest(rf, 0), 1), 3), 'o': -1, 'n': 'reflection_nebula'}}, {{'s': round(least(greatest(ga, 0), 1), 3), 'o': -2, 'n': 'galaxy'}}, {{'s': round(least(greatest(gc, 0), 1), 3), 'o': -3, 'n': 'globular_cluster'}},
 {{'s': round(least(greatest(pl, 0), 1), 3), 'o': -4, 'n': 'planetary_nebula'}}, {{'s': round(least(greatest(wf, 0), 1), 3), 'o': -5, 'n': 'wide_field'}}]) AS z FROM (SELECT *, 0.35::DOUBLE + greatest(red, 0) * 2.5 + sat * 0.45 + least(diffuse * 3, 0.25) + CASE WHEN red > greatest(blue, 0) + 0.02 THEN 0.15 ELSE 0 END AS e,
 0.25::DOUBLE + greatest(blue, 0) * 2 + sat * 0.35 AS rf, 0.25::DOUBLE + least(br * 4, 0.25) + CASE WHEN dn THEN 0 ELSE 0.15 END AS ga, 0.2::DOUBLE + CASE WHEN dn THEN 0.35 ELSE 0.05 END + least(cov * 3, 0.25) AS gc, 0.18::DOUBLE + least(br * 6, 0.35) + sat * 0.2 AS pl, 0.25::DOUBLE + CASE WHEN dn THEN 0.18 ELSE 0.05 END + greatest(0.12 - br, 0) AS wf FROM sd)),
sc AS (SELECT session, img, density, CASE WHEN z.s >= 0.35 THEN z.n ELSE 'unknown_deep_sky' END AS scene, CASE WHEN z.s >= 0.35 THEN z.s ELSE 0.3 END AS confidence FROM sl QUALIFY row_number() OVER (PARTITION BY session, img ORDER BY z.s DESC, z.o DESC) = 1)"""


@query("k18_classify_scene", "i:session,img s:density,scene d:confidence", f"WITH {SCENE} SELECT * FROM sc")
def _(s, d):
    return G.classify_scene(G.scene_features(lrgb(s, d), K), K)


@query("k19_compare_acceptance", "i:parent,candidate s:verdict d:core_gain,noise_ratio", f"""WITH {REG}, g AS (SELECT parent, candidate, avg(pv) FILTER (WHERE region = 'core') AS cb, avg(cv) FILTER (WHERE region = 'core') AS cc, stddev_pop(pv) FILTER (WHERE region = 'bg') AS bb, stddev_pop(cv) FILTER (WHERE region = 'bg') AS bc FROM px2 JOIN reg ON {IN} GROUP BY ALL)
SELECT parent, candidate, cc - cb AS core_gain, bc / bb AS noise_ratio, CASE WHEN cc >= cb - 0.01 AND bc <= 1.05 * bb THEN 'accept' WHEN cc >= cb - 0.01 OR bc <= 1.05 * bb THEN 'review' ELSE 'reject' END AS verdict FROM g""")
def _(s, d):
    return G.compare_acceptance(I.assign_regions(V.px2(s, d), I.regions(s)), P)


@query("k20_diagnose_log", "i:target,line s:code,severity", """WITH m AS (SELECT target, id AS line, kind, max(CASE WHEN kind = 'purchase' THEN id END) OVER (PARTITION BY target ORDER BY id) AS pm, max(CASE WHEN kind = 'purchase' THEN id END) OVER (PARTITION BY target) AS lm FROM ev)
SELECT target, line, CASE kind WHEN 'error' THEN 'E_ABORT' WHEN 'signup' THEN 'W_RETRY' ELSE 'I_NOTE' END AS code, CASE kind WHEN 'error' THEN 'fatal' WHEN 'signup' THEN CASE WHEN coalesce(lm > line, false) THEN 'benign' ELSE 'warning' END ELSE CASE WHEN coalesce(pm < line, false) THEN 'benign' ELSE 'warning' END END AS severity
FROM m WHERE kind IN ('error', 'signup', 'view')""")
def _(s, d):
    log = V.ev(s, d).select("target", F.col("id").alias("line"), F.concat(F.col("kind"), F.lit(": "), F.col("value").cast("string")).alias("text"))
    return G.diagnose_log(log, "target")


@query("k20_log_context", "i:log,line s:code,severity", """WITH m AS (SELECT id // 1000 AS log, id AS line, kind, max(CASE WHEN kind = 'purchase' THEN id END) OVER (PARTITION BY id // 1000) AS lm FROM ev)
SELECT log, line, 'W_COPY' AS code, CASE WHEN coalesce(lm > line, false) AND EXISTS (SELECT 1 FROM m o WHERE o.log = m.log AND o.kind = 'signup' AND o.line BETWEEN m.line - 5 AND m.line - 1)
 AND EXISTS (SELECT 1 FROM m o WHERE o.log = m.log AND o.kind = 'view' AND o.line BETWEEN m.line + 1 AND m.line + 9) THEN 'benign' ELSE 'warning' END AS severity FROM m WHERE kind = 'click'""")
def _(s, d):
    log = V.ev(s, d).select(F.floor(F.col("id") / 1000).alias("log"), F.col("id").alias("line"), F.concat(F.col("kind"), F.lit(": "), F.col("value").cast("string")).alias("text"))
    return G.context_findings(log, "log", "W_COPY", r"(?i)^click", r"(?i)^signup", r"(?i)^view")


@query("k21_assert_contract", "s:rule,field,key", """WITH z AS (SELECT frame, CASE WHEN frame % 101 = 0 THEN NULL ELSE fwhmx END AS fwhmx, tax FROM meas)
SELECT 'missing' AS rule, 'fwhmx' AS field, CAST(frame AS VARCHAR) AS key FROM z WHERE fwhmx IS NULL UNION ALL SELECT 'range', 'fwhmx', CAST(frame AS VARCHAR) FROM z WHERE fwhmx NOT BETWEEN 0.2 AND 4.9
UNION ALL SELECT 'range', 'tax', CAST(frame AS VARCHAR) FROM z WHERE tax NOT BETWEEN 0 AND 0.07 UNION ALL SELECT 'duplicate', 'frame', CAST(frame AS VARCHAR) FROM z GROUP BY frame HAVING count(*) > 1""")
def _(s, d):
    m = V.meas(s, d).withColumn("fwhmx", F.when(F.col("frame") % 101 != 0, F.col("fwhmx")))
    return G.assert_contract(m, "frame", ["fwhmx"], {"fwhmx": (0.2, 4.9), "tax": (0.0, 0.07)})


@query("k22_check_constraints", "i:frame d:violation b:survives", f"""WITH {REG}, st AS (SELECT frame, region, median(v) AS value FROM px JOIN reg ON {IN} GROUP BY ALL), l AS (SELECT * FROM (VALUES {', '.join(f"('{r}', {a}::DOUBLE, {b}::DOUBLE)" for r, a, b in G.LIMITS)}) t(region, mn, mx)),
g AS (SELECT frame, max(greatest(mn - value, value - mx, 0) / greatest(abs(mn), abs(mx), 1e-12)) AS violation FROM st JOIN l USING (region) GROUP BY frame) SELECT *, violation = 0 AS survives FROM g""")
def _(s, d):
    st = I.assign_regions(V.px(s, d), I.regions(s)).groupBy("frame", "region").agg(F.median("v").alias("value"))
    return G.check_constraints(st, ["frame"], s)


@query("k23_histogram_gate", "i:session,img,n s:reasons,status d:median,span,clipped", f"""WITH h AS (SELECT session, img, 255 * least(greatest(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0), 1) AS h FROM rgb), g AS (SELECT session, img, count(*) AS n, median(h) AS median, {q('h', .99)} - {q('h', .01)} AS span, avg((h >= 254)::INT) AS clipped FROM h GROUP BY ALL)
SELECT *, concat_ws(',', CASE WHEN median < 15 THEN 'too_dark' END, CASE WHEN median > 100 THEN 'too_bright' END, CASE WHEN span < 15 THEN 'flat' END, CASE WHEN clipped > 0.05 THEN 'clipped' END) AS reasons, CASE WHEN n < 32 THEN 'exempt' WHEN reasons = '' THEN 'passed' ELSE 'failed' END AS status FROM g""")
def _(s, d):
    return G.histogram_gate(V.rgb(s, d), K, 32)


@query("k24_evidence_conflicts", "i:session,img s:header,scene,review,conflicts", f"""WITH {SCENE}, z AS (SELECT session, img, CASE WHEN session % 2 = 0 THEN 'emission_nebula' ELSE 'wide_field' END AS header, scene, CASE WHEN img % 3 <> 0 THEN CASE WHEN img % 2 = 0 THEN 'emission_nebula' ELSE 'globular_cluster' END END AS review FROM sc)
SELECT *, concat_ws(',', CASE WHEN header <> scene THEN 'header/scene' END, CASE WHEN header <> review THEN 'header/review' END, CASE WHEN scene <> review THEN 'scene/review' END) AS conflicts FROM z WHERE header <> scene OR header <> review OR scene <> review""")
def _(s, d):
    sc = G.classify_scene(G.scene_features(lrgb(s, d), K), K).select(*K, "scene")
    ids = V.rgb(s, d).select(*K).distinct()
    h = ids.select(*K, F.when(F.col("session") % 2 == 0, "emission_nebula").otherwise("wide_field").alias("header"))
    r = ids.where(F.col("img") % 3 != 0).select(*K, F.when(F.col("img") % 2 == 0, "emission_nebula").otherwise("globular_cluster").alias("review"))
    return G.evidence_conflicts(h, sc, r, K)


@query("k25_formula_audit", "i:parent,candidate,n d:max_error b:ok", """SELECT parent, candidate, count(*) AS n, max(abs(round(0.7 * pv + 0.3 * cv, CASE WHEN parent % 2 = 0 THEN 5 ELSE 8 END) - (0.7 * pv + 0.3 * cv))) AS max_error, max_error <= 1e-6 AS ok FROM px2 GROUP BY ALL""")
def _(s, d):
    again = 0.7 * F.col("pv") + 0.3 * F.col("cv")
    p = V.px2(s, d).withColumn("again", again).withColumn("stored", F.when(F.col("parent") % 2 == 0, F.round(again, 5)).otherwise(F.round(again, 8)))
    return G.formula_audit(p, P, 1e-6)
