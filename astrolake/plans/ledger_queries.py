"""Run ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolake import views as V
from astrolake.operators import ledger as L
from astrolake.plans.registry import query


@query("a09_read_ledger", "i:run,step s:actor,verdict b:corrupt", """SELECT run, step, CASE WHEN step % 5 = 4 THEN NULL ELSE actor END AS actor, CASE WHEN step % 5 = 4 THEN NULL ELSE concat('v', length(text) % 3) END AS verdict, step % 5 = 4 AS corrupt FROM ledger""")
def _(s, d):
    body = F.to_json(F.struct(F.col("run"), F.col("actor"), F.concat(F.lit("v"), (F.length("text") % 3).cast("string")).alias("verdict")))
    raw = V.ledger(s, d).withColumn("raw", F.when(F.col("step") % 5 == 4, F.concat(F.lit("{broken "), body)).otherwise(body))
    p = L.read_ledger_text(raw, "raw", "run long, actor string, verdict string")
    return p.select("run", "step", F.col("doc.actor").alias("actor"), F.col("doc.verdict").alias("verdict"), F.col("doc.corrupt").isNotNull().alias("corrupt"))


@query("l01_derive_status", "i:run,issues,degraded s:status", """WITH z AS (SELECT run, run % 17 = 0 AND step = 1 AS st, (length(text) > 700)::INT AS i, contains(text, 'ß')::INT AS dg FROM ledger)
SELECT run, sum(i) AS issues, sum(dg) AS degraded, CASE WHEN bool_or(st) THEN 'failed' WHEN sum(i) > 0 THEN 'review_required' WHEN sum(dg) > 0 THEN 'degraded' ELSE 'success' END AS status FROM z GROUP BY run""")
def _(s, d):
    f = V.ledger(s, d).select("run", ((F.col("run") % 17 == 0) & (F.col("step") == 1)).alias("stop"), (F.length("text") > 700).cast("int").alias("issues"), F.contains("text", F.lit("ß")).cast("int").alias("degraded"))
    return L.derive_status(f, ["run"])


# one configuration change half-way through every third run
@query("l02_inherit_issues", "i:run,step s:issues,degraded b:config_changed", """WITH z AS (SELECT run, step, CASE WHEN run % 3 = 0 AND step >= 2 THEN 2 ELSE 1 END AS cfg, length(text) > 400 AS iss, contains(text, 'ü') OR contains(text, 'é') AS dg FROM ledger)
SELECT a.run, a.step, coalesce(string_agg('i' || b.step, ',' ORDER BY b.step) FILTER (WHERE b.iss AND b.cfg = a.cfg), '') AS issues, coalesce(string_agg('g' || b.step, ',' ORDER BY b.step) FILTER (WHERE b.dg), '') AS degraded, any_value(a.run % 3 = 0 AND a.step = 2) AS config_changed
FROM z a JOIN z b ON a.run = b.run AND b.step <= a.step GROUP BY a.run, a.step""")
def _(s, d):
    sid = F.col("step").cast("string")
    none = F.array().cast("array<string>")
    e = V.ledger(s, d).select(
        F.concat_ws(":", "run", "step").alias("id"), F.when(F.col("step") > 0, F.concat_ws(":", F.col("run"), F.col("step") - 1)).alias("parent"),
        F.when((F.col("run") % 3 == 0) & (F.col("step") >= 2), "2").otherwise("1").alias("config"),
        F.when(F.length("text") > 400, F.array(F.concat(F.lit("i"), sid))).otherwise(none).alias("issues"),
        F.when(F.col("text").rlike("[üé]"), F.array(F.concat(F.lit("g"), sid))).otherwise(none).alias("degraded"))
    r = L.inherit_issues(e)
    p = F.split("id", ":")
    return r.select(p[0].alias("run"), p[1].alias("step"), F.array_join(F.array_sort("issues"), ",").alias("issues"), F.array_join(F.array_sort("degraded"), ",").alias("degraded"), "config_changed")


CFG = """cfg AS (SELECT run, key, max(value) AS value, CASE key WHEN 'stretch_m' THEN 3 WHEN 'align_tol' THEN 1 WHEN 'denoise_k' THEN 2 WHEN 'color_sat' THEN 4 WHEN 'target' THEN 0 END AS st
 FROM (SELECT run, ['align_tol', 'denoise_k', 'stretch_m', 'color_sat', 'target', 'verbose'][step % 6 + 1] AS key, concat(actor, length(text)) AS value FROM ledger) GROUP BY run, key),
dg AS (SELECT run, sha256(max(text)) AS digest FROM ledger GROUP BY run),
fp AS (SELECT dg.run, n AS stage_no, sha256(concat(any_value(digest), '|', coalesce(string_agg(concat(key, '=', value), ';' ORDER BY key) FILTER (WHERE st <= n), ''))) AS fingerprint FROM dg CROSS JOIN range(1, 5) t(n) LEFT JOIN cfg ON cfg.run = dg.run GROUP BY dg.run, n)"""


def fingerprints(s, d):
    led = V.ledger(s, d)
    key = F.element_at(F.array(*[F.lit(k) for k in ("align_tol", "denoise_k", "stretch_m", "color_sat", "target", "verbose")]), (F.col("step") % 6 + 1).cast("int"))
    cfg = led.select("run", key.alias("key"), F.concat("actor", F.length("text").cast("string")).alias("value")).groupBy("run", "key").agg(F.max("value").alias("value"))
    dig = led.groupBy("run").agg(F.sha2(F.max("text"), 256).alias("digest"))
    return L.stage_fingerprints(cfg, dig, "run")


@query("l03_stage_fingerprints", "i:run,stage_no s:fingerprint", f"WITH {CFG} SELECT * FROM fp")
def _(s, d):
    return fingerprints(s, d)


@query("l04_resume_plan", "i:run,stage_no s:state", f"""WITH {CFG}, o AS (SELECT run, stage_no, NOT ((run + stage_no) % 5 = 0 OR (run % 7 = 0 AND stage_no = 2)) AS ok FROM fp), f AS (SELECT run, min(stage_no) FILTER (WHERE NOT ok) AS bad FROM o GROUP BY run)
SELECT run, stage_no, CASE WHEN bad IS NULL OR stage_no < bad THEN 'done' WHEN ok THEN 'invalidated' ELSE 'mismatch' END AS state FROM o JOIN f USING (run)""")
def _(s, d):
    w = fingerprints(s, d)
    rec = w.where("NOT (run % 7 = 0 AND stage_no = 2)").select("run", "stage_no", F.when((F.col("run") + F.col("stage_no")) % 5 == 0, "old").otherwise(F.col("fingerprint")).alias("recorded"))
    return L.resume_plan(rec, w, "run", "stage_no")


# every fifth run closes a cycle by naming its last step as the parent of its first
@query("l05_ancestors", "s:artefact,ancestor i:depth b:cycle", """WITH RECURSIVE m AS (SELECT run, max(step) AS last FROM ledger GROUP BY run),
e AS (SELECT concat(run, ':', step) AS c, concat(run, ':', step - 1) AS p FROM ledger WHERE step > 0 UNION ALL SELECT concat(run, ':0'), concat(run, ':', last) FROM m WHERE run % 5 = 0 AND last > 0),
r(a, b, depth) AS (SELECT c, p, 1 FROM e UNION ALL SELECT r.a, e.p, r.depth + 1 FROM r JOIN e ON r.b = e.c WHERE r.depth < 12)
SELECT a AS artefact, b AS ancestor, min(depth) AS depth, a = b AS cycle FROM r GROUP BY a, b""")
def _(s, d):
    led = V.ledger(s, d)
    e = led.where("step > 0").select(F.concat_ws(":", "run", "step").alias("child"), F.concat_ws(":", F.col("run"), F.col("step") - 1).alias("parent"))
    last = led.groupBy("run").agg(F.max("step").alias("last")).where("run % 5 = 0 AND last > 0")
    return L.ancestors(e.unionByName(last.select(F.concat_ws(":", F.col("run"), F.lit("0")).alias("child"), F.concat_ws(":", "run", "last").alias("parent"))))


@query("l05_ambiguous_owners", "s:digest i:owners,first_run", "SELECT sha256(substring(text, 1, 12)) AS digest, count(DISTINCT run) AS owners, min(run) AS first_run FROM ledger GROUP BY 1 HAVING count(DISTINCT run) > 1")
def _(s, d):
    return L.ambiguous_owners(V.ledger(s, d).select("run", F.sha2(F.substring("text", 1, 12), 256).alias("digest")))


@query("l06_review_check", "i:run,step s:verdict b:allowed,valid", """WITH z AS (SELECT run, step, list_transform(range(5), lambda i: CASE WHEN (run + step + i) % 13 = 0 THEN 'fail' WHEN (run + i) % 4 = 0 THEN 'n/a' ELSE 'pass' END) AS g, CASE WHEN actor = 'user' THEN 'reject' ELSE 'accept' END AS verdict FROM ledger)
SELECT run, step, verdict, NOT list_contains(g, 'fail') AS allowed, verdict <> 'accept' OR NOT list_contains(g, 'fail') AS valid FROM z""")
def _(s, d):
    g = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when((F.col("run") + F.col("step") + i) % 13 == 0, "fail").when((F.col("run") + i) % 4 == 0, "n/a").otherwise("pass"))
    return L.review_check(V.ledger(s, d).select("run", "step", g.alias("gates"), F.when(F.col("actor") == "user", "reject").otherwise("accept").alias("verdict")))


@query("l07_expand_steps", "i:run,ord s:step", f"""WITH RECURSIVE rg AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{s}', '{n}')" for i, s, n in L.REGISTRY)}) t(ord, step, need)), rq AS (SELECT DISTINCT run, ['load', 'calibrate', 'align', 'stack', 'stretch', 'denoise', 'export'][(run + step * 3) % 7 + 1] AS step FROM ledger),
x(run, step) AS (SELECT run, step FROM rq UNION SELECT x.run, rg.need FROM x JOIN rg ON rg.step = x.step WHERE rg.need <> '') SELECT x.run, x.step, ord FROM x JOIN rg USING (step)""")
def _(s, d):
    names = F.array(*[F.lit(n) for n in ("load", "calibrate", "align", "stack", "stretch", "denoise", "export")])
    r = V.ledger(s, d).select("run", F.element_at(names, ((F.col("run") + F.col("step") * 3) % 7 + 1).cast("int")).alias("step"))
    return L.expand_steps(r, s, "run")


@query("l08_failure_actions", "i:run,step s:stage,action", """WITH z AS (SELECT run, step, ['stretch', 'denoise', 'export', 'stack'][step % 4 + 1] AS stage, CASE WHEN (run + step) % 6 = 0 THEN 'preserve' END AS rq, CASE WHEN run % 11 = 0 AND step = 0 THEN 'stop' END AS ov FROM ledger), a AS (SELECT run, coalesce(bool_or(ov = 'stop'), false) AS any_ FROM z GROUP BY run)
SELECT run, step, stage, CASE WHEN any_ THEN 'stop' ELSE coalesce(rq, CASE stage WHEN 'stretch' THEN 'fallback' WHEN 'denoise' THEN 'preserve' WHEN 'export' THEN 'stop' ELSE 'fallback' END) END AS action FROM z JOIN a USING (run)""")
def _(s, d):
    st = F.element_at(F.array(*[F.lit(n) for n in ("stretch", "denoise", "export", "stack")]), (F.col("step") % 4 + 1).cast("int"))
    z = V.ledger(s, d).select("run", "step", st.alias("stage"), F.when((F.col("run") + F.col("step")) % 6 == 0, "preserve").alias("requested"), F.when((F.col("run") % 11 == 0) & (F.col("step") == 0), "stop").alias("override"))
    return L.failure_actions(z, ["run"])


@query("l09_next_stage", "i:run,stage,next_stage", """SELECT run, stage, CASE WHEN stage BETWEEN 1 AND 5 THEN stage + 1 END AS next_stage FROM (SELECT run, arg_max(step % 7, step) AS stage FROM ledger WHERE actor = 'assistant' GROUP BY run)""")
def _(s, d):
    r = V.ledger(s, d).select("run", "step", (F.col("step") % 7).alias("stage"), (F.col("actor") == "assistant").alias("accepted"))
    return L.next_stage(r, "run")


@query("l10_verify_seals", "i:frame s:expected", """WITH z AS (SELECT frame, concat('{"code":"', filter, '","escalate":', CASE WHEN nstars > 4 THEN 'true' ELSE 'false' END, ',"status":"', CASE WHEN frame % 2 = 0 THEN 'warning' ELSE 'failed' END, '","threshold":', target % 100, ',"value":', CASE WHEN nstars = 3 THEN 'null' ELSE CAST(nstars AS VARCHAR) END, '}') AS doc FROM frames WHERE frame % 23 = 0)
SELECT frame, substring(sha256(doc), 1, 20) AS expected FROM z""")
def _(s, d):
    f = V.frames(s, d)
    g = f.select("frame", F.col("filter").alias("code"), F.when(F.col("frame") % 2 == 0, "warning").otherwise("failed").alias("status"), (F.col("nstars") > 4).alias("escalate"),
                 F.when(F.col("nstars") != 3, F.col("nstars")).alias("value"), (F.col("target") % 100).alias("threshold"))
    sealed = L.seal(F.col("code"), F.col("status"), F.col("escalate"), F.when(F.col("frame") % 23 == 0, -1).otherwise(F.col("value")), F.col("threshold"))
    return L.verify_seals(g.withColumn("seal", sealed))


@query("c15_join_reviews", "i:run,n_reviews s:state", """WITH r AS (SELECT run, sha256(text) AS digest FROM ledger WHERE step = 0), v AS (SELECT l.run, CASE WHEN l.run % 4 = 0 THEN 'x' ELSE r.digest END AS b FROM ledger l JOIN r USING (run) WHERE actor = 'assistant'), g AS (SELECT run, count(*) AS n, min(b) AS b FROM v GROUP BY run)
SELECT run, coalesce(n, 0) AS n_reviews, CASE WHEN n IS NULL THEN 'unreviewed' WHEN n > 1 THEN 'ambiguous' WHEN b <> digest THEN 'stale' ELSE 'bound' END AS state FROM r LEFT JOIN g USING (run)""")
def _(s, d):
    led = V.ledger(s, d)
    r = led.where("step = 0").select("run", F.sha2("text", 256).alias("digest"))
    v = led.where("actor = 'assistant'").select("run").join(r, "run").select("run", F.when(F.col("run") % 4 == 0, "x").otherwise(F.col("digest")).alias("bound_digest"))
    return L.join_reviews(r, v, "run")


@query("f19_latest_revision", "i:run,latest s:actor b:consecutive", """WITH z AS (SELECT * FROM ledger WHERE NOT (run % 6 = 0 AND step = 1)) SELECT run, max(step) AS latest, arg_max(actor, step) AS actor, max(step) - min(step) + 1 = count(DISTINCT step) AND count(DISTINCT step) = count(*) AS consecutive FROM z GROUP BY run""")
def _(s, d):
    return L.latest_revision(V.ledger(s, d).where("NOT (run % 6 = 0 AND step = 1)"), "run", "step")


@query("i17_canonical_digest", "i:run,step s:digest", """SELECT run, step, sha256(concat('{"actor":"', actor, '","n":', length(text), ',"run":', run, '}')) AS digest FROM ledger""")
def _(s, d):
    return V.ledger(s, d).select("run", "step", L.canonical_digest({"run": F.col("run"), "actor": F.col("actor"), "n": F.length("text")}).alias("digest"))


@query("i18_json_paths", "i:id,k,missing,n_keys", """SELECT id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, -1 AS missing, len(regexp_extract_all(props, '"k"\\s*:')) AS n_keys FROM ev""")
def _(s, d):
    e = V.ev(s, d)
    return e.select("id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.absent").cast("long"), F.lit(-1)).alias("missing"), F.size(F.regexp_extract_all("props", F.lit('"k"\\s*:'), F.lit(0))).alias("n_keys"))
