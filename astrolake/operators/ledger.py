"""Run ledger: status, inheritance, fingerprints, resume, lineage, seals.

Parent chains are followed level by level (each entry is touched once), so the work grows with the
ledger and not with the square of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.operators.corpus import closure
from astrolake.session import cut


def read_ledger_text(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Parse JSON ledger rows with an explicit schema; unreadable rows keep their text in ``corrupt``."""
    full = schema + ", corrupt string"
    return df.withColumn("doc", F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}))


def derive_status(flags: DataFrame, keys: list[str]) -> DataFrame:
    """stop -> failed, issues -> review_required, degraded stages -> degraded, else success."""
    g = flags.groupBy(*keys).agg(F.max("stop").alias("stop"), F.sum("issues").alias("issues"), F.sum("degraded").alias("degraded"))
    st = F.when(F.col("stop"), "failed").when(F.col("issues") > 0, "review_required").when(F.col("degraded") > 0, "degraded").otherwise("success")
    return g.withColumn("status", st)


def inherit_issues(entries: DataFrame) -> DataFrame:
    """Issues pass from parent to child unless the configuration fingerprint changed; degraded stages always pass.

    ``entries(id, parent, config, issues array, degraded array)``.  One level of children per round, until no
    child is left.  An entry whose parent is missing has no parent state; entries on or below a cycle keep
    their own issues and have config_changed null.
    """
    e = cut(entries)
    known = e.select(F.col("id").alias("parent")).distinct()
    roots = e.where(F.col("parent").isNull()).unionByName(e.where(F.col("parent").isNotNull()).join(known, "parent", "left_anti"))
    level = cut(roots.select("id", "config", "issues", "degraded", F.lit(False).alias("config_changed")))
    done = level
    while not level.isEmpty():
        p = level.select(F.col("id").alias("parent"), F.col("config").alias("pc"), F.col("issues").alias("pi"), F.col("degraded").alias("pd"))
        j = e.join(p, "parent")
        changed = F.coalesce(F.col("pc") != F.col("config"), F.lit(False))
        empty = F.array().cast("array<string>")
        level = cut(j.select(
            "id", "config", F.array_union("issues", F.when(changed, empty).otherwise(F.col("pi"))).alias("issues"),
            F.array_union("degraded", "pd").alias("degraded"), changed.alias("config_changed")))
        done = done.unionByName(level)
    ringed = e.join(done.select("id"), "id", "left_anti")
    return done.unionByName(ringed.select("id", "config", "issues", "degraded", F.lit(None).cast("boolean").alias("config_changed")))


# fixed values: stages in order, settings assigned by exact key then by prefix, settings kept out of the hash
STAGES = ("align", "denoise", "stretch", "color")
EXACT = {"stretch_m": 3, "gain": 1}
PREFIX = {"align_": 1, "denoise_": 2, "stretch_": 3, "color_": 4}
EXCLUDED = ("verbose", "output_dir")


def stage_of(key: Column) -> Column:
    """Stage number of a setting; 0 for unassigned (hashed into every stage), null for excluded."""
    c = F.lit(0)
    for p, n in PREFIX.items():
        c = F.when(key.startswith(p), n).otherwise(c)
    for k, n in EXACT.items():
        c = F.when(key == k, n).otherwise(c)
    return F.when(~key.isin(*EXCLUDED), c)


def stage_fingerprints(settings: DataFrame, digests: DataFrame, run: str) -> DataFrame:
    """Digest of the input and all settings of stages 1..N, per run and stage.

    Settings are unique per run and key (a bounded configuration), so the sorted list is short.
    """
    s = settings.withColumn("stage_no", stage_of(F.col("key"))).where(F.col("stage_no").isNotNull())
    g = s.groupBy(run).agg(F.sort_array(F.collect_list(F.struct("key", "value", "stage_no"))).alias("cfg"))
    j = digests.join(g, run, "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(len(STAGES)))))
    part = F.transform(F.filter(F.coalesce("cfg", F.array().cast("array<struct<key:string,value:string,stage_no:int>>")), lambda z: z["stage_no"] <= F.col("n")),
                       lambda z: F.concat(z["key"], F.lit("="), z["value"]))
    names = F.element_at(F.array(*[F.lit(x) for x in STAGES]), F.col("n"))
    return j.select(run, F.col("n").alias("stage_no"), names.alias("stage"), F.sha2(F.concat_ws("|", F.col("digest"), F.array_join(part, ";")), 256).alias("fingerprint"))


def resume_plan(recorded: DataFrame, wanted: DataFrame, run: str, step: str) -> DataFrame:
    """Steps are done up to the first one whose record is missing or differs; the rest must run again.

    The first mismatch is one min per run, so no ordered scan is needed.
    """
    j = wanted.join(recorded, [run, step], "left").withColumn("ok", F.coalesce(F.col("fingerprint") == F.col("recorded"), F.lit(False)))
    first = j.groupBy(run).agg(F.min(F.when(~F.col("ok"), F.col(step))).alias("_bad"))
    done = F.col("_bad").isNull() | (F.col(step) < F.col("_bad"))
    return j.join(first, run).select(run, step, F.when(done, "done").when(F.col("ok"), "invalidated").otherwise("mismatch").alias("state"))


def ancestors(edges: DataFrame) -> DataFrame:
    """Every ancestor of an artefact with its distance; an artefact that reaches itself is on a cycle."""
    c = closure(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")))
    return c.select(F.col("a").alias("artefact"), F.col("b").alias("ancestor"), "depth", (F.col("a") == F.col("b")).alias("cycle"))


def ambiguous_owners(outputs: DataFrame) -> DataFrame:
    """Artefact digests produced by more than one run."""
    return outputs.groupBy("digest").agg(F.countDistinct("run").alias("owners"), F.min("run").alias("first_run")).where(F.col("owners") > 1)


def review_check(reviews: DataFrame) -> DataFrame:
    """Accept only when every gate is pass or not applicable."""
    ok = F.forall("gates", lambda g: g.isin("pass", "n/a"))
    return reviews.withColumn("allowed", ok).withColumn("valid", (F.col("verdict") != "accept") | ok)


# fixed values: step registry (order, step, needs)
REGISTRY = ((1, "load", ""), (2, "calibrate", "load"), (3, "align", "calibrate"), (4, "stack", "align"), (5, "stretch", "stack"), (6, "denoise", "stack"), (7, "export", "stretch"))


def expand_steps(requests: DataFrame, spark: SparkSession, key: str, registry=REGISTRY) -> DataFrame:
    """Requested steps with everything they need, in canonical order, each once per run."""
    edges = spark.createDataFrame([(s, n) for _, s, n in registry if n], "a string, b string")
    need = closure(edges).select(F.col("a").alias("step"), F.col("b").alias("need"))
    order = spark.createDataFrame([(i, s) for i, s, _ in registry], "ord int, step string")
    own = requests.select(key, "step").distinct()
    full = own.select(key, "step").unionByName(own.join(F.broadcast(need), "step").select(key, F.col("need").alias("step"))).distinct()
    return full.join(F.broadcast(order), "step").select(key, "step", "ord")


# fixed values: default failure actions by stage
FAILURE_DEFAULTS = {"stretch": "fallback", "denoise": "preserve", "export": "stop"}


def failure_actions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Request, else stage default, else fallback; any stop among the overrides makes every stage of the run stop."""
    default = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in FAILURE_DEFAULTS.items() for x in (F.lit(k), F.lit(v))]), F.col("stage")), F.lit("fallback"))
    stop = df.groupBy(*keys).agg(F.max(F.coalesce(F.col("override") == "stop", F.lit(False))).alias("_any"))
    j = df.join(stop, keys)
    act = F.coalesce("requested", default)
    return j.withColumn("action", F.when((act == "stop") | F.col("_any"), "stop").otherwise(act)).drop("_any")


# fixed values: stage that follows an accepted one
NEXT_STAGE = {1: 2, 2: 3, 3: 4, 4: 5, 5: 6}


def next_stage(runs: DataFrame, key: str) -> DataFrame:
    last = runs.where("accepted").groupBy(key).agg(F.max_by("stage", "step").alias("stage"))
    m = F.create_map(*[x for k, v in NEXT_STAGE.items() for x in (F.lit(k), F.lit(v))])
    return last.withColumn("next_stage", F.try_element_at(m, F.col("stage").cast("int")))


def seal(code: Column, status: Column, escalate: Column, value: Column, threshold: Column) -> Column:
    """First 20 hex digits of the digest of the authorising fields in canonical (sorted key) JSON."""
    doc = F.to_json(F.struct(code.alias("code"), escalate.alias("escalate"), status.alias("status"), threshold.alias("threshold"), value.alias("value")), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(doc, 256), 1, 20)


def verify_seals(gates: DataFrame) -> DataFrame:
    """Gate rows whose stored seal no longer fits their authorising fields."""
    s = seal(F.col("code"), F.col("status"), F.col("escalate"), F.col("value"), F.col("threshold"))
    return gates.withColumn("expected", s).where(~F.col("seal").eqNullSafe(F.col("expected")))


def join_reviews(receipts: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Receipts with their review: none, ambiguous (several), stale (digest differs) or bound."""
    r = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("bound_digest").alias("bound_digest"))
    j = receipts.join(r, key, "left")
    st = F.when(F.col("n").isNull(), "unreviewed").when(F.col("n") > 1, "ambiguous").when(F.col("bound_digest") != F.col("digest"), "stale").otherwise("bound")
    return j.select(key, st.alias("state"), F.coalesce("n", F.lit(0)).alias("n_reviews"))


def latest_revision(df: DataFrame, key: str, number: str) -> DataFrame:
    """Last revision and whether the numbering is consecutive and unique."""
    g = df.groupBy(key).agg(
        F.min(number).alias("lo"), F.max(number).alias("latest"), F.countDistinct(number).alias("k"), F.count(F.lit(1)).alias("n"), F.max_by("actor", number).alias("actor"))
    return g.withColumn("consecutive", (F.col("latest") - F.col("lo") + 1 == F.col("k")) & (F.col("k") == F.col("n")))


def canonical_digest(cols: dict[str, Column]) -> Column:
    """Digest of canonical JSON: keys sorted, no blanks."""
    doc = F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]), {"ignoreNullFields": "false"})
    return F.sha2(doc, 256)
