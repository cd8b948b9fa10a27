"""Incremental frame intake with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from astrolake.functions.scan import attach, carry_max
from astrolake.session import ensure_checkpoint_dir

SCORE_VERSION = "1"  # part of the cache key: a new scoring rule scores everything again
#: Size of a quantile sketch, and the rank error that goes with it: an estimate's rank is that share of the rows off at most.
SKETCH, RANK_ERROR = 800, 0.015
_STORE = "cache_key string, score double, version string, run string, batch long"


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def cache_key(version: str = SCORE_VERSION) -> Column:
    """Content and parameters of a row's score; every part is told from its neighbours and from null."""
    parts = [F.coalesce(F.to_json(F.struct("event_id", "value", "props")), F.lit("")), F.lit(version)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def score_rule() -> Column:
    return F.col("value") * F.get_json_object("props", "$.k").cast("int")


def score(df: DataFrame) -> DataFrame:
    """Per-row score with its cache key (content and parameters)."""
    return df.select("event_id", "event_type", score_rule().alias("score"), cache_key().alias("cache_key"))


def score_store(spark: SparkSession, store: str) -> DataFrame:
    """All scores kept in ``store`` so far: cache_key, score, and the version, run and batch they come from."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.read.schema(_STORE).parquet(store)


def cached_intake(spark: SparkSession, folder: str, pattern: str, out: str, store: str, version: str = SCORE_VERSION) -> DataFrame:
    """event_id, event_type, score, cached of all files this checkpoint has taken in; a score found in ``store`` is not computed again.

    Each batch is joined with the store on the cache key; only rows without a kept score go through the scoring rule,
    and their scores, one a key, join the store.  A batch overwrites its own folders in ``out`` and in the store and does not read the
    latter, so a repeated batch changes nothing.  Stored scores are partitioned by version: another version reads none of
    the old ones.  A null score is kept like any other; two rows of one content share one key.
    """
    run = out.rstrip("/").rsplit("/", 1)[-1]

    def take(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        known = score_store(session, store).where((F.col("version") == version) & ~((F.col("run") == run) & (F.col("batch") == batch)))
        known = known.groupBy("cache_key").agg(F.first("score").alias("kept"), F.lit(True).alias("cached"))
        seen = rows.withColumn("cache_key", cache_key(version)).join(known, "cache_key", "left")
        done = seen.select("event_id", "event_type", F.when(F.col("cached"), F.col("kept")).otherwise(score_rule()).alias("score"), F.coalesce("cached", F.lit(False)).alias("cached"), "cache_key")
        done.write.mode("overwrite").parquet(f"{out}/data/batch={batch}")
        fresh = session.read.parquet(f"{out}/data/batch={batch}").where("not cached").groupBy("cache_key").agg(F.first("score").alias("score"))
        fresh.write.mode("overwrite").parquet(f"{store}/version={version}/run={run}/batch={batch}")

    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    stream = event_stream(spark, folder, pattern, schema)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").select("event_id", "event_type", "score", "cached", "batch")


def deduplicate(df: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per content digest within the watermark."""
    d = with_event_time(df).withColumn("digest", F.sha2(F.concat_ws("|", "event_type", F.round("value", 1).cast("string"), F.col("user_id").cast("string")), 256))
    return d.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["digest"]).select("digest")


def rolling_quality(df: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows per kind: count, mean, deviation, median."""
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = df.groupBy(win.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", 0.5).alias("median"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "sd", "median")


def pane_sketches(df: DataFrame, pane_seconds: int, keys: list[str]) -> DataFrame:
    """(pane, keys, n, total, sketch) of each pane of event time; the state of a pane is one quantile sketch, whatever it takes in.

    Runs on a table and on a stream alike.  Values that are null or not a number take no part.
    """
    good = df.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).withColumn("value", F.col("value").cast("double"))
    g = good.groupBy(F.window("ts", f"{pane_seconds} seconds").alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch")).select(F.col("w.start").alias("pane"), *keys, "n", "total", "sketch")


def _starts(pane: Column, pane_seconds: int, size_seconds: int) -> Column:
    """Starts of all windows that hold a pane."""
    return F.transform(F.sequence(F.lit(0), F.lit(size_seconds // pane_seconds - 1)), lambda k: pane - F.make_dt_interval(secs=(k * pane_seconds).cast("decimal(18,6)")))


def rolling_spread(panes: DataFrame, pane_seconds: int, size_seconds: int, keys: list[str]) -> DataFrame:
    """start, keys, n, total, mean, lo, p10, p50, p90, hi, ratio of every window of ``size_seconds`` that slides by one pane.

    A window merges the sketches of its panes, so no row is counted again and a window's values never meet in one buffer.  lo and hi are exact, the
    quantiles have ranks within RANK_ERROR; ratio is p90 / p10, null where p10 is zero.
    """
    if size_seconds % pane_seconds:
        raise ValueError("a window must be a whole number of panes")
    spans = panes.withColumn("start", F.explode(_starts(F.col("pane"), pane_seconds, size_seconds)))
    w = spans.groupBy("start", *keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
    q = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in (0.0, 0.1, 0.5, 0.9, 1.0)]))
    named = w.withColumn("q", q).select("start", *keys, "n", "total", (F.col("total") / F.col("n")).alias("mean"), *[F.col("q")[i].alias(name) for i, name in enumerate(("lo", "p10", "p50", "p90", "hi"))])
    return named.withColumn("ratio", F.col("p90") / F.nullif(F.col("p10"), F.lit(0.0)))


def rank_check(rows: DataFrame, windows: DataFrame, pane_seconds: int, size_seconds: int, keys: list[str]) -> DataFrame:
    """Whether the ranks of p10, p50 and p90 are within RANK_ERROR of what they stand for, by counting all rows of each window."""
    at = rows.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).withColumn("start", F.explode(_starts(F.window("ts", f"{pane_seconds} seconds")["start"], pane_seconds, size_seconds)))
    j = attach(at.select("start", *keys, F.col("value").cast("double").alias("v")), windows.select("start", *keys, "n", "p10", "p50", "p90"), ["start", *keys])
    near = []
    for name, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)):
        slack = F.max("n") * RANK_ERROR + 1
        near.append(((F.count_if(F.col("v") < F.col(name)) <= p * F.max("n") + slack) & (F.count_if(F.col("v") <= F.col(name)) >= p * F.max("n") - slack)).alias(f"{name}_near"))
    return j.groupBy("start", *keys).agg(*near)


def session_quality(df: DataFrame, gap: str) -> DataFrame:
    """Session windows per target: quiet gaps end a session."""
    g = df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.select("user_id", F.col("w.start").alias("start"), "n", "mean")


def late_rows(df: DataFrame, delay_seconds: float) -> DataFrame:
    """Side output: rows more than ``delay`` behind the newest event time seen before them."""
    t = df.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    m = carry_max(t, ["event_type"], "event_id", "_t", "_seen")
    return m.where(F.col("_t") < F.col("_seen") - int(delay_seconds * 1e6)).select("event_id", "event_type", ((F.col("_seen") - F.col("_t")) / 1e6).alias("late_by"))


def run_once(stream: DataFrame, out: str, mode: str = "append") -> None:
    """Process everything available now, exactly once per checkpoint, into parquet."""
    q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def run_updates(stream: DataFrame, out: str, keys: list[str]) -> DataFrame:
    """Process everything available now in update mode; the newest row of each key, open windows included.

    Each batch overwrites its own folder, so a repeated batch changes nothing.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/data/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{out}/data")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("_r")).select(*keys, "_r.*")


def intake(spark: SparkSession, folder: str, pattern: str, out: str) -> DataFrame:
    """Score only files not seen by this checkpoint yet; returns all scores so far."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    run_once(score(event_stream(spark, folder, pattern, schema)), out)
    return spark.read.parquet(f"{out}/data")
