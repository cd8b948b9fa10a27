"""Score cache and rolling sketches beyond what the given tables reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolake.streaming import intake as S

EVENT = "event_id long, event_type string, value double, props string"


def _put(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def test_only_new_content_is_scored(spark):
    base = S.work_folder(spark, "cache-test")
    folder, store = f"{base}/in", f"{base}/store"
    _put(spark, folder, [(1, "a", 2.0, '{"k": 3}'), (2, "a", None, '{"k": 3}'), (None, None, 1.0, None), (4, "a", 1.0, "no json")])
    first = S.cached_intake(spark, folder, "*.parquet", f"{base}/r1", store).collect()
    assert {(r.event_id, r.score, r.cached) for r in first} == {(1, 6.0, False), (2, None, False), (None, None, False), (4, None, False)}
    # one new file: a repeated row, a changed value under an old id, and a new row
    _put(spark, folder, [(1, "a", 2.0, '{"k": 3}'), (1, "a", 5.0, '{"k": 3}'), (5, "b", 1.0, '{"k": 1}')])
    again = S.cached_intake(spark, folder, "*.parquet", f"{base}/r1", store)
    assert again.where("batch = 1").count() == 3 and again.where("batch = 1 and not cached").count() == 2
    fresh = S.cached_intake(spark, folder, "*.parquet", f"{base}/r2", store)
    assert fresh.count() == 7 and fresh.where("not cached").isEmpty()
    assert {(r.event_id, r.score) for r in fresh.collect()} == {(1, 6.0), (1, 15.0), (2, None), (None, None), (4, None), (5, 1.0)}
    other = S.cached_intake(spark, folder, "*.parquet", f"{base}/r3", store, version="2")
    assert other.count() == 7 and other.where("cached").isEmpty()
    assert S.score_store(spark, store).where("version = '1'").count() == S.score_store(spark, store).where("version = '2'").count() == 6


def test_a_repeated_batch_changes_nothing(spark):
    base = S.work_folder(spark, "cache-retry")
    folder, store, out = f"{base}/in", f"{base}/store", f"{base}/r"
    _put(spark, folder, [(i, "a", float(i), '{"k": 2}') for i in range(20)])
    want = sorted(S.cached_intake(spark, folder, "*.parquet", out, store).collect())
    # the commit of the batch is lost, as when the driver dies after writing: the same batch runs again
    fs = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/state/commits/0"), False)
    assert sorted(S.cached_intake(spark, folder, "*.parquet", out, store).collect()) == want
    assert S.score_store(spark, store).count() == 20


def test_sketched_windows_hold_their_ranks_and_stay_small(spark):
    rng = np.random.default_rng(4)
    base = np.datetime64("2024-01-01T00:00:00", "us")
    n = 120_000
    at = (base + (rng.random(n) * 24 * 3600e6).astype("timedelta64[us]")).astype(object).tolist()
    values = np.where(rng.random(n) < 0.3, 7.0, rng.lognormal(0, 2, n)).tolist()
    rows = spark.createDataFrame([(t, "hot" if i % 10 else "cold", v) for i, (t, v) in enumerate(zip(at, values))], "ts timestamp, kind string, value double")
    odd = spark.createDataFrame([(at[0], None, 1.0), (at[0], "bad", None), (at[0], "bad", float("nan"))], "ts timestamp, kind string, value double")
    rows = rows.unionByName(odd)
    panes = S.pane_sketches(rows, 3600, ["kind"]).cache()
    assert panes.agg(F.max(F.length("sketch"))).first()[0] < 40_000  # 4,500 values of 8 bytes each would already be as much
    w = S.rolling_spread(panes, 3600, 6 * 3600, ["kind"])
    got = w.where("kind = 'hot'").join(S.rank_check(rows, w, 3600, 6 * 3600, ["kind"]), ["start", "kind"])
    assert got.count() == 29 and got.where("not (p10_near and p50_near and p90_near)").isEmpty()
    assert abs(w.where("kind is null").first()["p50"] - 1.0) < 1e-12 and w.where("kind = 'bad'").isEmpty()
    with pytest.raises(ValueError):
        S.rolling_spread(panes, 3600, 5000, ["kind"])
    assert S.rolling_spread(S.pane_sketches(rows.where("false"), 3600, ["kind"]), 3600, 7200, ["kind"]).isEmpty()


def test_exact_window_bounds(spark):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", 5.0), ("2024-01-01 01:00:00", 5.0), ("2024-01-01 00:59:59", 0.0)], "t string, value double").select(F.col("t").cast("timestamp").alias("ts"), "value")
    w = S.rolling_spread(S.pane_sketches(rows, 3600, []), 3600, 7200, []).orderBy("start").collect()
    assert [(str(r.start)[11:13], r.n, r.lo, r.hi, r.ratio) for r in w] == [("23", 1, 0.0, 0.0, None), ("00", 3, 0.0, 5.0, None), ("01", 2, 5.0, 5.0, 1.0)]
