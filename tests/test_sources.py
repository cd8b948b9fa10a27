"""File sources, the publishing sink and incremental intake on real folders."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from astrolake.sources import files as FS
from astrolake.sources import headers as HD
from astrolake.sources import sink as SK
from astrolake.sources import tables as TB
from astrolake.streaming import intake as S


def test_list_and_read_headers(spark, tmp_path):
    card = lambda t: t.ljust(80)
    head = card("SIMPLE  =                    T") + card("GAIN    = 100 / unit") + card("EXPTIME = 3.0D+02") + card("OBJECT  = 'M 42 / x'") + card("END") + card("GAIN    = 5")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.fits").write_text(head)
    for n in ("b.FIT", ".hidden.fits", "clip.mp4", "notes.txt"):
        (tmp_path / n).write_text("x")
    got = {r["name"]: r["state"] for r in FS.list_frames(spark, str(tmp_path)).collect()}
    assert got == {"a.fits": "frame", "b.FIT": "frame", "clip.mp4": "error"}
    raw = spark.read.format("binaryFile").load(str(tmp_path / "sub")).select(F.col("path").alias("frame"), "content")
    h = {r["key"]: (r["raw"], r["value"]) for r in HD.read_headers(raw).collect()}
    assert h == {"SIMPLE": ("T", None), "GAIN": ("100", 100.0), "EXPTIME": ("3.0D+02", 300.0), "OBJECT": ("M 42 / x", None)}


def test_sequence_file(spark, tmp_path):
    (tmp_path / "r.seq").write_text(
        "S 'x' 1 3 3 5 0 1\nI 1 1\nI 2 0\nI 3 1\nR0 2.1 2.2 0.9 1 100 50 H 1 0 3.5 0 1 -2 0 0 1\nR0 short row\nR0 2.5 2.6 0.8 1 90 40 H 1 0 7 0 1 4 0 0 1\n")
    r = TB.read_sequence(TB.read_lines(spark, str(tmp_path))).orderBy("index").collect()
    assert [(x["index"], x["included"], x["fwhm"], x["h"][2]) for x in r] == [(1, True, 2.1, 3.5), (3, True, 2.5, 7.0)]


def test_of_two_writers_of_a_version_one_wins(spark, tmp_path):
    root = str(tmp_path / "race")
    ready = threading.Barrier(4)

    def write(k):
        df = spark.range(10 + k).toDF("id")
        path = SK._staged(df, root, None)
        ready.wait()
        return k, SK._commit(spark, root, "v 1/x", path, 10 + k)

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(4)))
    winners = [k for k, won in done if won]
    assert len(winners) == 1 and SK.manifest(spark, root).count() == 1
    assert SK.published(spark, root, "v 1/x").count() == 10 + winners[0]


def test_publish_takes_any_label(spark, tmp_path):
    root = str(tmp_path / "labels")
    df = spark.createDataFrame([(1, "Ha"), (2, "Ha"), (3, "a/b=c d"), (4, None), (5, "01")], "id int, filter string")
    m = SK.publish_each(df, root, "filter")
    assert {(r.version, r.rows) for r in m.collect()} == {("vHa", 2), ("va/b=c d", 1), ("vunlabelled", 1), ("v01", 1)}
    assert [r.id for r in SK.published(spark, root, "va/b=c d").collect()] == [3]
    with pytest.raises(ValueError, match="vHa"):
        SK.publish_each(spark.createDataFrame([(9, "Ha"), (9, "new")], "id int, filter string"), root, "filter")
    assert SK.published(spark, root, "vHa").count() == 2 and SK.published(spark, root, "vnew").count() == 1


def test_publish_is_all_or_nothing(spark, tmp_path):
    df = spark.range(10).withColumn("s", F.col("id") % 2)
    root = str(tmp_path / "out")
    m = SK.publish(df, root, "v1", ["s"])
    assert [(r["version"], r["rows"]) for r in m.collect()] == [("v1", 10)]
    with pytest.raises(ValueError):
        SK.publish(df, root, "v1")
    assert SK.published(spark, root, "v1").count() == 10


def _events(spark, lo, hi):
    return spark.range(lo, hi).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"),
        F.lit('{"k": 2}').alias("props"))


def test_intake_scores_only_new_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _events(spark, 0, 5).coalesce(1).write.parquet(src)
    assert S.intake(spark, src, "*.parquet", out).count() == 5
    _events(spark, 5, 8).coalesce(1).write.mode("append").parquet(src)
    again = S.intake(spark, src, "*.parquet", out)
    assert again.count() == 8 and again.select("cache_key").distinct().count() == 8


def test_late_row_past_the_watermark_is_dropped(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = _events(spark, 0, 1).schema

    def step(df):
        df.coalesce(1).write.mode("append").parquet(src)
        S.run_once(S.rolling_quality(S.event_stream(spark, src, "*.parquet", schema).withWatermark("ts", "1 hour"), "1 day"), out)

    step(_events(spark, 0, 72))
    step(_events(spark, 1, 2))
    step(_events(spark, 200, 201))
    n = {r["start"].day: r["n"] for r in spark.read.parquet(f"{out}/data").collect()}
    assert n[1] == 24 and n[2] == 24
