"""Streaming queries and their batch twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from astrolake import views as V
from astrolake.plans.registry import query
from astrolake.session import cut
from astrolake.streaming import intake as S


def ev(s, d):
    return S.with_event_time(V.table(s, d, "events"))


def stream(s, d):
    return S.event_stream(s, d, "events.parquet", V.table(s, d, "events").schema)


@query("s01_incremental_intake", "i:event_id s:event_type d:score", "SELECT event_id, event_type, value * CAST(json_extract_string(props, '$.k') AS INTEGER) AS score FROM events")
def _(s, d):
    return S.intake(s, d, "events.parquet", S.work_folder(s, "intake"))


@query("s01_cached_intake", "i:pass s:event_type i:scored,reused d:total", """
WITH e AS (SELECT event_type, event_id % 10 = 0 AS late, value * CAST(json_extract_string(props, '$.k') AS INTEGER) AS score FROM events)
SELECT 1 AS pass, event_type, count(*) FILTER (WHERE NOT late) AS scored, 0 AS reused, sum(score) FILTER (WHERE NOT late) AS total FROM e GROUP BY event_type HAVING scored > 0
UNION ALL SELECT 2, event_type, count(*) FILTER (WHERE late), count(*) FILTER (WHERE NOT late), sum(score) FROM e GROUP BY event_type
UNION ALL SELECT 3, event_type, count(*) FILTER (WHERE late), count(*) FILTER (WHERE NOT late), sum(score) FROM e GROUP BY event_type
UNION ALL SELECT 4, event_type, count(*), 0, sum(score) FROM e GROUP BY event_type""")
def _(s, d):
    """A first file; a new reader after a second file, which alone is scored; the same reader again; a new version, which scores all."""
    base = S.work_folder(s, "cached")
    folder, store = f"{base}/in", f"{base}/scores"
    rows, late = V.table(s, d, "events"), F.col("event_id") % 10 == 0

    def told(number, out, version="1"):
        got = S.cached_intake(s, folder, "*.parquet", f"{base}/{out}", store, version)
        return got.groupBy("event_type").agg(F.count_if(~F.col("cached")).alias("scored"), F.count_if("cached").alias("reused"), F.sum("score").alias("total")).select(F.lit(number).alias("pass"), "*")

    rows.where(~late).write.mode("append").parquet(folder)
    first = told(1, "reader-1")
    rows.where(late).write.mode("append").parquet(folder)
    parts = [first, told(2, "reader-2"), told(3, "reader-2"), told(4, "reader-3", "2")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("s02_idempotent_intake", "s:digest", "SELECT DISTINCT sha256(concat(event_type, '|', CAST(round(value, 1) AS VARCHAR), '|', user_id)) AS digest FROM events")
def _(s, d):
    out = S.work_folder(s, "dedup")
    S.run_once(S.deduplicate(stream(s, d), "60 days"), out)
    return s.read.parquet(f"{out}/data")


def _win(step: str, size: str) -> str:
    return f"""SELECT strftime(st, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, median(value) AS median
FROM (SELECT *, unnest(range(time_bucket(INTERVAL '{step}', ts) - INTERVAL '{size}' + INTERVAL '{step}', time_bucket(INTERVAL '{step}', ts) + INTERVAL '1 second', INTERVAL '{step}')) AS st FROM events) GROUP BY ALL"""


def _show(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("s03_tumbling_quality", "s:start,event_type i:n d:mean,sd,median", _win("1 day", "1 day"))
def _(s, d):
    return _show(S.rolling_quality(ev(s, d), "1 day"))


@query("s03_sliding_quality", "s:start,event_type i:n d:mean,sd,median", _win("6 hours", "1 day"))
def _(s, d):
    return _show(S.rolling_quality(ev(s, d), "1 day", "6 hours"))


@query("s03_session_quality", "i:user_id,n s:start d:mean", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS brk FROM events), k AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, avg(value) AS mean FROM k GROUP BY user_id, k""")
def _(s, d):
    return _show(S.session_quality(ev(s, d), "6 hours"))


@query("s03_late_rows", "i:event_id s:event_type d:late_by", """WITH z AS (SELECT event_id, event_type, CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 3 HOURS ELSE ts END AS ts FROM events), m AS (SELECT *, max(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM z)
SELECT event_id, event_type, (epoch_us(seen) - epoch_us(ts)) / 1e6 AS late_by FROM m WHERE epoch_us(ts) < epoch_us(seen) - 3600000000""")
def _(s, d):
    e = ev(s, d).withColumn("ts", F.when(F.col("event_id") % 50 == 0, F.col("ts") - F.expr("INTERVAL 3 HOURS")).otherwise(F.col("ts")))
    return S.late_rows(e, 3600)


@query("s03_streaming_windows", "s:start,event_type i:n d:mean,sd,median", _win("1 day", "1 day"))
def _(s, d):
    out = S.work_folder(s, "windows")
    q = S.rolling_quality(S.with_event_time(stream(s, d)).withWatermark("ts", "1 hour"), "1 day")
    return _show(S.run_updates(q, out, ["start", "event_type"]))


_SPREAD = f"""SELECT start, event_type, count(*) AS n, sum(value) AS total, min(value) AS lo, max(value) AS hi, true AS p10_near, true AS p50_near, true AS p90_near, true AS ratio_ok FROM (
SELECT strftime(st, '%Y-%m-%d %H:%M') AS start, event_type, value FROM (SELECT *, unnest(range(time_bucket(INTERVAL '6 hours', ts) - INTERVAL '18 hours', time_bucket(INTERVAL '6 hours', ts) + INTERVAL '1 second', INTERVAL '6 hours')) AS st FROM events)) GROUP BY ALL"""


def _spread(s, d, panes):
    """Windows of a day that slide by six hours, and whether the ranks of their quantiles hold against all rows."""
    w = cut(S.rolling_spread(panes, 21600, 86400, ["event_type"]))
    j = w.join(S.rank_check(ev(s, d), w, 21600, 86400, ["event_type"]), ["start", "event_type"])
    return _show(j.withColumn("ratio_ok", (F.col("p10") == 0) | (F.abs(F.col("ratio") * F.col("p10") - F.col("p90")) < 1e-9 * F.abs(F.col("p90")) + 1e-12)))


@query("s03_rolling_spread", "s:start,event_type i:n d:total,lo,hi b:p10_near,p50_near,p90_near,ratio_ok", _SPREAD)
def _(s, d):
    return _spread(s, d, S.pane_sketches(ev(s, d), 21600, ["event_type"]))


@query("s03_streaming_spread", "s:start,event_type i:n d:total,lo,hi b:p10_near,p50_near,p90_near,ratio_ok", _SPREAD)
def _(s, d):
    live = S.pane_sketches(S.with_event_time(stream(s, d)).withWatermark("ts", "1 hour"), 21600, ["event_type"])
    return _spread(s, d, S.run_updates(live, S.work_folder(s, "panes"), ["pane", "event_type"]))
