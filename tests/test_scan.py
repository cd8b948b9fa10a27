"""Spread scans against numpy and pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from astrolake.functions import scan as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 30_000
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 6, n))
    v = np.where(rng.random(n) < 0.4, 5.0, rng.normal(5, 2, n)).round(3)
    pdf = pd.DataFrame({"k": key, "id": rng.permutation(n), "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def test_exact_quantiles_all_dialects(skewed):
    pdf, df = skewed
    spec = {"a": (0.5, "pL"), "b": (0.9, "pL"), "c": (0.013, "pL"), "d": (0.9, "pF"), "e": (1.0, "pF"), "u": (0.5, "upper"), "z": (0.0, "pL")}
    got = {r["k"]: r for r in S.exact_quantiles(df, ["k"], "v", spec, "n").collect()}
    for k, g in pdf.groupby("k"):
        x = np.sort(g.v.to_numpy())
        want = {"a": np.percentile(x, 50), "b": np.percentile(x, 90), "c": np.percentile(x, 1.3), "d": x[min(int(len(x) * 0.9), len(x) - 1)], "e": x[-1], "u": x[len(x) // 2], "z": x[0]}
        assert got[k]["n"] == len(x)
        for name, w in want.items():
            assert got[k][name] == pytest.approx(w, abs=1e-9), (k, name)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 4095, 4096, 4097, 9000])
def test_exact_quantiles_counts_around_the_switch(spark, n):
    x = (np.arange(n) * 7919 % 10007).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": x}))
    r = S.exact_quantiles(df, ["k"], "v", {"m": (0.5, "pL"), "q": (0.05, "pL"), "f": (0.1, "pF")}).first()
    s = np.sort(x)
    assert r["m"] == np.median(x)
    assert r["q"] == pytest.approx(np.percentile(x, 5))
    assert r["f"] == s[min(int(n * 0.1), n - 1)]


def test_exact_quantiles_ignore_nulls_and_match_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", 2.0), ("b", None)], "k string, v double")
    got = {r["k"]: r["m"] for r in S.exact_median(df, ["k"], "v", "m").collect()}
    assert got == {None: 2.0, "a": 2.0}


@pytest.mark.parametrize("desc", [False, True])
def test_ranked_is_exact_under_ties(skewed, desc):
    pdf, df = skewed
    r = S.ranked(df, ["k"], "v", "id", desc=desc, total="n", running={"cum": F.col("v")}).toPandas()
    w = pdf.sort_values(["k", "v", "id"], ascending=[True, not desc, True]).copy()
    w["rk"] = w.groupby("k").cumcount() + 1
    w["cum"] = w.groupby("k").v.cumsum()
    m = r.merge(w, on=["k", "id"], suffixes=("", "_w"))
    assert (m.rk == m.rk_w).all() and len(m) == len(pdf)
    assert np.allclose(m["cum"], m.cum_w)
    assert (m.n == m.groupby("k").id.transform("count")).all()


def test_ranked_spreads_one_hot_value(spark):
    """A value shared by every row is still cut by the tie breaker, not ranked in one bucket."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), "id", F.lit(2.5).alias("v"))
    r = S.ranked(df, ["k"], "v", "id").toPandas().sort_values("id")
    assert (r.rk.to_numpy() == np.arange(1, 20_001)).all()


def test_chunked_scans(spark):
    rng = np.random.default_rng(3)
    n = 5000
    pdf = pd.DataFrame({"k": rng.integers(0, 3, n), "o": rng.permutation(n), "v": rng.normal(size=n)})
    pdf["m"] = np.where(rng.random(n) < 0.01, pdf.v, np.nan)
    df = spark.createDataFrame(pdf).withColumn("m", F.when(~F.isnan("m"), F.col("m")))
    w = pdf.sort_values(["k", "o"]).copy()
    w["last"] = w.groupby("k").m.ffill()
    w["sum"] = w.groupby("k").v.cumsum()
    w["lag"] = w.groupby("k").v.shift(1)
    w["mx"] = w.groupby("k").v.cummax().groupby(w.k).shift(1)
    w["pos"] = w.groupby("k").cumcount()
    d = S.carry_last(df, ["k"], "o", "m", "last", width=37)
    d = S.carry_sum(d, ["k"], "o", F.col("v"), "sum", width=41)
    d = S.lag_by(d, ["k"], "o", "v", "lag", width=29)
    d = S.carry_max(d, ["k"], "o", "v", "mx", width=31)
    d = S.rank_by_id(d, ["k"], "o", "pos", width=33)
    got = d.toPandas().sort_values(["k", "o"])
    for c in ("last", "sum", "lag", "mx", "pos"):
        assert np.allclose(got[c].to_numpy(dtype=float), w[c].to_numpy(dtype=float), equal_nan=True), c


def test_answers_hold_when_the_group_table_is_too_large_to_broadcast(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    q = {r["k"]: r["m"] for r in S.exact_quantiles(df, ["k"], "v", {"m": (0.3, "pL")}).collect()}
    for k, g in pdf.groupby("k"):
        assert q[k] == pytest.approx(np.percentile(g.v, 30))
    r = S.ranked(df, ["k"], "v", "id").toPandas()
    w = pdf.sort_values(["k", "v", "id"]).copy()
    w["want"] = w.groupby("k").cumcount() + 1
    m = r.merge(w[["id", "want"]], on="id")
    assert len(m) == len(pdf) and (m.rk == m.want).all()


def test_rank_cuts_are_compared_once_a_row(spark):
    df = spark.createDataFrame([(i % 2, None if i % 13 == 0 else float(i * 37 % 101), i) for i in range(600)], "g long, v double, id long")
    out = S.ranked(df, ["g"], "v", "id", total="n")
    rows = out.collect()
    for g in (0, 1):
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["rk"])
        assert [r["rk"] for r in mine] == list(range(1, 301)) and {r["n"] for r in mine} == {300}
        known = [(r["v"], r["id"]) for r in mine if r["v"] is not None]
        assert known == sorted(known)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("_cv#") < 62
