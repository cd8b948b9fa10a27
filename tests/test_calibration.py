"""Matching by several optional tolerances against all pairs."""

import math

import numpy as np
import pytest

from astrolake.operators import calibration as K

LIGHT, MASTER = "id long, cam string, temp double, gain double, exposure double, filter string", "mid long, mname string, kind string, cam string, temp double, gain double, exposure double, filter string"
TOL = {"temp": 2.0, "gain": 0.0, "exposure": 0.5}


def _has(v):
    return v is not None and math.isfinite(v)


def _want(lights, masters, optional, strict):
    out = []
    for i, cam, *values, _ in lights:
        found = []
        for mid, name, _, mcam, *settings, _ in masters:
            score, ok = 0.0, cam is not None and cam == mcam
            for (key, allowed), a, b in zip(TOL.items(), values, settings):
                if not _has(a) and not _has(b):
                    ok = ok and key in optional
                elif not _has(a) or not _has(b) or abs(a - b) > allowed:
                    ok = False
                else:
                    score += abs(a - b) / allowed if allowed else abs(a - b)
            if ok:
                found.append((round(score, 9), name, mid))
        best = min(found, default=None)
        tie = strict and best is not None and len({n for s, n, _ in found if s == best[0]}) > 1
        out.append((i, "missing" if best is None else "tie" if tie else "matched", None if best is None or tie else best[2], None if best is None or tie else best[0], len(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    pick = lambda values: values[int(rng.integers(len(values)))]
    temps, gains, exposures = [None, float("nan"), float("inf"), -10.0, -9.0, -8.5, -0.0, 0.0, 2.0, 4.0], [None, 0.0, 100.0], [None, 30.0, 30.4, 60.0]
    lights = [(int(i // 2), pick(["a", "b", None]), pick(temps), pick(gains), pick(exposures), None) for i in range(300)]
    masters = [(int(i), pick(["m1", "m2", f"n{i}"]), "dark", pick(["a", "b", None]), pick(temps), pick(gains), pick(exposures), None) for i in range(80)]
    return lights, masters + masters[:3]


@pytest.mark.parametrize("optional", [(), ("temp", "gain"), ("temp", "gain", "exposure")])
@pytest.mark.parametrize("strict", [False, True])
def test_matches_equal_all_pairs(spark, rows, optional, strict):
    lights, masters = rows
    l, m = spark.createDataFrame(lights, LIGHT), spark.createDataFrame(masters, MASTER)
    got = K.match_by_tolerances(l, m, ["cam"], TOL, optional, strict).collect()
    assert sorted((tuple(r) for r in got), key=str) == _want(lights, masters, optional, strict)
    assert not optional or any(r.status == "matched" for r in got)
    assert not (strict and optional) or any(r.status == "tie" for r in got)


def test_no_rows(spark, rows):
    lights, masters = rows
    l, m = spark.createDataFrame(lights, LIGHT), spark.createDataFrame(masters, MASTER)
    assert K.match_by_tolerances(l.where("false"), m, ["cam"], TOL).count() == 0
    assert {r.status for r in K.match_by_tolerances(l, m.where("false"), ["cam"], TOL).collect()} == {"missing"}
    assert K.plan_by_tolerances(l, m.where("false"), TOL, "exposure").where("reason <> 'no_dark'").isEmpty()


def test_one_setting_of_very_many_lights_meets_masters_once(spark):
    l = spark.range(20_000).selectExpr("id", "'a' as cam", "-10d as temp", "100d as gain", "30d as exposure", "string(null) as filter")
    m = spark.range(500).selectExpr("id as mid", "concat('m', id) as mname", "'dark' as kind", "'a' as cam", "-10d as temp", "100d as gain", "30d as exposure", "string(null) as filter")
    best = K.best_for_settings(l, m, ["cam"], TOL)
    assert [(r.best.mname, r.tied, r.candidates) for r in best.collect()] == [("m0", True, 500)]


def test_plan_reasons(spark):
    at = (-10.0, 100.0, 30.0)
    masters = [(1, "d", "dark", "c", *at, None), (2, "f", "flat", "c", -10.0, 100.0, 1.0, "ha "), (3, "g", "flat", "c", -10.0, 100.0, 1.0, None), (4, "b", "bias", "c", -10.0, 100.0, 0.0, None)]
    lights = [(1, "c", *at, "HA"), (2, "c", *at, "OIII"), (3, "c", *at, None), (4, "c", -10.0, 100.0, 60.0, "HA"), (5, "c", 50.0, 100.0, 30.0, "HA")]
    l, m = spark.createDataFrame(lights, LIGHT), spark.createDataFrame(masters, MASTER)
    plan = lambda **kw: {r.id: (r.dark, r.flat, r.bias, r.reason) for r in K.plan_by_tolerances(l, m, TOL, "exposure", **kw).collect()}
    assert plan() == {1: (1, 2, 4, "complete"), 2: (1, 3, 4, "complete"), 3: (1, 2, 4, "complete"), 4: (None, 2, 4, "no_dark"), 5: (None, None, None, "no_dark")}
    loose = plan(allow_missing_dark=True)
    assert loose[4] == (None, 2, 4, "dark_waived") and loose[5] == (None, None, None, "dark_waived")
    strict = plan(strict=True)
    assert strict[1] == (1, 2, 4, "complete") and strict[2] == (1, None, 4, "unlabelled_flat") and strict[3] == (1, 2, 4, "complete")
