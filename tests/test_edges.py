"""Hand-made edge fixtures and closed-form properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from astrolake.functions import sky as K
from astrolake.functions import tiles as A
from astrolake.functions import tone as N
from astrolake.operators import components as C
from astrolake.operators import corpus as CO
from astrolake.operators import frame_stats as FS
from astrolake.operators import frames as R
from astrolake.operators import gates as G
from astrolake.operators import images as I
from astrolake.operators import joins as J
from astrolake.operators import ledger as L
from astrolake.operators import select as Q
from astrolake.operators import stack as ST
from astrolake.operators import stars as S


def frames(spark, sharp):
    return spark.createDataFrame([("s", i + 1, float(v)) for i, v in enumerate(sharp)], "session string, frame long, sharpness double")


def test_otsu_keeps_exactly_the_sharp_half(spark):
    rng = np.random.default_rng(123)
    sharp = np.concatenate([rng.normal(2500, 50, 10), rng.normal(1200, 50, 10)])
    got = {r["frame"] for r in Q.select_otsu(frames(spark, sharp), ["session"]).collect()}
    assert got == set(range(1, 11))


@pytest.mark.parametrize("sharp,reason,n", [([5, 4, 3], "few", 3), ([7] * 6, "uniform", 6), ([100, 99, 98, 97, 96], "calm", 4)])
def test_otsu_exceptions(spark, sharp, reason, n):
    rows = Q.select_otsu(frames(spark, sharp), ["session"]).collect()
    assert len(rows) == n and {r["reason"] for r in rows} == {reason}


def test_percent_keeps_at_least_one_and_rounds_half_even(spark):
    assert Q.select_percent(frames(spark, [1.0]), ["session"], 10).count() == 1
    assert Q.select_percent(frames(spark, range(5)), ["session"], 50).count() == 2


def test_utility_on_linear_decay(spark):
    q = np.linspace(2500, 1075, 20)
    rows = Q.select_utility(frames(spark, q), ["session"]).collect()
    norm = (q - q.min()) / (q.max() - q.min() + 1e-6)
    u = [norm[:k].mean() ** 2 * math.sqrt(k / 20) for k in range(1, 21)]
    best = 3 + int(np.argmax(u[2:19]))
    assert len(rows) == best


def test_empty_input_gives_empty_output(spark):
    e = frames(spark, [])
    assert Q.select_percent(e, ["session"]).count() == 0
    assert Q.select_otsu(e, ["session"]).count() == 0


def test_axial_mean_of_wrapping_axes(spark):
    for angles, want in (([89, -89], -90), ([10, 190, -170], 10), ([179, -1], -1)):
        d = spark.createDataFrame([(1, 3.0, 2.0, float(a)) for a in angles], "g int, fwhmx double, fwhmy double, angle double")
        r = S.axial_mean(d, ["g"]).first()
        assert abs(math.remainder(r["axis"] - want, 180)) < 1e-6
    round_star = spark.createDataFrame([(1, 2.0, 2.0, 10.0)], "g int, fwhmx double, fwhmy double, angle double")
    assert S.axial_mean(round_star, ["g"]).first()["status"] == "not_applicable"


def test_constant_and_non_finite_pixels(spark):
    nan, inf = float("nan"), float("inf")
    d = spark.createDataFrame([(1, [2.0] * 4), (2, [1.0, nan, inf, -inf, 3.0]), (3, []), (4, None), (5, [nan])], "frame int, tile array<double>")
    clean = {r["frame"]: r for r in FS.clean_finite(d).collect()}
    assert clean[2]["tile"] == [1.0, 2.0, 2.0, 2.0, 3.0] and clean[2]["n_nan"] == 1 and clean[2]["n_neginf"] == 1
    assert clean[3]["tile"] == [] and clean[4]["tile"] is None and clean[4]["n_nan"] == 0 and clean[5]["tile"] == [0.0]
    st = {r["frame"]: r for r in FS.image_stats(d.where("frame <> 5"), ["frame"]).collect()}
    assert st[1]["mad_sigma"] == 0 and st[1]["sd"] == 0 and st[1]["min_ratio"] == 1 and st[3]["mean"] is None and st[4]["mx"] is None
    assert FS.normalize_robust(d.where("frame = 1")).first()["tile"] == [0.0] * 4


def test_frame_statistics_against_numpy(spark):
    rng = np.random.default_rng(4)
    h, w, b = 7, 10, 4  # neither square nor made of whole blocks
    images = {i: rng.normal(size=(h, w)) for i in range(3)}
    d = spark.createDataFrame([(i, x.ravel().tolist(), "x") for i, x in images.items()], "frame int, tile array<double>, spread string")
    robust = lambda x: 1.4826 * np.median(np.abs(x - np.median(x)))
    cells = lambda x: [x[y : y + b, k : k + b] for y in range(0, h, b) for k in range(0, w, b)]
    spread, noise = FS.block_spread(d, ["frame"], w, b), FS.noise(d, ["frame"], w, b=b)
    for r in spread.collect():
        m = [np.median(c) for c in cells(images[r["frame"]])]
        assert r["spread"] == pytest.approx(np.percentile(m, 95) - np.percentile(m, 5)) and r["sky"] == pytest.approx(np.median(images[r["frame"]]))
    for r in noise.collect():
        x = images[r["frame"]]
        res = np.array([[x[y, k] - np.median(x[max(0, y - 1) : y + 2, max(0, k - 1) : k + 2]) for k in range(w)] for y in range(h)])
        s = [robust(c) for c in cells(res)]
        assert r["sigma"] == pytest.approx(robust(res[x <= np.percentile(x, 35)]))
        assert (r["block_median"], r["block_p90"]) == (pytest.approx(np.median(s)), pytest.approx(np.percentile(s, 90)))
    for df in (spread, noise, FS.image_stats(d, ["frame"]), FS.fit_plane(d, ["frame"], 7), FS.corner_uniformity(d, ["frame"], 7, centre=3)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_colour_statistics_against_numpy(spark):
    rng = np.random.default_rng(6)
    planes = {i: rng.uniform(0.1, 0.9, size=(6, 60)) for i in range(2)}
    rows = [(i, *[p.tolist() for p in x]) for i, x in planes.items()] + [(9, *[[0.5] * 4] * 6), (10, *[[]] * 6), (11, *[None] * 6)]
    d = spark.createDataFrame(rows, "img int, " + ", ".join(f"{c} array<double>" for c in ("r", "g", "b", "cr", "cg", "cb")))
    color, gains, fid = FS.color_stats(d, ["img"]), FS.match_gains(d, ["img"]), FS.fidelity_metrics(d, ["img"])
    got = {r["img"]: r for r in color.collect()}
    kept = {r["img"]: r for r in fid.collect()}
    for i, (r, g, b, cr, cg, cb) in planes.items():
        l = 0.2126 * r + 0.7152 * g + 0.0722 * b
        assert got[i]["bg_g"] == pytest.approx(np.median(g[l <= np.percentile(l, 30)])) and got[i]["p99_b"] == pytest.approx(np.percentile(b, 99))
        assert got[i]["corr_rb"] == pytest.approx(np.corrcoef(r, b)[0, 1])
        dark = l <= np.median(l)
        chroma = lambda *x: np.std((np.max(x, 0) - np.min(x, 0))[dark])
        assert kept[i]["n_bg"] == dark.sum() and kept[i]["chroma_noise_gain"] == pytest.approx(chroma(cr, cg, cb) / chroma(r, g, b))
    assert got[9]["corr_rg"] is None and got[9]["bg_r"] == 0.5 and got[10]["bg_r"] is None and got[11]["p99_r"] is None
    assert {r["img"]: r["gain_r"] for r in gains.collect()}[9] == pytest.approx(1) and kept[9]["n_bg"] == 4 and kept[10]["n_bg"] is None
    for df in (color, gains, fid):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_array_median_even_odd_empty(spark):
    d = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0, 2.0, 3.0],), ([],)], "t array<double>")
    rows = d.select(A.median_of(F.col("t")).alias("m"), A.mad_of(F.col("t")).alias("d"), A.quantile_of(F.col("t"), 0.25).alias("q")).collect()
    assert [r["m"] for r in rows] == [2.0, 2.5, None] and rows[0]["d"] == 1.0 and rows[1]["q"] == 1.75


def test_region_touching_the_edge_is_half_open(spark):
    px = spark.createDataFrame([(y, x, 1.0) for y in range(8) for x in range(8)], "y int, x int, v double")
    r = spark.createDataFrame([("e", "bg", 6, 6, 8, 8)], "region string, role string, x0 int, y0 int, x1 int, y1 int")
    assert I.assign_regions(px, r).count() == 4


def test_unique_match_is_symmetric_and_inclusive(spark):
    a = spark.createDataFrame([(1, "L", 0.0, 0.0), (2, "L", 5.0, 5.0), (3, "L", 9.0, 9.0), (4, "M", 0.0, 0.0)], "id long, layer string, x double, y double")
    b = spark.createDataFrame([(11, "L", 1.0, 0.0), (12, "L", 5.2, 5.0), (13, "L", 4.8, 5.0)], "id long, layer string, x double, y double")
    ab = {(r["id_a"], r["id_b"]) for r in J.match_unique(a, b, ["layer"], 1.0).collect()}
    ba = {(r["id_b"], r["id_a"]) for r in J.match_unique(b, a, ["layer"], 1.0).collect()}
    assert ab == ba == {(1, 11)}
    assert {r["id"] for r in J.unmatched(a, b, ["layer"], 1.0).collect()} == {3, 4}


def test_heap_of_copies_is_ambiguous_without_a_square(spark):
    a = spark.range(3000).select("id", F.lit("L").alias("layer"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    assert J.near_edges(a, a, ["layer"], 1.0).count() == 1
    assert J.match_unique(a, a, ["layer"], 1.0).count() == 0


def test_strict_tie_is_an_error(spark):
    l = spark.createDataFrame([(1, 5, 10.0), (2, 5, 100.0)], "id long, gain int, temp double")
    m = spark.createDataFrame([(7, "a", 5, 9.0), (8, "b", 5, 11.0)], "mid long, mname string, gain int, temp double")
    got = {r["id"]: (r["status"], r["mid"]) for r in J.match_masters(l, m, ["gain"], {"temp": 2.0}, strict=True).collect()}
    assert got == {1: ("tie", None), 2: ("missing", None)}
    assert J.match_masters(l, m, ["gain"], {"temp": 2.0}).where("id = 1").first()["mid"] == 7


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 500, (300, 2)), np.concatenate([rng.uniform(0, 20, (40, 2)), [[499.0, 499.0]]])
    da = spark.createDataFrame(pd.DataFrame({"id": range(300), "x": a[:, 0], "y": a[:, 1]}))
    db = spark.createDataFrame(pd.DataFrame({"id": range(len(b)), "x": b[:, 0], "y": b[:, 1]}))
    got = {r["id"]: r["ref"] for r in J.nearest(da, db, 4.0, 600.0).collect()}
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]).round(9)
    assert got == {i: int(np.argmin(d[i])) for i in range(300)}


def test_separation_and_groups_wrap_in_ra(spark):
    p = spark.createDataFrame([(1, 0, 359.5, 0.0), (2, 0, 0.5, 0.0), (3, 0, 30.0, 0.0), (4, 1, 10.0, 5.0)], "id long, target int, ra double, dec double")
    got = {r["target"]: r["max_sep"] for r in J.max_separation(p, "target").collect()}
    assert got[0] == pytest.approx(30.5) and got[1] == 0
    lab = {r["id"]: r["mosaic"] for r in J.mosaic_groups(p, 6.0, 4.0).collect()}
    assert lab == {1: 1, 2: 1, 3: 3, 4: 4}


def test_max_separation_against_brute_force(spark):
    rng = np.random.default_rng(8)
    ra, dec = rng.uniform(0, 360, 200).round(3), rng.uniform(-60, 60, 200).round(3)
    p = spark.createDataFrame(pd.DataFrame({"id": range(200), "target": np.arange(200) % 3, "ra": ra, "dec": dec}))
    got = {r["target"]: r["max_sep"] for r in J.max_separation(p, "target").collect()}
    for t in range(3):
        m = np.arange(200) % 3 == t
        d = (ra[m][:, None] - ra[m][None] + 180) % 360 - 180
        s = np.hypot(d * np.cos(np.radians((dec[m][:, None] + dec[m][None]) / 2)), dec[m][:, None] - dec[m][None])
        assert got[t] == pytest.approx(s.max(), abs=1e-9)


def test_components_on_a_long_chain_and_a_cycle(spark):
    n = spark.range(60)
    e = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(50, 51), (51, 52), (52, 50)], "a long, b long"))
    lab = {r["id"]: r["label"] for r in C.components(n, e).collect()}
    assert all(lab[i] == 0 for i in range(40)) and lab[52] == 50 and lab[45] == 45


def test_thin_against_greedy(spark):
    rng = np.random.default_rng(11)
    x, y, f = rng.uniform(0, 20, 300).round(2), rng.uniform(0, 20, 300).round(2), rng.integers(1, 30, 300).astype(float)
    got = {r["id"] for r in S.thin(spark.createDataFrame(pd.DataFrame({"id": range(300), "x": x, "y": y, "flux": f})), 1.5).collect()}
    kept = []
    for i in sorted(range(300), key=lambda i: (-f[i], i)):
        if all(round(math.hypot(x[i] - x[j], y[i] - y[j]), 9) >= 1.5 for j in kept):
            kept.append(i)
    assert got == set(kept)


def test_farthest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 100, (80, 2)).round(3)
    got = [r["id"] for r in S.farthest(spark.createDataFrame(pd.DataFrame({"id": range(80), "x": p[:, 0], "y": p[:, 1]})), 6).orderBy("step").collect()]
    sel = [min(range(80), key=lambda i: (p[i, 1], p[i, 0], i))]
    while len(sel) < 6:
        d = np.min([np.hypot(p[:, 0] - p[s, 0], p[:, 1] - p[s, 1]) for s in sel], axis=0)
        sel.append(int(np.argmax(d)))
    assert got == sel


def test_log_context_counts_lines_on_both_sides(spark):
    def severity(gap, ahead, done=True):
        lines = ["open"] + ["x"] * gap + ["copy failed"] + ["x"] * ahead + ["close"] + (["done"] if done else [])
        d = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "log int, line int, text string")
        return [r["severity"] for r in G.context_findings(d, "log", "W", "^copy", "^open", "^close", "^done").collect()]

    assert severity(4, 8) == ["benign"] and severity(5, 8) == ["warning"] and severity(4, 9) == ["warning"] and severity(0, 0, False) == ["warning"]


def test_sky_rectangles_must_not_overlap(spark):
    d = lambda rows: spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double")
    sky = d([(1, 0.0, 0.0, 4.0, 4.0), (2, 3.0, 3.0, 9.0, 9.0), (3, 20.0, 0.0, 30.0, 8.0), (4, 30.0, 0.0, 34.0, 8.0)])
    assert sorted(r[0] for r in J.unclear_sky(sky, d([(1, 33.0, 7.0, 50.0, 50.0)]), 8.0).collect()) == [1, 2, 4]


def test_farthest_with_ties_copies_and_many_steps(spark):
    p = [(i, float(i % 21), float(i // 21 % 20)) for i in range(440)] + [(900, None, 1.0)]
    d = spark.createDataFrame(p, "id long, x double, y double")
    sel, dist = [], {i: math.inf for i, _, _ in p[:440]}
    at = {i: (y, x) for i, x, y in p[:440]}
    while len(sel) < 300:
        best = min(dist, key=lambda i: (-dist[i], *at[i], i))
        sel.append(best)
        dist = {i: min(v, round(math.dist(at[i], at[best]), 9)) for i, v in dist.items()}
    got = S.farthest(d, 300, 40).orderBy("step").collect()
    assert [r["id"] for r in got] == sel and [r["step"] for r in got] == list(range(1, 301))
    assert S.farthest(d.where("id < 3 or id = 420"), 9).count() == 3  # 420 is a copy of 0
    assert S.farthest(d.where("false"), 2).count() == 0


def test_shape_field_recovers_a_quadratic_and_drops_outliers(spark):
    rng = np.random.default_rng(4)
    x, y = rng.uniform(0, 100, 500), rng.uniform(0, 80, 500)
    u, w = 2 * x / 100 - 1, 2 * y / 80 - 1
    z = 2 + 0.3 * u - 0.1 * w + 0.5 * u * u + 0.2 * u * w - 0.4 * w * w + rng.normal(0, 1e-3, 500)
    z[:10] += 5
    r = S.shape_field(spark.createDataFrame(pd.DataFrame({"layer": "a", "x": x, "y": y, "z": z})), "layer", "z", 100.0, 80.0).first()
    assert [r[f"c_{t}"] for t in S.TERMS] == pytest.approx([2, 0.3, -0.1, 0.5, 0.2, -0.4], abs=2e-3)
    assert 10 <= r["dropped"] < 60


def test_gates_keep_three_states_apart(spark):
    m = spark.createDataFrame([(1, 0.5, None), (2, 1.7, 1.0), (3, 1.2, 0.8)], "img int, noise_gain double, chroma_retention double")
    m = m.withColumn("bg_sigma", F.lit(1.0)).withColumn("drift_p95", F.lit(0.0)).withColumn("chroma_noise_gain", F.lit(1.0))
    got = {(r["img"], r["code"]): (r["status"], r["escalate"]) for r in G.evaluate_gates(m, ["img"], G.thresholds(spark), [x[0] for x in G.FIDELITY], G.ESCALATING).collect()}
    a, b = "BACKGROUND_RELATIVE_NOISE_BOUNDED", "SUBJECT_CHROMA_VISIBILITY_PRESERVED"
    assert (1, a) not in got and got[(2, a)] == ("failed", True) and got[(3, a)] == ("degraded", False)
    assert got[(1, b)] == ("unavailable", False) and (2, b) not in got and got[(3, b)] == ("warning", False)
    assert got[(1, "BACKGROUND_NOISE_BOUNDED")] == ("uncalibrated", False)


def test_squeeze_line_both_ways(spark):
    d = spark.createDataFrame([("a", "healthy", 1.0), ("a", "degraded", 3.0), ("a", "degraded", 5.0), ("b", "healthy", 9.0), ("b", "degraded", 2.0)], "m string, label string, value double")
    got = {r["m"]: r for r in G.squeeze_line(d, ["m"]).collect()}
    assert got["a"]["status"] == "lineable" and got["a"]["line"] == 3.0
    assert got["b"]["status"] == "not_lineable" and got["b"]["crossing"] == 7.0 and got["b"]["line"] is None


def test_log_marker_before_after_and_never(spark):
    rows = [("x", 1, "signup a"), ("x", 2, "purchase"), ("x", 3, "signup b"), ("x", 4, "view"), ("y", 1, "view"), ("y", 2, "error")]
    got = {(r["k"], r["line"]): r["severity"] for r in G.diagnose_log(spark.createDataFrame(rows, "k string, line long, text string"), "k", width=2).collect()}
    assert got == {("x", 1): "benign", ("x", 3): "warning", ("x", 4): "benign", ("y", 1): "warning", ("y", 2): "fatal"}


def test_reviews_and_revisions(spark):
    r = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "run long, digest string")
    v = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (3, "c"), (9, "z")], "run long, bound_digest string")
    assert {x["run"]: x["state"] for x in L.join_reviews(r, v, "run").collect()} == {1: "bound", 2: "stale", 3: "ambiguous", 4: "unreviewed"}


def test_lineage_cycle_is_reported(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    got = {(r["artefact"], r["ancestor"]): r["cycle"] for r in L.ancestors(e).collect()}
    assert got[("a", "a")] and got[("d", "c")] is False and len(got) == 12


def test_resume_stops_at_first_mismatch(spark):
    w = spark.createDataFrame([(1, s, f"f{s}") for s in range(1, 5)], "run int, step int, fingerprint string")
    rec = spark.createDataFrame([(1, 1, "f1"), (1, 2, "old"), (1, 3, "f3")], "run int, step int, recorded string")
    assert [r["state"] for r in L.resume_plan(rec, w, "run", "step").orderBy("step").collect()] == ["done", "mismatch", "invalidated", "mismatch"]


def test_curves_invert(spark):
    d = spark.range(0, 101).select((F.col("id") / 100).alias("v"))
    m = d.select(F.max(F.abs(N.mtf(N.mtf(F.col("v"), 0.15), 0.85) - F.col("v"))), F.max(F.abs(N.inverse_anscombe(N.anscombe(F.col("v"))) - F.col("v")))).first()
    assert m[0] < 1e-12 and m[1] < 1e-12
    g = [r[0] for r in d.select(N.ghs(F.col("v"), 2.0, 4.0, 0.3, 0.05, 0.9)).collect()]
    assert g[0] == pytest.approx(0) and g[-1] == pytest.approx(1) and all(b >= a for a, b in zip(g, g[1:]))
    mid = d.where("v > 0 AND v < 1").select(N.mtf(F.col("v"), N.mtf_midpoint(F.col("v"), 0.25))).collect()
    assert all(r[0] == pytest.approx(0.25) for r in mid)


def test_hsv_round_trip(spark):
    d = spark.range(512).select((F.col("id") % 8 / 7).alias("r"), (F.floor(F.col("id") / 8) % 8 / 7).alias("g"), (F.floor(F.col("id") / 64) / 7).alias("b"))
    back = N.hsv_to_rgb(*N.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")))
    assert d.select(F.max(F.greatest(*[F.abs(x - F.col(c)) for x, c in zip(back, "rgb")]))).first()[0] < 1e-12


def test_angles(spark):
    rows = [("12:30:00", True, 187.5), ("-00 30 00", False, -0.5), ("+10:00:36", False, 10.01), ("45.25", False, 45.25), ("1:75:00", False, None), ("abc", False, None)]
    d = spark.createDataFrame(rows, "t string, h boolean, want double")
    for r in d.select("want", K.parse_angle(F.col("t"), F.col("h")).alias("got")).collect():
        assert r["got"] == (None if r["want"] is None else pytest.approx(r["want"]))


def test_effective_frames_and_weights(spark, tmp_path):
    t = spark.createDataFrame([(1, f, [float(f + p) for p in range(4)], 60.0, 2.0) for f in range(6)], "session int, frame int, tile array<double>, exposure double, fwhm double")
    flagged = ST.frame_weights(ST.align_sky(ST.norm_exposure(t))).withColumn("detail", F.array_repeat(F.lit(0.5), 4)).withColumn("flag", F.array_repeat(F.lit(False), 4))
    for r in ST.stack_weighted(flagged).collect():
        assert r["neff"] == pytest.approx(6) and r["n"] == 6 and r["rejected"] == 0


def test_sections_and_links(spark):
    d = spark.createDataFrame([(1, "Intro\n=====\nbody\nmore\nIntro\n---\nx\nnot a head\n-\nplain")], "doc_id long, text string")
    s = CO.explode_sections(d, "doc_id", "text").orderBy("section").collect()
    assert [r["section_id"] for r in s] == ["intro", "intro-2"] and s[0]["body"] == "body\nmore" and s[1]["body"].startswith("x\nnot")


def test_catalogue_ids(spark):
    d = spark.createDataFrame([("m 42", "M42"), ("NGC-6888", "NGC6888"), ("caldwell 20", "C20"), ("sh-2 101", "SH2101"), ("some thing", "SOMETHING")], "n string, want string")
    assert all(r["want"] == r["got"] for r in d.select("want", R.catalog_id(F.col("n")).alias("got")).collect())
    t = R.with_target_type(d.withColumnRenamed("n", "target_name"), R.target_catalogue(spark)).collect()
    assert {r["catalog_id"]: r["type_is_guessed"] for r in t}["M42"] is False


def test_continue_chains_and_long_keys(spark):
    from astrolake.sources.headers import read_headers

    cards = ["LONG    = 'aaa&'", "CONTINUE  'bbb&'", "CONTINUE  'ccc'", "HIERARCH ESO DET ID = 'x1' / id", "GAIN    = 12", "END"]
    df = spark.createDataFrame([("f", "".join(c.ljust(80) for c in cards).encode())], "frame string, content binary")
    assert {r.key: r.raw for r in read_headers(df).collect()} == {"LONG": "aaabbbccc", "ESO DET ID": "x1", "GAIN": "12"}


def test_closure_of_a_long_chain_and_a_cycle(spark):
    from astrolake.operators.corpus import closure

    edges = [(i, i + 1) for i in range(90)] + [(200, 201), (201, 200)]
    got = {(r.a, r.b): r.depth for r in closure(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert len(got) == 90 * 91 // 2 + 4 and got[(0, 90)] == 90 and got[(200, 200)] == 2


def test_entries_without_their_parent_stay(spark):
    from astrolake.operators.ledger import inherit_issues

    rows = [("a", None, "c", ["i"], []), ("b", "a", "c", [], ["d"]), ("lost", "gone", "c", ["k"], []), ("r1", "r2", "c", [], []), ("r2", "r1", "c", [], [])]
    df = spark.createDataFrame(rows, "id string, parent string, config string, issues array<string>, degraded array<string>")
    got = {r.id: (r.issues, r.config_changed) for r in inherit_issues(df).collect()}
    assert got == {"a": (["i"], False), "b": (["i"], False), "lost": (["k"], False), "r1": ([], None), "r2": ([], None)}
