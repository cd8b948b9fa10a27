"""Plans and row counts that decide whether a query grows with its input: nothing exploded is broadcast, nothing squares."""

import random

import pytest
from pyspark.sql import functions as F

from astrolake import session
from astrolake.operators import corpus as C
from astrolake.operators import geometry as G
from astrolake.operators import joins as J
from astrolake.operators import stars as S
from astrolake.sources import headers as HD
from astrolake.sources import tables as TB

STARS = "id long, layer string, x double, y double, flux double, fwhm double, sat boolean"


def stars(spark, n=400):
    return spark.createDataFrame([(i, "AB"[i % 2], i % 20 + 0.1 * (i % 3), i // 20 + 0.0, float(i % 7), 1.0 + i % 5, i % 11 == 0) for i in range(n)], STARS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def kept(monkeypatch):
    """Plans of everything that is checkpointed meanwhile."""
    seen = []

    def cut(df):
        seen.append(plan(df))
        return session.cut(df)

    for module in (J, S):
        monkeypatch.setattr(module, "cut", cut)
    return seen


def test_star_matches_broadcast_no_table(spark, kept):
    a, b = stars(spark), stars(spark).withColumn("x", F.col("x") + 0.25)
    one, two = J.match_unique(a, b, ["layer"], 1.0), J.match_summary(a, b, ["layer"], 1.0)
    assert one.count() > 0 and two.count() == 2
    plans = [*kept, plan(one), plan(J.unmatched(a, b, ["layer"], 1.0))]
    assert len(kept) >= 2 and all("BroadcastHashJoin" not in p for p in plans)


def test_star_match_summary_meets_the_neighbours_once(spark, kept):
    a = stars(spark)
    two = J.match_summary(a, a, ["layer"], 1.0)
    assert sum("Generate" in p for p in [*kept, plan(two)]) == 1


def test_thinning_broadcasts_no_table(spark, kept):
    out = S.thin(stars(spark), 1.5)
    assert out.count() > 0 and kept
    assert all("BroadcastHashJoin" not in p for p in [*kept, plan(out)])


def test_a_heap_of_rectangles_is_not_paired(spark, monkeypatch):
    paired = []
    real = J.overlap_pairs
    monkeypatch.setattr(J, "overlap_pairs", lambda a, b, size: paired.append(a.count()) or real(a, b, size))
    box = lambda rows: spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    heap = box([(i, i * 0.001, 0.0, 10.0 + i * 0.001, 10.0) for i in range(500)] + [(900, 50.0, 50.0, 60.0, 60.0)])
    got = {r[0] for r in J.unclear_sky(heap, box([(1, 200.0, 200.0, 210.0, 210.0)]), 16.0).collect()}
    assert got == set(range(500)) and max(paired) == 1


@pytest.mark.parametrize("seed", range(3))
def test_unclear_sky_against_all_pairs(spark, seed):
    r = random.Random(seed)
    rect = lambda i: (lambda x, y: (i, x, y, x + r.choice([0.0, 0.5, 1.0, 4.0, 9.5]), y + r.choice([0.0, 0.5, 2.0, 7.0])))(r.randint(-160, 160) / 2, r.randint(-160, 160) / 2)
    sky, others = [rect(r.randint(1, 60)) for _ in range(90)], [rect(i) for i in range(12)]
    sky += [(200 + i, *sky[i][1:]) for i in range(4)] + [(300, None, 1.0, 2.0, 2.0)]
    hit = lambda a, b: None not in a and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]
    want = {a[0] for a in sky if any(hit(a, b) for b in others) or any(a[0] != b[0] and None not in b and hit(a, b) for b in sky)}
    schema = "id long, x0 double, y0 double, x1 double, y1 double"
    assert {x[0] for x in J.unclear_sky(spark.createDataFrame(sky, schema), spark.createDataFrame(others, schema), 16.0).collect()} == want


def test_projection_refines_a_pair_once(spark):
    f = spark.createDataFrame([(1, 10.0, 5.0, 600.0, 500.0, -0.01, 0.0, 0.0, 0.01)], "id long, ra0 double, dec0 double, crpix1 double, crpix2 double, cd11 double, cd12 double, cd21 double, cd22 double")
    term = F.array(F.struct(F.lit(2).alias("p"), F.lit(0).alias("q"), F.lit(1e-6).alias("c")))
    cat = spark.createDataFrame([(7, 11.0, 6.0), (8, 190.0, 6.0)], "obj long, ra double, dec double")
    out = G.project_catalog(f.withColumn("a_sip", term).withColumn("b_sip", term), cat, 1200.0, 1000.0, 8.0)
    assert [r["obj"] for r in out.collect()] == [7]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(sequence") <= 1


def test_masters_meet_distinct_settings(spark):
    l = spark.createDataFrame([(i, 1, float(i % 3)) for i in range(300)], "id long, gain int, temp double")
    m = spark.createDataFrame([(i, f"m{i}", 1, 0.5) for i in range(40)], "mid long, mname string, gain int, temp double")
    out = J.match_masters(l, m, ["gain"], {"temp": 1.0})
    assert out.where("status = 'matched' and mid = 0 and candidates = 40").count() == 200 and out.count() == 300
    assert "keys=[id" not in plan(out)


def corpus(spark):
    docs = spark.createDataFrame([(i, "en", "src", f"alpha w{i % 5} beta\nword{i % 3} alpha 图像 again again") for i in range(40)], "doc_id long, lang string, source string, text string")
    q = spark.createDataFrame([(i, f"alpha w{i % 5} word{i % 3}") for i in range(7)], "query long, text string")
    return q, docs, C.document_fields(docs)


def test_scores_in_blocks_and_without_sorting_pairs(spark, monkeypatch):
    q, docs, f = corpus(spark)
    terms, post = session.cut(C.query_terms(q)), session.cut(C.postings(f, "doc", list(C.WEIGHTS)))
    ids = session.cut(C.idf(post, "doc", docs))
    run = lambda: C.with_bonus(C.score_fielded(terms, post, "doc", ids), q, f, "doc")
    rows = lambda df: sorted((r["query"], r["doc"], round(r["score"], 9), r["matched"]) for r in df.collect())
    whole = rows(run())
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(run())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    monkeypatch.setattr(C, "BLOCK", 2)
    assert rows(run()) == whole and len(whole) == 280


def test_document_frequencies_move_only_counts(spark):
    q, docs, f = corpus(spark)
    f = f.withColumnRenamed("doc", "doc_id")
    twice = docs.unionByName(docs.where("doc_id < 3"))
    for d in (docs, twice):
        fields = C.document_fields(d).withColumnRenamed("doc", "doc_id")
        want = {(r["term"], r["df"], round(r["idf"], 9)) for r in C.idf(C.postings(fields, "doc_id", list(C.WEIGHTS)), "doc_id", d).collect()}
        assert {(r["term"], r["df"], round(r["idf"], 9)) for r in C.document_frequencies(fields, "doc_id", ["tags", "body"], d).collect()} == want
    assert "doc_id" not in "".join(line for line in plan(C.document_frequencies(f, "doc_id", ["tags", "body"], docs)).splitlines() if "Exchange hash" in line)


def test_only_asked_terms_of_texts_move(spark):
    q, docs, f = corpus(spark)
    asked = spark.createDataFrame([(1, "alpha"), (1, "nowhere"), (2, "图像")], "query long, term string")
    assert {r[0] for r in C.known_terms(f, ["tags", "body"], asked).collect()} == {"alpha", "图像"}


def test_star_lines_are_split_once_and_move_as_numbers(spark):
    head = "\t".join(TB.STAR_COLUMNS)
    row = lambda i, n=11: "\t".join([str(i), "A", "0.1", "2", "5", "6", "2.5", "2.0", "10", "0", "G"][:n])
    lines = spark.createDataFrame([(1, 0, "# x"), (1, 1, head), (1, 2, row(7)), (1, 3, row(7)), (1, 4, row(8, 5))], "file long, line int, text string")
    good, bad = TB.read_stars_strict(lines)
    assert sorted((r["line"], r["duplicate"]) for r in good.collect()) == [(2, True), (3, True)] and [r["reason"] for r in bad.collect()] == ["column_count"]
    out = TB.read_stars(lines)
    assert sorted(r["line"] for r in out.collect()) == [2, 3]
    for df in (out, good):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_header_text_is_built_once(spark):
    d = spark.range(3).select(F.col("id").alias("frame"), F.concat(F.rpad(F.concat(F.lit("GAIN    = "), F.col("id").cast("string")), 80, " "), F.rpad(F.lit("END"), 80, " ")).alias("content"))
    out = HD.read_headers(d)
    assert sorted((r["frame"], r["key"], r["value"]) for r in out.collect()) == [(i, "GAIN", float(i)) for i in range(3)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("rpad(concat(GAIN") == 1


@pytest.mark.parametrize("seed", range(2))
def test_masters_are_counted_along_the_line(spark, seed):
    r = random.Random(seed)
    temps = lambda n: [r.choice([None, float("nan"), round(r.uniform(-9, 9), 1), r.randint(-4, 4) + r.choice([0.0, 1e-12])]) for _ in range(n)]
    lights = [(i, r.choice([1, 2, None]), t) for i, t in enumerate(temps(150))]
    masters = [(i, f"m{i % 7}", r.choice([1, 2, None]), t) for i, t in enumerate(temps(90))]
    for strict in (False, True):
        want = set()
        for i, g, t in lights:
            near = [(round(abs(t - u) / 2, 9), name, mid) for mid, name, h, u in masters if None not in (g, h, t, u) and g == h and abs(t - u) <= 2]
            best = min(near, default=None)
            tie = strict and best is not None and len({n for s, n, _ in near if s == best[0]}) > 1
            want.add((i, "missing" if not near else "tie" if tie else "matched", None if tie or not near else best[2], None if tie or not near else best[0], len(near)))
        l, m = spark.createDataFrame(lights, "id long, gain int, temp double"), spark.createDataFrame(masters, "mid long, mname string, gain int, temp double")
        assert {tuple(x) for x in J.match_masters(l, m, ["gain"], {"temp": 2.0}, strict).collect()} == want


def test_masters_within_a_tolerance_are_not_all_paired(spark, monkeypatch):
    from astrolake.operators import calibration as K
    l = spark.range(300).select("id", F.lit(1).alias("gain"), (F.col("id") * 0.01).alias("temp"))
    m = spark.range(200).select(F.col("id").alias("mid"), F.concat(F.lit("m"), F.col("id")).alias("mname"), F.lit(1).alias("gain"), (F.col("id") * 0.011).alias("temp"))
    plans = []
    monkeypatch.setattr(K, "cut", lambda df: plans.append(df) or session.cut(df))
    out = J.match_masters(l, m, ["gain"], {"temp": 50.0})
    assert out.where("candidates = 200").count() == 300
    assert "m_temp) <= 50" not in "".join(plan(df) for df in plans) and "cell" in plan(out)


def test_filter_words_are_split_once_a_row(spark):
    from astrolake.operators import frames as R
    df = spark.createDataFrame([(1, "Ha_OIII", "Canon"), (2, "LP", "Seestar S50"), (3, " none ", None), (4, None, "Canon"), (5, "UV/IR cut", "x")], "id long, raw string, device string")
    out = R.with_filter_class(df, "raw", "device")
    assert sorted((r["id"], r["filter_class"], r["lines"], r["normalized"]) for r in out.collect()) == [
        (1, "dual_band", "H-alpha,OIII", "Ha_OIII"), (2, "dual_band", "H-alpha,OIII", "LP"), (3, "unknown", "", "none"), (4, "unknown", "", None), (5, "broadband", "", "UV/IR cut")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2


def test_one_row_group_is_spread(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    pq.write_table(pa.table({"doc_id": list(range(4000)), "text": [f"{i * 7919 % 4001:x}" * 40 for i in range(4000)]}), tmp_path / "t.parquet", compression="none")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        t = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert t.rdd.getNumPartitions() > 8 and t.select(F.spark_partition_id()).distinct().count() == 1
        out = session.spread(t, "doc_id")
        assert out.select(F.spark_partition_id()).distinct().count() == 8 and out.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_weighted_terms_equal_postings(spark):
    q, docs, f = corpus(spark)
    terms = session.cut(C.query_terms(q))
    post = session.cut(C.postings_of(C.postings(f, "doc", list(C.WEIGHTS)), terms, "doc"))
    per = session.cut(C.weighted_terms(f, "doc", terms))
    ids = lambda df: {(r["term"], r["df"], round(r["idf"], 9)) for r in df.collect()}
    assert ids(C.term_idf(per, docs)) == ids(C.idf(post, "doc", docs))
    i = session.cut(C.term_idf(per, docs))
    rows = lambda df: sorted((r["query"], r["doc"], round(r["score"], 9), r["strong"], r["matched"]) for r in df.collect())
    assert rows(C.score_weighted(terms, per, "doc", i, 40)) == rows(C.score_fielded(terms, post, "doc", i))
