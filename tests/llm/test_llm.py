"""Training-data operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import base64
import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from astrolake.llm import decontam, hmm, html_extract, langid, line_dedup, near_dup, packing, shared, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, gone int, node string, label string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here\nshort", 1, "a", "x"),
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here\nshort", 1, "a", "x"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here\nshort", None, None, None),
        (3, "", 2, "b", None), (4, None, 3, None, "y"), (None, "a text without an id that is long enough to matter", 4, "c", "z"),
        (5, LONG, 5, "d", None), (6, "one", 6, "e", None), (7, "one", 7, "e", None), (8, " \t\n ", 8, "f", None),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _sets(rows, width):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def _components(sets):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_dups_equal_brute_force(docs):
    sets = _sets([(r.doc_id, r.text) for r in docs.collect()], 4)
    want = _components(sets)
    got = near_dup.near_dups(docs, 80, 4).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dups_in_one_large_group(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for p in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[p] = f"r{i}_{p}"
        rows.append((i, " ".join(words)))
    got = near_dup.near_dups(spark.createDataFrame(rows, "doc_id long, text string"), 80, 4).collect()
    assert {r.doc_id: r.component_id for r in got} == _components(_sets(rows, 4))


def test_sets_that_meet_in_many_trees_make_few_pairs(spark, monkeypatch):
    """Forty sets that share nearly all tokens meet in every tree, mostly behind the same star."""
    rows = [(i, " ".join(f"b{j}" if j != i else f"r{i}" for j in range(400))) for i in range(40)]
    seen, confirmed = [], near_dup._confirmed

    def counted(pairs, *rest):
        seen.append(pairs.distinct().count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(near_dup, "_confirmed", counted)
    got = near_dup.near_dups(spark.createDataFrame(rows, "doc_id long, text string"), 80, 4).collect()
    assert {r.component_id for r in got} == {0} and seen[0] <= 4 * 39


def test_sketches_never_reject_a_close_pair():
    rng = np.random.default_rng(11)
    sketch = lambda x: (x[: near_dup.SKETCH] >> np.uint64(32)).astype(np.uint32)
    for n in (1, 7, 200, near_dup.SKETCH, near_dup.SKETCH + 1, 3000):
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        others = []
        for k in range(0, n, max(1, n // 40)):
            others.append(np.unique(np.concatenate([base[rng.permutation(len(base))[k:]], rng.integers(0, 2**64, k // 3, dtype=np.uint64)])))
        got = near_dup.may_be_close(sketch(base), len(base), [sketch(o) for o in others], np.array([len(o) for o in others]), 80)
        for o, ok in zip(others, got):
            both = len(np.intersect1d(base, o))
            close = 100 * both >= 80 * (len(base) + len(o) - both)
            assert ok or not close
            if max(len(base), len(o)) <= near_dup.SKETCH:
                assert ok == close


def test_near_dups_on_odd_rows(odd, none):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dup.near_dups(odd).collect()}
    assert got[(1, 12)] == (1, True) and got[(2, 12)] == (1, False)
    assert got[(3, 0)] == (3, True) and got[(4, 0)] == (4, True) and got[(8, 0)] == (8, True)
    assert got[(7, 1)] == (6, False) and [v for k, v in got.items() if k[0] is None] == [(None, True)]
    assert near_dup.near_dups(none).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j - 1] + (x != y), left[j] + 1, row[j - 1] + 1))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_links_equal_brute_force(spark, edits):
    rng = np.random.default_rng(edits)
    texts = []
    for _ in range(12):
        line = "".join(rng.choice(list("abcdéß "), 24))
        for _ in range(6):
            x = list(line)
            for _ in range(int(rng.integers(0, 4))):
                p = int(rng.integers(0, len(x)))
                x[p : p + 1] = [[], ["z"], [x[p], "q"]][int(rng.integers(0, 3))]
            texts.append("".join(x))
    texts = sorted({t for t in texts if len(t) >= line_dedup.LEAST_CHARS})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {(r.h1, r.h2): r.line for r in line_dedup.lines(df, "doc_id", "text").collect()}
    got = {frozenset((names[(r.a1, r.a2)], names[(r.b1, r.b2)])) for r in line_dedup.edit_links(df, edits).collect()}
    assert got == {frozenset(p) for p in itertools.combinations(texts, 2) if _distance(*p) <= edits}


def test_line_dedup_on_odd_rows(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "__n_lines", "__n_gone", "__n_near"]
    got = {(r.doc_id, r.node): (r.text, r["__n_gone"]) for r in out.collect()}
    assert got[(1, "a")][1] == 0 and got[(2, None)] == ("short", 1)
    assert got[(3, "b")] == ("", 0) and got[(4, None)] == (None, 0) and got[(5, "d")] == (LONG, 0)
    assert out.count() == odd.count() and line_dedup.dedup_lines(none).count() == 0


def test_edits_grow_with_the_line(spark):
    rng = np.random.default_rng(3)
    texts = []
    for chars in (60, 97, 101, 152, 251):
        line = "".join(rng.choice(list("abcdé \U0001f600"), chars))
        for _ in range(6):
            x = list(line)
            for _ in range(int(rng.integers(0, chars // 80 + 2))):
                p = int(rng.integers(0, len(x)))
                x[p : p + 1] = [[], ["z"], [x[p], "q"]][int(rng.integers(0, 3))]
            texts.append("".join(x))
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {(r.h1, r.h2): r.line for r in line_dedup.lines(df, "doc_id", "text").collect()}
    got = {frozenset((names[(r.a1, r.a2)], names[(r.b1, r.b2)])) for r in line_dedup.edit_links(df).collect()}
    edits = {p: max(1, min(map(len, p)) // 50) for p in itertools.combinations(texts, 2)}
    far = {p: _distance(*p) for p, k in edits.items() if abs(len(p[0]) - len(p[1])) <= k}
    assert got == {frozenset(p) for p, d in far.items() if d <= edits[p]} and any(2 < d <= edits[p] for p, d in far.items())


def test_long_lines_meet_by_words_and_by_characters(spark):
    """Blanks come, go and move; some lines have too few words for word keys, others just enough."""
    rng = np.random.default_rng(11)
    texts = []
    for chars, blank in itertools.product((100, 148, 205), (3, 6, 8, 10, 14, 40)):
        line = "".join(" " if rng.random() < 1 / blank else c for c in rng.choice(list("abcdeß"), chars))
        for _ in range(7):
            x = list(line)
            for _ in range(int(rng.integers(0, chars // 50 + 2))):
                p = int(rng.integers(0, len(x)))
                x[p : p + 1] = [[], [" "], ["z"], [x[p], " "], [" ", x[p]]][int(rng.integers(0, 5))]
            texts.append("".join(x))
    texts = sorted({t for t in texts if len(t) >= line_dedup.LEAST_CHARS})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {(r.h1, r.h2): r.line for r in line_dedup.lines(df, "doc_id", "text").collect()}
    got = {frozenset((names[(r.a1, r.a2)], names[(r.b1, r.b2)])) for r in line_dedup.edit_links(df).collect()}
    edits = {p: max(1, min(map(len, p)) // 50) for p in itertools.combinations(texts, 2)}
    want = {frozenset(p) for p, k in edits.items() if abs(len(p[0]) - len(p[1])) <= k and _distance(*p) <= k}
    assert got == want and len(want) > 60


def test_repeated_words_give_few_keys_and_lose_no_link(spark):
    """Lines that repeat a word or a few words, with edits before, inside and behind the repetition."""
    rng = np.random.default_rng(7)
    texts = ["the " * 2000, "of and " * 900 + "in"]
    for unit, n in (("the ", 40), ("of and ", 25), ("a be con ", 22)):
        for head in ("", "some other words stand here first "):
            line = head + unit * n
            for _ in range(8):
                x = list(line)
                for _ in range(int(rng.integers(0, len(line) // 50 + 2))):
                    q = int(rng.integers(0, len(x)))
                    x[q : q + 1] = [[], ["z"], [x[q], "q"]][int(rng.integers(0, 3))]
                texts.append("".join(x))
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = line_dedup.lines(df, "doc_id", "text")
    assert max(r.n for r in line_dedup._sides(every, 1).select(F.size("sides").alias("n")).collect()) < 100
    names = {(r.h1, r.h2): r.line for r in every.collect()}
    got = {frozenset((names[(r.a1, r.a2)], names[(r.b1, r.b2)])) for r in line_dedup.edit_links(df).collect()}
    edits = {p: min(map(len, p)) // 50 for p in itertools.combinations(texts, 2)}
    want = {frozenset(p) for p, k in edits.items() if abs(len(p[0]) - len(p[1])) <= k and _distance(*p) <= k}
    assert got == want and len(want) > 20


def test_lines_meet_on_runs_and_across_bands_of_length(spark):
    """Lines of few different words around the edges of the bands, with edits spread evenly; one gram between other words meets nothing."""
    rng = np.random.default_rng(17)
    vocabulary, texts = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8)))) for _ in range(40)], []
    for chars in [round(line_dedup.BAND**i) + d for i in (26, 28, 30) for d in (0, 1)]:
        for _ in range(4):
            line = " ".join(rng.choice(vocabulary, chars))[:chars]
            for lost in range(chars // 50 + 2):
                x = list(line)
                for i in range(lost):  # from the right end, so that places stay
                    p = len(line) * (lost - i) // (lost + 1)
                    x[p : p + 1] = [[], ["z"]][int(rng.integers(0, 2))]
                texts.append("".join(x))
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {(r.h1, r.h2): r.line for r in line_dedup.lines(df, "doc_id", "text").collect()}
    got = {frozenset((names[(r.a1, r.a2)], names[(r.b1, r.b2)])) for r in line_dedup.edit_links(df).collect()}
    edits = {p: min(map(len, p)) // 50 for p in itertools.combinations(texts, 2)}
    want = {frozenset(p) for p, k in edits.items() if abs(len(p[0]) - len(p[1])) <= k and _distance(*p) <= k}
    assert got == want and any(len({int(math.log(len(x), line_dedup.BAND)) for x in p}) == 2 for p in want)
    gram = [" ".join([*(f"{side}word{i}" for i in range(4)), "one two three", *(f"more{side}{i}" for i in range(8))]) for side in ("left", "west")]
    near = [" ".join(f"{i}words{i}" for i in range(20)), " ".join(f"{i}words{i}" for i in range(19)) + " 19word19"]
    df = spark.createDataFrame(list(enumerate(gram + near)), "doc_id long, text string")
    keyed = line_dedup._sides(line_dedup.lines(df, "doc_id", "text"), 1)
    met = {(r.a1, r.b1) for turn in range(line_dedup.TURNS) for r in line_dedup._met(keyed, turn, 1).collect()}
    h1 = {r.line: r.h1 for r in line_dedup.lines(df, "doc_id", "text").collect()}
    assert met == {tuple(sorted(h1[x] for x in near))}


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    out = shared.kept(spark.range(50_000).repartition(7, "id").groupBy((F.col("id") % 999).alias("k")).count(), "counts")
    assert files() <= before and out.agg(F.sum("count")).first()[0] == 50_000
    assert spark.conf.get(shared.CLEANUP) == "false"


def test_letter_counts_never_part_near_lines(spark):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(60):
        a = list(rng.choice(list("abcdeß \U0001f600thn"), int(rng.integers(20, 400))))
        b, k = list(a), int(rng.integers(0, 12))
        for _ in range(k):
            q = int(rng.integers(0, len(b)))
            b[q : q + 1] = [[], ["z"], [b[q], "e"]][int(rng.integers(0, 3))]
        rows.append(("".join(a), "".join(b), k))
    df = spark.createDataFrame(rows, "a string, b string, k int")
    both = df.select("k", *[x for s in "ab" for x in (F.length(s).alias(f"c{s}"), *[F.expr(e.replace("line", s).replace("chars", f"length({s})")).alias(f"n{i}{s}") for i, e in enumerate(line_dedup._letter_counts())])])
    bits = " + ".join(f"bit_count(n{i}a ^ n{i}b)" for i in range(len(line_dedup._letter_counts())))
    assert both.where(f"{bits} > 2 * k - abs(ca - cb)").count() == 0
    assert df.select(F.lit("e" * 30).alias("line"), F.lit(30).alias("chars")).selectExpr(*line_dedup._letter_counts()).distinct().count() == 1


def test_one_id_with_two_texts_keeps_lines_of_both(spark):
    common, only, other = "a line that both of the texts hold", "a sentence of the second text alone", "what nobody else has said before now"
    rows = [(7, f"{common}\n{only}"), (7, f"{other}\n{common}"), (7, f"{other}\n{common}"), (None, common)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4 and [r.text for r in out if r.doc_id is None] == [common]
    texts = sorted(r.text for r in out if r.doc_id == 7)
    first, second = f"{common}\n{only}", f"{other}\n{common}"
    assert texts in (sorted([first, other, other]), sorted([only, second, second]))


def test_dedup_lines_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = [" ".join("".join(rng.choice(list("abcde"), int(rng.integers(2, 8)))) for _ in range(n)) for n in (1, 4, 5, 6, 22, 23, 40) for _ in range(3)]
    pool += [x[:9] + "z" + x[10:] for x in pool if len(x) > 20] + ["", " ", "Les."]
    rows = [(i, "\n".join(rng.choice(pool, int(rng.integers(1, 7))))) for i in range(40)]
    want = {}
    k = line_dedup.LEAST_CHARS
    near = lambda a, b: a != b and min(len(a), len(b)) >= k and _distance(a, b) <= max(1, min(len(a), len(b)) // 50)
    every = {x for _, t in rows for x in t.split("\n") if len(x) >= k}
    first = {x: min((i, p) for i, t in rows for p, y in enumerate(t.split("\n")) if x == y) for _, t in rows for x in t.split("\n")}
    for i, t in rows:
        out, n_near = [], 0
        for p, x in enumerate(t.split("\n")):
            others = [y for y in every if near(x, y)]
            n_near += bool(others)
            if not x.strip() and len(x) < k or (first[x] == (i, p) and not any(first[y] < first[x] for y in others)):
                out.append(x)
        want[i] = ("\n".join(out), len(t.split("\n")) - len(out), n_near)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect()
    assert {r.doc_id: (r.text, r["__n_gone"], r["__n_near"]) for r in got} == want and any(n for _, _, n in want.values())


def test_short_copies_go(spark):
    df = spark.createDataFrame([(1, "Les.\n\nA"), (2, "Les.\n\nB\nLes.")], "doc_id long, text string")
    assert [r.text for r in line_dedup.dedup_lines(df, short=True).orderBy("doc_id").collect()] == ["Les.\n\nA", "\nB"]


def test_leaks_and_slots(spark, odd, none):
    items = spark.createDataFrame([
        (1, "Alice has 12 apples and gives 5 apples to Bob . How many apples does Alice keep in her basket ?"),
        (2, None), (3, "two words"), (4, "seven little words that make one item"), (5, "")], "item_id long, text string")
    rows = [
        (1, "intro words here Tom has 30 apples and gives 7 apples to Mary . How many apples does Tom keep in her basket ? the end"),
        (2, "Tom has 30 apples and gives 7 apples to Mary . How many apples does Peter keep in her basket ?"),
        (3, "x y z seven little words that make one item q"),
        (4, "an apple a day keeps the doctor away and so on and on for long"), (5, None), (None, "seven little words that make one item")]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1), (3, 4), (None, 4)}
    assert decontam.leaks(odd, items.where("false")).count() == 0 and decontam.leaks(none, items).count() == 0
    assert decontam.decontaminate(odd, items).columns == odd.columns and decontam.decontaminate(odd, items).count() == odd.count()


def test_leaks_hold_copies_behind_headings_and_with_many_slots(spark):
    items = spark.createDataFrame([(1, "How do plants make sugar from light ?"), (2, "John Smith was born in New York City in 1923")], "item_id long, text string")
    rows = [(1, "Question: How do plants make sugar from light ? yes"), (2, "it says John Smith was born in New York City in 1923 and so on"),
            (3, "Question: Anna do plants make sugar from light ?"), (4, "Peter Brown was born in Old Mill Town in 1950")]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1), (2, 2)}


def test_leaks_hold_every_copied_item(docs, spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.item_id: " ".join(r.text.lower().split()) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in " ".join((r.text or "").lower().split())}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert want and want <= got


def test_packing(docs, odd, none):
    got = packing.pack_documents(docs).toPandas()
    words = {r.doc_id: len((r.text or "").encode().split()) + 1 for r in docs.collect()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == words
    for _, b in got.groupby("bin_id"):
        b = b.sort_values("position")
        assert (b.position + b.n_tokens).iloc[-1] == b.n_tokens.sum() <= b.capacity.iloc[0]
        assert list(b.position) == [0, *b.n_tokens.cumsum()[:-1]]
        assert b.capacity.iloc[0] == min(c for c in packing.CAPACITIES if c >= b.n_tokens.sum())
    assert got.n_tokens.sum() / got.drop_duplicates("bin_id").capacity.sum() > 0.97
    assert packing.pack_documents(odd).agg(F.count_distinct("bin_id", "position"), F.count("*")).first()[0] == packing.pack_documents(odd).count()
    assert packing.pack_documents(none).count() == 0


def test_best_fit_equals_plain_best_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 65, 300).tolist()
    where, held = packing.pack(sizes, (64,), 0)
    room = []  # plain best fit over all bins
    for n in sorted(sizes, reverse=True):
        fits = [b for b in room if b[0] >= n]
        if fits:
            min(fits, key=lambda b: b[0])[0] -= n
        else:
            room.append([64 - n])
    assert len(held) == len(room) and sum(sizes) <= 64 * len(held)


def test_top_k_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 2]) for i in range(90)] + [(200, None), (201, [None] * 6), (202, [math.nan] * 6), (203, [math.inf] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(i, rows[7][1]) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: [math.floor(64 * x) for x in e] for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    want = set()
    for q in [i for i in v if i % 20 == 0]:
        s = sorted(((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q))[:20]
        want |= {(q, r, c, -x) for r, (x, c) in enumerate(s, 1)}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()} == want
    assert topk.top_k(df.where("vec_id in (0, 1)"), F.col("vec_id") % 20 == 0).count() == 1
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_forward_equals_all_paths():
    rng = np.random.default_rng(5)
    k, m = 3, 4
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k)
    seqs = [np.array(x) for x in ([0, 1, 3, 2], [2], [1, 1, 0])]
    for x, got in zip(seqs, hmm.forward(seqs, start, move, emit)):
        total = sum(start[p[0]] * emit[p[0], x[0]] * np.prod([move[a, b] * emit[b, o] for a, b, o in zip(p, p[1:], x[1:])]) for p in itertools.product(range(k), repeat=len(x)))
        assert math.isclose(got, math.log10(total), abs_tol=1e-9)


def test_lm_scores(docs, odd, none):
    got = {r.doc_id: r for r in hmm.lm_scores(docs, ~shared.fold(1, 5)).collect()}
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = {}
    for i, w in texts.items():
        if not held(i):
            for x in [*w, None]:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in texts.items():
        base = sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None])
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w) + 1, sum(x in count for x in [*w, None]), n)
    assert sum(got[i].score for i in texts if held(i)) > sum(got[i].base_score for i in texts if held(i))
    assert hmm.lm_scores(odd, ~shared.fold(1, 5)).count() == odd.count() and hmm.lm_scores(none, ~shared.fold(1, 5)).count() == 0


def test_toxicity(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / max(1, got.predicted.sum()) > 0.9 and hit / got.toxic.sum() > 0.6
    out = toxicity.toxicity(odd, labels).toPandas()
    assert len(out) == odd.count() and out.score.between(0, 1).all()
    assert toxicity.toxicity(none, labels.where("false")).count() == 0
    assert toxicity.without_toxic(odd, labels).columns == odd.columns


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Home</a> Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies to make the site better for all of you and the others.</div><article><h1>A &amp; B</h1><p>The first
  of the paragraphs &lt;b&gt; is one that is <b>long</b> enough to be the text of the page and it is kept.<p>Short one.</p><form>Name <input> of the user</form>
<p>And the last of them is also one of the longer ones that the reader will see at the end.</p></article><aside>More of the same and that is for you</aside>
<div id="comments"><p>I am a reader and this is the comment that I have to make on the article.</p></div><footer>&copy; all of it</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "u", "", None), (3, "u", "<p>no end <b", None), (3, "u", "<p>no end <b", None)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    one = next(r for r in got if r.page_id == 1)
    assert one.text.split("\n\n") == [
        "A & B", "The first of the paragraphs <b> is one that is long enough to be the text of the page and it is kept.", "Short one.",
        "And the last of them is also one of the longer ones that the reader will see at the end."]
    assert one.n_chars == len(one.text) and len(got) == 5 and [r.text for r in got if r.page_id == 2] == [""]
    assert html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string").where("false")).count() == 0


def test_main_text_in_loose_markup():
    para = "The first of the paragraphs is one that is long enough to be the text of the page and it is kept for the reader to see in the end, as it was in the page."
    both = f"<p>{para}</p><p>{para}</p>"
    for page in (
            f"<body><ul><li><a href='/'>Home<li><a href='/x'>News</ul><div>{both}</div></body>", f"<body><a href='/'>Home<div>{both}</div></body>",
            f"<div class='layout has-sidebar'><article>{both}</article></div>", f"<div class='with-comments'>{both}</div>"):
        assert html_extract.main_blocks(page) == [para, para], page
    # links around blocks, comments and menus stay out
    assert html_extract.main_blocks(f"<article>{both}</article><div class='comments'><article>{both}</article></div><a href='/'><p>{para}</p></a><nav>{both}</nav>") == [para, para]


def test_warc_round_trip_with_magic_inside(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/é x", "hé\r\n\r\nllo", 1), (2, None, "before " + inner + "after", 2), (3, "u", inner, 3), (4, "u", None, 4), (5, "u", "", 5), (6, "u", "hé\r\n\r\nllo", 6), (7, "u", "before " + inner + "after", 7), (8, "u", "WARC/1.1\r\n" * 3, 8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, length int")
    for least in (0, 1):
        first = {}
        want = set()
        for i, _, h, _ in pages:
            p = (h or "").encode()
            f = first.setdefault(p, i) if len(p) >= least else i
            want.add((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
        assert {tuple(r)[:5] for r in warc.archive_round_trip(df, least).collect()} == want
    assert warc.archive_round_trip(df.where("false")).count() == 0


def test_warc_tells_rows_of_one_id_apart(spark):
    pages = [(7, "one"), (7, "seven alone"), (7, "two"), (3, "one"), (3, "two"), (9, "one"), (9, "one"), (9, "two"), (3, "one"), (None, "one"), (None, None), (5, "x" * 300_000), (6, "x" * 300_000)]
    first = {}
    for i, h in pages:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, h in pages:
        p, f = (h or "").encode(), first.get(h, i) if i is not None else None
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    got = warc.archive_round_trip(spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_language(spark, docs, none):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = langid.identify(pages, docs).toPandas()
    assert len(got) == pages.count() and (got.lang == got.declared).mean() > 0.97
    bad = spark.createDataFrame([(1, None, None), (None, "http://h.fr/fr/x", "<html lang=fr>"), (2, "x", ""), (2, "x", "")], "page_id long, url string, html string")
    assert langid.identify(bad, docs).count() == 4 and {r.lang for r in langid.identify(bad, none.withColumn("lang", F.lit("a"))).collect()} == {None}
    assert langid.identify(bad.where("false"), docs).count() == 0


def test_pipeline(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = shared.kept(stage(spark, kept, SF), name)
        if name != "packing":
            assert out.columns == docs.columns and out.count() <= kept.count()
        if name == "near_dup":
            rows = {r.doc_id: r.text for r in kept.collect()}
            want = _components(_sets(rows.items(), 5))
            assert {r.doc_id for r in out.collect()} == {i for i, c in want.items() if i == c}
        last, kept = kept, out
    assert {r.doc_id for r in kept.select("doc_id").distinct().collect()} == {r.doc_id for r in last.collect()}
