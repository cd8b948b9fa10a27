"""Phrase fingerprints, spelling groups and collocations against brute force, and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolake.llm import collocations, phrase_print, queries, spelling

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, n long, word string, h long, place long, edge string"
LONG = ". ".join(f"wörd{chr(97 + i % 26)}{chr(97 + i % 7)} tail" for i in range(40_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and languages, empty and very long texts, repeated rows and ids, clashing extra columns."""
    extra = (1, "x", None, 7, "first")
    rows = [
        (1, "Color colour COLOR colour", "en"), (1, "Color colour COLOR colour", "en"), (1, "another text of the same id", None), (2, "", "en"), (3, None, None),
        (None, "color Color color, color", None), (None, None, None), (5, LONG, "en"), (6, " \t\n.,;:!? ", "en"), (7, "\U0001d11e× ÷x ßß", "de"), (2**53 + 1, "a", "en")]
    return spark.createDataFrame([(i, t, l, *extra) for i, t, l in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _same(df, name):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang").toArrow())
    rel = con.execute(queries.ORACLE_SQL[name])
    return [d[0] for d in rel.description], rel.fetchall()


def _phrases(text):
    seen, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
    return seen


def test_phrases_are_the_plain_parse():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 3000):
        text = "".join(rng.choice(list("abcé\U0001d11e"), n))
        ends, _ = phrase_print.parse(text, {})
        assert {text[a:b] for a, b in zip([0, *ends], ends)} == _phrases(text)
        for other in ("", "b", text[::-1], text + "abc"):
            edited, mark = phrase_print.Parsed(text).edited(other)
            assert edited == text[: n - n // 2] + other[: n // 2] and mark == phrase_print.Parsed(edited).print


def test_likeness_is_near_the_share_of_common_phrases():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    for share in (0.0, 0.3, 0.6, 1.0):
        a = " ".join(rng.choice(words, 900))
        b = a[: int(len(a) * share)] + " ".join(rng.choice(words, 900))[int(len(a) * share):]
        x, y = _phrases(a), _phrases(b)
        assert abs(phrase_print.likeness(phrase_print.Parsed(a).print, phrase_print.Parsed(b).print) - len(x & y) / len(x | y)) < 0.15


def _expected(rows):
    """Rows in order of descending id with the next one's text, by hand."""
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        one, edited = phrase_print.Parsed(text), text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        mark = phrase_print.Parsed(edited).print
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), one.print, mark, phrase_print.likeness(one.print, mark), phrase_print.likeness(one.print, phrase_print.Parsed(following).print)))
    return out


def test_neighbour_edits(spark, docs, odd):
    rows = [(r.doc_id, r.text or "") for r in docs.orderBy(F.desc("doc_id")).collect()]
    want = sorted(_expected(rows))
    few = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for coalesce in ("true", "false"):  # one range and many
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        assert sorted(tuple(r) for r in queries.op11_fingerprints(spark, SF).collect()) == want
        assert sorted(tuple(r) for r in phrase_print.with_neighbour_edits(docs.repartition(7)).collect()) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", few)
    order = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).orderBy(F.desc_nulls_last("doc_id"), "h").collect()
    key = lambda r: tuple(str(v) for v in r)
    got = phrase_print.with_neighbour_edits(odd).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(_expected([(r.doc_id, r.text) for r in order]), key=key)
    one = phrase_print.with_neighbour_edits(odd.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert phrase_print.with_neighbour_edits(odd.where("false")).count() == 0
    marks = {r.fingerprint for r in phrase_print.fingerprints(odd).where("n_chars = 0").collect()}
    assert marks == {""} and phrase_print.likeness("", "") == 1.0 and phrase_print.likeness("", one[0].fingerprint) == 0.0


def _words(rows, least_chars=5, least_n=3, damage=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1:] if h % damage == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_n}


def _groups(n):
    """All pairs by trying every single edit over the letters in use."""
    letters = {c for w in n for c in w}
    out = {}
    near = {}
    for w in n:
        edits = {w[:k] + w[k + 1:] for k in range(len(w))} | {w[:k] + c + w[k + 1:] for k in range(len(w)) for c in letters} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        near[w] = (edits - {w}) & n.keys()
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return set(out.values())


def test_spelling_groups(spark, docs, odd):
    want = _groups(_words([(r.doc_id, r.text) for r in docs.collect()]))
    got = [tuple(r) for r in queries.op12_spelling(spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(w[1] for w in want) and any(w[1] and w[1] != w[2] for w in want)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in spelling.spelling_groups(odd, damage=97).collect()} == _groups(_words(rows))
    assert spelling.spelling_groups(odd.where("false"), damage=97).count() == 0
    cols, sql = _same(odd, "op12_spelling")
    assert set(sql) == {tuple(r[c] for c in cols) for r in spelling.spelling_groups(odd, damage=97).collect()}


def test_near_words_in_runs_of_a_letter_long_words_and_shared_stems(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), int(k))) for k in rng.integers(5, 9, 400)}
    long = "".join(rng.choice(list("xyz"), 900))
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "aaaab", long, long[:450] + long[451:], long[:-1], long[:300] + "q" + long[301:], "q" + long[1:], long[1:]}
    n = dict.fromkeys(words, 3)
    got = [tuple(r) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    want = Counter({w[0]: w[4] for w in _groups(n)})
    assert len(got) == len(set(got)) and Counter(w for w, _ in got) == +want and {(b, a) for a, b in got} == set(got)


def _best(rows, support=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for m in (1, 2, 3):
                f[lang].update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = set()
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        rank = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in frequent.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(rank)[:top], 1):
            out.add((lang, r, p.decode(), -a, left, right, n[lang], -s))
    return out


def test_collocations(spark, docs, odd):
    want = _best([(r.lang, r.text) for r in docs.collect()])
    got = [tuple(r) for r in queries.op13_collocations(spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    shared = spark.createDataFrame([("en" if i % 3 else None, "New York, new york city. New York\tCity! a  b c d; a b c " + "x y " * 20) for i in range(8)], "lang string, text string")
    for part in (odd, shared, docs.repartition(11)):
        rows = [(r.lang, r.text) for r in part.collect()]
        assert {tuple(r) for r in collocations.collocations(part).collect()} == _best(rows)
        assert {tuple(r) for r in collocations.collocations(part, top=3).collect()} == _best(rows, top=3)
    cols, sql = _same(odd, "op13_collocations")
    assert set(sql) == {tuple(r[c] for c in cols) for r in collocations.collocations(odd).collect()}
    assert collocations.collocations(odd.where("false")).count() == 0


def test_shards_lose_no_frequent_phrase(docs):
    assert [collocations.local_support(10, k) for k in (1, 2, 3, 4, 5, 9, 10)] == [10, 5, 4, 3, 2, 2, 1]
    texts = docs.select("lang", "text").repartition(9)
    hashes = collocations.candidates(texts, 3, 10)
    exact = {(r.lang, r.phrase): r.c for r in collocations.counted(texts, hashes, 3).where("words > 0 and c >= 10").collect()}
    f = defaultdict(Counter)
    for r in docs.collect():
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", r.text.lower() if r.text.isascii() else "".join(c.lower() if c < "\x80" else c for c in r.text)):
            words = piece.split(" ")
            words = [w for w in words if w]
            for m in (1, 2, 3):
                f[r.lang].update(" ".join(words[k : k + m]) for k in range(len(words) - m + 1))
    assert exact == {(lang, p): c for lang, seen in f.items() for p, c in seen.items() if c >= 10}


def test_long_texts_are_cut_between_pieces(monkeypatch):
    text = LONG.encode()
    whole = collocations.Chunk()
    whole.add(text)
    monkeypatch.setattr(collocations, "SLICE", 1000)
    cut = collocations.Chunk()
    cut.add(text)
    codes = collocations.Codes()
    for (_, a, m), (_, b, n) in zip(whole.phrases(3, b"en", codes), cut.phrases(3, b"en", codes)):
        assert dict(zip(a.tolist(), m.tolist())) == dict(zip(b.tolist(), n.tolist()))
