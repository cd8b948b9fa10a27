"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.llm.shared import fold, kept

#: Labelled rows that lexicons and the classifier are fitted on (smallest hashes first), terms of the lexicons, and
#: how much likelier a term must be in toxic rows, as a log ratio.
FIT_ROWS, LEXICON_TERMS, LEAST_RATIO = 60_000, 4_096, 2.0
#: Lexicon voters (terms are dealt to them by kind and by hash) and rounds of the label model.
WORD_VOTERS, STEM_VOTERS, ROUNDS = 6, 6, 30
STEMS = (4, 5, 6, 7, 8)

# General English insults, and patterns of address.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash garbage clown clowns worthless pathetic disgusting dumb imbecile jerk vermin filth "
    "filthy coward liar freak ugly hate shut fool fools".split())
PATTERNS = (
    r"\byou(?:'re| are)? (?:such )?an? ?\w* ?(?:idiot|moron|loser|clown|fool|liar|coward)",
    r"\b(?:shut up|go to hell|get lost|drop dead|hate (?:you|them|these))\b",
    r"\b(?:kill|hurt) (?:you|them|yourself)\b",
)
VOTERS = WORD_VOTERS + STEM_VOTERS + 1 + len(PATTERNS)

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = [re.compile(p) for p in PATTERNS]


def terms(words: set[str]) -> set[str]:
    """A document's words, and the stems (``stem*``) of its longer words."""
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _voter(term: str) -> int:
    from xxhash import xxh32_intdigest

    h = xxh32_intdigest(term.encode())
    return WORD_VOTERS + h % STEM_VOTERS if term.endswith("*") else h % WORD_VOTERS


def mine_lexicon(fit: DataFrame) -> dict[str, float]:
    """Terms much likelier in toxic than in other rows of ``fit(text, toxic)``, with their log ratio; at most LEXICON_TERMS."""

    def count(known: set[str] | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for b in batches:
                for t in b["text"]:
                    found = terms(set(_WORD.findall(t.lower())))
                    seen.update(found if known is None else known & found)
                    if len(seen) > 500_000:
                        yield pd.DataFrame({"term": list(seen.keys()), "n": list(seen.values())})
                        seen = Counter()
            yield pd.DataFrame({"term": pd.Series(list(seen.keys()), dtype="str"), "n": pd.Series(list(seen.values()), dtype="int64")})

        return run

    total = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    bad = fit.where("toxic = 1").select("text").mapInPandas(count(None), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where("n >= 2")
    most = {r["term"]: r["n"] for r in bad.orderBy(F.desc("n"), "term").limit(20 * LEXICON_TERMS).collect()}
    known = set(most)
    clean = {r["term"]: r["n"] for r in fit.where("toxic = 0").select("text").mapInPandas(count(known), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    p, q = total.get(1, 0) + 1, total.get(0, 0) + 1
    ratio = {t: float(np.log((n + 0.5) / p) - np.log((clean.get(t, 0) + 0.5) / q)) for t, n in most.items()}
    base = p / (p + q)

    def evidence(t: str) -> float:
        """Log likelihood ratio of the term's own toxic share against the general one."""
        n, m = most[t], most[t] + clean.get(t, 0)
        own = n / m
        return 2 * (n * np.log(own / base) + ((m - n) * np.log((1 - own) / (1 - base)) if own < 1 else 0.0))

    enough = 2 * np.log(max(len(most), 2))  # so many terms are tried that weaker ones arise by chance
    strong = sorted((t for t in ratio if ratio[t] >= LEAST_RATIO and evidence(t) >= enough), key=lambda t: (-ratio[t] * np.log1p(most[t]), t))
    return {t: ratio[t] for t in strong[:LEXICON_TERMS]}


def _votes(docs: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """``keep`` columns, ``mask`` of the voters that call a document toxic, and ``x``: the classifier's features."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = {t: (_voter(t), r) for t, r in held.value.items()}
        cache: dict[str, tuple] = {}

        def look(w: str) -> tuple:
            return tuple({words[t] for t in terms({w}) if t in words}) + (((WORD_VOTERS + STEM_VOTERS, 4.0),) if w in INSULTS else ())

        for b in batches:
            masks, features = [], []
            for t in b["text"]:
                low = (t or "").lower()
                hits, weight, tokens = np.zeros(VOTERS), 0.0, 0
                strong = set()
                for w, n in Counter(_WORD.findall(low)).items():
                    tokens += n
                    got = cache.get(w)
                    if got is None:
                        if len(cache) > 300_000:
                            cache.clear()
                        got = cache[w] = look(w)
                    if got:
                        for v, _ in got:
                            hits[v] += n
                        best = max(r for _, r in got)
                        weight += n * best
                        if best >= 4:
                            strong.add(w)
                for k, p in enumerate(_PATTERNS):
                    if p.search(low):
                        hits[VOTERS - len(_PATTERNS) + k] = 1
                masks.append(sum(1 << v for v in range(VOTERS) if hits[v]))
                features.append([*np.log1p(hits), np.log1p(weight), np.log1p(100 * weight / (tokens + 20)), np.log1p(len(strong)), float(len(strong) > 0)])
            yield b[keep].assign(mask=pd.Series(masks, dtype="int64").values, x=features)

    kinds = dict(docs.dtypes)
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", mask long, x array<double>")


def label_model(masks: np.ndarray, counts: np.ndarray, prior: float) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """Posterior of toxic by vote pattern, voter accuracies (2 x voters) and the voters' correlations.

    Expectation maximisation over the pattern counts of the whole corpus.  Within a class the voters' residual
    correlations are estimated too; a voter that goes with others counts for less, so that near copies of one
    signal are not taken for several witnesses.
    """
    votes = ((masks[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    post = np.where(votes.sum(1) >= 2, 0.95, np.where(votes.sum(1) == 1, min(0.5, 4 * prior), prior / 4))
    corr, acc = np.eye(VOTERS), np.zeros((2, VOTERS))
    for _ in range(ROUNDS):
        corr = np.zeros((VOTERS, VOTERS))
        for y in (0, 1):
            w = counts * (post if y else 1 - post)
            acc[y] = (w @ votes + (0.5 if y else 0.1)) / (w.sum() + 1)
            z = (votes - acc[y]) / np.sqrt(acc[y] * (1 - acc[y]) + 1e-9)
            corr += (z * w[:, None]).T @ z / (w.sum() + 1e-9) / 2
        weight = 1 / (1 + np.maximum(corr - np.diag(np.diag(corr)), 0).sum(1))
        up = votes * np.log((acc[1] + 1e-6) / (acc[0] + 1e-6)) + (1 - votes) * np.log((1 - acc[1] + 1e-6) / (1 - acc[0] + 1e-6))
        logit = np.log(prior / (1 - prior)) + up @ weight
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(masks.tolist(), post.tolist())), acc, corr


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Labels are learned only from rows that are not held out (crc32 of the id as text, mod 3, is not 1), at most
    FIT_ROWS of them: they give the terms that the lexicon voters hold.  The vote patterns of ALL documents train the
    label model; a logistic regression on voter features is fitted to its posteriors, anchored by the known labels of
    the fitting rows.  Whole texts are read; only the text enters a score.

    Null and empty texts have no votes and get the classifier's score of an empty text.  Rows with a null id are
    scored and not held out.  Repeated rows get equal scores.  Without usable labels of both kinds, or without any
    term found, only the fixed lexicon and patterns vote.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~fold(1, 3))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    fit = kept(rows.join(F.broadcast(chosen), "doc_id").where("text is not null"), "fit")
    lexicon = mine_lexicon(fit)
    share = fit.agg(F.avg("toxic")).first()[0]
    prior = min(0.5, max(0.005, share if share is not None else 0.05))

    scored = kept(_votes(rows, lexicon, ["doc_id"]), "votes")
    patterns = scored.groupBy("mask").count().collect()
    if not patterns:
        return scored.select("doc_id", fold(1, 3).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    post, _, _ = label_model(np.array([r["mask"] for r in patterns], np.int64), np.array([r["count"] for r in patterns], float), prior)
    base, weights = _classifier(fit, lexicon, post)
    z = F.aggregate(F.zip_with("x", F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(float(base)), lambda s, v: s + v)
    score = 1 / (1 + F.exp(-z))
    out = scored.select("doc_id", fold(1, 3).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def _classifier(fit: DataFrame, lexicon: dict[str, float], post: dict[int, float]) -> tuple[float, list[float]]:
    """Intercept and weights: each fitting row counts as toxic by its posterior and as clean by the rest, half of it drawn to its label."""
    table = fit.sparkSession.createDataFrame([(int(m), float(p)) for m, p in post.items()] or [(0, 0.0)], "mask long, p double")
    rows = _votes(fit, lexicon, ["doc_id", "toxic"]).join(F.broadcast(table), "mask", "left")
    p = 0.5 * F.coalesce("p", F.lit(0.0)) + 0.5 * F.col("toxic")
    soft = rows.select(array_to_vector("x").alias("features"), p.alias("p"))
    data = kept(soft.select("features", F.lit(1.0).alias("label"), F.col("p").alias("w")).unionByName(soft.select("features", F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w"))).where("w > 1e-6"), "soft")
    kinds = data.select("label").distinct().count()
    if kinds < 2:
        return -4.0, [0.5] * VOTERS + [0.5, 0.5, 0.5, 0.5]
    model = LogisticRegression(maxIter=40, regParam=1e-4, weightCol="w").fit(data)
    return float(model.intercept), [float(v) for v in model.coefficients]


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic; columns as they are, rows with a null id stay."""
    bad = toxicity(docs, labels, id_col, text_col).where("predicted = 1").select(F.col("doc_id").alias("__toxic_id")).where("__toxic_id is not null").distinct()
    return docs.join(bad, docs[id_col] == F.col("__toxic_id"), "left_anti")
