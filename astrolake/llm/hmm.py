"""Hidden Markov language model: Baum-Welch over the training documents, scaled forward scores of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.llm.shared import ascii_words, kept

#: Latent states, words with emissions of their own, classes of all other words, blocks of the corpus, and passes over them.
STATES, HEAD, CLASSES, BLOCKS, PASSES = 8, 6_000, 64, 4, 2
#: Words of a training segment, and tokens that one forward pass holds at once.
SEGMENT, AT_ONCE = 64, 400_000


def _class_of(word: bytes) -> int:
    """The class of a word without emissions of its own, by its last two bytes: endings tell languages apart."""
    tail = word[-3:].strip(b".,;:!?")[-2:] or word[-1:]
    return (tail[-1] * 31 + (tail[-2] if len(tail) > 1 else 0) * 7) % CLASSES


class _Symbols(dict):
    """Word -> symbol: its place among the head words, or HEAD slots on, its class."""

    def __init__(self, head: dict[bytes, int]) -> None:
        super().__init__(head)
        self.head, self.size = head, len(head)

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.size + 400_000:
            self.clear()
            self.update(self.head)
        self[word] = value = self.size + _class_of(word)
        return value


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) of all tokens of ``train(text)`` but the ends; counted in each task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(ascii_words(t))
            if len(seen) > 500_000:
                yield pd.DataFrame({"word": list(seen.keys()), "c": list(seen.values())})
                seen = Counter()
        yield pd.DataFrame({"word": pd.Series(list(seen.keys()), dtype="object"), "c": pd.Series(list(seen.values()), dtype="int64")})

    return train.select("text").mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def forward_backward(seqs: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions (states x symbols) of rows of ``seqs`` (-1 pads the end), and log10 likelihood.

    ``first`` tells the rows that begin a document; the others begin in the chain's long-run distribution.
    """
    rows, width = seqs.shape
    k, symbols = emit.shape
    run = np.full(k, 1 / k)
    for _ in range(60):
        run = run @ move
    real = seqs >= 0
    e = emit.T[np.maximum(seqs, 0)]
    alpha = np.empty((width, rows, k))
    scale = np.ones((width, rows))
    a = np.where(first[:, None], start, run) * e[:, 0]
    for t in range(width):
        if t:
            a = np.where(real[:, t, None], (alpha[t - 1] @ move) * e[:, t], alpha[t - 1])
        s = a.sum(axis=1)
        scale[t] = np.where(real[:, t], s, 1.0)
        alpha[t] = a / s[:, None]
    beta = np.ones((rows, k))
    moves = np.zeros((k, k))
    out = np.zeros((symbols, k))
    for t in range(width - 1, -1, -1):
        gamma = alpha[t] * beta
        gamma *= (real[:, t] / np.maximum(gamma.sum(axis=1), 1e-300))[:, None]
        for s in range(k):
            out[:, s] += np.bincount(np.maximum(seqs[:, t], 0), gamma[:, s], symbols)
        if t:
            here = beta * e[:, t] / scale[t][:, None]
            moves += (alpha[t - 1][real[:, t]].T @ here[real[:, t]]) * move
            beta = np.where(real[:, t, None], here @ move.T, beta)
        else:
            begin = gamma[first].sum(axis=0)
    return begin, moves, out.T, float(np.log10(scale).sum())


def forward(docs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 likelihood of each symbol sequence, exactly: the scaled forward recursion over all its tokens, longest documents first."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    sizes = np.array([len(docs[i]) for i in order])
    total = np.zeros(len(docs))
    if not len(docs) or not sizes[0]:
        return total
    flat = np.concatenate([docs[i] for i in order])
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    table = np.ascontiguousarray(emit.T)
    alive = int((sizes > 0).sum())
    a = start * table[flat[base[:alive]]]
    logs = np.zeros(len(docs))
    for t in range(int(sizes[0])):
        if t:
            alive = int(np.searchsorted(-sizes, -t, "left"))
            a = (a[:alive] @ move) * table[flat[base[:alive] + t]]
        s = a.sum(axis=1)
        a /= s[:, None]
        logs[:alive] += np.log10(s)
    total[order] = logs
    return total


class Model:
    """Parameters of a trained chain; all of a fixed size, whatever the corpus."""

    def __init__(self, head: dict[bytes, int]) -> None:
        rng = np.random.default_rng(7)
        self.head, self.symbols = head, len(head) + CLASSES + 1
        self.end = self.symbols - 1
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        self.emit = rng.dirichlet(np.ones(STATES), self.symbols).T

    def set(self, begin: np.ndarray, moves: np.ndarray, out: np.ndarray, general: np.ndarray) -> None:
        """Maximisation, each emission smoothed towards the general distribution of symbols."""
        self.start = (begin + 1) / (begin + 1).sum()
        self.move = (moves + 0.5) / (moves + 0.5).sum(axis=1, keepdims=True)
        mass = out.sum(axis=1, keepdims=True)
        self.emit = (out + 20 * general) / (mass + 20)


def encode(texts, symbols: _Symbols, end: int) -> list[np.ndarray]:
    out = []
    for t in texts:
        words = ascii_words(t)
        x = np.empty(len(words) + 1, np.int32)
        x[:-1] = np.fromiter(map(symbols.__getitem__, words), np.int32, len(words))
        x[-1] = end
        out.append(x)
    return out


def train(rows: DataFrame, head: dict[bytes, int], general: np.ndarray) -> Model:
    """Baum-Welch over all of ``rows(doc_id, text)``, incrementally by blocks.

    The documents are dealt to BLOCKS by hash.  A round takes the expected counts of one block, summed over its
    partitions, replaces that block's earlier counts and maximises over the sum of all blocks; after PASSES passes
    every document has been counted PASSES times and the counts of all documents make the model.
    """
    spark = rows.sparkSession
    model = Model(head)
    model.emit = (model.emit * general + 1e-12) / (model.emit * general + 1e-12).sum(axis=1, keepdims=True)
    held = spark.sparkContext.broadcast(head)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols, end = _Symbols(held.value), len(held.value) + CLASSES
        for b in batches:
            x = encode(b["text"], symbols, end)
            yield pd.DataFrame({"block": b["block"], "symbols": [v.astype("<u2").tobytes() for v in x]})

    coded = kept(rows.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(BLOCKS)).cast("int").alias("block")).mapInPandas(segments, "block int, symbols binary"), "coded")
    held_counts: dict[int, tuple] = {}
    for turn in range(PASSES * BLOCKS):
        block = turn % BLOCKS
        params = spark.sparkContext.broadcast((model.start, model.move, model.emit))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start, move, emit = params.value
            begin, moves, out = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(emit)
            for b in batches:
                cut, first = [], []
                for v in b["symbols"]:
                    x = np.frombuffer(v, "<u2")
                    n = -(-len(x) // SEGMENT)
                    padded = np.full(n * SEGMENT, -1, np.int32)
                    padded[: len(x)] = x
                    cut.append(padded.reshape(n, SEGMENT))
                    first += [True] + [False] * (n - 1)
                seqs, first = np.concatenate(cut), np.array(first)
                for i in range(0, len(seqs), AT_ONCE // SEGMENT // 4):
                    part = slice(i, i + AT_ONCE // SEGMENT // 4)
                    g, m, o, _ = forward_backward(seqs[part], start, move, emit, first[part])
                    begin, moves, out = begin + g, moves + m, out + o
            flat = np.concatenate([begin, moves.ravel()])
            yield pd.DataFrame({"symbol": np.r_[-1, np.arange(emit.shape[1])], "counts": [flat.tolist(), *out.T.tolist()]})

        sums = F.array(*[F.sum(F.coalesce(F.get("counts", i), F.lit(0.0))) for i in range(STATES)])
        per = coded.where(F.col("block") == block).select("symbols").mapInPandas(expect, "symbol int, counts array<double>")
        tail = [F.sum(F.when(F.col("symbol") < 0, F.get("counts", i))) for i in range(STATES + STATES * STATES)]
        got = kept(per, "expected")
        chain = got.where("symbol < 0").agg(F.array(*tail).alias("v")).first()["v"]
        if chain[0] is None:
            continue
        out = np.zeros_like(model.emit)
        for r in got.where("symbol >= 0").groupBy("symbol").agg(sums.alias("v")).collect():
            out[:, r["symbol"]] = r["v"]
        v = np.array(chain)
        held_counts[block] = (v[:STATES], v[STATES:].reshape(STATES, STATES), out)
        model.set(*[sum(c[i] for c in held_counts.values()) for i in range(3)], general)
    return model


def lm_scores(docs: DataFrame, is_train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Tokens are words with A-Z lowered, then one end.  ``is_train`` (a condition on doc_id) names the rows that are
    learned from; all of them are counted and trained on.  The HEAD commonest words have emissions of their own, all
    others share the emission of their class and divide it in proportion to c + 0.5.  As that share does not
    depend on the state, a text's likelihood is the exact forward likelihood of its symbols times its words' shares
    within their classes; only these, and the base, need the counts of rarer words, which meet them in a join.

    Null and empty texts are one end token.  Null ids are trained on and scored.  Repeated rows are scored each.  An
    empty training set leaves uniform parameters and N = 0.  Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    learned = rows.where(is_train)
    counts = kept(word_counts(learned), "counts")
    ends = learned.count()
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    top = counts.orderBy(F.desc("c"), "word").limit(HEAD).collect()
    head = {bytes(r["word"]): i for i, r in enumerate(top)}
    head_counts = np.array([r["c"] for r in top], float)
    known = spark.sparkContext.broadcast(head)

    class_udf = F.udf(_class_of, "int")
    rare = counts.join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w in head] or [(bytearray(b" "),)], "word binary")), "word", "left_anti")
    in_class = {r["k"]: (r["c"], r["v"]) for r in rare.groupBy(class_udf("word").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    class_c = np.array([in_class.get(k, (0, 0))[0] for k in range(CLASSES)], float)
    class_v = np.array([in_class.get(k, (0, 0))[1] for k in range(CLASSES)], float)
    whole = class_c + 0.5 * (class_v + 1)  # what is counted of a class, and half a token for all unseen words of it
    general = np.r_[head_counts + 0.5, whole, ends + 0.5]
    general = general / general.sum()
    model = train(learned, head, general)
    params = spark.sparkContext.broadcast((model.start, model.move, model.emit, head_counts, whole))
    unit = float(n + 0.5 * (v + 1))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per row everything but its rare words, which go out with their number in the row."""
        start, move, emit, head_c, class_mass = params.value
        symbols, size = _Symbols(known.value), len(known.value)
        end = size + CLASSES
        base = np.r_[np.log10((head_c + 0.5) / max(unit, 1e-9)), np.zeros(CLASSES), np.log10((ends + 0.5) / max(unit, 1e-9))]
        for b in batches:
            texts = b["text"].tolist()
            step = max(1, len(texts) * AT_ONCE * 6 // max(1, sum(len(t) if t else 1 for t in texts)))
            for i in range(0, len(texts), step):
                x = encode(texts[i : i + step], symbols, end)
                logs = forward(x, start, move, emit)
                out = []
                for t, s in zip(texts[i : i + step], x):
                    rest = Counter(w for w, k in zip(ascii_words(t), s.tolist()) if k >= size)
                    mine = np.bincount(s, minlength=end + 1)[size:end]
                    known_here = int((s < size).sum()) + (ends > 0)
                    out.append((len(s), known_here, float(base[s].sum()), float(-(mine @ np.log10(np.maximum(class_mass, 1e-9)))), list(rest.keys()), list(rest.values())))
                got = pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "shift", "words", "times"])
                got.insert(0, "row", b["row"].iloc[i : i + step].to_numpy())
                got.insert(1, "forward", logs)
                yield got

    part = _scored(rows, score)
    apart = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    log_share = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    met = apart.join(counts.withColumnRenamed("word", "words"), "words", "left").select("row", "times", "c", log_share.alias("l"))
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("l")).alias("logs"), F.sum("times").alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"))
    logs, rare_n, seen = F.coalesce("logs", F.lit(0.0)), F.coalesce("rare", F.lit(0)), F.coalesce("seen", F.lit(0))
    return part.drop("words", "times").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - rare_n * float(np.log10(max(unit, 1e-9)))).alias("base_score"), (F.col("forward") + F.col("shift") + logs).alias("score"))


def _scored(rows: DataFrame, score) -> DataFrame:
    """The rows of ``score`` with their doc_id carried along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(row=np.arange(len(b)))
            for got in score(iter([b])):
                got["doc_id"] = b["doc_id"].to_numpy()[got["row"].to_numpy()]
                yield got.drop(columns="row")

    fields = "forward double, n_tokens long, n_known long, base double, shift double, words array<binary>, times array<long>, doc_id long"
    return kept(rows.mapInPandas(run, fields).withColumn("row", F.monotonically_increasing_id()), "scored")
