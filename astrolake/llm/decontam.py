"""Benchmark decontamination by template windows and slot consistency."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Template words of a window, words of a match that count as a leak, and words that must be literal in it.
WINDOW, RUN, LITERAL = 8, 13, 5
#: Characters of benchmark text that are broadcast at once; a larger benchmark goes through in more blocks.
BLOCK_CHARS = 8_000_000

# Unit words, number words and common given names.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons gram grams pound pounds ounce ounces ml l liter liters litre litres "
    "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros "
    "percent % degree degrees mph kmh watt watts volt volts".split())
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million half double twice dozen".split())
NAMES = frozenset(
    "james john robert michael william david mary patricia jennifer linda elizabeth barbara susan sarah alice bob carol dave eve tom tim sam ben "
    "anna emma olivia noah liam lucas mia sophia jack harry george peter paul mark luke maria jose juan carlos ana pierre marie jean hans anna "
    "julia laura kevin brian lisa nancy karen betty helen sandra donna natalia weng ken betsy joy".split())

LITERAL_KIND, NUM, UNIT, NAME = 0, 1, 2, 3
_EDGE = "\"'`.,;:!?()[]{}<>*_~|«»“”‘’„…-–—"


def canonical(word: str, opening: bool) -> tuple[str, int]:
    """(template word, kind) of one surface word; ``opening``: it begins a sentence, where a capital says nothing."""
    core = word.strip(_EDGE)
    if not core:
        return "", LITERAL_KIND
    low = core.casefold()
    digits = low.lstrip("$€£+-#")
    if digits[:1].isdigit():
        return "<num>", NUM
    if low in NUMBERS:
        return "<num>", NUM
    if low in UNITS:
        return "<unit>", UNIT
    if low.removesuffix("'s").removesuffix("’s") in NAMES and core[0].isupper():
        return "<name>", NAME
    if not opening and core[0].isupper() and len(core) > 1 and not core.isupper():
        return "<name>", NAME
    return low, LITERAL_KIND


class Template:
    """Words of many texts as template codes, hashed words and kinds; remembers each surface word."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.rows: list[tuple[int, int, int, int, bool]] = []

    def number(self, word: str) -> int:
        n = self.at.get(word)
        if n is None:
            from xxhash import xxh3_64_intdigest as h

            (a, ka), (b, kb) = canonical(word, True), canonical(word, False)
            n = self.at[word] = len(self.rows)
            self.rows.append((h(a.encode()), h(b.encode()), ka, kb, word.rstrip("\"'”’)").endswith((".", "!", "?"))))
        return n

    def read(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Words by text, and over all texts in a row: template codes, kinds, and the text each belongs to."""
        if len(self.rows) > 400_000:
            self.at, self.rows = {}, []
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        n = np.fromiter((self.number(w) for ws in words for w in ws), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(texts)), sizes)
        if not len(n):
            return words, np.empty(0, np.uint64), np.empty(0, np.int8), of
        table = np.array([r[:2] for r in self.rows], np.uint64), np.array([r[2:4] for r in self.rows], np.int8), np.array([r[4] for r in self.rows], bool)
        opening = np.ones(len(n), bool)
        opening[1:] = table[2][n[:-1]] | (of[1:] != of[:-1])
        return words, np.where(opening, table[0][n, 0], table[0][n, 1]), np.where(opening, table[1][n, 0], table[1][n, 1]), of


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    out = np.full(max(0, len(codes) - width + 1), width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(out)]
    return out ^ (out >> np.uint64(32))


class Index:
    """Template windows of a block of benchmark items, by window width (shorter for items of fewer words)."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = {}
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        template = Template()
        words, codes, kinds, of = template.read([t for _, t in items])
        ends = np.cumsum([len(w) for w in words])
        for (item, _), w, end in zip(items, words, ends):
            c, k = codes[end - len(w) : end], kinds[end - len(w) : end]
            if len(w) < 3:
                continue  # two words decide nothing
            self.items[item] = (w, k)
            width = min(WINDOW, len(w))
            found = list(enumerate(windows(c, width).tolist()))
            other = template.rows[template.number(w[0])][1]
            if other != c[0]:  # the first word as read behind other words
                found += [(-1, x) for x in windows(np.concatenate([np.array([other], np.uint64), c[1:width]]), width).tolist()]
            for p, x in found:
                self.at[width][x].append((item, p))
        self.at = {w: dict(x) for w, x in self.at.items()}
        self.sorted = {w: np.sort(np.fromiter(x, np.uint64, len(x))) for w, x in self.at.items()}


def _consistent(pairs: list[tuple[int, str, str]]) -> bool:
    """Each slot value of the item always stands for one value in the text, and different ones stay different."""
    forth: dict = {}
    back: dict = {}
    return all(forth.setdefault((k, a), b) == b and back.setdefault((k, b), a) == a for k, a, b in pairs)


def matches(texts: list[str], index: Index, template: Template) -> list[tuple[int, int, int, int, int, float, int, bool, bool]]:
    """(text, item, word offset, run of words, literal words in it, share of the item, slots, slots consistent, slots equal)."""
    words, codes, kinds, of = template.read(texts)
    starts = np.searchsorted(of, np.arange(len(texts)))
    runs: dict[tuple[int, int, int, int], list[int]] = defaultdict(list)
    for width, table in index.sorted.items():
        x = windows(codes, width)
        if not len(x):
            continue
        at = np.searchsorted(table, x)
        hit = np.flatnonzero((table[np.minimum(at, len(table) - 1)] == x) & (of[: len(x)] == of[width - 1 :]))
        for p in hit.tolist():
            d = int(of[p])
            q = p - int(starts[d])
            for item, ip in index.at[width][int(x[p])]:
                if ip < 0:
                    ip = 0
                    if words[d][q].strip(_EDGE).casefold() != index.items[item][0][0].strip(_EDGE).casefold():
                        continue  # another name in its place
                runs[(d, item, q - ip, width)].append(ip)
    out = []
    for (d, item, shift, width), places in runs.items():
        iw, ik = index.items[item]
        places = sorted(set(places))
        begin = places[0]
        for here, following in zip(places, [*places[1:], None]):
            if following == here + 1:
                continue
            a, b = begin, here + width
            begin = following
            slots = [(int(ik[i]), iw[i].strip(_EDGE).casefold(), words[d][shift + i].strip(_EDGE).casefold()) for i in range(a, b) if ik[i]]
            literal = int((ik[a:b] == LITERAL_KIND).sum())
            out.append((d, item, shift + a, b - a, literal, (b - a) / len(iw), len(slots), _consistent(slots), all(x == y for _, x, y in slots)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, offset, run_words, share, n_slots): the longest leaking run of each item in each document.

    Numbers, units and names become typed placeholders.  Windows of WINDOW template words are looked up
    in the benchmark's; consecutive hits on one alignment join into a run.  A run is a leak if it
    covers RUN words or the whole item, holds LITERAL plain words (or, in a shorter item, a majority) or is a copy with
    the same slot values, and its slots stand for each other one to one, so that an exact copy and a re-parameterised question are caught and
    a mere resemblance is not.

    Null and empty texts or items match nothing; items under three words are too short to decide.  Rows
    with a null id are searched and carry the null.  Repeated rows repeat their matches once.  The benchmark
    passes in blocks of BLOCK_CHARS characters, so what is broadcast is bounded at any benchmark size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    found = None
    for k in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        part = rows.mapInPandas(_search(docs.sparkSession.sparkContext.broadcast([tuple(r) for r in held])), "doc_id long, item_id long, offset long, run_words long, share double, n_slots long")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("run_words", (-F.col("offset")).alias("back"), "share", "n_slots")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.back")).alias("offset"), "best.run_words", "best.share", "best.n_slots")


def _search(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, template = Index(held.value), Template()
        for b in batches:
            ids, texts, out = b["doc_id"].tolist(), [t or "" for t in b["text"]], []
            step = max(1, len(texts) // (1 + sum(map(len, texts)) // 8_000_000))
            for i in range(0, len(texts), step):
                for d, item, at, run_words, literal, share, slots, same, equal in matches(texts[i : i + step], index, template):
                    if same and (run_words >= RUN or share == 1) and (equal or literal >= min(LITERAL, run_words // 2 + 1)):
                        out.append((ids[i + d], item, at, run_words, share, slots))
            got = pd.DataFrame(out, columns=["doc_id", "item_id", "offset", "run_words", "share", "n_slots"])
            got["doc_id"] = pd.array(got["doc_id"].tolist(), dtype="Int64")
            yield got.astype({"item_id": "int64", "offset": "int64", "run_words": "int64", "n_slots": "int64", "share": "float64"})

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that leak a benchmark item; columns as they are, rows with a null id stay."""
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__leaky")).where("__leaky is not null").distinct()
    return docs.join(bad, docs[id_col] == F.col("__leaky"), "left_anti")
