"""Phrase collocations by partitioned mining: shards give candidates at a lowered support, then all are counted exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from astrolake.llm.shared import Codes, kept

#: Shards of the table.  A phrase that occurs ``support`` times occurs at least ``local_support`` times in one of them.
SHARDS = 3
#: Words a task gathers before it sends their phrases on.
CHUNK = 1 << 19
#: Texts copied out of an Arrow batch at a time.
ROWS = 256
#: Words whose codes a task remembers.
CODES = 100_000
#: Bytes of text cut into words at a time, at the end of a piece.
SLICE = 1 << 20
#: Bits of the filter of candidates that every task of the second pass gets (8 MB, whatever it holds).
BITS = 1 << 26

_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\x0d", bytes(range(97, 123)) + b" " + b"\n" * 9)
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def local_support(support: int, shards: int = SHARDS) -> int:
    """Less in every shard is less than ``support`` in all of them."""
    return (support - 1) // shards + 1


class Chunk:
    """Words of one language as numbers, with a 0 between pieces."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b"\n": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        """The words of a whole text; long texts go in slices that end with a piece."""
        data, at, number = text.translate(_TABLE), 0, self.number
        while at < len(data):
            end = len(data) if len(data) - at <= SLICE else data.find(b"\n", at + SLICE) % (len(data) + 1)
            words = [w for w in data[at:end].replace(b"\n", b" \n ").split(b" ") if w]
            self.parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            self.parts.append(np.zeros(1, np.int32))
            self.size += len(words) + 1
            at = end

    def phrases(self, longest: int, lang: bytes, codes: Codes) -> Iterator[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]]:
        """For each length: links, hash, and count of every distinct phrase.

        A phrase is linked to the one without its last word, at every length so far, and to that word's number; so
        phrases are told apart by their words, while the hash is the same in every task.
        """
        ids = np.concatenate([*self.parts, np.zeros(longest, np.int32)])
        coded = np.fromiter((codes[w] for w in self.number), np.uint64, len(self.number))
        hashes = np.full(1, codes[b"\x00" + lang], np.uint64)
        where = np.flatnonzero(ids)  # where a phrase starts
        group, links = np.zeros(len(where), np.int64), []
        for width in range(1, longest + 1):
            following = ids[where + width - 1]
            whole = following > 0
            where, key = where[whole], group[whole] * len(coded) + following[whole]
            kinds, group, counts = np.unique(key, return_inverse=True, return_counts=True)
            first, last = kinds // len(coded), kinds % len(coded)
            links.append((first, last))
            hashes = (hashes[first] ^ coded[last] * _MIX[0]) * _MIX[1]
            hashes ^= hashes >> np.uint64(32)
            yield links, hashes, counts


def spelled(links: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray) -> np.ndarray:
    """The word numbers of the phrases ``at``, one row each."""
    columns = []
    for first, last in reversed(links):
        columns.append(last[at])
        at = first[at]
    return np.stack(columns[::-1], axis=1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Chunk]]:
    """Chunks of one language each, as they fill up and at the end of the task."""
    held: dict[str, Chunk] = {}
    for b in batches:
        for at in range(0, b.num_rows, ROWS):  # few texts at a time are copied out of the batch
            part = b.slice(at, ROWS)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                chunk = held.setdefault(lang, Chunk())
                chunk.add(text)
                if chunk.size >= CHUNK:
                    yield lang, held.pop(lang)
        while sum(c.size for c in held.values()) >= 2 * CHUNK:
            most = max(held, key=lambda k: held[k].size)
            yield most, held.pop(most)
    yield from held.items()


def candidates(texts: DataFrame, longest: int, support: int) -> DataFrame:
    """Hashes of the phrases that are frequent in some shard at ``local_support``: all that are frequent in the table, and few others.

    A shard is every SHARDS-th split of the table.  It is mined completely: each task counts the phrases of its split,
    and grouped sums by hash and shard put the tasks of a shard together.  SHARDS is at most 256, and hashes keep 56 bits.
    """
    least = local_support(support)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, shard = Codes(CODES), np.uint64(TaskContext.get().partitionId() % SHARDS)
        for lang, chunk in _chunks(batches):
            for _, hashes, counts in chunk.phrases(longest, lang.encode(), codes):
                keys = hashes << np.uint64(8) | shard  # as one number, since there are very many
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "c"])

    seen = texts.mapInArrow(run, "key long, c long")
    # each task has summed its own, so nearly all keys of a task are distinct: summing once more before the shuffle would only fill memory
    return seen.repartition("key").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select(F.shiftrightunsigned("key", 8).alias("hash")).distinct()


def _filter(hashes: DataFrame) -> np.ndarray:
    """The candidates as BITS bits: it may hold strangers, never misses; at most BITS / 64 rows reach the driver."""
    slots = hashes.select(F.pmod("hash", F.lit(BITS)).alias("slot"))
    words = slots.selectExpr("cast(slot div 64 as int) as at", "shiftleft(1L, cast(slot % 64 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def counted(texts: DataFrame, hashes: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, words, c): exact counts over all texts of the phrases whose hash passes the filter of ``hashes``, and, with no words, of all words.

    Each task sums up its own; the sums of one phrase, told by its words, then meet in a grouped aggregate.
    """
    marks = texts.sparkSession.sparkContext.broadcast(_filter(hashes))

    def frame(langs: list[str], phrases: list[bytes], width: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(phrases), width, np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "words", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(CODES)
        for lang, chunk in _chunks(batches):
            names = list(chunk.number)
            yield frame([lang], [b""], 0, np.array([sum(np.count_nonzero(p) for p in chunk.parts)]))
            for links, hashes, counts in chunk.phrases(longest, lang.encode(), codes):
                slots = hashes & np.uint64(BITS - 1)
                hit = np.flatnonzero(marks.value[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1))
                phrases = [b" ".join([names[i] for i in row]) for row in spelled(links, hit).tolist()]
                yield frame([lang] * len(phrases), phrases, len(links), counts[hit])

    return texts.mapInArrow(run, "lang string, phrase string, words int, c long").groupBy("lang", "phrase", "words").agg(F.sum("c").alias("c"))


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, cover: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``longest`` words of each language by the score of their worst cut.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of that cut, ``n`` all words of the language.  A phrase goes if a longer
    frequent one around it has ``cover`` percent of its count.  A null language is ``und``; a null or empty text has no words; repeated
    rows and ids count each time; ties go by count and then by the bytes of the phrase; an empty table gives no rows; other columns are
    not read.

    Two passes over the texts: ``candidates`` mines the shards, ``counted`` counts what they found.  Parts of a frequent phrase are frequent
    themselves, so the second pass holds every count a cut needs.  Common phrases leave each task as one row, so none is a hot key of the
    counts; parts that many phrases share are joined with skewed partitions split.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    found = kept(counted(texts, candidates(texts, longest, support), longest).where((F.col("c") >= support) | (F.col("words") == 0)), "phrases")
    frequent = found.where((F.col("c") >= support) & (F.col("words") > 1)).withColumn("w", F.split("phrase", " "))

    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = frequent.select("lang", "phrase", "words", F.col("c").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda name, c: found.select("lang", F.col("phrase").alias(name), F.col("c").alias(c))
    wide = "cast({} as decimal(15,0))".format
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", F.expr(f"({wide('1000000')} * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})"))
    worst = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = frequent.where("words > 2").select("lang", "c", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("c").alias("longer"))
    left = worst.join(inside, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {cover} * a"))
    # the ranking reaches no more than `top` rows a language from any task
    best = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    words = found.where("words = 0").select("lang", F.col("c").alias("n"))
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
