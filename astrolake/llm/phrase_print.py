"""Document fingerprints from Lempel-Ziv phrases: documents that compress well together have like fingerprints."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from astrolake.llm.shared import kept

#: Slots of a signature; each keeps one byte of its smallest hash.  Two unlike slots are equal by chance once in 256.
SLOTS = 128

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_EDGES = (np.arange(SLOTS, dtype=np.uint64)) << np.uint64(64 - 7)
_MOST = np.iinfo(np.uint64).max
#: Where a slot without phrases looks for a value: its own order of all slots.
_DONORS = np.stack([np.random.default_rng([20, i]).permutation(SLOTS) for i in range(SLOTS)])


def parse(text: str, root: dict, start: int = 0) -> tuple[list[int], list[dict]]:
    """Ends of the phrases of ``text`` from ``start`` on, and the node each hangs from.

    A phrase is the longest one in the dictionary ``root`` (a tree of code points) plus one code point, and joins it.
    A known phrase left over at the end of the text is no new phrase.
    """
    ends, parents, node = [], [], root
    for end, point in enumerate(text[start:], start + 1):
        following = node.get(point)
        if following is None:
            node[point] = {}
            parents.append(node)
            ends.append(end)
            node = root
        else:
            node = following
    return ends, parents


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to 2 ** bits of the base and of its inverse."""
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(1 << bits, b))]) for b in (_BASE, _UNBASE))


def _hashes(text: str, ends: list[int], start: int) -> np.ndarray:
    """A 64-bit hash of each phrase from ``start`` on: a polynomial over its code points, mixed."""
    if not ends:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text[start:].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    up, down = _powers(max(14, len(points).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * up[: len(points)])])
    to = np.asarray(ends, dtype=np.int64) - start
    since = np.concatenate([np.zeros(1, np.int64), to[:-1]])
    h = (sums[to] - sums[since]) * down[since]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash that falls into each slot by its first bits, or the largest number."""
    ordered = np.append(np.sort(hashes), _MOST)
    first = ordered[np.searchsorted(ordered, _EDGES)]
    return np.where(first >> np.uint64(64 - 7) == np.arange(SLOTS, dtype=np.uint64), first, _MOST)


class Parsed:
    """A text, the ends of its phrases, and its slots; the dictionary serves an edit that keeps the text before ``cut``."""

    def __init__(self, text: str) -> None:
        self.text, self.cut, self.root = text, len(text) - len(text) // 2, {}
        self.ends, self.parents = parse(text, self.root)
        self.both = bisect_right(self.ends, self.cut)
        hashes = _hashes(text, self.ends, 0)
        self.shared = _smallest(hashes[: self.both])
        self.print = encode(np.minimum(self.shared, _smallest(hashes[self.both :])))

    def edited(self, other: str) -> tuple[str, str]:
        """The text with its last floor(n / 2) code points replaced by the first as many (or all) of ``other``, and its fingerprint.

        Phrases that end before the edit are the same in both: later ones leave the dictionary, last first, and the parse goes on from there.
        """
        text = self.text[: self.cut] + other[: len(self.text) - self.cut]
        while len(self.ends) > self.both:
            del self.parents.pop()[self.text[self.ends.pop() - 1]]
        at = self.ends[-1] if self.ends else 0
        return text, encode(np.minimum(self.shared, _smallest(_hashes(text, parse(text, self.root, at)[0], at))))


def encode(slots: np.ndarray) -> str:
    """The printed form: one byte a slot in base64, empty slots filled from others; empty for a text without phrases."""
    filled = slots != _MOST
    if not filled.any():
        return ""
    if not filled.all():
        bare = np.flatnonzero(~filled)
        slots = slots.copy()
        slots[bare] = slots[_DONORS[bare, filled[_DONORS[bare]].argmax(axis=1)]]
    return base64.b64encode((slots & np.uint64(255)).astype(np.uint8).tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """Estimated share of common phrases: equal slots, less those that agree by chance; 1 for equal prints, 0 against an empty one."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = np.mean(np.frombuffer(base64.b64decode(a), np.uint8) == np.frombuffer(base64.b64decode(b), np.uint8))
    return max(0.0, (float(same) - 1 / 256) * 256 / 255)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, n_chars): the phrase fingerprint of every row's whole text; a null text counts as empty.

    Map-only.  Repeated rows and ids give one row each; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([Parsed(t).print for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "fingerprint", "n_chars"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string, n_chars long").withColumnRenamed("id", id_col)


_FIELDS = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_SHAPE = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _beside(one: Parsed, following: Parsed) -> tuple:
    edited, mark = one.edited(following.text)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return len(one.text), digest, one.print, mark, likeness(one.print, mark), likeness(one.print, following.print)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def with_neighbour_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text against its edited text and the next text.

    The next document is the one that follows by descending doc_id, null ids last; rows of one id follow by a hash of their
    text and then by their place in the table, so repeated rows have one order.  After the last comes the first, so a
    single row is its own next one.  A null text counts as empty: it has an empty fingerprint, like another empty one by 1
    and any other by 0.  An empty table gives no rows; columns other than doc_id and text are not read.

    Rows are dealt by ranges of (id, hash, place), so that neither a hot id nor null ids meet in one task, and each task walks its
    range once with one row in hand.  Only the first row and the last of each range leave it with their texts: the last one
    meets the first of the next range in a join of two rows a range.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("place")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blank, kinds = None, (None,) * len(_FIELDS), None
        for b in batches:
            kinds = {"doc_id": b.schema.field("doc_id").type, "h": pa.int64(), "place": pa.int64(), "edge": pa.string(), "text": pa.string(), **_FIELDS}
            out = []
            for i, h, place, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "h", "place", "text"))):
                parsed = Parsed(text)
                if held is None:
                    out.append((i, h, place, "first", text, *blank))
                else:
                    out.append((*held[0], None, None, *_beside(held[1], parsed)))
                held = (i, h, place), parsed
            yield _batch(out, kinds)
        if held is not None:
            yield _batch([(*held[0], "last", held[1].text, *blank)], kinds)

    shape = f"doc_id {kind}, h long, place long, edge string, text string, {_SHAPE}"
    walked = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, shape), "prints")
    edges = walked.where("edge is not null")  # two rows a range
    ranks = edges.select("doc_id", "h", "place", "edge").withColumn("at", F.row_number().over(W.orderBy(*order, "edge")))
    placed = edges.select("place", "edge", "text", "doc_id").join(ranks.select("place", "edge", "at"), ["place", "edge"])
    firsts = placed.where("edge = 'first'").select(F.col("at").alias("to"), F.col("text").alias("other"))
    lasts = placed.where("edge = 'last'").select("doc_id", "text", F.when(F.col("at") == edges.count(), 1).otherwise(F.col("at") + 1).alias("to"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *_beside(Parsed(t), Parsed(o))) for i, t, o in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "other")))]
            yield _batch(out, {"doc_id": b.schema.field("doc_id").type, **_FIELDS})

    ends = lasts.join(firsts, "to").select("doc_id", "text", "other").mapInArrow(close, f"doc_id {kind}, {_SHAPE}")
    return walked.where("edge is null").select("doc_id", *_FIELDS).unionByName(ends)
