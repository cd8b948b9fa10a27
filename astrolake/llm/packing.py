"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths, the fixed cost of a sequence in tokens, and documents that are packed together.
CAPACITIES, OVERHEAD, SHARD_ROWS = (512, 1024, 2048, 4096), 16, 4_000


def word_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` and one end token."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[tuple[int, int]], list[int]]:
    """Best-fit decreasing over several capacities: ((bin, offset) of each size, capacity of each bin).

    A piece goes to the open bin it leaves least room in (the oldest of equals).  If none fits, a new bin is opened at
    the capacity of least cost: what it costs, less the going rate for the room that remaining tokens can still
    fill.  In the end each bin shrinks to the smallest capacity that holds its contents.
    """
    rate = min((c + overhead) / c for c in capacities)
    room: list[tuple[int, int]] = []
    used: list[int] = []
    where: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    left = sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        left -= n
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free = min((c for c in capacities if c >= n), key=lambda c: (c + overhead - rate * min(c - n, left), c))
            b = len(used)
            used.append(0)
        where[i] = (b, used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return where, [min(c for c in capacities if c >= u) for u in used]


def pack_documents(docs: DataFrame, tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id, capacity, position.

    ``tokens`` gives a document's token count (default: words and one end token).  A document longer than the
    largest capacity is cut into full pieces, which are bins of their own, and a rest.  Pieces are dealt by hash to
    shards of about SHARD_ROWS, each packed in one task, so no task grows with the input; a shard
    wastes at most its last few bins.  Every token of every document lies in exactly one bin.

    Null and empty texts count as their end token alone.  Null ids and repeated rows are packed as rows of their
    own (``bin_id`` and ``position`` keep them apart).  Other columns are neither read nor returned.
    """
    top = max(capacities)
    n = tokens if tokens is not None else word_tokens(F.col(text_col))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.cast("long").alias("n"))
    shards = max(1, -(-docs.count() // SHARD_ROWS))
    cut = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(n - 1) div {top}")))).alias("piece"))
    pieces = cut.select(
        "doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (shard,), b in batches:
            b = b.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
            where, held = pack(b["n_tokens"].tolist(), capacities)
            b["bin_id"] = [int(shard) * 2**32 + k for k, _ in where]
            b["capacity"] = [held[k] for k, _ in where]
            b["position"] = [p for _, p in where]
            yield b[["doc_id", "piece", "start", "n_tokens", "bin_id", "capacity", "position"]]

    def one(key, b: pd.DataFrame) -> pd.DataFrame:
        return next(run(iter([(key, b)])))

    return pieces.groupBy("shard").applyInPandas(one, "doc_id long, piece long, start long, n_tokens long, bin_id long, capacity long, position long")
