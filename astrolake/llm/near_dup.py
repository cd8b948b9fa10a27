"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from astrolake.llm.shared import Codes, ascii_words, components, dropped, id_filter, kept, maybe_in

#: Minwise tokens kept of each set, independent trees, and the node size from which a node branches again.
COORDS, TREES, LEAF = 128, 12, 64
#: Stars of a large node, members that its consensus is taken from, and the longest path it branches by at once.
PIVOTS, SAMPLE, LONGEST = 3, 48, 16
#: -log of the share of pairs at the similarity itself that the paths below the large nodes may part.
PARTED = 7.0
#: Comparisons up to which a node's stragglers are set against all its members, and the blocks this is done in.
COMPARISONS, BLOCK = 4_000_000, 512
#: Minwise tokens two sets must share before their full sets are compared; a pair at 0.8 misses this with 3e-4.
LEAST_SHARED = 86
#: Smallest shingle numbers kept of a straggler's set (all of most sets, an even sample of a longer one), and the
#: standard deviations by which a sample may fall short of the similarity.
SKETCH, DEVIATIONS = 512, 4.5


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, codes: Codes) -> np.ndarray:
    """Sorted distinct shingles of a whole text as 64-bit numbers; a shorter text is one shingle, an empty one none."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    x = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(x))
    out = np.full(len(x) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + x[i : len(x) - n + 1 + i])
    return np.unique(out)


def minwise(s: np.ndarray, by: np.ndarray) -> np.ndarray:
    low = np.full(len(by), 2**32 - 1, np.uint32)
    for i in range(0, len(s), 4096):
        part = ((s[i : i + 4096, None] * by) >> np.uint64(32)).astype(np.uint32)
        low = np.minimum(low, part.min(axis=0))
    return low


def _uid(s: np.ndarray) -> int:
    return int.from_bytes(md5(s.tobytes()).digest()[:8], "little", signed=True)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, uid, sig, brief): size, identity, minwise tokens and the tokens' last bytes of each document's set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, by = Codes(), _multipliers()
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"]):
                s = shingle_set(t, width, codes)
                low = minwise(s, by)
                rows.append((i, len(s), _uid(s), low.astype(">u4").tobytes(), low.astype(np.uint8).tobytes()) if len(s) else (i, 0, 0, b"", b""))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "uid", "sig", "brief"])

    return docs.mapInPandas(run, "doc_id long, n long, uid long, sig binary, brief binary")


@F.pandas_udf(IntegerType())
def shared_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), ">u4").reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype("int32"))


@F.pandas_udf(IntegerType())
def shared_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Tokens whose last bytes agree: never fewer than the shared tokens."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype("int32"))


@F.pandas_udf(LongType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)]
    return pd.Series(out, dtype="int64")


def near_dups(docs: DataFrame, similarity: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two sets are linked if ``100 * |A and B| >= similarity * |A or B|``, confirmed on the full sets of
    word shingles.  Equal sets collapse first.  In each of TREES trees a set falls into the node of one
    minwise token.  A node's stars, in a large node also its centre, are compared with all its members; what is
    then still in different components is compared exhaustively in a small node, while a large node branches
    along paths of further tokens, until no large node holds two components.  A node never emits all its pairs.

    Null or empty texts have no set and are linked with nothing.  Rows with a null id pass with
    component_id null and kept true.  Repeated rows share their component; each row is returned.
    Other columns of ``docs`` are neither read nor returned.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prof = kept(profiles(rows, width), "profiles")
    sets = kept(
        prof.where("n > 0 and doc_id is not null").groupBy("uid").agg(F.min("sig").alias("sig"), F.min("brief").alias("brief"), F.max("n").alias("n"), F.min("doc_id").alias("first_id")), "sets"
    )
    # signatures are in ``sets`` now; two copies of them would be the largest tables
    ids = kept(prof.select("doc_id", "n", "uid"), "ids")
    dropped(prof)
    labels = _labels(rows, sets, similarity, width)
    of_set = sets.join(labels.withColumnRenamed("id", "uid"), "uid", "left").select("uid", "first_id", F.coalesce("label", "uid").alias("label"))
    least = of_set.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = kept(of_set.join(least, "label").select("uid", "component_id"), "components")
    dropped(sets)
    out = ids.join(named, "uid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _token(coord):
    return F.expr("sig").substr(coord * 4 + 1, F.lit(4))


def _grown(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components once the links ``found`` are added; of what is known, one link from each set to its label stands for all."""
    return components(found if labels is None else found.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b"))))


def _labels(rows: DataFrame, sets: DataFrame, similarity: int, width: int) -> DataFrame:
    """(id, label) of every set that has a link."""
    labels = None
    roots = F.array_distinct(F.array(*[F.xxhash64(F.lit(-1 - t).cast("long"), _token(F.lit(t))) for t in range(TREES)]))
    members = sets.select("uid", F.explode(roots).alias("node"))
    first_level = True
    while True:
        # the first star does not depend on the node: sets that meet in several trees have it in common, so they make one pair
        ranks = [F.xxhash64("uid"), *[F.xxhash64("uid", "node", F.lit(p)) for p in range(1, PIVOTS)]]
        nodes = members.groupBy("node").agg(F.count("*").alias("size"), *[F.min(F.struct(h.alias("h"), "uid")).alias(f"p{p}") for p, h in enumerate(ranks)])
        nodes = nodes.where("size > 1").select("node", "size", F.when(F.col("size") > LEAF, F.array_distinct(F.array(*[F.col(f"p{p}.uid") for p in range(PIVOTS)]))).otherwise(F.array("p0.uid")).alias("stars"))
        members = kept(members.join(nodes, "node"), "members")
        big = _consensus(members.where(F.col("size") > LEAF).select("node", "size", "uid"), sets)
        stars = members.select("uid", F.explode("stars").alias("star"))
        if big is not None:
            stars = stars.unionByName(members.select("node", "uid").join(big.select("node", F.col("centre").alias("star")), "node").select("uid", "star"))
        pairs = stars.where("star <> uid").select(F.least("star", "uid").alias("a"), F.greatest("star", "uid").alias("b"))
        labels = _grown(labels, _confirmed(pairs, rows, sets, similarity, width))
        marked = members.join(labels.withColumnRenamed("id", "uid"), "uid", "left").select("node", "size", "uid", F.coalesce("label", "uid").alias("label"))
        mixed = marked.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("node")
        still = kept(marked.join(mixed, "node"), "mixed")
        near = _leaf_pairs(still.where(F.col("size") <= LEAF), sets)
        large = None
        if big is not None:
            odd = _odd(still.where(F.col("size") > LEAF))
            large = odd.where(F.col("others") * F.col("size") > COMPARISONS).select("uid", F.col("node").alias("parent"))
            first_level = first_level and large.isEmpty()
            odd = odd.where(F.col("others") * F.col("size") <= COMPARISONS)
            near = near.unionByName(_straggler_pairs(odd, sets, _sketches(odd, rows, sets, width), similarity, TREES if first_level else 0))
            first_level = False
        found = _confirmed(near, rows, sets, similarity, width)
        dropped(members, still)
        if not found.isEmpty():
            labels = _grown(labels, found)
        if large is None or large.isEmpty():
            return labels
        members = _branch(large, big, sets, similarity / 100)


def _consensus(large: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Per large node: ``centre``, the member that shares most tokens with the node's commonest ones, and ``share``, the mean share.

    The commonest tokens come from about SAMPLE members; they only guide the branching and decide no link.
    """
    if large.isEmpty():
        return None

    def commonest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sigs in b["sigs"]:
                m = np.frombuffer(b"".join(bytes(x) for x in sigs), ">u4").reshape(len(sigs), -1)
                mode = []
                for column in m.T:
                    v, n = np.unique(column, return_counts=True)
                    mode.append(v[n.argmax()])
                out.append(np.array(mode, ">u4").tobytes())
            yield pd.DataFrame({"node": b["node"], "mode": out})

    held = kept(large.join(sets.select("uid", "sig"), "uid"), "large")
    some = held.where("pmod(xxhash64(uid, node, 5), greatest(1, size div %d)) = 0" % SAMPLE).groupBy("node").agg(F.collect_list("sig").alias("sigs"))
    mode = some.mapInPandas(commonest, "node long, mode binary")
    told = kept(held.join(mode, "node").select("node", "size", "uid", shared_tokens("sig", "mode").alias("same")), "centres")
    return kept(told.groupBy("node").agg(F.max_by("uid", F.struct("same", "uid")).alias("centre"), F.avg(F.col("same") / COORDS).alias("share"), F.max("size").alias("size")), "nodes")


def _branch(large: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Members of the children of large nodes that still hold several components.

    A child's path is chosen by the parent: ``steps`` coordinates, as many as split a node of its size and mean
    similarity into leaves, and as many ``paths`` as bring a pair at the similarity together in some tree.
    """
    mutual = F.greatest(F.lit(0.01), F.least(F.lit(0.9), F.col("share") * F.col("share")))
    steps = F.least(F.lit(LONGEST), F.greatest(F.lit(1), F.ceil(F.log(F.col("size") / 24) / -F.log(mutual)).cast("int")))
    paths = F.greatest(F.lit(1), F.ceil(PARTED / (TREES * similarity) / F.pow(F.lit(similarity), F.col("steps"))).cast("int"))
    plan = nodes.select(F.col("node").alias("parent"), steps.alias("steps")).withColumn("paths", paths)
    dealt = large.join(plan, "parent").join(sets.select("uid", "sig"), "uid").select("uid", "parent", "sig", "steps", F.explode(F.sequence(F.lit(1), F.col("paths"))).alias("path"))
    at = lambda i: F.pmod(F.xxhash64("parent", "path", i), F.lit(COORDS)).cast("int")
    tokens = F.transform(F.sequence(F.lit(1), F.col("steps")), lambda i: F.xxhash64(_token(at(i))))
    return dealt.select("uid", F.xxhash64("parent", "path", tokens).alias("node")).distinct()


def _leaf_pairs(still: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components in small nodes that share enough minwise tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for group in b["group"]:
                uid = np.array([g["uid"] for g in group], np.int64)
                lab = np.array([g["label"] for g in group], np.int64)
                sig = np.frombuffer(b"".join(bytes(g["sig"]) for g in group), ">u4").reshape(len(uid), -1)
                for i in range(len(uid) - 1):
                    ok = ((sig[i + 1 :] == sig[i]).sum(axis=1) >= LEAST_SHARED) & (lab[i + 1 :] != lab[i])
                    out += [(min(uid[i], v), max(uid[i], v)) for v in uid[i + 1 :][ok]]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    groups = still.join(sets.select("uid", "sig"), "uid").groupBy("node").agg(F.collect_list(F.struct("uid", "label", "sig")).alias("group"))
    return groups.select("group").mapInPandas(run, "a long, b long")


def _odd(still: DataFrame) -> DataFrame:
    """Members of large nodes with ``odd``: not of the node's main component, and ``others``: how many are."""
    per = still.groupBy("node", "label").agg(F.count("*").alias("n"))
    main = per.groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    return kept(still.join(main, "node").select("node", "size", "uid", "label", "others", (F.col("label") != F.col("main")).alias("odd")), "odd")


def _sketches(odd: DataFrame, rows: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(uid, low): the SKETCH smallest shingle numbers, by their upper 32 bits, of the sets in ``odd``, from whole texts."""
    asked = kept(odd.select("uid").distinct().join(sets.select("uid", "first_id"), "uid"), "asked")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for b in batches:
            found = [s for s in (shingle_set(t, width, codes) for t in b["text"]) if len(s)]
            low = [(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for s in found]
            yield pd.DataFrame({"uid": pd.Series([_uid(s) for s in found], dtype="int64"), "low": low})

    read = maybe_in(rows, F.col("doc_id"), id_filter(asked, "first_id")).mapInPandas(run, "uid long, low binary")
    return kept(read.join(asked.select("uid"), "uid").groupBy("uid").agg(F.min("low").alias("low")), "sketches")


def may_be_close(low: np.ndarray, n: int, others: list[np.ndarray], sizes: np.ndarray, similarity: int) -> np.ndarray:
    """Which of the sets in ``others`` (sketches, sizes) may be similar enough to the set ``low`` of size ``n``.

    Exact for sets within SKETCH.  Of longer ones, only numbers up to the smaller of the two last ones are compared: of
    those both sketches are complete, so they sample the union evenly, and DEVIATIONS allow for the sampling.
    """
    last = lambda s, m: s[-1] if m > SKETCH else np.uint32(2**32 - 1)
    top = np.minimum(np.array([last(s, m) for s, m in zip(others, sizes)], np.uint32), last(low, n))
    flat, owner = np.concatenate(others), np.repeat(np.arange(len(others)), [len(s) for s in others])
    inside = flat <= top[owner]
    hit = low[np.minimum(np.searchsorted(low, flat), len(low) - 1)] == flat
    count = lambda mask: np.bincount(owner[mask], minlength=len(others))
    both = count(inside & hit)
    union = np.searchsorted(low, top, side="right") + count(inside) - both
    slack = np.where((sizes > SKETCH) | (n > SKETCH), DEVIATIONS * np.sqrt(similarity * (100 - similarity) * union), 0)
    return 100 * both >= similarity * union - slack


def _straggler_pairs(odd: DataFrame, sets: DataFrame, sketches: DataFrame, similarity: int, trees: int) -> DataFrame:
    """Pairs of a straggler and any member of its node, of different components, that share enough minwise tokens and whose sketches may be close.

    ``trees``: the nodes are those of that many first tokens, and none is left to branch; then a pair that meets in
    several trees is reported by the first of them alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda g: (np.array([x["uid"] for x in g], np.int64), np.array([x["label"] for x in g], np.int64), np.frombuffer(b"".join(bytes(x["sig"]) for x in g), ">u4").astype(np.uint32).reshape(len(g), -1), np.array([x["n"] for x in g], np.int64), [np.frombuffer(bytes(x["low"]), np.uint32) for x in g])
        for b in batches:
            out = [np.empty((0, 2), np.int64)]
            for few, many in zip(b["few"], b["many"]):
                (u, lu, su, nu, fu), (v, lv, sv, nv, fv) = read(few), read(many)
                tree = int(((su[:, :trees] == su[0, :trees]).all(axis=0) & (sv[:, :trees] == su[0, :trees]).all(axis=0)).argmax()) if trees else 0
                for i in range(len(u)):
                    same = sv == su[i]
                    ok = (same.sum(axis=1) >= LEAST_SHARED) & (lv != lu[i])
                    if trees:  # the tree of this node is the one whose token all its members share
                        ok[ok] = same[ok, :trees].argmax(axis=1) == tree
                    if ok.any():
                        ok[ok] = may_be_close(fu[i], int(nu[i]), [fv[j] for j in np.flatnonzero(ok)], nv[ok], similarity)
                    out.append(np.stack([np.minimum(v[ok], u[i]), np.maximum(v[ok], u[i])], axis=1))
            yield pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    item = F.struct("uid", "label", "sig", "n", "low")
    held = odd.join(sets.select("uid", "sig", "n"), "uid").join(sketches, "uid").withColumn("blocks", F.ceil(F.col("others") / BLOCK).cast("int"))
    few = held.where("odd").groupBy("node", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list(item).alias("few"))
    dealt = held.select("node", F.pmod(F.xxhash64("uid", F.lit(1)), F.ceil(F.col("size") / BLOCK)).alias("chunk"), "uid", "label", "sig", "n", "low", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    many = dealt.groupBy("node", "block", "chunk").agg(F.collect_list(item).alias("many"))
    return many.join(few, ["node", "block"]).select("few", "many").mapInPandas(run, "a long, b long")


def _confirmed(pairs: DataFrame, rows: DataFrame, sets: DataFrame, similarity: int, width: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda k: sets.select(F.col("uid").alias(k), F.col("brief").alias(f"brief_{k}"), F.col("n").alias(f"n_{k}"), F.col("first_id").alias(f"id_{k}"))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    near = kept(near.where(shared_bytes("brief_a", "brief_b") >= LEAST_SHARED).select("a", "b", "n_a", "n_b", "id_a", "id_b"), "candidates")
    if near.isEmpty():
        return near.select("a", "b")
    wanted = id_filter(near.select(F.explode(F.array("id_a", "id_b")).alias("doc_id")), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for b in batches:
            found = [shingle_set(t, width, codes) for t in b["text"]]
            found = [s for s in found if len(s)]
            yield pd.DataFrame({"uid": pd.Series([_uid(s) for s in found], dtype="int64"), "tokens": [s.tobytes() for s in found]})

    full = maybe_in(rows, F.col("doc_id"), wanted).mapInPandas(run, "uid long, tokens binary")
    uids = near.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    full = kept(full.join(uids, "uid", "left_semi").groupBy("uid").agg(F.min("tokens").alias("tokens")), "full")
    both = near.join(full.withColumnRenamed("uid", "a").withColumnRenamed("tokens", "t_a"), "a").join(full.withColumnRenamed("uid", "b").withColumnRenamed("tokens", "t_b"), "b")
    common = both.select("a", "b", "n_a", "n_b", overlap("t_a", "t_b").alias("both"))
    links = kept(common.where(100 * F.col("both") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"), "links")
    dropped(near, full)
    return links
