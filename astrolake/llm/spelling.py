"""Spelling variants by a walk of all words through a distributed trie, with one edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.llm.shared import kept

#: Letters that make up a word.
RUN = "([A-Za-z\\u00C0-\\u00FF]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_chars: int, least_n: int, damage: int | None = None) -> DataFrame:
    """(word, n): the lower-cased runs of letters of all texts that are long and frequent enough.

    With ``damage``, a run whose crc32 together with its doc_id divides by it loses one letter, at the crc32 modulo its length.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN), F.lit(1))).alias("run")).where(F.length("run") >= least_chars)
    word = F.col("run")
    if damage:
        runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8")))
        word = F.expr(f"if(h % {damage} = 0, concat(left(run, int(h % length(run))), substring(run, int(h % length(run)) + 2)), run)")
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= least_chars) & (F.col("n") >= least_n))


def _node(back: Column, start: Column) -> Column:
    """A trie node is known by the hash of its reading direction and the letters that lead to it."""
    return F.xxhash64(back, start)


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes on each word's own path, and the edges of the trie of all words, read forwards and backwards.

    paths: (s, back, p, node, to, child): word ``s`` as read, and each node where it may turn off, at depth ``p``, with its own next one.
    edges: (node, c, label, child, ends): by the first letter of the label; ``ends`` if a word ends at the child.
    Only nodes where words branch or end are kept, so a path through letters nobody leaves is one edge.  Nodes at a depth
    below two have none: no walk starts there.
    """
    both = words.select(F.col("word").alias("s"), F.lit(False).alias("back")).unionByName(words.select(F.reverse("word").alias("s"), F.lit(True).alias("back")))
    starts = both.select("s", "back", F.explode(F.sequence(F.lit(2), F.length("s"))).alias("p")).withColumn("node", _node(F.col("back"), F.expr("left(s, p)")))
    following = F.expr("substring(s, p + 1, 1)")
    ends = starts.groupBy("node").agg(F.min(following).alias("a"), F.max(following).alias("b")).where("a <> b or a = ''").select("node")
    stops = starts.join(ends, "node", "left_semi").groupBy("s", "back").agg(F.sort_array(F.collect_list(F.struct("p", "node"))).alias("stops"))
    paths = stops.select("s", "back", F.posexplode("stops").alias("i", "stop"), "stops").select(
        "s", "back", F.col("stop.p").alias("p"), F.col("stop.node").alias("node"), F.expr("get(stops, i + 1)").alias("next"))
    paths = kept(paths.select("s", "back", "p", "node", F.col("next.p").alias("to"), F.col("next.node").alias("child")), "paths")
    edges = paths.where("to is not null").groupBy("node", F.expr("substring(s, p + 1, 1)").alias("c")).agg(
        F.first(F.expr("substring(s, p + 1, to - p)")).alias("label"), F.first("child").alias("child"), F.max(F.expr("to = length(s)")).alias("ends"))
    return paths, kept(edges, "trie")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other): all pairs of ``words`` that differ by one inserted, deleted or replaced letter, both ways round.

    A state is (word, position, node, edits).  Without an edit a word is on its own path, so those states are all there from the start.
    At each node of its path a word may replace its next letter by another edge's, or skip the letter; then it has one edit and
    follows the edges level by level, until its letters are used up at a node where another word ends.  Edits in the later half
    are found forwards, those in the earlier half backwards, where few words share the long start and few edges leave.  A
    replacement is looked for from the smaller letter only, a missing letter from the longer word only, and of a run
    of one letter only the last is skipped.
    """
    paths, edges = trie(words)
    half = F.expr("if(back, floor((length(s) + 1) / 2), ceil((length(s) - 1) / 2))")
    own = paths.where((F.col("p") >= half) & F.expr("p < length(s)"))
    out = edges.withColumnRenamed("child", "onto")
    swap = own.join(out, "node").where("c > substring(s, p + 1, 1) and substring(s, p + 2, length(label) - 1) = substring(label, 2) and p + length(label) <= length(s)")
    swapped = swap.select("s", "back", F.expr("p + length(label)").alias("p"), F.col("onto").alias("node"), "ends")
    skip = own.withColumn("c", F.expr("substring(s, p + 2, 1)")).where("c <> '' and c <> substring(s, p + 1, 1)").join(out, ["node", "c"])
    skipped = skip.where("substring(s, p + 2, length(label)) = label").select("s", "back", F.expr("p + 1 + length(label)").alias("p"), F.col("onto").alias("node"), "ends")
    short = own.where("p = length(s) - 1").select("s", "back", F.expr("p + 1").alias("p"), "node", F.lit(True).alias("ends"))
    level = kept(swapped.unionByName(skipped).unionByName(short).where("p < length(s) or ends"), "states")
    levels = []
    while not level.isEmpty():
        levels.append(level.where("p = length(s)"))
        ahead = level.where("p < length(s)").drop("ends").withColumn("c", F.expr("substring(s, p + 1, 1)")).join(out, ["node", "c"])
        ahead = ahead.where("substring(s, p + 1, length(label)) = label").select("s", "back", F.expr("p + length(label)").alias("p"), F.col("onto").alias("node"), "ends")
        level = kept(ahead.where("p < length(s) or ends"), "states")
    if not levels:
        return words.select("word", F.col("word").alias("other")).where("false")
    done = levels[0]
    for more in levels[1:]:
        done = done.unionByName(more)
    terminals = words.select(F.col("word").alias("other"), F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    terminals = terminals.select("other", _node(F.col("back"), F.expr("if(back, reverse(other), other)")).alias("node"))
    found = done.join(terminals, "node").select(F.expr("if(back, reverse(s), s)").alias("word"), "other").where("levenshtein(word, other) = 1")
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of each chain, by following twice as far each round.

    Counts at least double along a chain, so chains are short and have no rings.
    """
    reach = kept(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = kept(reach.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        reach = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reach


def spelling_groups(docs: DataFrame, least_chars: int = 5, least_n: int = 3, ratio: int = 2, damage: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: every frequent word, its most frequent near word if that has ``ratio`` times its count, and where such forms lead.

    A null or empty text has no words; a null id counts as an empty one; repeated rows and ids count each time; ties go to
    the smallest word in code-point order; an empty table gives no rows; columns other than doc_id and text are not read.
    Words are counted before anything is joined, and a node's edges are at most the letters, so a join gives few rows for each word;
    a node with very many words below is a skewed key, which Spark splits.
    """
    words = kept(word_counts(docs, least_chars, least_n, damage), "words")
    near = near_words(words.select("word")).join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    # of the largest count, the smallest word: kept apart by their counts, since strings have no negative
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.max("m").alias("m"), F.min_by("other", F.struct(-F.col("m"), "other")).alias("other"))
    told = words.join(best, "word", "left").withColumn("enough", F.coalesce(F.col("m") >= ratio * F.col("n"), F.lit(False)))
    formed = kept(told.select("word", F.when(F.col("enough"), F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("enough"), F.col("m")).alias("form_n")), "forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
