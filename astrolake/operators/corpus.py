"""Corpus search: sections, links, postings, fielded ranking, coverage and scope.

Ranking joins query terms with postings on the term, so nothing scans every document per query;
term frequencies are combined per document and field before anything is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from astrolake.functions.text import STOP, normalise, script_tokens, slug
from astrolake.session import cut, hold

# fixed values: field weights of the fielded score
WEIGHTS = {"title": 12.0, "tags": 8.0, "description": 6.0, "category": 5.0, "headings": 4.0, "applies_to": 3.0, "body": 1.0}
STRONG = tuple(f for f in WEIGHTS if f != "body")


def with_front_matter(df: DataFrame, text: str) -> DataFrame:
    """Split ``---`` front matter from the body; keys to a map, tags to an array, dates typed, gaps listed."""
    parts = F.split(F.col(text), r"(?m)^---\s*$\n?", 3)
    has = (F.size(parts) == 3) & (F.trim(parts[0]) == "")
    meta = F.when(has, F.str_to_map(F.trim(parts[1]), F.lit("\n"), F.lit(": ")))
    out = df.withColumn("meta", meta).withColumn("body", F.when(has, parts[2]).otherwise(F.col(text)))
    get = lambda k: F.trim(F.try_element_at("meta", F.lit(k)))
    return (
        out.withColumn("title", get("title")).withColumn("tags", F.split(get("tags"), r"\s*,\s*"))
        .withColumn("updated", F.try_to_timestamp(get("updated"), F.lit("yyyy-MM-dd")).cast("date"))
        .withColumn("missing", F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(get(k), F.lit("")) == "", F.lit(k)) for k in ("title", "tags", "updated")])), ",")))


def explode_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Headed sections of a text as rows, without a shuffle until repeated slugs are numbered.

    A heading is a non-blank line followed by a rule of one repeated mark at least two short of it.
    """
    d = hold(df.select(key, text), "ln", F.split(F.col(text), "\n")).select(key, "ln")
    rule = r"^(?:=+|-+|\*+|~+)$"

    def is_head(i: Column) -> Column:
        here, below = F.get("ln", i), F.get("ln", i + 1)
        return (F.trim(here) != "") & ~here.rlike(rule) & below.rlike(rule) & (F.length(below) >= F.length(here) - 2)

    n = F.size("ln")
    d = hold(d, "heads", F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(is_head(i), F.lit(False))))
    d = d.withColumn("n", n).select(key, "ln", "n", "heads", F.posexplode("heads").alias("k", "h"))
    end = F.coalesce(F.get("heads", F.col("k") + 1), F.col("n"))
    d = d.select(
        key, F.col("k").alias("section"), F.get("ln", F.col("h")).alias("heading"), (F.col("h") + 1).alias("start_line"), end.alias("end_line"),
        F.array_join(F.slice("ln", F.col("h") + 3, F.greatest(end - F.col("h") - 2, F.lit(0))), "\n").alias("body"))
    d = d.withColumn("slug", slug(F.col("heading")))
    w = W.partitionBy(key, "slug").orderBy("section")
    i = F.row_number().over(w)
    return d.withColumn("section_id", F.when(i == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), i.cast("string"))))


def explode_commands(df: DataFrame, key: str, html: str) -> DataFrame:
    """Usage/description entries of a manual page: the first sentence of a paragraph and the rest."""
    pat = F.lit(r"<p>([^<.]+)\.([^<]*)</p>")
    z = F.arrays_zip(F.regexp_extract_all(html, pat, F.lit(1)).alias("usage"), F.regexp_extract_all(html, pat, F.lit(2)).alias("description"))
    return df.select(key, F.posexplode(z).alias("i", "z")).select(key, "i", F.trim("z.usage").alias("usage"), F.trim("z.description").alias("description"))


def page_paths(pages: DataFrame) -> DataFrame:
    """Path of a page (first word of its title), unique by smallest id."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    p = pages.select("page_id", F.concat(F.lit("/"), F.split(title, " ")[0]).alias("path"))
    return p.groupBy("path").agg(F.min("page_id").alias("target"))


def links(pages: DataFrame) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("i", "path"))


def resolve_links(pages: DataFrame) -> DataFrame:
    """Every link with its target page or null."""
    return links(pages).join(page_paths(pages), "path", "left")


def missing_targets(resolved: DataFrame) -> DataFrame:
    """Dangling paths with the number of referring pages and the first of them."""
    d = resolved.where(F.col("target").isNull()).select("path", "page_id").distinct()
    return d.groupBy("path").agg(F.count(F.lit(1)).alias("referrers"), F.min("page_id").alias("first_referrer"))


def link_graph(resolved: DataFrame) -> DataFrame:
    """Out-degree, dangling links and in-degree per page; distinct edges only."""
    e = resolved.groupBy("page_id", "path").agg(F.first("target").alias("target"))
    out = e.groupBy("page_id").agg(F.count("target").alias("out_degree"), F.count_if(F.col("target").isNull()).alias("dangling"))
    inn = e.where(F.col("target").isNotNull()).groupBy(F.col("target").alias("page_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    j = out.join(inn, "page_id", "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("page_id", z("out_degree"), z("dangling"), z("in_degree"))


def closure(edges: DataFrame) -> DataFrame:
    """Nodes reachable from every start (depth >= 1), each once at its smallest depth.

    Path doubling: a round joins the known pairs with themselves, so chains of any length settle in a
    logarithmic number of checkpointed rounds; cycles end because nothing new or nearer is found.
    """
    seen = cut(edges.select("a", "b").distinct().withColumn("depth", F.lit(1)))
    size = F.struct(F.count("*"), F.sum("depth"))
    was = seen.agg(size).first()[0]
    while True:
        far = seen.select("a", F.col("b").alias("m"), F.col("depth").alias("d1")).join(seen.select(F.col("a").alias("m"), "b", "depth"), "m")
        pairs = seen.unionByName(far.select("a", "b", (F.col("d1") + F.col("depth")).alias("depth")))
        seen = cut(pairs.groupBy("a", "b").agg(F.min("depth").alias("depth")))
        now = seen.agg(size).first()[0]
        if now == was:
            return seen
        was = now


def document_fields(docs: DataFrame) -> DataFrame:
    """Fielded view of a plain document: first line, second line, short lines, language, source, whole text."""
    docs = hold(docs.select("doc_id", "lang", "source", "text"), "lines", F.split("text", "\n"))
    lines = F.col("lines")
    short = F.filter(lines, lambda s: F.size(F.split(s, " ")) <= 5)
    return docs.select(
        F.col("doc_id").alias("doc"), F.get(lines, F.lit(0)).alias("title"), F.concat_ws(" ", "lang", "source").alias("tags"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("description"), F.col("lang").alias("category"), F.array_join(short, " ").alias("headings"),
        F.col("source").alias("applies_to"), F.col("text").alias("body"))


def postings(fields: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(term, document, field, tf) over the terms of every script, combined before the shuffle."""
    long = fields.unpivot([key], names, "field", "content")
    terms = long.select(key, "field", F.explode(script_tokens(F.col("content"), stops=False)).alias("term")).where(~F.col("term").isin(*STOP))
    return terms.groupBy("term", key, "field").agg(F.count(F.lit(1)).alias("tf"))


TERM_ROWS = 200_000  # an asked-term table up to this many rows is broadcast


def small_or_plain(df: DataFrame) -> DataFrame:
    """Broadcast a kept table whose row count has been checked; leave a larger one to a shuffle join."""
    return F.broadcast(df) if df.count() <= TERM_ROWS else df


def postings_of(post: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Only the postings of terms somebody asked for; document frequencies of those terms stay whole.

    With few terms the postings do not move.  With many they are shuffled by term for the semi join
    and then spread by (term, document), so a term found in every document is not one task.
    """
    asked = cut(terms.select("term").distinct())
    few = asked.count() <= TERM_ROWS
    out = post.join(F.broadcast(asked) if few else asked, "term", "left_semi")
    return out if few else out.repartition("term", key)


def idf(post: DataFrame, key: str, docs: DataFrame) -> DataFrame:
    """Document frequency and ln((N+1)/(df+1))+1 per term; N is a scalar sub-query over the corpus."""
    df = post.select("term", key).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.select("term", "df", (F.ln((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def document_frequencies(fields: DataFrame, key: str, names: list[str], docs: DataFrame) -> DataFrame:
    """``idf`` straight from the texts: a document gives each of its terms once, so only counts are shuffled.

    Where ids repeat, rows of one id count as one document, and its terms have to meet first.
    """
    if not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return idf(postings(fields, key, names), key, docs)
    tokens = F.flatten(F.array(*[F.coalesce(script_tokens(F.col(c), stops=False), F.array().cast("array<string>")) for c in names]))
    terms = fields.select(F.explode(F.array_distinct(tokens)).alias("term")).where(~F.col("term").isin(*STOP))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", (F.ln((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def known_terms(fields: DataFrame, names: list[str], asked: DataFrame) -> DataFrame:
    """Distinct ``asked`` terms that some document holds; a text gives each term once and keeps only asked ones before anything moves."""
    tokens = F.flatten(F.array(*[F.coalesce(script_tokens(F.col(c), stops=False), F.array().cast("array<string>")) for c in names]))
    terms = fields.select(F.explode(F.array_distinct(tokens)).alias("term"))
    return terms.join(small_or_plain(asked.select("term").distinct()), "term", "left_semi").distinct()


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct raw terms of a query (weight 1.0; tokens with letters and digits count as models, 0.8)."""
    t = queries.select("query", F.explode(F.array_distinct(script_tokens(F.col("text")))).alias("term"))
    return t.withColumn("weight", F.when(F.col("term").rlike("[a-z]") & F.col("term").rlike("[0-9]"), 0.8).otherwise(1.0))


# fixed values: aliases of the bound query set (alias, intent, terms)
ALIASES = (
    ("thand", "intent_merge", ("ther", "ning")), ("heed", "intent_noise", ("onen", "erst")), ("ere", "intent_focus", ("inth", "ations")),
    ("tisher", "intent_tone", ("edst", "reer")), ("onthe", "intent_colour", ("heon",)), ("图像", "intent_image", ("image", "frame")),
)


def alias_table(spark: SparkSession, rows=ALIASES) -> DataFrame:
    return spark.createDataFrame([(a, i, list(t)) for a, i, t in rows], "alias string, intent string, terms array<string>")


def expand_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Intents and expanded terms of a query: ASCII aliases on word boundaries by token equality, others by containment.

    Multi-script containment runs over the (constant) alias table as a literal array; ASCII aliases are an equi join on tokens.
    """
    a = aliases.withColumn("ascii", F.col("alias").rlike("^[\\x00-\\x7f]+$"))
    toks = queries.select("query", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("alias"))
    hit = toks.join(F.broadcast(a.where("ascii").drop("ascii")), "alias")
    other = [(r, i, t) for r, i, t in ALIASES if not r.isascii()]
    if other:
        lits = F.array(*[F.struct(F.lit(r).alias("alias"), F.lit(i).alias("intent"), F.array(*[F.lit(x) for x in t]).alias("terms")) for r, i, t in other])
        wide = queries.select("query", "text", F.explode(lits).alias("z")).where(F.contains("text", F.col("z.alias"))).select("query", "z.alias", "z.intent", "z.terms")
        hit = hit.select("query", "alias", "intent", "terms").unionByName(wide)
    return hit.select("query", "alias", "intent", F.explode("terms").alias("term"))


def profile_queries(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Raw and expanded terms with their best weight (expanded 0.62)."""
    x = expand_aliases(queries, aliases).select("query", "term", F.lit(0.62).alias("weight"))
    return query_terms(queries).unionByName(x).groupBy("query", "term").agg(F.max("weight").alias("weight"))


def length_weight(term: Column) -> Column:
    return 1 + 0.18 * F.least(F.greatest(F.length(term) - 2, F.lit(0)), F.lit(4))


def field_impacts(post: DataFrame, key: str, idfs: DataFrame) -> DataFrame:
    """(term, document, impact, strong): what a term adds to the score of a document, before the weight a query gives it.

    Sum over fields of weight*(1+ln(min(tf,8))), times idf and length weight.
    """
    fw = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    per = post.groupBy("term", key).agg(
        F.sum(fw[F.col("field")] * (1 + F.ln(F.least("tf", F.lit(8))))).alias("s"), F.max(F.col("field").isin(*STRONG)).alias("strong"))
    return _impacts(per, key, idfs)


def _impacts(per: DataFrame, key: str, idfs: DataFrame) -> DataFrame:
    return per.join(small_or_plain(idfs.select("term", "idf")), "term").select("term", key, (F.col("s") * F.col("idf") * length_weight(F.col("term"))).alias("impact"), "strong")


def weighted_terms(fields: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """(term, document, s, strong) of every asked term: the field sums of ``field_impacts`` in one aggregate, so postings by field never move."""
    long = fields.unpivot([key], list(WEIGHTS), "field", "content")
    found = long.select(key, "field", F.explode(script_tokens(F.col("content"), stops=False)).alias("term")).where(~F.col("term").isin(*STOP))
    asked = small_or_plain(cut(terms.select("term").distinct()))
    tf = {f: F.count_if(F.col("field") == f) for f in WEIGHTS}
    per = found.join(asked, "term", "left_semi").groupBy("term", key).agg(*[n.alias(f"tf_{f}") for f, n in tf.items()])
    part = lambda f: F.when(F.col(f"tf_{f}") > 0, WEIGHTS[f] * (1 + F.ln(F.least(F.col(f"tf_{f}"), F.lit(8))))).otherwise(0.0)
    strong = reduce(lambda a, b: a | b, [F.col(f"tf_{f}") > 0 for f in STRONG])
    return per.select("term", key, reduce(lambda a, b: a + b, map(part, WEIGHTS)).alias("s"), strong.alias("strong"))


def term_idf(per: DataFrame, docs: DataFrame) -> DataFrame:
    """``idf`` of a table that holds each term of a document once."""
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", (F.ln((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


PAIRS = 1_000_000  # sums of query and document a task holds at once
BLOCK = 1_000  # queries summed at once


def score_fielded(terms: DataFrame, post: DataFrame, key: str, idfs: DataFrame) -> DataFrame:
    """Every document that matches, with the sum of its impacts times the query weights: one row per (query, document).

    The impacts of a document are brought together once; with few query terms (broadcast) its scores are then summed where it lies, and
    no pair of query and document moves.  Documents are dealt so that a task holds at most some PAIRS sums, and more than BLOCK queries are
    taken in blocks, so the memory of a task does not grow with either table.  For queries of few words ``ranking`` sums only documents that may be among the best.
    """
    return _blocks(terms, field_impacts(post, key, idfs), key, post.agg(F.approx_count_distinct(key)).first()[0])


def score_weighted(terms: DataFrame, per: DataFrame, key: str, idfs: DataFrame, docs: int) -> DataFrame:
    """``score_fielded`` of ``weighted_terms`` over some ``docs`` documents."""
    return _blocks(terms, _impacts(per, key, idfs), key, docs)


def _blocks(terms: DataFrame, impacts: DataFrame, key: str, docs: int) -> DataFrame:
    asked = terms.agg(F.count_distinct("query")).first()[0]
    parts = max(impacts.sparkSession.sparkContext.defaultParallelism, -(-docs * min(asked, BLOCK) // PAIRS))
    placed = impacts.repartition(parts, key)
    blocks = -(-asked // BLOCK)
    if blocks <= 1:
        return _sums(terms, placed, key)
    placed = cut(placed)
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_sums(terms.where(block == i), placed, key) for i in range(blocks)])


def _sums(terms: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    return placed.join(small_or_plain(terms), "term").groupBy("query", key).agg(
        F.sum(F.col("impact") * F.col("weight")).alias("score"), F.max("strong").alias("strong"), F.count(F.lit(1)).alias("matched"))


BONUS = 45.0 + 5.0  # the most that title and hint add


def with_bonus(scored: DataFrame, queries: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """+45 when the title occurs in the query, +5 per category hint."""
    q = queries.select("query", normalise(F.col("text")).alias("_q"))
    q = hold(q, "_w", F.split("_q", " "))
    t = docs.select(key, normalise(F.col("title")).alias("_t"), "category")
    # pairs stay where they are and are not sorted: queries are broadcast, titles hashed beside them
    j = scored.join(small_or_plain(q), "query").join(t.hint("shuffle_hash"), key)
    title = F.when((F.length("_t") > 0) & F.contains("_q", "_t"), 45.0).otherwise(0.0)
    hint = F.when(F.array_contains("_w", F.col("category")), 5.0).otherwise(0.0)
    return j.withColumn("score", F.col("score") + title + hint).drop("_q", "_w", "_t", "category")


def strong_only(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("score") > 0) & F.col("strong"))


def rank(scored: DataFrame, key: str, k: int) -> DataFrame:
    """Top k documents per query by (-score, id)."""
    w = W.partitionBy("query").orderBy(F.desc(F.round("score", 6)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_required_first(hits: DataFrame, key: str, k: int) -> DataFrame:
    """Best document of each required term first, the rest by score.

    ``hits``: (query, term, doc, score); a document leads when it is the best of any of its terms.
    """
    return lead_first(hits, hits.groupBy("query", key).agg(F.max("score").alias("score")), key, k)


def lead_first(hits: DataFrame, scored: DataFrame, key: str, k: int) -> DataFrame:
    """``rank_required_first`` with the scores (query, doc, score) of all documents of ``hits`` at hand, so that hits are read once."""
    best = hits.groupBy("query", "term").agg(F.min_by(key, F.struct((-F.round("score", 6)).alias("s"), F.col(key))).alias(key))
    lead = cut(best.select("query", key).distinct().withColumn("lead", F.lit(True)))
    d = scored.join(small_or_plain(lead), ["query", key], "left").withColumn("lead", F.coalesce("lead", F.lit(False)))
    w = W.partitionBy("query").orderBy(F.desc("lead"), F.desc(F.round("score", 6)), key)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def match_terms(docs: DataFrame, key: str, fields: list[str], terms: list[str]) -> DataFrame:
    """Exact substring mode for a short constant term list: one scan, no join."""
    low = {f: F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    lits = F.array(*[F.lit(t) for t in terms])

    def found(content: Column) -> Column:
        return F.filter(lits, lambda t: F.contains(content, t))

    hits = reduce(F.array_union, [found(c) for c in low.values()])
    return docs.select(key, F.explode(hits).alias("term"))


def score_manual(terms: DataFrame, post: DataFrame, key: str, idfs: DataFrame, cands: DataFrame, queries: DataFrame) -> DataFrame:
    """Alternative ranking: exact id / alias / title bonuses plus per-token idf*(80 alias + 28 title + 16 heading + 2 min(body,12))."""
    tf = lambda f, cap: F.least(F.coalesce(F.max(F.when(F.col("field") == f, F.col("tf"))), F.lit(0)), F.lit(cap))
    per = post.groupBy("term", key).agg((80 * tf("alias", 4) + 28 * tf("title", 4) + 16 * tf("heading", 4) + 2 * tf("body", 12)).alias("s")).join(idfs.select("term", "idf"), "term")
    tok = terms.join(per, "term").groupBy("query", key).agg(F.sum(F.col("s") * F.col("idf")).alias("tok"))
    j = tok.join(queries.select("query", normalise(F.col("text")).alias("q")), "query").join(
        cands.select(key, F.lower("cid").alias("cid"), normalise(F.col("alias")).alias("alias"), normalise(F.col("title")).alias("title"), normalise(F.col("heading")).alias("heading")), key)
    has = lambda c: (F.length(c) > 0) & F.contains("q", F.col(c))
    bonus = (
        F.when(F.col("q") == F.col("cid"), 1200.0).otherwise(0.0) + F.when(has("alias"), 900.0).otherwise(0.0)
        + F.when(F.col("q") == F.col("title"), 700.0).when(has("title"), 260.0).otherwise(0.0) + F.when(has("heading"), 180.0).otherwise(0.0))
    return j.select("query", key, (F.col("tok") + bonus).alias("score"))


def coverage(terms: DataFrame, ranked: DataFrame, post: DataFrame, key: str) -> DataFrame:
    """Core terms found in the ranked results of their query; insufficient coverage withholds the results."""
    found = ranked.select("query", key).join(post.select("term", key).distinct(), key).select("query", "term").distinct().withColumn("hit", F.lit(1))
    j = terms.join(found, ["query", "term"], "left")
    g = j.groupBy("query").agg(F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))
    n = ranked.groupBy("query").agg(F.count(F.lit(1)).alias("scored"))
    g = g.join(n, "query", "left").withColumn("scored", F.coalesce("scored", F.lit(0)))
    ok = (F.col("scored") > 0) & (F.col("unmatched") == 0)
    return g.withColumn("status", F.when(ok, "sufficient").otherwise("insufficient")).withColumn("kept", F.when(ok, F.col("scored")).otherwise(0))


def scope(queries: DataFrame, intents: DataFrame, ranked: DataFrame, strong_at: float) -> DataFrame:
    """Explicit exit, recognised intent, strong match, else out of scope."""
    i = intents.groupBy("query").agg(F.min("intent").alias("intent"))
    b = ranked.groupBy("query").agg(F.max("score").alias("best"))
    j = queries.select("query", "text").join(i, "query", "left").join(b, "query", "left")
    return j.select("query", F.when(F.lower("text").rlike(r"\b(?:unrelated|off topic)\b"), "exit").when(F.col("intent").isNotNull(), "intent").when(
        F.coalesce(F.col("best") >= strong_at, F.lit(False)), "match").otherwise("out").alias("scope"), "intent")


def verification_reasons(df: DataFrame) -> DataFrame:
    """Why an answer needs checking; declined clauses are removed from the question first."""
    q = F.regexp_replace(F.lower("question"), r"\bnot? [^.,]*", " ")
    return df.withColumn("reasons", F.concat_ws(
        ",", F.when(q.rlike(r"\b(?:latest|current|price|there|here)\b"), "hint"), F.when(q.rlike(r"\b(?:tonight|today|when|hour)\b"), "observing_time"),
        F.when(F.col("stale"), "stale_evidence"), F.when(F.col("evidence_only"), "evidence_only"), F.when(F.col("n_results") == 0, "no_coverage")))


def corpus_facts(docs: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    j = docs.join(labels, "doc_id", "left")
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("quality") == 1).alias("verified"), F.count_if(F.col("quality") == 0).alias("needs_review"), F.count_if(F.col("quality").isNull()).alias("evidence_only"))


def build_catalog(pages: DataFrame) -> DataFrame:
    """Search catalogue: one row per page and per command, with the aliases pointing at the page."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    p = pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), "page_id", F.lit("page").alias("kind"), title.alias("label"))
    c = explode_commands(pages, "page_id", "html").select(
        F.concat(F.lit("cmd:"), F.col("page_id").cast("string"), F.lit(":"), F.col("i").cast("string")).alias("id"), "page_id", F.lit("command").alias("kind"), F.col("usage").alias("label"))
    al = resolve_links(pages).where(F.col("target").isNotNull()).groupBy(F.col("target").alias("page_id")).agg(F.array_join(F.sort_array(F.collect_set("path")), ",").alias("aliases"))
    return p.unionByName(c).join(al, "page_id", "left").withColumn("aliases", F.when(F.col("kind") == "page", F.coalesce("aliases", F.lit(""))).otherwise(""))


