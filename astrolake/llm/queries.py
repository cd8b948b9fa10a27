"""The named queries of the training-data operators, with production parameters, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.llm.collocations import collocations
from astrolake.llm.decontam import leaks
from astrolake.llm.hmm import lm_scores
from astrolake.llm.html_extract import extract_main_text
from astrolake.llm.langid import identify
from astrolake.llm.line_dedup import dedup_lines
from astrolake.llm.near_dup import near_dups
from astrolake.llm.packing import pack_documents
from astrolake.llm.phrase_print import with_neighbour_edits
from astrolake.llm.shared import fold
from astrolake.llm.spelling import spelling_groups
from astrolake.llm.topk import top_k
from astrolake.llm.toxicity import toxicity
from astrolake.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading the written archives back gives for every page."""
    return archive_round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, with its confidence and evidence."""
    return identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its text without repeated lines, and how many lines it has, lost, and had near others."""
    out = dedup_lines(_table(spark, sf_dir, "documents"), short=True)
    return out.select("doc_id", "text", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_gone").cast("long").alias("n_gone"), F.col("__n_near").alias("n_near"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin."""
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every query vector."""
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document, learned from those whose crc32 mod 5 is not 1."""
    out = lm_scores(_table(spark, sf_dir, "documents"), ~fold(1, 5))
    return out.select("doc_id", fold(1, 5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: sets of four words, linked from 0.8."""
    return near_dups(_table(spark, sf_dir, "documents"), similarity=80, width=4)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they leak."""
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every document and its edited text, and how like they are."""
    return with_neighbour_edits(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word."""
    return spelling_groups(_table(spark, sf_dir, "documents"), least_chars=5, least_n=3, ratio=2, damage=97)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of each language."""
    return collocations(_table(spark, sf_dir, "documents"), support=10, longest=3, cover=50, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_toxicity, op3_warc, op4_language_id, op5_line_dedup, op6_packing, op7_exact_top_k, op8_lm_scoring, op9_near_dup, op10_decontamination,
        op11_fingerprints, op12_spelling, op13_collocations)
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op12_spelling": """
WITH runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
per_doc AS (SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))),
hex AS (SELECT id, run, c, lower(hex(encode(id || ':' || run))) AS h FROM per_doc),
bytes AS (SELECT id, run, c, list_transform(range(length(h) // 2), lambda k: (instr('0123456789abcdef', h[2 * k + 1]) - 1) * 16 + instr('0123456789abcdef', h[2 * k + 2]) - 1) AS b FROM hex),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (SELECT word, sum(c)::BIGINT AS n FROM (
            SELECT c, CASE WHEN h % 97 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word FROM hashed)
          WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
holes AS (SELECT word, unnest(range(length(word))) AS i FROM words),
cut AS (SELECT DISTINCT word, word[:i] || word[i + 2:] AS rest FROM holes),
masked AS (SELECT word, i, word[:i] || '*' || word[i + 2:] AS mask FROM holes),
near AS (SELECT a.word, b.word AS other FROM masked a JOIN masked b ON a.i = b.i AND a.mask = b.mask AND a.word <> b.word
         UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
         UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
sized AS (SELECT near.word, other, o.n AS other_n, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, encode(other)) AS k, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN words o ON o.word = near.other),
formed AS (SELECT w.word, w.n, coalesce(s.n_near, 0) AS n_near, CASE WHEN s.other_n >= 2 * w.n THEN s.other END AS form, CASE WHEN s.other_n >= 2 * w.n THEN s.other_n END AS form_n
           FROM words w LEFT JOIN sized s ON s.word = w.word AND s.k = 1),
chain AS (WITH RECURSIVE up AS (SELECT word, word AS last, 0 AS d FROM formed UNION ALL SELECT up.word, f.form, d + 1 FROM up JOIN formed f ON f.word = up.last WHERE f.form IS NOT NULL)
          SELECT word, arg_max(last, d) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
""",
    "op13_collocations": """
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
lists AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM lists, (VALUES (1), (2), (3)) AS s(m)),
f AS (SELECT lang, m, phrase, count(*) AS c FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND c >= 10),
cuts AS (SELECT c.lang, c.phrase, m, a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM cand c, (VALUES (1), (2)) AS s(k) WHERE k < m),
scored AS (SELECT cuts.*, l.c AS l, r.c AS r, (1000000::HUGEINT * a * a) // (l.c::HUGEINT * r.c) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM scored) WHERE first = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM cand WHERE m = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE m = 3) GROUP BY ALL),
ranked AS (SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, encode(w.phrase)) AS rank, w.phrase, a, l, r, n.n, score::BIGINT AS score
           FROM worst w JOIN n ON n.lang = w.lang LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""",
}
