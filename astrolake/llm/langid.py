"""Language of pages by Bayesian fusion of text, declared language, address and host."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from astrolake.llm.shared import kept

#: Most words kept of each language (whole steps of counts, STEPS to a doubling), weight of a prior's parent in rows, and words of a page that count as independent witnesses.
WORDS, STEPS, PARENT, WITNESSES = 20_000, 8, 4.0, 40.0

_SKIP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)
_WORD = re.compile(r"[^\W\d_]+")


def features(words: list[str]) -> Counter:
    """Words, and their endings (``~xy``) for words the model does not hold."""
    seen = Counter(words)
    for w, n in list(seen.items()):
        seen["~" + w[-2:]] += n
    return seen


def text_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(feature, lang, c): the commonest words and all endings of each language, counted over all labelled documents.

    Words are taken by whole steps of their counts, from the highest down, as long as no more than WORDS come together;
    so no task ever sorts the words of a language, and words that occur equally often share one fate.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        frame = lambda: pd.DataFrame([(f, k, n) for k, c in seen.items() for f, n in c.items()], columns=["feature", "lang", "c"]).astype({"feature": "str", "lang": "str", "c": "int64"})
        for b in batches:
            for k, t in zip(b["lang"], b["text"]):
                seen.setdefault(k, Counter()).update(_WORD.findall(t.lower()))
            if sum(map(len, seen.values())) > 500_000:
                yield frame()
                seen.clear()
        yield frame()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    words = rows.mapInPandas(run, "feature string, lang string, c long").groupBy("feature", "lang").agg(F.sum("c").alias("c"))
    words = kept(words, "words")
    ends = words.groupBy(F.concat(F.lit("~"), F.substring("feature", -2, 2)).alias("feature"), "lang").agg(F.sum("c").alias("c"))
    total = words.groupBy("lang").agg(F.sum("c").alias("c")).select(F.lit("").alias("feature"), "lang", "c")
    stepped = words.withColumn("step", F.floor(F.log2("c") * STEPS))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("step")))
    cuts = stepped.groupBy("lang", "step").agg(F.count("*").alias("n")).withColumn("upto", upto).where(F.col("upto") <= WORDS).groupBy("lang").agg(F.min("step").alias("cut"))
    top = stepped.join(F.broadcast(cuts), "lang").where("step >= cut").select("feature", "lang", "c")  # a row a language
    return ends.unionByName(total).unionByName(top)


def _likelihoods(pages: DataFrame, model: DataFrame, langs: list[str]) -> DataFrame:
    """``pages`` with ``ll``: log likelihood of the visible text in each language, tempered to WITNESSES words."""
    at = {k: i for i, k in enumerate(langs)}
    table: dict[str, np.ndarray] = {}
    for r in model.collect():  # at most WORDS words a language, and endings
        table.setdefault(r["feature"], np.zeros(len(langs)))[at[r["lang"]]] = r["c"]
    total = table.pop("", np.ones(len(langs)))
    logs = {f: np.log((c + 0.01) / (total + 1)) for f, c in table.items()}
    held = pages.sparkSession.sparkContext.broadcast((logs, np.log(0.01 / (total + 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, none = held.value
        for b in batches:
            out, sizes = [], []
            for h in b["html"]:
                words = _WORD.findall(unescape(_SKIP.sub(" ", h or "")).lower())
                ll = np.zeros(len(langs))
                for w, n in Counter(words).items():
                    got = known.get(w)
                    ll += n * (got if got is not None else known.get("~" + w[-2:], none))
                out.append((ll * min(1.0, WITNESSES / max(1, len(words)))).tolist())
                sizes.append(len(words))
            yield b.drop(columns="html").assign(ll=out, n_words=sizes)

    kinds = ", ".join(f"{c} {t}" for c, t in pages.dtypes if c != "html")
    return pages.mapInPandas(run, f"{kinds}, ll array<double>, n_words long")


def _softmax(ll: Column) -> Column:
    e = F.transform(ll, lambda x: F.exp(x - F.array_max(ll)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.get("post", i)) for i in range(n)]).alias(name))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host) of every page.

    The text gives a likelihood for each language seen in ``docs`` (word and ending counts over all of them).  Its
    posterior, summed by group over all pages, tells how often each declared markup language and each address suffix
    (two-letter first path part, else top-level domain) goes with each language, and the prior of each host, smoothed
    towards its domain's, and that towards all pages'.  All four are multiplied.

    Null or empty pages are decided by the other evidence; a page with none gets the most common language.  A
    null url has no host of its own.  Ties go to the first language in order.  Repeated rows and null ids are kept.  Without labelled
    documents the language is null.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    part = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})(?:[/?#-]|$)", 1))
    rows = pages.select(
        F.col(id_col).alias("page_id"), html.alias("html"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.when(part != "", part).otherwise(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"),
        F.lower(F.regexp_extract(html, r'''(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})''', 1)).alias("declared"))
    model = kept(text_model(docs), "model")
    langs = [r["lang"] for r in model.where("feature = ''").select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select("page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), "declared", "host")
    n = len(langs)
    read = _likelihoods(rows, model, langs)
    read = kept(read.withColumn("post", _softmax(F.col("ll"))), "read")
    every = read.agg(F.array(*[F.sum(F.get("post", i)) for i in range(n)]).alias("all")).first()["all"] or [0.0] * n
    share = [((x or 0.0) + 1) / (sum(y or 0.0 for y in every) + n) for x in every]
    general = F.array(*map(F.lit, share))
    by = {"declared": _sums(read, ["declared"], n, "by_declared"), "suffix": _sums(read, ["suffix"], n, "by_suffix")}
    hosts = _sums(read, ["domain", "host"], n, "by_host")
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.get("by_host", i)) for i in range(n)]).alias("by_domain"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    prior_domain = F.zip_with("by_domain", general, lambda c, g: (c + PARENT * g) / (total(F.col("by_domain")) + PARENT))
    domains = domains.withColumn("of_domain", prior_domain)
    prior_host = F.zip_with("by_host", "of_domain", lambda c, g: (c + PARENT * g) / (total(F.col("by_host")) + PARENT))
    priors = kept(hosts.join(domains, "domain").select("domain", "host", prior_host.alias("prior")), "hosts")
    # P(value | language) up to a factor that all languages share: its count under the language over the language's pages
    told = [kept(d.select(k, F.transform(F.zip_with(f"by_{k}", F.array(*[F.lit(float(x or 0.0)) for x in every]), lambda c, a: (c + 0.5) / (a + 1)), lambda p: F.log(p)).alias(f"l_{k}")), k) for k, d in by.items()]
    out = read.select("page_id", "host", "domain", "declared", "suffix", "ll", "post").join(priors, ["domain", "host"]).join(told[0], "declared").join(told[1], "suffix")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = add(add(F.col("ll"), F.col("l_declared")), add(F.col("l_suffix"), F.transform("prior", lambda p: F.log(p))))
    out = out.withColumn("fused", fused).withColumn("final", _softmax(F.col("fused")))
    best = lambda c: F.element_at(F.array(*map(F.lit, langs)), F.array_position(c, F.array_max(c)).cast("int"))
    return out.select("page_id", best(F.col("final")).alias("lang"), F.array_max("final").alias("confidence"), best(F.col("post")).alias("text_lang"), "declared", "host")
