"""Text expressions: normalising, tokens, identifiers, snippets, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: full-width forms folded to ASCII (compatibility folding has no built-in; these are the forms that occur in titles and queries)
WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ　（），：；！？"
NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ (),:;!?"
# fixed values: characters of scripts written without spaces
CJK = "一-鿿"
# fixed values: words that never become search terms
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def normalise(c: Column) -> Column:
    """Fold full-width forms, lower-case, collapse whitespace."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, WIDE, NARROW)), r"\s+", " "))


def ngrams(c: Column, lo: int, hi: int) -> Column:
    """Character n-grams (lengths lo..hi) of a short run, used for scripts without spaces."""
    def of(n: int) -> Column:
        last = F.length(c) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(n) for n in range(lo, hi + 1)]))


def script_tokens(c: Column, lo: int = 2, hi: int = 4, stops: bool = True) -> Column:
    """Search terms of a text in any script, in order, repeats included.

    Outside CJK a term is a whole word of letters, marks and digits, so accented words stay whole; words of one letter and stop words
    are none (with ``stops`` false they stay, for callers that drop them later).  Scripts written without spaces give every n-gram of ``lo`` to ``hi`` characters of each run.  Null gives null.
    """
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit(rf"[a-z0-9[\p{{L}}\p{{M}}\p{{N}}&&[^{CJK}]]]{{2,}}"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(*STOP)) if stops else words
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]{{{lo},}}"), F.lit(0))
    return F.when(c.rlike(f"[{CJK}]{{{lo}}}"), F.concat(words, F.flatten(F.transform(runs, lambda r: ngrams(r, lo, hi))))).otherwise(words)


def identifiers(c: Column) -> Column:
    """Model-like tokens: letters with digits, or runs of capitals."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(?:[A-Za-z]+[0-9]+[A-Za-z0-9]*|[A-Z]{2,})\b"), F.lit(0)))


def snippet(text: Column, terms: Column, width: int = 240, lead: int = 60) -> Column:
    """``width`` characters from ``lead`` before the first hit of any term, with ellipses where cut."""
    low = F.lower(text)
    first = F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0))
    start = F.greatest(F.coalesce(first, F.lit(1)) - lead, F.lit(1))
    body = F.substring(text, start, F.lit(width))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + width - 1 < F.length(text), "…").otherwise(""))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def safe_label(c: Column) -> Column:
    """Letters, digits, dot, dash and underscore; anything else becomes one underscore."""
    s = F.trim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), F.lit("_."))
    return F.when(s == "", "unnamed").otherwise(s)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", " ")


def parse_date(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")


def is_stale(stale_after: Column, as_of: Column) -> Column:
    return F.coalesce(stale_after < as_of, F.lit(False))
