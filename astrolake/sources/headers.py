"""Header cards to long key/value rows, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.session import hold

CARD = 80  # fixed value: bytes per card


def number(c: Column) -> Column:
    """Plain, exponent and Fortran D-exponent numbers."""
    return F.regexp_replace(F.trim(c), "(?i)^([+-]?[0-9.]+)D([+-]?[0-9]+)$", "$1E$2").try_cast("double")


def read_headers(df: DataFrame, frame: str = "frame", content: str = "content") -> DataFrame:
    """(frame, card, key, raw, value): 80-character cards up to END, quotes unwrapped, comments cut, numbers typed.

    All CONTINUE cards in a row are appended to the string card they follow when it ends with an ampersand.
    HIERARCH cards take the words before their equals sign as key.
    """
    df, text = hold(df.select(frame, content), "_x", F.col(content).cast("string")), F.col("_x")
    n = F.floor(F.length(text) / CARD).cast("int")
    cards = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(text, i * CARD + 1, F.lit(CARD)))
    d = hold(df, "cards", cards).select(frame, "cards")
    end = F.array_position(F.transform("cards", lambda c: F.rtrim(c)), "END").cast("int")
    d = d.withColumn("cards", F.when(end > 0, F.slice("cards", 1, end - 1)).otherwise(F.col("cards")))
    z = d.select(frame, "cards", F.posexplode("cards").alias("card", "c"))
    long_key = F.col("c").startswith("HIERARCH ") & F.col("c").contains("=")
    rest = F.when(long_key, F.regexp_extract("c", "^[^=]*=(.*)$", 1)).otherwise(F.substring("c", 11, CARD))
    inside = lambda c: F.regexp_extract(c, r"'((?:[^']|'')*)'", 1)
    quoted = F.regexp_extract(rest, r"^\s*'((?:[^']|'')*)'", 1)
    is_text = rest.rlike(r"^\s*'")
    after = F.slice("cards", F.col("card") + 2, F.size("cards"))
    stop = F.array_position(F.transform(after, lambda c: ~c.startswith("CONTINUE")), True).cast("int")
    parts = F.slice(after, 1, F.when(stop > 0, stop - 1).otherwise(F.size(after)))
    more = F.array_join(F.transform(parts, lambda c, i: F.when(i < F.size(parts) - 1, F.regexp_replace(F.rtrim(inside(c)), "&$", "")).otherwise(F.rtrim(inside(c)))), "")
    joined = F.when(F.rtrim(quoted).endswith("&") & (F.size(parts) > 0), F.concat(F.regexp_replace(F.rtrim(quoted), "&$", ""), more)).otherwise(F.rtrim(quoted))
    bare = F.trim(F.regexp_extract(rest, r"^([^/]*)", 1))
    raw = F.when(is_text, F.replace(joined, F.lit("''"), F.lit("'"))).otherwise(bare)
    key = F.when(long_key, F.trim(F.regexp_extract("c", "^HIERARCH ([^=]*)=", 1))).otherwise(F.trim(F.substring("c", 1, 8)))
    z = z.where((F.substring("c", 9, 2) == "= ") | long_key).select(frame, "card", key.alias("key"), raw.alias("raw"), is_text.alias("_t"))
    return z.select(frame, "card", "key", "raw", F.when(~F.col("_t"), number(F.col("raw"))).alias("value"))
