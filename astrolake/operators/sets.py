"""Set comparisons: candidate unions, key differences, snapshots, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_candidates(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Pages, commands and sections as one candidate table; sections already catalogued are dropped."""
    have = a.select(key).unionByName(b.select(key)).distinct()
    return a.unionByName(b).unionByName(c.join(have, key, "left_anti"))


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys (with multiplicity) of a missing from b, and of b extra to a."""
    ka, kb = a.select(key), b.select(key)
    return ka.exceptAll(kb).withColumn("side", F.lit("missing")).unionByName(kb.exceptAll(ka).withColumn("side", F.lit("extra")))


def label_sets(manifest: DataFrame, buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Layer labels of a manifest against the buckets stacked."""
    m, b = manifest.select(*keys, "label").distinct(), buckets.select(*keys, "label").distinct()
    both = m.intersect(b).withColumn("state", F.lit("common"))
    return both.unionByName(m.exceptAll(b).withColumn("state", F.lit("missing"))).unionByName(b.exceptAll(m).withColumn("state", F.lit("extra")))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    j = old.select(key, F.col("digest").alias("was")).join(new.select(key, F.col("digest").alias("now")), key, "full_outer")
    st = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return j.withColumn("state", st).where(F.col("state").isNotNull()).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def check_split(pts: DataFrame, keys: list[str]) -> DataFrame:
    """Fit/validation split: disjoint, complete, at least three members on each side.

    ``pts`` carries id and the flags in_fit, in_val.
    """
    g = pts.groupBy(*keys).agg(
        F.count_if(F.col("in_fit")).alias("fit"), F.count_if(F.col("in_val")).alias("val"), F.count_if(F.col("in_fit") & F.col("in_val")).alias("shared"),
        F.count_if(~F.col("in_fit") & ~F.col("in_val")).alias("left_out"))
    return g.withColumn("valid", (F.col("shared") == 0) & (F.col("left_out") == 0) & (F.col("fit") >= 3) & (F.col("val") >= 3))
