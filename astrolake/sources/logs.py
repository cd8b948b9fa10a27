"""Log lines to samples: channel statistics and photometric fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.functions.scan import carry_last, carry_sum


def asof_last(df: DataFrame, keys: list[str], order: str, marker: str, name: str) -> DataFrame:
    """Attach the latest marker at or before each row."""
    return carry_last(df, keys, order, marker, name)


def read_stat_samples(log: DataFrame, key: str) -> DataFrame:
    """Channel statistics rescaled to the domain of the last preceding "Reading image" line.

    A channel that comes again in the same log opens a new sample.
    """
    pat = r"^(\w+): mean ([0-9.]+), median ([0-9.]+), sigma ([0-9.]+)"
    d = log.withColumn("dom", F.when(F.col("text").startswith("Reading image"), F.regexp_extract("text", r"domain ([0-9]+)", 1).try_cast("double")))
    d = carry_last(d, [key], "line", "dom", "domain")
    s = d.where(F.col("text").rlike(pat)).withColumn("channel", F.regexp_extract("text", pat, 1))
    s = carry_sum(s, [key, "channel"], "line", F.lit(1), "sample")
    v = lambda i: F.regexp_extract("text", pat, i).try_cast("double") / F.col("domain")
    return s.select(key, "line", "channel", "sample", "domain", v(2).alias("mean"), v(3).alias("median"), v(4).alias("sigma"))


def read_fit_quality(log: DataFrame, key: str) -> DataFrame:
    """Photometric fits: last fit of every log with stars used and excluded, and a verdict over all channels."""
    pat = r"^fit (\w+): slope ([-0-9.eE+]+) intercept ([-0-9.eE+]+) sigma ([0-9.eE+-]+) used (\d+) excluded (\d+)"
    f = log.where(F.col("text").rlike(pat))
    g = lambda i: F.regexp_extract("text", pat, i)
    f = f.select(key, "line", g(1).alias("channel"), g(2).try_cast("double").alias("slope"), g(3).try_cast("double").alias("intercept"), g(4).try_cast("double").alias("sigma"),
                 g(5).cast("long").alias("used"), g(6).cast("long").alias("excluded"))
    last = f.groupBy(key, "channel").agg(F.max_by(F.struct("slope", "sigma", "used", "excluded"), "line").alias("z"))
    s = last.select(key, "channel", "z.*")
    bad = (F.col("slope") <= 0) | (F.col("used") < 3)
    weak = (F.col("sigma") > 0.2) | (F.col("excluded") > F.col("used"))
    out = s.groupBy(key).agg(
        F.count(F.lit(1)).alias("fits"), F.sum("used").alias("used"), F.sum("excluded").alias("excluded"), F.max("sigma").alias("sigma"),
        F.max(F.col("slope")).alias("_hi"), F.min(F.col("slope")).alias("_lo"), F.bool_or(bad).alias("_bad"), F.bool_or(weak).alias("_weak"))
    return out.select(key, "fits", "used", "excluded", "sigma", F.when(F.col("_lo") > 0, F.col("_hi") / F.col("_lo")).alias("gain_ratio"),
                      F.when(F.col("_bad"), "degenerate").when(F.col("_weak"), "degraded").otherwise("acceptable").alias("verdict"))


