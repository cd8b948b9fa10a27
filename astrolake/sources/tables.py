"""Line-oriented tables: registration sequences and star tables.

All take long text rows (file, line, text); ``read_lines`` makes them from files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from astrolake.functions.scan import join_on, rank_by_id
from astrolake.session import hold


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of whole small text files (tables and logs of one run each)."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return t.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))


def read_sequence(lines: DataFrame) -> DataFrame:
    """Registration rows matched to image rows by position within the file.

    Rows with fewer than 17 tokens or without an ``H`` are dropped; unparsable numbers leave ``ok`` false.
    """
    tok = F.split(F.trim("text"), r"\s+")
    img = rank_by_id(lines.where(F.col("text").rlike(r"^I\s")), ["file"], "line").select(
        "file", "rk", F.get(tok, F.lit(1)).try_cast("long").alias("index"), (F.get(tok, F.lit(2)) == "1").alias("included"))
    reg = rank_by_id(lines.where(F.col("text").rlike(r"^R\d+\s")), ["file"], "line")
    reg = reg.withColumn("t", tok).where((F.size("t") >= 17) & (F.get("t", F.lit(7)) == "H"))
    num = lambda i: F.get("t", F.lit(i)).try_cast("double")
    h = F.transform(F.slice("t", 9, 9), lambda v: v.try_cast("double"))
    reg = reg.select("file", "rk", num(1).alias("fwhm"), num(2).alias("wfwhm"), num(3).alias("roundness"), num(4).alias("quality"), num(5).alias("background"), num(6).alias("nstars"), h.alias("h"))
    ok = F.col("fwhm").isNotNull() & F.forall("h", lambda v: v.isNotNull())
    return join_on(reg, img, ["file", "rk"], "left").withColumn("ok", ok)


# fixed values: star table columns in order
STAR_COLUMNS = ("star", "layer", "A", "beta", "X", "Y", "FWHMx", "FWHMy", "Angle", "Sat", "Profile")


def _cells(lines: DataFrame) -> DataFrame:
    """Rows with their cells; text and cells stand behind generators, so that no later expression builds or splits them again."""
    d = hold(lines.withColumnRenamed("text", "_t"), "text", F.col("_t")).drop("_t")
    return hold(d.where(~F.col("text").startswith("#") & (F.trim("text") != "")), "c", F.split("text", "\t"))


def _cell(name: str) -> Column:
    return F.trim(F.get("c", F.lit(STAR_COLUMNS.index(name))))


def read_stars(lines: DataFrame, header_limit: int = 15) -> DataFrame:
    """Tolerant form: the header must be among the first lines; widths within 0.1..50, roundness within 0..1."""
    head = lines.where((F.col("line") < header_limit) & F.lower("text").contains("fwhmx")).groupBy("file").agg(F.min("line").alias("_h"))
    fx, fy = _cell("FWHMx").try_cast("double"), _cell("FWHMy").try_cast("double")
    d = hold(_cells(lines), "w", F.struct(fx.alias("x"), fy.alias("y"))).select("file", "line", F.col("w.x").alias("fwhmx"), F.col("w.y").alias("fwhmy"))
    d = d.withColumn("roundness", F.least("fwhmx", "fwhmy") / F.greatest("fwhmx", "fwhmy"))
    # rows meet their header as numbers, without their text
    d = d.where((F.col("fwhmx") > 0.1) & (F.col("fwhmx") < 50) & F.col("roundness").between(0, 1))
    return d.join(head, "file").where(F.col("line") > F.col("_h")).drop("_h")


def read_stars_strict(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strict form: valid rows with duplicate flags, and a quarantine table with reasons."""
    d = _cells(lines).where(~F.lower("text").contains("fwhmx"))
    n = lambda c: _cell(c).try_cast("double")
    reason = (
        F.when(F.size("c") != len(STAR_COLUMNS), "column_count").when(_cell("star").try_cast("long").isNull(), "bad_id")
        .when(n("X").isNull() | n("Y").isNull(), "bad_position").when(F.coalesce(n("FWHMx") <= 0, F.lit(True)) | F.coalesce(n("FWHMy") <= 0, F.lit(True)), "bad_width"))
    d = hold(d, "reason", reason)
    bad = d.where(F.col("reason").isNotNull()).select("file", "line", "reason")
    ok = d.where(F.col("reason").isNull()).select(
        "file", "line", _cell("star").cast("long").alias("star"), _cell("layer").alias("layer"), n("X").alias("x"), n("Y").alias("y"), n("FWHMx").alias("fwhmx"), n("FWHMy").alias("fwhmy"), _cell("Profile").alias("profile"))
    # counted over windows: the lines are parsed once and move once a key
    ok = ok.withColumn("n_id", F.count(F.lit(1)).over(W.partitionBy("file", "star"))).withColumn("n_pos", F.count(F.lit(1)).over(W.partitionBy("file", "layer", "x", "y")))
    return ok.withColumn("duplicate", (F.col("n_id") > 1) | (F.col("n_pos") > 1)).drop("n_id", "n_pos"), bad
