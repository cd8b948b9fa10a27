"""Frame files: listing, digests, container checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: accepted and refused suffixes
FRAME_SUFFIXES = (".fit", ".fits", ".fts")
VIDEO_SUFFIXES = (".avi", ".mov", ".mp4", ".mkv", ".ser", ".jpg", ".jpeg", ".png", ".webp")
BLOCK = 2880  # fixed value: container block size in bytes


def classify_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Frame files stay, hidden and other files drop, videos and previews become error rows."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    state = F.when(suffix.isin(*FRAME_SUFFIXES), "frame").when(suffix.isin(*VIDEO_SUFFIXES), "error")
    return df.withColumn("name", name).withColumn("state", state).where(F.col("state").isNotNull() & ~F.col("name").startswith(".") & (F.col("name") != ""))


def list_frames(spark: SparkSession, path: str) -> DataFrame:
    """Recursive listing with modification time and length; file contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return classify_paths(df).orderBy("path")


def digest_files(df: DataFrame, content: str) -> DataFrame:
    return df.withColumn("digest", F.sha2(F.col(content), 256))


def digest_set(df: DataFrame, keys: list[str], order: str, path: Column, digest: Column, width: int = 10_000) -> DataFrame:
    """Digest of a set of files in path order.

    Paths are ordered by an integer position; runs of ``width`` files are digested first and the run
    digests after that, so a set of any size never meets whole in one group.
    """
    chunk = df.select(*keys, F.floor(F.col(order) / width).alias("_chunk"), F.col(order).alias("_o"), F.concat_ws("=", path, digest).alias("_line"))
    part = chunk.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct("_o", "_line"))).alias("_l"), F.count(F.lit(1)).alias("_n"))
    part = part.select(*keys, "_chunk", "_n", F.sha2(F.array_join(F.transform("_l", lambda z: z["_line"]), "\n"), 256).alias("_d"))
    whole = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_d"))).alias("_l"), F.sum("_n").alias("files"))
    return whole.select(*keys, "files", F.sha2(F.array_join(F.transform("_l", lambda z: z["_d"]), "\n"), 256).alias("digest"))


def check_containers(df: DataFrame) -> DataFrame:
    """Declared geometry times sample size against file length, with block padding."""
    data = F.col("naxis1") * F.col("naxis2") * F.coalesce("naxis3", F.lit(1)) * F.abs("bitpix") / 8
    need = F.col("header_blocks") * BLOCK + F.ceil(data / BLOCK) * BLOCK
    bare = F.col("header_blocks") * BLOCK + data
    st = (F.when(F.col("bitpix").isNull() | F.col("naxis1").isNull(), "unreadable").when(F.col("length") < bare, "truncated")
          .when(F.col("length") < need, "unpadded").when(F.col("length") > need, "trailing").otherwise("complete"))
    return df.withColumn("expected", need).withColumn("container", st)
