"""Helpers of the training-data operators: written tables, bounded id filters, components, words."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of an id filter.  It is broadcast as at most BITS / 64 rows of two longs (2 MB), whatever it holds.
BITS = 1 << 23
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@lru_cache
def _own_folder(app: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder of ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own_folder(spark.sparkContext.applicationId)
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and lost executors cost nothing.

    Shuffle files of the write go as soon as it is done, as nothing reads them again; they would stay until the driver collects garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of ``kept`` tables that nothing reads any more, once what came of them is written."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def id_filter(ids: DataFrame, key: str) -> DataFrame:
    """The set of ``ids[key]`` as a bitmap table (word, bits) of at most BITS / 64 rows; may hold strangers, never misses."""
    slots = ids.select(F.pmod(F.xxhash64(F.col(key)), F.lit(BITS)).alias("__slot"))
    return slots.selectExpr("cast(__slot div 64 as int) as __word", "shiftleft(1L, cast(__slot % 64 as int)) as __bit").groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def maybe_in(df: DataFrame, key: Column, marks: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in the id filter: a map-side cut before an exact join."""
    hit = df.withColumn("__slot", F.pmod(F.xxhash64(key), F.lit(BITS))).withColumn("__word", F.expr("cast(__slot div 64 as int)"))
    return hit.join(F.broadcast(marks), "__word").where("shiftrightunsigned(__bits, cast(__slot % 64 as int)) & 1 = 1").drop("__word", "__slot", "__bits")


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(id, label)`` for every id in a link; label is the smallest id of its component.

    Each round takes the smallest label among neighbours, then the label's own label, until nothing
    changes.  Every round is a written table; a hub's rows meet in joins that Spark can split.
    """
    both = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = kept(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = kept(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            return labels


def fold(part: int, of: int, key: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves ``part`` when divided by ``of``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == part, F.lit(False))


class Codes(dict):
    """Word -> stable 64-bit number, remembered; forgets everything once it holds ``most`` words."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxh3_64_intdigest(word)
        return value


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
