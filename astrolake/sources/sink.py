"""Publishing: write a set aside, then make it visible by one atomic step a version."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version string, path string, rows long"


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, root: str, version: str, path: str, rows: int) -> bool:
    """Make ``version`` name ``path``; false if another writer was first.

    The manifest entry is a folder that is complete before it gets its name, and the renaming refuses a name that is
    taken; so of any number of writers of one version exactly one wins, and readers see all of an entry or none.
    """
    entry, name = f"{root}/_staged/{uuid.uuid4().hex}", f"{root}/manifest/at-{quote(version, safe='')}"
    spark.createDataFrame([(version, path, rows)], _MANIFEST).coalesce(1).write.json(entry)
    source, fs = _hadoop(spark, entry)
    target, _ = _hadoop(spark, name)
    fs.mkdirs(target.getParent())
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, options)
    except Py4JJavaError:
        if not fs.exists(target):
            raise
        fs.delete(source, True)
        return False
    return True


def _staged(df: DataFrame, root: str, partition_by: list[str] | None) -> str:
    path = f"{root}/data/{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def publish(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a finished artefact set aside and give it its version; returns the manifest.

    Readers resolve the data through the manifest, so a half-written set is never visible and an
    earlier good version is left untouched.  A version that is already published, by an earlier or a concurrent writer, is
    refused, and what was written for it goes.
    """
    spark = df.sparkSession
    if not manifest(spark, root).where(F.col("version") == version).isEmpty():  # spares the write; the commit decides
        raise ValueError(f"version {version} is already published")
    path = _staged(df, root, partition_by)
    if not _commit(spark, root, version, path, spark.read.schema(df.schema).parquet(path).count()):
        folder, fs = _hadoop(spark, path)
        fs.delete(folder, True)
        raise ValueError(f"version {version} is already published")
    return manifest(spark, root)


def publish_each(df: DataFrame, root: str, label: str, prefix: str = "v", partition_by: list[str] | None = None) -> DataFrame:
    """Publish every label's rows as a version of its own, ``prefix`` and the label, with one partitioned write of all; returns the manifest.

    Labels are whatever the column holds; rows without one make the version ``prefix`` and ``unlabelled``.  Each version is
    committed by itself.  If some are taken already, the others are still published, and the error names those refused.
    """
    spark = df.sparkSession
    named = df.withColumn("_version", F.concat(F.lit(prefix), F.coalesce(F.col(label).cast("string"), F.lit("unlabelled"))))
    path = _staged(named.drop(label), root, ["_version", *(partition_by or [])])
    counts = spark.read.schema(named.drop(label).schema).parquet(path).groupBy("_version").count().orderBy("_version")
    # one small row a version: the loop is over names, the rows never come here
    refused = [r["_version"] for r in counts.toLocalIterator() if not _commit(spark, root, r["_version"], f"{path}/_version={_escaped(spark, r['_version'])}", r["count"])]
    if refused:
        raise ValueError(f"already published: {', '.join(refused)}")
    return manifest(spark, root)


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as the writer spells it in folder names."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    folder, fs = _hadoop(spark, f"{root}/manifest")
    if not fs.exists(folder) or not fs.listStatus(folder):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").json(f"{root}/manifest")


def published(spark: SparkSession, root: str, version: str) -> DataFrame:
    path = manifest(spark, root).where(F.col("version") == version).first()["path"]
    return spark.read.parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
