"""Session and checkpoint helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "astrolake", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitted session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session that names none gets a scratch folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """Keep a table out of broadcasts: joins with it shuffle and sort.

    The planner sizes a table by its compressed file and takes an exploded row for one, so a table many times the
    broadcast limit can look small enough to be collected by the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when the rows of the input arrive in fewer tasks than there are cores.

    Splits are cut by bytes, but the rows of a row group all go to one of them, so splits that hold rows are counted (no column is
    read for that).  Inputs that fill many splits pass unchanged; others are hashed by their id.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > want and df.select(F.spark_partition_id().alias("p")).distinct().count() * 2 > want:
        return df
    return df.repartition(want, key)


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column behind a generator, so that later expressions read it instead of repeating it.

    Projections above a plain column would be merged with it, and an expression merged into a
    lambda is evaluated once per element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
