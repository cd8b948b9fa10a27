"""Working views over the given tables: the shapes the operators run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.functions.scan import rank_by_id
from astrolake.session import cut, spread

SIDE = 8  # pixels per frame side


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """One row per stored frame tile: (session, frame, tile array)."""
    return spread(table(spark, d, "embeddings"), "vec_id").select(
        F.col("label").alias("session"), F.col("vec_id").alias("frame"), F.col("embedding").alias("tile")
    )


def _yx() -> list:
    return [
        F.floor(F.col("pos") / SIDE).cast("int").alias("y"),
        (F.col("pos") % SIDE).cast("int").alias("x"),
    ]


def pixels(tiles: DataFrame, *keep: str) -> DataFrame:
    """Pixel rows (keep, y, x, v) of tile rows."""
    e = tiles.select(*keep, F.posexplode("tile").alias("pos", "e"))
    return e.select(*keep, *_yx(), F.col("e").cast("double").alias("v"))


def px(spark: SparkSession, d: str) -> DataFrame:
    """Pixel rows (session, frame, y, x, v)."""
    return pixels(tiles(spark, d), "session", "frame")


def ranked_tiles(spark: SparkSession, d: str) -> DataFrame:
    return rank_by_id(tiles(spark, d), ["session"], "frame")


def px2(spark: SparkSession, d: str) -> DataFrame:
    """Parent/candidate pixels: frame n against the next frame of its session, joined as whole tiles."""
    r = ranked_tiles(spark, d)
    p = r.select("session", F.col("rk"), F.col("frame").alias("parent"), F.col("tile").alias("pt"))
    c = r.select("session", (F.col("rk") - 1).alias("rk"), F.col("frame").alias("candidate"), F.col("tile").alias("ct"))
    j = p.join(c, ["session", "rk"]).select(
        "session", "parent", "candidate", F.posexplode(F.arrays_zip("pt", "ct")).alias("pos", "z")
    )
    return j.select(
        "session", "parent", "candidate", *_yx(),
        F.col("z.pt").cast("double").alias("pv"), F.col("z.ct").cast("double").alias("cv"),
    )


def rgb_planes(spark: SparkSession, d: str) -> DataFrame:
    """Colour images (session, img, r, g, b) with one array a plane: frames 3k, 3k+1, 3k+2 of a session are the
    R, G, B planes of image ``img``, lifted by one half into the display range.
    """
    r = ranked_tiles(spark, d).withColumn("img", F.floor(F.col("rk") / 3)).withColumn("ch", F.col("rk") % 3)
    planes = r.groupBy("session", "img").agg(
        *[F.first(F.when(F.col("ch") == i, F.col("tile")), True).alias(c) for i, c in enumerate("rgb")]
    ).where(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull())
    return planes.select("session", "img", *[F.transform(c, lambda v: v.cast("double") + 0.5).alias(c) for c in "rgb"])


def rgb2_planes(spark: SparkSession, d: str) -> DataFrame:
    """Planes of image k beside those of image k+1 of the session (cr, cg, cb)."""
    a = rgb_planes(spark, d)
    b = a.select("session", (F.col("img") - 1).alias("img"), *[F.col(c).alias(f"c{c}") for c in "rgb"])
    return a.join(b, ["session", "img"])


def _plane_pixels(planes: DataFrame, names: list[str]) -> DataFrame:
    z = planes.select("session", "img", F.posexplode(F.arrays_zip(*names)).alias("pos", "z"))
    return z.select("session", "img", *_yx(), *[F.col(f"z.{c}").alias(c) for c in names])


def rgb(spark: SparkSession, d: str) -> DataFrame:
    """Colour pixels (session, img, y, x, r, g, b); the planes meet as arrays, so no pixel is shuffled."""
    return _plane_pixels(rgb_planes(spark, d), ["r", "g", "b"])


def rgb_long(spark: SparkSession, d: str) -> DataFrame:
    """Colour pixels in long form (session, img, channel, y, x, v)."""
    w = rgb(spark, d)
    return w.unpivot(["session", "img", "y", "x"], ["r", "g", "b"], "channel", "v")


def rgb2(spark: SparkSession, d: str) -> DataFrame:
    """Colour pixels of image k beside those of image k+1 of the session (candidate)."""
    return _plane_pixels(rgb2_planes(spark, d), ["r", "g", "b", "cr", "cg", "cb"])


def meas(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("layer"), F.col("l_linestatus").alias("profile"),
        (F.col("l_quantity") / 10).alias("fwhmx"),
        (F.col("l_quantity") / 10 * (1 - F.col("l_discount"))).alias("fwhmy"),
        F.col("l_extendedprice").alias("flux"), F.col("l_partkey").alias("star"),
        F.col("l_suppkey").alias("panel"), F.col("l_tax").alias("tax"), F.col("l_shipdate").alias("ts"),
    )


def frames(spark: SparkSession, d: str) -> DataFrame:
    m = meas(spark, d).groupBy("frame").agg(
        F.count(F.lit(1)).alias("nstars"),
        F.percentile("fwhmx", 0.5).alias("fwhm"),
        F.avg(F.col("fwhmy") / F.col("fwhmx")).alias("roundness"),
    )
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("frame"), F.col("o_orderpriority").alias("session"),
        F.col("o_orderstatus").alias("filter"), F.col("o_custkey").alias("target"),
        (F.col("o_totalprice") / 1000).alias("background"), F.col("o_orderdate").alias("ts"),
    )
    return o.join(m, "frame").withColumn("wfwhm", F.col("fwhm") * (1 + 1 / F.col("nstars")))


def frame_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The frame table kept: one row per frame, for operators that pass over it more than once."""
    return cut(frames(spark, d))


def stars_a(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), F.col("p_type").alias("layer"), F.col("p_brand").alias("brand"),
        (k % 50 + (k % 7) * 0.1).alias("x"), (F.floor(k / 50) + (k % 5) * 0.1).alias("y"),
        (F.col("p_size") / 10).alias("fwhm"), (F.col("p_size") >= 48).alias("sat"),
        F.col("p_retailprice").alias("flux"),
    )


def stars_b(spark: SparkSession, d: str) -> DataFrame:
    a = stars_a(spark, d).where(F.col("id") % 9 != 0)
    return a.select(
        (F.col("id") + 100000).alias("id"), "layer", "brand",
        (F.col("x") + (F.col("id") % 4) * 0.25).alias("x"), "y",
        (F.col("fwhm") * 1.1).alias("fwhm"), "sat", (F.col("flux") * 0.97).alias("flux"),
    )


def light(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("gain"),
        F.col("c_acctbal").alias("temp"), F.col("c_mktsegment").alias("filter"),
    )


def master(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("mid"), F.col("s_name").alias("mname"), F.col("s_nationkey").alias("gain"),
        F.col("s_acctbal").alias("temp"),
        F.element_at(F.array(*[F.lit(k) for k in ("dark", "flat", "bias")]), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("kind"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("BUILDING")).alias("filter"),
    )


def panels(spark: SparkSession, d: str) -> DataFrame:
    """Mosaic panels on the sky: RA wraps past 360, Dec stays within +-60 degrees."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("id"), F.col("s_nationkey").alias("target"),
        F.pmod(k * 37.0 + F.col("s_acctbal") / 100, F.lit(360.0)).alias("ra"),
        ((k % 61) * 2.0 - 60.0).alias("dec"),
    )


def ev(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("target"), F.col("event_type").alias("kind"),
        "value", "props", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled corpus metric: healthy = quality 1, degraded = quality 0."""
    l = table(spark, d, "labels")
    n = docs(spark, d).select("doc_id", "source", "lang", "n_chars")
    return l.join(n, "doc_id").select(
        F.col("doc_id").alias("sample"), "source", "lang", F.col("n_chars").cast("double").alias("value"),
        F.when(F.col("quality") == 1, "healthy").otherwise("degraded").alias("label"),
        (F.col("toxic") == 1).alias("flagged"),
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages"), "page_id")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("run"), F.col("turn").alias("step"), F.col("role").alias("actor"), "text"
    )
