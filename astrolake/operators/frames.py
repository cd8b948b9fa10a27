"""Frame catalogue: classification, decisions and quality reports as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.functions.scan import attach, exact_quantiles, join_on
from astrolake.session import cut, hold

# fixed values: accepted colour filter array patterns
BAYER = ("RGGB", "BGGR", "GRBG", "GBRG")
# fixed values: chain thresholds (degrees, relative scale, multiples of the field)
ROTATION_LIMIT, SCALE_LIMIT, MOSAIC_FACTOR = 5.0, 0.05, 1.2


def frame_catalog(header: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Long header rows (frame, key, raw) to one typed row per frame; bad numbers become null."""
    wide = header.groupBy("frame").pivot("key", list(keys)).agg(F.first("raw", True))
    return wide.select("frame", *[F.col(k).try_cast(t).alias(k.lower().replace("-", "_")) for k, t in keys.items()])


def with_frame_kind(df: DataFrame) -> DataFrame:
    """NAXIS 2/3 to cfa / mono / rgb; a mosaic without pattern is refused unless the sensor is monochrome."""
    two, pat = F.col("naxis") == 2, F.upper(F.trim("bayerpat"))
    has = F.coalesce(F.length("bayerpat") > 0, F.lit(False))
    return df.withColumn(
        "kind", F.when(F.col("naxis") == 3, "rgb").when(two & has, "cfa").when(two & F.col("mono_sensor"), "mono").otherwise("refused")
    ).withColumn("pattern_warning", has & ~pat.isin(*BAYER))


def with_frame_role(df: DataFrame) -> DataFrame:
    """Role (bias, dark, flat, light in that order), processing stage and transfer state."""
    text = F.concat_ws(" ", F.lower(F.coalesce("imagetyp", F.lit(""))), F.lower("stem"))
    has = lambda *t: text.rlike("|".join(t))
    role = F.when(has("bias", "offset"), "bias").when(has("dark"), "dark").when(has("flat"), "flat").when(has("light", "object"), "light").otherwise("unknown")
    stem = F.lower("stem")
    stacked = F.coalesce(F.col("ncombine") > 0, F.lit(False))
    stage = (
        F.when(stacked, "stacked_or_integrated")
        .when(stem.contains("master") & F.col("role").isin("bias", "dark", "flat"), "master_calibration")
        .when(stem.rlike("stack|integrat|masterlight"), "stacked_or_integrated").otherwise("unknown"))
    linear = F.lower("suffix").isin(".fit", ".fits", ".fts", ".xisf")
    return df.withColumn("role", role).withColumn("stage", stage).withColumn(
        "transfer", F.when(linear, "likely_linear").otherwise("unknown")
    ).withColumn("confidence", F.when(linear, "medium").otherwise("low"))


# fixed values: device rules (priority, id, class, match all of, match one of)
DEVICE_RULES = (
    (1, "zwo_seestar_s50", "smart", {"INSTRUME": r"(?i)^seestar"}, {"TELESCOP": r"(?i)seestar", "CREATOR": r"(?i)seestar"}),
    (2, "zwo_seestar_s30", "smart", {"TELESCOP": r"(?i)^s30\b"}, {}),
    (3, "zwo_asiair_dslr", "traditional", {"CREATOR": r"(?i)^zwo\s+asiair"}, {"INSTRUME": r"(?i)nikon|canon|pentax|sony"}),
    (4, "touptek_atr585m_mono", "traditional", {"INSTRUME": r"(?i)^atr585m"}, {}),
    (5, "zwo_seestar_generic", "smart", {"CREATOR": r"(?i)seestar"}, {"PRODUCER": r"(?i)zwo", "TELESCOP": r"(?i)seestar"}),
)


def device_rules(spark: SparkSession) -> DataFrame:
    """One row per (rule, header key, pattern, group)."""
    rows = []
    for prio, rid, cls, every, any_of in DEVICE_RULES:
        rows += [(prio, rid, cls, k, p, "match") for k, p in every.items()]
        rows += [(prio, rid, cls, k, p, "any_of") for k, p in any_of.items()]
    return spark.createDataFrame(rows, "priority int, rule string, class string, key string, pattern string, part string")


def identify_device(header: DataFrame, rules: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """First rule whose every match pattern hits and whose any-of group (if any) has a hit.

    Equi join of long headers with the constant rule table on the header key; the rule shape (how
    many patterns it needs) is compared with what hit.
    """
    need = rules.groupBy("rule").agg(
        F.count_if(F.col("part") == "match").alias("need"), F.max((F.col("part") == "any_of").cast("int")).alias("group_need"))
    j = header.join(F.broadcast(rules), "key").where(F.expr("raw rlike pattern"))
    hit = j.groupBy("frame", "rule", "priority", "class").agg(
        F.count_if(F.col("part") == "match").alias("hits"), F.max((F.col("part") == "any_of").cast("int")).alias("group_hit"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("part") == "match", F.col("key")))), "+").alias("matched_by"))
    ok = hit.join(F.broadcast(need), "rule").where((F.col("hits") == F.col("need")) & (F.col("group_hit") >= F.col("group_need")))
    best = ok.groupBy("frame").agg(F.min_by(F.struct("rule", "class", "matched_by"), "priority").alias("_m"))
    every = header.groupBy("frame").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("evidence"))
    out = every.join(best, "frame", "left").select(
        "frame", F.coalesce("_m.rule", F.lit("unidentified")).alias("device"), F.col("_m.class").alias("class"),
        F.col("_m.matched_by").alias("matched_by"), F.when(F.col("_m").isNull(), F.col("evidence")).alias("evidence"))
    if overrides is not None:
        out = out.join(F.broadcast(overrides), "device", "left")
    return out


def sensor_groups(specs: DataFrame) -> DataFrame:
    """Normalised sensor code to the devices that carry it, confirmed sensors only."""
    code = F.upper(F.regexp_replace("sensor", "[^A-Za-z0-9]", ""))
    return specs.where(F.col("status") == "confirmed").groupBy(code.alias("sensor")).agg(
        F.array_join(F.sort_array(F.collect_set("device")), ",").alias("devices"), F.countDistinct("device").alias("n"))


# fixed values: what phrases of neighbouring words, written together, say about a filter
FILTER_LINES = (("H-alpha", ("ha", "halpha")), ("OIII", ("o3", "oiii", "oxygen")), ("SII", ("s2", "sii", "sulfur", "sulphur")))
DUAL_PRODUCTS = ("lextreme", "lenhance", "lultimate", "nbz", "alpt")
DUAL_WORDS = ("dual", "duo", "dualband", "duoband")
BROAD_WORDS = ("uvir", "uv/ir", "uvircut", "uv/ircut", "ircut", "cls", "broadband", "clear")
# fixed values: what a whole label says, and the device words behind a label of the device
LUMINANCE_LABELS, CHANNEL_LABELS = ("l", "lum", "luminance"), ("r", "g", "b", "red", "green", "blue")
DEVICE_LABELS, DEVICE_WORDS = ("lp", "seestarlp", "zwoseestarlp"), ("s30", "s50", "seestars30", "seestars50", "seestar30", "seestar50")


def words_of(c: Column) -> Column:
    """Lower-case words of a label; blanks, hyphens and underscores part words, other signs are words of their own."""
    plain = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("α"), F.lit("alpha"))
    return F.filter(F.split(F.regexp_replace(plain, r"([^a-z0-9\s_-])", " $1 "), r"[\s_-]+"), lambda w: w != "")


def phrases_of(words: Column, longest: int = 4) -> Column:
    """Every run of up to ``longest`` neighbouring words, written together."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.array(*[F.array_join(F.slice(words, i, n), "") for n in range(1, longest + 1)])))


def with_filter_class(df: DataFrame, raw: str, device: str) -> DataFrame:
    """Class, emission lines and short name of a filter label, decided by the first rule that speaks.

    Named lines come first, then products, labels of the device, dual-band words, luminance, colour channels and
    broadband words.  Only array expressions over the label's own phrases: nothing is joined or shuffled.
    """
    # words, phrases and lines are read by many rules, so each is worked out once a row
    held = hold(df, "_words", words_of(F.col(raw)))
    held = hold(held, "_label", F.array_join("_words", ""))
    held = hold(hold(held, "_said", phrases_of(F.col("_words"))), "_device", words_of(F.col(device)))
    label = F.col("_label")
    says = lambda vocabulary: F.arrays_overlap("_said", F.array(*map(F.lit, vocabulary)))
    known = F.arrays_overlap(phrases_of(F.col("_device")), F.array(*map(F.lit, DEVICE_WORDS)))
    held = hold(held, "_lines", F.array_compact(F.array(*[F.when(says(spelled), F.lit(line)) for line, spelled in FILTER_LINES])))
    held = hold(held, "_two", says(DUAL_PRODUCTS) | (label.isin(*DEVICE_LABELS) & known))
    lines, two_lines = F.col("_lines"), F.col("_two")
    count = F.size(lines)
    rules = (
        (count > 0, F.element_at(F.array(F.lit("narrowband"), F.lit("dual_band"), F.lit("multi_band")), F.greatest(count, F.lit(1)))),
        (two_lines | says(DUAL_WORDS), F.lit("dual_band")),
        (label.isin(*LUMINANCE_LABELS), F.lit("luminance")),
        (label.isin(*CHANNEL_LABELS), F.lit("broadband_channel")),
        (says(BROAD_WORDS), F.lit("broadband")),
    )
    short = (
        (count == 1, F.array_join(lines, "")),
        (label.isin(*LUMINANCE_LABELS), F.lit("L")),
        (label.isin(*CHANNEL_LABELS), F.upper(F.substring(label, 1, 1))),
    )
    first = lambda table, other: F.coalesce(*[F.when(when, then) for when, then in table], other)
    found = F.when(count > 0, F.array_join(lines, ",")).when(two_lines, "H-alpha,OIII").otherwise("")
    return held.select(*[F.col(c) for c in df.columns if c not in ("filter_class", "lines", "normalized")], first(rules, F.lit("unknown")).alias("filter_class"), found.alias("lines"), first(short, F.trim(raw)).alias("normalized"))


# fixed values: catalogue of named targets (id, type)
CATALOGUE = (
    ("M1", "planetary_nebula"),
    ("M2", "globular_cluster"),
    ("M3", "globular_cluster"),
    ("M4", "globular_cluster"),
    ("M5", "globular_cluster"),
    ("M8", "emission_nebula"),
    ("M9", "globular_cluster"),
    ("M10", "globular_cluster"),
    ("M11", "open_cluster"),
    ("M12", "globular_cluster"),
    ("M13", "globular_cluster"),
    ("M15", "globular_cluster"),
    ("M16", "emission_nebula"),
    ("M17", "emission_nebula"),
    ("M20", "emission_nebula"),
    ("M22", "globular_cluster"),
    ("M27", "planetary_nebula"),
    ("M29", "open_cluster"),
    ("M31", "galaxy"),
    ("M32", "galaxy"),
    ("M33", "galaxy"),
    ("M34", "open_cluster"),
    ("M35", "open_cluster"),
    ("M39", "open_cluster"),
    ("M41", "open_cluster"),
    ("M42", "emission_nebula"),
    ("M43", "emission_nebula"),
    ("M44", "open_cluster"),
    ("M45", "open_cluster"),
    ("M51", "galaxy"),
    ("M53", "globular_cluster"),
    ("M57", "planetary_nebula"),
    ("M63", "galaxy"),
    ("M64", "galaxy"),
    ("M67", "open_cluster"),
    ("M74", "galaxy"),
    ("M77", "galaxy"),
    ("M78", "reflection_nebula"),
    ("M81", "galaxy"),
    ("M82", "galaxy"),
    ("M83", "galaxy"),
    ("M92", "globular_cluster"),
    ("M94", "galaxy"),
    ("M97", "planetary_nebula"),
    ("M101", "galaxy"),
    ("M104", "galaxy"),
    ("M106", "galaxy"),
    ("NGC253", "galaxy"),
    ("NGC281", "emission_nebula"),
    ("NGC891", "galaxy"),
    ("NGC1499", "emission_nebula"),
    ("NGC2174", "emission_nebula"),
    ("NGC2237", "emission_nebula"),
    ("NGC2244", "open_cluster"),
    ("NGC2359", "emission_nebula"),
    ("NGC4565", "galaxy"),
    ("NGC4631", "galaxy"),
    ("NGC5907", "galaxy"),
    ("NGC6888", "emission_nebula"),
    ("NGC6960", "emission_nebula"),
    ("NGC6992", "emission_nebula"),
    ("NGC6995", "emission_nebula"),
    ("NGC7000", "emission_nebula"),
    ("NGC7023", "reflection_nebula"),
    ("NGC7331", "galaxy"),
    ("NGC7635", "emission_nebula"),
    ("IC405", "emission_nebula"),
    ("IC410", "emission_nebula"),
    ("IC434", "emission_nebula"),
    ("IC443", "emission_nebula"),
    ("IC1396", "emission_nebula"),
    ("IC1805", "emission_nebula"),
    ("IC1848", "emission_nebula"),
    ("IC2118", "reflection_nebula"),
    ("B33", "dark_nebula"),
    ("B142", "dark_nebula"),
    ("LDN1622", "dark_nebula"),
)
STAR_DOMINANT = ("globular_cluster", "open_cluster", "star_cluster", "double_star")


def target_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOGUE), "catalog_id string, catalog_type string")


# fixed values: spelled catalogue prefixes and their short forms
PREFIXES = {"M": "M", "NGC": "NGC", "IC": "IC", "B": "B", "LDN": "LDN", "CED": "CED", "VDB": "VDB", "C": "C", "CALDWELL": "C", "SH2": "SH2", "SH-2": "SH2"}


def catalog_id(name: Column) -> Column:
    """``m 42`` -> ``M42``, ``ngc-6888`` -> ``NGC6888``; anything else upper-cased without blanks."""
    tight = F.regexp_replace(F.upper(F.trim(name)), r"\s+", "")
    number = lambda spelled: F.regexp_extract(tight, rf"^{spelled}[-_]?(\d+)$", 1)
    entries = [F.when(number(spelled) != "", F.concat(F.lit(short), number(spelled))) for spelled, short in PREFIXES.items()]
    return F.coalesce(*entries, tight)


def with_target_type(df: DataFrame, cat: DataFrame, guess: str = "emission_nebula") -> DataFrame:
    """Left join with the constant catalogue; unknown names fall back to a guess that says so."""
    j = df.withColumn("catalog_id", catalog_id(F.col("target_name"))).join(F.broadcast(cat), "catalog_id", "left")
    kind = F.coalesce("catalog_type", F.lit(guess))
    return j.withColumn("target_type", kind).withColumn("type_is_guessed", F.col("catalog_type").isNull()).withColumn(
        "star_dominant", kind.isin(*STAR_DOMINANT) | (F.col("catalog_id") == "M45")).drop("catalog_type")


# fixed values: target types that a user may declare
KNOWN_TYPES = (
    "emission_nebula", "reflection_nebula", "dark_nebula", "galaxy", "planetary_nebula", "globular_cluster", "open_cluster", "star_cluster", "double_star",
    "supernova_remnant", "wide_field",
)
# fixed values: common names and second catalogue numbers of catalogued objects
SYNONYMS = (
    ("ORION NEBULA", "M42"), ("GREAT ORION NEBULA", "M42"), ("ANDROMEDA GALAXY", "M31"), ("TRIANGULUM GALAXY", "M33"), ("WHIRLPOOL GALAXY", "M51"),
    ("EAGLE NEBULA", "M16"), ("CRAB NEBULA", "M1"), ("LAGOON NEBULA", "M8"), ("DUMBBELL NEBULA", "M27"), ("RING NEBULA", "M57"), ("PLEIADES", "M45"),
    ("PLEIADES CLUSTER", "M45"), ("ROSETTE NEBULA", "NGC2237"), ("ROSETTE", "NGC2237"), ("ROSETTE CLUSTER", "NGC2244"), ("C50", "NGC2237"), ("C49", "NGC2244"),
    ("C11", "NGC7635"), ("C20", "NGC7000"), ("C27", "NGC6888"), ("C33", "NGC6992"), ("C34", "NGC6960"), ("C4", "NGC7023"), ("C14", "NGC869"),
    ("WITCH HEAD NEBULA", "IC2118"), ("NORTH AMERICA NEBULA", "NGC7000"), ("IRIS NEBULA", "NGC7023"), ("CRESCENT NEBULA", "NGC6888"), ("HORSEHEAD NEBULA", "IC434"),
)


def with_synonym(df: DataFrame, name: str) -> DataFrame:
    """``catalog_id`` of a target name after the synonym table: common names with blanks or underscores in any case, and second catalogue numbers.

    A null or blank name has the empty id.
    """
    own = catalog_id(F.coalesce(name, F.lit("")))
    bare = lambda c: F.regexp_replace(c, r"[\s_]+", "")
    names = df.sparkSession.createDataFrame(list(SYNONYMS), "_name string, _means string").withColumn("_name", bare(F.col("_name")))
    j = df.withColumn("_own", own).withColumn("_bare", bare(F.col("_own"))).join(F.broadcast(names), F.col("_bare") == F.col("_name"), "left")  # constant table
    return j.withColumn("catalog_id", F.coalesce("_means", "_own")).drop("_own", "_bare", "_name", "_means")


def with_resolved_type(df: DataFrame, cat: DataFrame, name: str, declared: str, guess: str = "emission_nebula") -> DataFrame:
    """catalog_id, target_type, type_source and star_dominant of a target that may declare its type.

    A known declared type rules (``declared``), then the catalogue's (``catalogue``), then any other declaration as it is
    (``unknown_type``), and last the guess (``guess``).
    """
    said = F.nullif(F.regexp_replace(F.lower(F.trim(F.col(declared))), " ", "_"), F.lit(""))
    j = with_synonym(df, name).withColumn("_said", said).join(F.broadcast(cat), "catalog_id", "left")  # constant table
    known = F.coalesce(F.col("_said").isin(*KNOWN_TYPES), F.lit(False))
    source = F.when(known, "declared").when(F.col("catalog_type").isNotNull(), "catalogue").when(F.col("_said").isNotNull(), "unknown_type").otherwise("guess")
    kind = F.when(known, F.col("_said")).otherwise(F.coalesce("catalog_type", "_said", F.lit(guess)))
    return j.withColumn("target_type", kind).withColumn("type_source", source).withColumn("star_dominant", F.col("target_type").isin(*STAR_DOMINANT) | (F.col("catalog_id") == "M45")).drop("catalog_type", "_said")


# fixed values: stretch policy (target type, method, background level)
STRETCH_POLICY = (
    ("galaxy", "masked_ghs_standard", 0.035), ("planetary_nebula", "masked_ghs_standard", 0.035),
    ("globular_cluster", "pi_mtf", 0.05), ("open_cluster", "pi_mtf", 0.05), ("star_cluster", "pi_mtf", 0.05), ("double_star", "pi_mtf", 0.05),
    ("reflection_nebula", "arcsinh", 0.05), ("dark_nebula", "arcsinh", 0.05), ("emission_nebula", "emission", 0.045),
)


def with_stretch_policy(df: DataFrame, spark: SparkSession) -> DataFrame:
    pol = spark.createDataFrame(list(STRETCH_POLICY), "target_type string, method string, level double")
    m42 = F.col("catalog_id") == "M42"
    return df.join(F.broadcast(pol), "target_type", "left").withColumn(
        "method", F.when(m42, "masked_ghs_standard").otherwise(F.coalesce("method", F.lit("pi_mtf")))
    ).withColumn("level", F.when(m42, 0.035).otherwise(F.coalesce("level", F.lit(0.05))))


def with_transform(df: DataFrame, h: str = "h") -> DataFrame:
    """Displacement, rotation and scale of a 3x3 homography stored row-major."""
    e = lambda i: F.col(h)[i]
    det = e(0) * e(4) - e(1) * e(3)
    return (
        df.withColumn("dx", e(2)).withColumn("dy", e(5)).withColumn("rotation_deg", F.degrees(F.atan2(e(3), e(0))))
        .withColumn("scale", F.when(det > 0, F.sqrt(det)))
        .withColumn("pure_translation", (F.abs(e(0) - 1) < 1e-3) & (F.abs(e(4) - 1) < 1e-3) & (F.abs(e(1)) < 1e-4) & (F.abs(e(3)) < 1e-4))
        .withColumn("has_projection", (F.abs(e(6)) > 1e-9) | (F.abs(e(7)) > 1e-9)))


def transform_summary(df: DataFrame, keys: list[str], fov: float) -> DataFrame:
    """Displacement span, largest rotation, scale deviation from the (upper) median, mosaic flag."""
    base = df.groupBy(*keys).agg(
        (F.max("dx") - F.min("dx")).alias("span_x"), (F.max("dy") - F.min("dy")).alias("span_y"),
        F.max(F.abs("rotation_deg")).alias("rotation_max"), F.min("scale").alias("_lo"), F.max("scale").alias("_hi"), F.count(F.lit(1)).alias("n"))
    mid = exact_quantiles(df, keys, "scale", {"median_scale": (0.5, "upper")})
    j = join_on(base, mid, keys)
    span = F.greatest("span_x", "span_y")
    dev = F.greatest(F.col("_hi") - F.col("median_scale"), F.col("median_scale") - F.col("_lo")) / F.col("median_scale")
    return j.withColumn("span", span).withColumn("scale_dev", dev).withColumn("mosaic", span > MOSAIC_FACTOR * fov).drop("_lo", "_hi")


def with_chain(df: DataFrame) -> DataFrame:
    """Processing chain from frame kind and the transform summary."""
    hard = F.col("mosaic") | (F.col("rotation_max") > ROTATION_LIMIT) | (F.col("scale_dev") > SCALE_LIMIT)
    chain = F.when(F.col("kind") == "mono", "mono").when(F.col("kind") == "rgb", "rgb").when(hard, "drizzle").when(F.col("mono_sensor"), "mono").otherwise("debayer")
    why = F.concat_ws(",", F.when(F.col("mosaic"), "mosaic"), F.when(F.col("rotation_max") > ROTATION_LIMIT, "rotation"), F.when(F.col("scale_dev") > SCALE_LIMIT, "scale"))
    return df.withColumn("chain", chain).withColumn("reasons", F.when(F.col("kind") == "cfa", why).otherwise(""))


def with_optics(df: DataFrame, wavelength_um: float = 0.55) -> DataFrame:
    """Sampling scale (arcsec/px), Airy radius (px) and the undersampling flag."""
    scale = 206.264806 * F.col("pixel_um") / F.col("focal_mm")
    airy = 1.22 * wavelength_um * (F.col("focal_mm") / F.col("aperture_mm")) / F.col("pixel_um")
    return df.withColumn("arcsec_px", scale).withColumn("airy_px", airy).withColumn("undersampled", airy < 1.0)


def with_framing(df: DataFrame) -> DataFrame:
    short = F.least("fov_w", "fov_h")
    ratio = F.when((short > 0) & (F.col("size") > 0), F.col("size") / short)
    return df.withColumn("framing_ratio", ratio).withColumn(
        "framing", F.when(ratio > 0.85, "fills_frame").when(ratio >= 0.35, "balanced").when(ratio >= 0.10, "wide_field").when(ratio.isNotNull(), "tiny"))


# fixed values: star strength baselines and bounds
STRENGTH = {"cluster": 0.90, "galaxy": 0.65, "nebula": 0.55}
STRENGTH_DEFAULT, STRENGTH_MIN, STRENGTH_MAX = 0.65, 0.40, 0.95
# fixed values: words of narrowband filters, and what they, other filters and bright stars change
NARROW_WORDS, NARROW, WIDE, BRIGHT, BRIGHT_FROM = ("narrow", "dnb", "duo", "dual", "lp", "sii", "ha", "oiii", "sho"), -0.05, 0.05, -0.05, 0.01
# fixed values: ramps over the flux ratio (where one begins, signed width, change at its end)
FLUX_RAMPS = ((0.25, 0.20, -0.15), (0.15, -0.10, 0.10))


def with_star_strength(df: DataFrame) -> DataFrame:
    """Baseline of the target type, moved by flux ramps, bright stars and the kind of filter, within bounds."""
    kind, filters = F.lower("target_type"), F.lower("filter_type")
    base = F.coalesce(*[F.when(kind.contains(word), F.lit(value)) for word, value in STRENGTH.items()], F.lit(STRENGTH_DEFAULT))
    along = lambda start, width: F.least(F.greatest((F.col("flux_ratio") - start) / width, F.lit(0.0)), F.lit(1.0))
    parts = [change * along(start, width) for start, width, change in FLUX_RAMPS]
    parts = [F.coalesce(part, F.lit(0.0)) for part in parts]
    parts.append(F.when(F.col("bright_ratio") > BRIGHT_FROM, BRIGHT).otherwise(0.0))
    parts.append(F.when(F.exists(F.array(*map(F.lit, NARROW_WORDS)), lambda w: F.contains(filters, w)), NARROW).otherwise(WIDE))
    total = base
    for part in parts:
        total = total + part
    return df.withColumn("strength", F.least(F.greatest(total, F.lit(STRENGTH_MIN)), F.lit(STRENGTH_MAX)))


def frame_quality(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Per metric: min, p10, p50, p90, p99, max (floor index), outliers beyond 1.5x median, sigma/median, dispersion."""
    long = df.unpivot([*keys, "frame"], metrics, "metric", "value").where(F.col("value").isNotNull())
    g = [*keys, "metric"]
    q = exact_quantiles(long, g, "value", {f"p{int(p * 100)}": (p, "pF") for p in (0.1, 0.5, 0.9, 0.99)}, count_as="n")
    q = cut(q)
    s = attach(long, q.select(*g, "p50"), g).groupBy(*g).agg(
        F.min("value").alias("mn"), F.max("value").alias("mx"), F.stddev_samp("value").alias("_sd"),
        F.count_if(F.col("value") > 1.5 * F.col("p50")).alias("n_outlier"))
    j = join_on(q, s, g)
    nz = lambda c: F.nullif(c, F.lit(0.0))
    return j.withColumn("rel_sigma", F.col("_sd") / nz(F.col("p50"))).withColumn("dispersion", F.col("p90") / nz(F.col("p10"))).drop("_sd")


def dispersion_gate(df: DataFrame, keys: list[str], metric: str, need_n: int = 20, need_ratio: float = 1.4, thin: int = 30) -> DataFrame:
    q = exact_quantiles(df, keys, metric, {"p10": (0.1, "pF"), "p90": (0.9, "pF")}, count_as="n")
    ratio = F.col("p90") / F.nullif(F.col("p10"), F.lit(0.0))
    reason = F.when(F.col("n") < need_n, "too_few_frames").when(ratio.isNull(), "unmeasurable").when(ratio <= need_ratio, "low_dispersion").when(F.col("n") < thin, "thin").otherwise("ok")
    return q.withColumn("ratio", ratio).withColumn("reason", reason).withColumn("eligible", reason.isin("ok", "thin"))


def filter_breakdown(df: DataFrame, keys: list[str]) -> DataFrame:
    """Frames per normalised filter, the unlabelled group first."""
    g = df.groupBy(*keys, F.upper(F.rtrim("filter")).alias("filter")).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(*keys, F.asc_nulls_first("filter"))


def order_nulls(df: DataFrame, col: str, *rest: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_first(col), *rest)


def preflight(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a multi-filter batch: mixed settings, mixed geometry, bucket counts, alias collisions.

    Expects filter, settings, geometry, identity columns.  Distinct values are reduced per bucket
    before anything crosses buckets.
    """
    b = df.groupBy(*keys, "filter").agg(
        F.count(F.lit(1)).alias("n"), F.min("settings").alias("s0"), F.max("settings").alias("s1"),
        F.min("geometry").alias("g0"), F.max("geometry").alias("g1"), F.min("identity").alias("identity"))
    mixed = b.where(F.col("s0") != F.col("s1")).select(*keys, F.lit("mixed_settings").alias("code"), F.col("filter").alias("detail"))
    small = b.where(F.col("n") < 2).select(*keys, F.lit("bucket_too_small").alias("code"), F.col("filter").alias("detail"))
    unlabelled = b.where(F.col("filter").isNull()).select(*keys, F.lit("missing_filter").alias("code"), F.lit("").alias("detail"))
    alias = b.groupBy(*keys, "identity").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("identity").isNotNull()).select(
        *keys, F.lit("alias_collision").alias("code"), F.col("identity").alias("detail"))
    whole = b.groupBy(*keys).agg(F.count("filter").alias("k"), F.min("g0").alias("g0"), F.max("g1").alias("g1"))
    geo = whole.where(F.col("g0") != F.col("g1")).select(*keys, F.lit("mixed_geometry").alias("code"), F.lit("").alias("detail"))
    count = whole.where((F.col("k") < 2) | (F.col("k") > 8)).select(*keys, F.lit("bucket_count").alias("code"), F.col("k").cast("string").alias("detail"))
    out = mixed
    for part in (small, unlabelled, alias, geo, count):
        out = out.unionByName(part)
    return out


# fixed values: preparation gates (metric, warn beyond, fail beyond, lower is bad)
PRECHECK = (
    ("min_stars", 5.0, 5.0, True), ("fwhm_spread", 3.0, None, False), ("alignment_px", 0.15, 0.50, False),
    ("sky_spread", 0.02, 0.10, False), ("structure", 0.03, 0.12, False),
)


def precheck(df: DataFrame, keys: list[str], spark: SparkSession) -> DataFrame:
    """Set-level gates PASS / WARN / FAIL: one aggregate row, unpivoted against the constant limits."""
    g = df.groupBy(*keys).agg(
        F.min("nstars").cast("double").alias("min_stars"), (F.max("fwhm") / F.min("fwhm")).alias("fwhm_spread"),
        F.max("alignment").alias("alignment_px"),
        ((F.max("background") - F.min("background")) / F.nullif(F.avg("background"), F.lit(0.0))).alias("sky_spread"),
        F.stddev_pop("roundness").alias("structure"))
    long = g.unpivot(keys, [m for m, *_ in PRECHECK], "metric", "value")
    lim = spark.createDataFrame(list(PRECHECK), "metric string, warn double, fail double, lower boolean")
    j = long.join(F.broadcast(lim), "metric")
    fail = F.when(F.col("lower"), F.col("value") < F.col("fail")).otherwise(F.col("value") > F.col("fail"))
    warn = F.when(F.col("lower"), F.col("value") < F.col("warn")).otherwise(F.col("value") > F.col("warn"))
    st = F.when(F.col("value").isNull(), "UNAVAILABLE").when(F.coalesce(fail, F.lit(False)), "FAIL").when(warn, "WARN").otherwise("PASS")
    return j.withColumn("status", st).select(*keys, "metric", "value", "status")


def verdict(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Worst status of a set and the metrics that block it."""
    sev = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    g = checked.groupBy(*keys).agg(
        F.max(sev).alias("_s"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") == "FAIL", F.col("metric")))), ",").alias("blockers"))
    return g.withColumn("verdict", F.when(F.col("_s") == 2, "FAIL").when(F.col("_s") == 1, "WARN").otherwise("PASS")).drop("_s")
