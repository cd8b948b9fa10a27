"""Frame catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolake import views as V
from astrolake.operators import frames as R
from astrolake.plans.registry import query

# Header cards bound to the event table: one long row per (frame, key).
HEADER_SQL = """hdr AS (
 SELECT id AS frame, 'GAIN' AS key, CAST(k AS VARCHAR) AS raw FROM ev UNION ALL
 SELECT id, 'EXPTIME', CASE WHEN id % 13 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END FROM ev UNION ALL
 SELECT id, 'IMAGETYP', kind FROM ev UNION ALL
 SELECT id, 'INSTRUME', CASE target % 5 WHEN 0 THEN 'Seestar S50' WHEN 1 THEN 'NIKON D5100' WHEN 2 THEN 'ATR585M' WHEN 3 THEN 'imx462' ELSE 'Canon' END FROM ev UNION ALL
 SELECT id, 'CREATOR', CASE id % 4 WHEN 0 THEN 'ZWO ASIAIR Plus' WHEN 1 THEN 'Seestar app' WHEN 2 THEN 'ZWO  asiair' ELSE 'NINA' END FROM ev UNION ALL
 SELECT id, 'TELESCOP', CASE WHEN id % 3 = 0 THEN 'Seestar' ELSE 'S30 mini' END FROM ev WHERE id % 6 < 4)"""


def header(s, d):
    e = V.ev(s, d)
    pick = lambda m, names: F.element_at(F.array(*[F.lit(n) for n in names]), (m + 1).cast("int"))
    cards = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("GAIN", "EXPTIME", "IMAGETYP", "INSTRUME", "CREATOR", "TELESCOP")]),
        F.array(
            F.col("k").cast("string"), F.when(F.col("id") % 13 == 0, "n/a").otherwise(F.col("value").cast("string")), F.col("kind"),
            pick(F.col("target") % 5, ("Seestar S50", "NIKON D5100", "ATR585M", "imx462", "Canon")),
            pick(F.col("id") % 4, ("ZWO ASIAIR Plus", "Seestar app", "ZWO  asiair", "NINA")),
            F.when(F.col("id") % 6 < 4, F.when(F.col("id") % 3 == 0, "Seestar").otherwise("S30 mini"))))
    long = e.select(F.col("id").alias("frame"), F.explode(cards).alias("key", "raw"))
    return long.where(F.col("raw").isNotNull())


@query("a03_frame_catalog", "i:frame,gain d:exptime s:imagetyp,instrume,telescop", f"""WITH {HEADER_SQL}
SELECT frame, max(TRY_CAST(CASE WHEN key = 'GAIN' THEN raw END AS INTEGER)) AS gain, max(TRY_CAST(CASE WHEN key = 'EXPTIME' THEN raw END AS DOUBLE)) AS exptime,
 max(CASE WHEN key = 'IMAGETYP' THEN raw END) AS imagetyp, max(CASE WHEN key = 'INSTRUME' THEN raw END) AS instrume, max(CASE WHEN key = 'TELESCOP' THEN raw END) AS telescop
FROM hdr GROUP BY frame""")
def _(s, d):
    return R.frame_catalog(header(s, d), {"GAIN": "int", "EXPTIME": "double", "IMAGETYP": "string", "INSTRUME": "string", "TELESCOP": "string"})


@query("b03_identify_device", "i:frame s:device,class,matched_by,evidence", rf"""WITH {HEADER_SQL},
w AS (SELECT frame, max(CASE WHEN key = 'INSTRUME' THEN lower(raw) END) AS ins, max(CASE WHEN key = 'CREATOR' THEN lower(raw) END) AS cre,
 max(CASE WHEN key = 'TELESCOP' THEN lower(raw) END) AS tel, string_agg(key, ',' ORDER BY key) AS ev_ FROM hdr GROUP BY frame),
r AS (SELECT *, CASE WHEN ins LIKE 'seestar%' AND (coalesce(tel, '') LIKE '%seestar%' OR cre LIKE '%seestar%') THEN 'zwo_seestar_s50'
 WHEN regexp_matches(coalesce(tel, ''), '^s30\b') THEN 'zwo_seestar_s30'
 WHEN regexp_matches(cre, '^zwo\s+asiair') AND regexp_matches(ins, 'nikon|canon|pentax|sony') THEN 'zwo_asiair_dslr'
 WHEN ins LIKE 'atr585m%' THEN 'touptek_atr585m_mono' WHEN cre LIKE '%seestar%' AND coalesce(tel, '') LIKE '%seestar%' THEN 'zwo_seestar_generic' ELSE 'unidentified' END AS device FROM w)
SELECT frame, device, CASE WHEN device IN ('zwo_seestar_s50','zwo_seestar_s30','zwo_seestar_generic') THEN 'smart' WHEN device <> 'unidentified' THEN 'traditional' END AS class,
 CASE device WHEN 'zwo_seestar_s50' THEN 'INSTRUME' WHEN 'zwo_seestar_s30' THEN 'TELESCOP' WHEN 'zwo_asiair_dslr' THEN 'CREATOR' WHEN 'touptek_atr585m_mono' THEN 'INSTRUME'
 WHEN 'zwo_seestar_generic' THEN 'CREATOR' END AS matched_by, CASE WHEN device = 'unidentified' THEN ev_ END AS evidence FROM r""")
def _(s, d):
    return R.identify_device(header(s, d), R.device_rules(s))


STRUCT_SQL = """SELECT *, CASE WHEN frame % 3 < 2 THEN 2 ELSE 3 END AS naxis, CASE frame % 4 WHEN 0 THEN 'RGGB' WHEN 1 THEN 'gbrg ' WHEN 2 THEN NULL ELSE 'XXXX' END AS bayerpat,
 frame % 5 < 2 AS mono_sensor, CASE filter WHEN 'O' THEN 'Light Frame' WHEN 'F' THEN 'Flat' ELSE NULL END AS imagetyp,
 concat(CASE frame % 4 WHEN 0 THEN 'masterdark' WHEN 1 THEN 'bias' WHEN 2 THEN 'stack' ELSE 'img' END, '_', frame) AS stem,
 CASE WHEN frame % 7 = 0 THEN 5 END AS ncombine, CASE WHEN frame % 5 = 0 THEN '.tif' ELSE '.fits' END AS suffix FROM frames"""


def structure(s, d):
    f = V.frames(s, d)
    m = F.col("frame") % 4
    return f.select(
        "*", F.when(F.col("frame") % 3 < 2, 2).otherwise(3).alias("naxis"),
        F.when(m == 0, "RGGB").when(m == 1, "gbrg ").when(m == 3, "XXXX").alias("bayerpat"), (F.col("frame") % 5 < 2).alias("mono_sensor"),
        F.when(F.col("filter") == "O", "Light Frame").when(F.col("filter") == "F", "Flat").alias("imagetyp"),
        F.concat(F.when(m == 0, "masterdark").when(m == 1, "bias").when(m == 2, "stack").otherwise("img"), F.lit("_"), F.col("frame").cast("string")).alias("stem"),
        F.when(F.col("frame") % 7 == 0, 5).alias("ncombine"), F.when(F.col("frame") % 5 == 0, ".tif").otherwise(".fits").alias("suffix"))


KIND = """CASE WHEN naxis = 3 THEN 'rgb' WHEN bayerpat IS NOT NULL THEN 'cfa' WHEN mono_sensor THEN 'mono' ELSE 'refused' END"""


@query("b01_frame_kind", "i:frame s:kind b:pattern_warning", f"""WITH z AS ({STRUCT_SQL})
SELECT frame, {KIND} AS kind, bayerpat IS NOT NULL AND upper(trim(bayerpat)) NOT IN ('RGGB','BGGR','GRBG','GBRG') AS pattern_warning FROM z""")
def _(s, d):
    return R.with_frame_kind(structure(s, d))


@query("b02_frame_role", "i:frame s:role,stage,transfer,confidence", f"""WITH z AS ({STRUCT_SQL}), r AS (SELECT *, lower(concat(coalesce(imagetyp, ''), ' ', stem)) AS t FROM z),
q AS (SELECT *, CASE WHEN t LIKE '%bias%' OR t LIKE '%offset%' THEN 'bias' WHEN t LIKE '%dark%' THEN 'dark' WHEN t LIKE '%flat%' THEN 'flat' WHEN t LIKE '%light%' OR t LIKE '%object%' THEN 'light' ELSE 'unknown' END AS role FROM r)
SELECT frame, role, CASE WHEN ncombine > 0 THEN 'stacked_or_integrated' WHEN stem LIKE '%master%' AND role IN ('bias','dark','flat') THEN 'master_calibration'
 WHEN stem LIKE '%stack%' OR stem LIKE '%integrat%' THEN 'stacked_or_integrated' ELSE 'unknown' END AS stage,
 CASE WHEN suffix = '.fits' THEN 'likely_linear' ELSE 'unknown' END AS transfer, CASE WHEN suffix = '.fits' THEN 'medium' ELSE 'low' END AS confidence FROM q""")
def _(s, d):
    return R.with_frame_role(structure(s, d))


@query("b04_sensor_groups", "s:sensor,devices i:n", """
SELECT upper(replace(p_name, ' ', '')) AS sensor, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS devices, count(DISTINCT p_brand) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1""")
def _(s, d):
    p = V.table(s, d, "part").select(F.col("p_name").alias("sensor"), F.col("p_brand").alias("device"), F.when(F.col("p_size") % 2 == 0, "confirmed").otherwise("reported").alias("status"))
    return R.sensor_groups(p)


LABELS = ("Ha", "O III", "s2", "L-eXtreme", "LP", "Lum", "R", "blue", "UV/IR cut", "Dual band", "Ha_OIII", "H alpha O3 SII", "clear", "none known", "")
LABEL_SQL = f"""SELECT p_partkey AS id, [{', '.join(f"'{x}'" for x in LABELS)}][p_partkey % {len(LABELS)} + 1] AS raw, CASE WHEN p_size % 2 = 0 THEN 'Seestar S50' ELSE 'Canon' END AS device FROM part"""


@query("b05_filter_class", "i:id s:filter_class,lines,normalized", f"""WITH z AS ({LABEL_SQL})
SELECT id, CASE p WHEN 0 THEN 'narrowband' WHEN 1 THEN 'narrowband' WHEN 2 THEN 'narrowband' WHEN 3 THEN 'dual_band' WHEN 4 THEN CASE WHEN device LIKE 'Seestar%' THEN 'dual_band' ELSE 'unknown' END
 WHEN 5 THEN 'luminance' WHEN 6 THEN 'broadband_channel' WHEN 7 THEN 'broadband_channel' WHEN 8 THEN 'broadband' WHEN 9 THEN 'dual_band' WHEN 10 THEN 'dual_band' WHEN 11 THEN 'multi_band'
 WHEN 12 THEN 'broadband' ELSE 'unknown' END AS filter_class,
 CASE p WHEN 0 THEN 'H-alpha' WHEN 1 THEN 'OIII' WHEN 2 THEN 'SII' WHEN 3 THEN 'H-alpha,OIII' WHEN 4 THEN CASE WHEN device LIKE 'Seestar%' THEN 'H-alpha,OIII' ELSE '' END WHEN 10 THEN 'H-alpha,OIII' WHEN 11 THEN 'H-alpha,OIII,SII' ELSE '' END AS lines,
 CASE p WHEN 0 THEN 'H-alpha' WHEN 1 THEN 'OIII' WHEN 2 THEN 'SII' WHEN 5 THEN 'L' WHEN 6 THEN 'R' WHEN 7 THEN 'B' ELSE raw END AS normalized
FROM (SELECT *, id % {len(LABELS)} AS p FROM z)""")
def _(s, d):
    p = V.spread(V.table(s, d, "part"), "p_partkey")
    raw = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("p_partkey") % len(LABELS) + 1).cast("int"))
    z = p.select(F.col("p_partkey").alias("id"), raw.alias("raw"), F.when(F.col("p_size") % 2 == 0, "Seestar S50").otherwise("Canon").alias("device"))
    return R.with_filter_class(z, "raw", "device")


def targets(s, d):
    p = V.table(s, d, "part")
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("m "), (k % 110).cast("string"))).when(k % 3 == 1, F.concat(F.lit("ngc-"), (k % 7400).cast("string"))).otherwise(F.col("p_name"))
    return p.select(k.alias("id"), name.alias("target_name"), "p_size")


TARGET_SQL = f"""z AS (SELECT p_partkey AS id, p_size, CASE p_partkey % 3 WHEN 0 THEN concat('M', p_partkey % 110) WHEN 1 THEN concat('NGC', p_partkey % 7400) ELSE upper(replace(p_name, ' ', '')) END AS catalog_id FROM part),
cat AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{t}')" for n, t in R.CATALOGUE)}) t(catalog_id, kind)),
tt AS (SELECT z.id, p_size, z.catalog_id, coalesce(kind, 'emission_nebula') AS target_type, kind IS NULL AS type_is_guessed,
 coalesce(kind, '') IN ('globular_cluster', 'open_cluster') OR z.catalog_id = 'M45' AS star_dominant FROM z LEFT JOIN cat USING (catalog_id))"""


@query("b06_target_type", "i:id s:catalog_id,target_type b:type_is_guessed,star_dominant", f"WITH {TARGET_SQL} SELECT * FROM tt")
def _(s, d):
    return R.with_target_type(targets(s, d), R.target_catalogue(s))


DECLARED = (" Open Cluster ", "galaxy", "Comet", "", "Wide Field", "supernova_remnant ")
SAID_SQL = f"""sy AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{t}')" for n, t in R.SYNONYMS)}) t(name, means)), wd AS (SELECT name, means, row_number() OVER (ORDER BY name) - 1 AS i FROM sy WHERE NOT regexp_matches(name, '^C[0-9]')),
nm AS (SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN concat('M', p_partkey % 110) WHEN 1 THEN concat('NGC', p_partkey % 7400) WHEN 2 THEN w.means WHEN 3 THEN w.means WHEN 4 THEN coalesce(c.means, concat('C', p_partkey % 60)) WHEN 5 THEN upper(replace(p_name, ' ', '')) ELSE '' END AS catalog_id,
 CASE WHEN p_partkey % 4 = 0 THEN [{', '.join(f"'{x}'" for x in DECLARED)}][p_partkey % {len(DECLARED)} + 1] END AS said FROM part LEFT JOIN wd w ON w.i = p_partkey % (SELECT count(*) FROM wd) LEFT JOIN sy c ON c.name = concat('C', p_partkey % 60)),
sd AS (SELECT id, nm.catalog_id, kind, nullif(replace(lower(trim(said)), ' ', '_'), '') AS said FROM nm LEFT JOIN (SELECT * FROM (VALUES {', '.join(f"('{n}', '{t}')" for n, t in R.CATALOGUE)}) t(catalog_id, kind)) k ON k.catalog_id = nm.catalog_id)"""


@query("b06_resolved_type", "i:id s:catalog_id,target_type,type_source b:star_dominant", f"""WITH {SAID_SQL}, ty AS (SELECT *, said IN ({', '.join(f"'{t}'" for t in R.KNOWN_TYPES)}) IS TRUE AS known FROM sd),
tz AS (SELECT id, catalog_id, CASE WHEN known THEN said ELSE coalesce(kind, said, 'emission_nebula') END AS target_type, CASE WHEN known THEN 'declared' WHEN kind IS NOT NULL THEN 'catalogue' WHEN said IS NOT NULL THEN 'unknown_type' ELSE 'guess' END AS type_source FROM ty)
SELECT *, target_type IN ({', '.join(f"'{t}'" for t in R.STAR_DOMINANT)}) OR catalog_id = 'M45' AS star_dominant FROM tz""")
def _(s, d):
    """Names as numbers, as common names in two spellings, as second catalogue numbers, as words, and blank; a quarter declare a type."""
    p, k = V.table(s, d, "part"), F.col("p_partkey")
    words = sorted(n for n, _ in R.SYNONYMS if not n[1:].isdigit())
    word = F.element_at(F.array(*[F.lit(w.title()) for w in words]), (k % len(words) + 1).cast("int"))
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    name = F.when(k % 7 == 0, text("m ", k % 110)).when(k % 7 == 1, text("ngc-", k % 7400)).when(k % 7 == 2, word).when(k % 7 == 3, F.translate(word, " ", "_")).when(k % 7 == 4, text("Caldwell ", k % 60)).when(k % 7 == 5, F.col("p_name"))
    said = F.when(k % 4 == 0, F.element_at(F.array(*[F.lit(x) for x in DECLARED]), (k % len(DECLARED) + 1).cast("int")))
    return R.with_resolved_type(p.select(k.alias("id"), name.alias("name"), said.alias("declared")), R.target_catalogue(s), "name", "declared")


@query("b07_stretch_policy", "i:id s:method d:level", f"""WITH {TARGET_SQL}
SELECT id, CASE WHEN catalog_id = 'M42' OR target_type IN ('galaxy', 'planetary_nebula') THEN 'masked_ghs_standard' WHEN target_type IN ('reflection_nebula', 'dark_nebula') THEN 'arcsinh'
 WHEN target_type = 'emission_nebula' THEN 'emission' ELSE 'pi_mtf' END AS method, CASE WHEN catalog_id = 'M42' OR target_type IN ('galaxy', 'planetary_nebula') THEN 0.035 WHEN target_type = 'emission_nebula' THEN 0.045 ELSE 0.05 END AS level FROM tt""")
def _(s, d):
    return R.with_stretch_policy(R.with_target_type(targets(s, d), R.target_catalogue(s)), s)


GEO_SQL = """geo AS (SELECT *, (frame % 13 - 6) * 0.4::DOUBLE AS rot, 1 + (frame % 7 - 3) * 0.01::DOUBLE AS sc, (frame % 97)::DOUBLE AS tx, (frame % 89)::DOUBLE AS ty, CASE WHEN frame % 50 = 0 THEN 1e-5::DOUBLE ELSE 0 END AS pr FROM frames),
tr AS (SELECT *, tx AS dx, ty AS dy, degrees(atan2(sc * sin(radians(rot)), sc * cos(radians(rot)))) AS rotation_deg, sqrt(sc * sc) AS scale FROM geo)"""


def registered(s, d):
    f = V.frame_catalogue(s, d)
    a = F.radians((F.col("frame") % 13 - 6) * 0.4)
    sc = 1 + (F.col("frame") % 7 - 3) * 0.01
    h = F.array(sc * F.cos(a), -sc * F.sin(a), (F.col("frame") % 97).cast("double"), sc * F.sin(a), sc * F.cos(a), (F.col("frame") % 89).cast("double"),
                F.when(F.col("frame") % 50 == 0, 1e-5).otherwise(0.0), F.lit(0.0), F.lit(1.0))
    return R.with_transform(f.withColumn("h", h))


@query("b11_transform", "i:frame d:dx,dy,rotation_deg,scale b:pure_translation,has_projection", f"""WITH {GEO_SQL}
SELECT frame, dx, dy, rotation_deg, scale, abs(sc * cos(radians(rot)) - 1) < 1e-3 AND abs(sc * sin(radians(rot))) < 1e-4 AS pure_translation, pr > 1e-9 AS has_projection FROM tr""")
def _(s, d):
    return registered(s, d)


SUMMARY_SQL = f"""{GEO_SQL}, md AS (SELECT session, scale AS median_scale FROM (SELECT session, scale, row_number() OVER (PARTITION BY session ORDER BY scale) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM tr) WHERE i = n // 2),
ts AS (SELECT session, max(dx) - min(dx) AS span_x, max(dy) - min(dy) AS span_y, greatest(max(dx) - min(dx), max(dy) - min(dy)) AS span, max(abs(rotation_deg)) AS rotation_max, max(abs(scale - median_scale) / median_scale) AS scale_dev,
 any_value(median_scale) AS median_scale, greatest(max(dx) - min(dx), max(dy) - min(dy)) > 1.2 * 64 AS mosaic, count(*) AS n FROM tr JOIN md USING (session) GROUP BY session)"""


@query("d21_transform_summary", "s:session i:n d:span_x,span_y,span,rotation_max,scale_dev,median_scale b:mosaic", f"WITH {SUMMARY_SQL} SELECT * FROM ts")
def _(s, d):
    return R.transform_summary(registered(s, d), ["session"], 64.0)


@query("b12_chain", "i:frame s:chain,reasons", f"""WITH {SUMMARY_SQL}, z AS ({STRUCT_SQL}), j AS (SELECT frame, {KIND} AS kind, mono_sensor, ts.* FROM z JOIN ts USING (session))
SELECT frame, CASE WHEN kind = 'mono' THEN 'mono' WHEN kind = 'rgb' THEN 'rgb' WHEN mosaic OR rotation_max > 5 OR scale_dev > 0.05 THEN 'drizzle' WHEN mono_sensor THEN 'mono' ELSE 'debayer' END AS chain,
 CASE WHEN kind = 'cfa' THEN concat_ws(',', CASE WHEN mosaic THEN 'mosaic' END, CASE WHEN rotation_max > 5 THEN 'rotation' END, CASE WHEN scale_dev > 0.05 THEN 'scale' END) ELSE '' END AS reasons FROM j""")
def _(s, d):
    t = R.transform_summary(registered(s, d), ["session"], 64.0)
    return R.with_chain(R.with_frame_kind(structure(s, d)).join(t, "session"))


@query("b20_optics", "i:frame d:arcsec_px,airy_px b:undersampled", """WITH z AS (SELECT frame, 2.4::DOUBLE + frame % 5 * 0.35::DOUBLE AS p, 250.0::DOUBLE + frame % 9 * 100 AS f, 50.0::DOUBLE + frame % 4 * 20 AS a FROM frames)
SELECT frame, 206.264806::DOUBLE * p / f AS arcsec_px, 1.22::DOUBLE * 0.55 * (f / a) / p AS airy_px, airy_px < 1 AS undersampled FROM z""")
def _(s, d):
    k = F.col("frame")
    return R.with_optics(V.frames(s, d).withColumn("pixel_um", 2.4 + k % 5 * 0.35).withColumn("focal_mm", 250.0 + k % 9 * 100).withColumn("aperture_mm", 50.0 + k % 4 * 20))


@query("b21_framing", "i:frame s:framing d:framing_ratio", """WITH z AS (SELECT frame, background * 0.7310585786 AS size, 60.0::DOUBLE + frame % 5 * 100 AS w, 40.0::DOUBLE + frame % 7 * 100 AS h FROM frames)
SELECT frame, size / least(w, h) AS framing_ratio, CASE WHEN framing_ratio > 0.85 THEN 'fills_frame' WHEN framing_ratio >= 0.35 THEN 'balanced' WHEN framing_ratio >= 0.10 THEN 'wide_field' ELSE 'tiny' END AS framing FROM z""")
def _(s, d):
    k = F.col("frame")
    return R.with_framing(V.frames(s, d).withColumn("size", F.col("background") * 0.7310585786).withColumn("fov_w", 60.0 + k % 5 * 100).withColumn("fov_h", 40.0 + k % 7 * 100))


@query("b22_star_strength", "i:id d:strength", f"""WITH {TARGET_SQL}, q AS (SELECT id, target_type, (p_size % 11) * 0.05::DOUBLE AS r, (p_size % 3) * 0.008::DOUBLE AS b, CASE WHEN id % 2 = 0 THEN 'Ha' ELSE 'clear' END AS f FROM tt)
SELECT id, least(greatest(CASE WHEN target_type LIKE '%cluster%' THEN 0.90 WHEN target_type LIKE '%galaxy%' THEN 0.65 WHEN target_type LIKE '%nebula%' THEN 0.55 ELSE 0.65 END::DOUBLE
 + CASE WHEN r > 0.25 THEN -0.15::DOUBLE * least(1, (r - 0.25::DOUBLE) / 0.20::DOUBLE) WHEN r < 0.15::DOUBLE THEN 0.10::DOUBLE * least(1, (0.15::DOUBLE - r) / 0.10::DOUBLE) ELSE 0 END
 + CASE WHEN b > 0.01 THEN -0.05::DOUBLE ELSE 0 END + CASE WHEN f = 'Ha' THEN -0.05::DOUBLE ELSE 0.05::DOUBLE END, 0.40::DOUBLE), 0.95::DOUBLE) AS strength FROM q""")
def _(s, d):
    t = R.with_target_type(targets(s, d), R.target_catalogue(s))
    t = t.withColumn("flux_ratio", (F.col("p_size") % 11) * 0.05).withColumn("bright_ratio", (F.col("p_size") % 3) * 0.008)
    return R.with_star_strength(t.withColumn("filter_type", F.when(F.col("id") % 2 == 0, "Ha").otherwise("clear")))


def _pf(col: str, p: float) -> str:
    return f"max({col}) FILTER (WHERE i = least(CAST(floor(n * {p}::DOUBLE) AS BIGINT), n - 1))"


@query("d19_frame_quality", "s:session,metric i:n,n_outlier d:mn,p10,p50,p90,p99,mx,rel_sigma,dispersion", f"""
WITH l AS (SELECT session, frame, 'fwhm' AS metric, fwhm AS value FROM frames UNION ALL SELECT session, frame, 'roundness', roundness FROM frames UNION ALL SELECT session, frame, 'background', background FROM frames),
o AS (SELECT *, row_number() OVER (PARTITION BY session, metric ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY session, metric) AS n FROM l),
q AS (SELECT session, metric, any_value(n) AS n, min(value) AS mn, {_pf('value', .1)} AS p10, {_pf('value', .5)} AS p50, {_pf('value', .9)} AS p90, {_pf('value', .99)} AS p99, max(value) AS mx, stddev_samp(value) AS sd FROM o GROUP BY ALL)
SELECT q.*, sd / nullif(p50, 0) AS rel_sigma, p90 / nullif(p10, 0) AS dispersion, c.n_outlier FROM q JOIN (SELECT l.session, l.metric, count(*) FILTER (WHERE value > 1.5 * p50) AS n_outlier FROM l JOIN q USING (session, metric) GROUP BY ALL) c USING (session, metric)""")
def _(s, d):
    return R.frame_quality(V.frame_catalogue(s, d), ["session"], ["fwhm", "roundness", "background"])


@query("d20_dispersion_gate", "s:session,reason i:n d:p10,p90,ratio b:eligible", f"""
WITH o AS (SELECT session, wfwhm AS v, row_number() OVER (PARTITION BY session ORDER BY wfwhm) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM frames),
q AS (SELECT session, any_value(n) AS n, {_pf('v', .1)} AS p10, {_pf('v', .9)} AS p90 FROM o GROUP BY session)
SELECT *, p90 / p10 AS ratio, CASE WHEN n < 20 THEN 'too_few_frames' WHEN ratio <= 1.4 THEN 'low_dispersion' WHEN n < 30 THEN 'thin' ELSE 'ok' END AS reason, reason IN ('ok', 'thin') AS eligible FROM q""")
def _(s, d):
    return R.dispersion_gate(V.frame_catalogue(s, d), ["session"], "wfwhm")


@query("d22_filter_breakdown", "s:session,filter i:n", """SELECT session, CASE WHEN frame % 10 = 0 THEN NULL ELSE upper(rtrim(concat(lower(filter), ' '))) END AS filter, count(*) AS n FROM frames GROUP BY ALL""")
def _(s, d):
    f = V.frames(s, d).withColumn("filter", F.when(F.col("frame") % 10 != 0, F.concat(F.lower("filter"), F.lit(" "))))
    return R.filter_breakdown(f, ["session"])


BATCH_SQL = """b AS (SELECT session, target % 20 AS batch, frame, CASE WHEN frame % 40 <> 0 THEN filter END AS filter, concat(nstars % 2, '|', frame % 2) AS settings, concat('g', target % 3) AS geometry,
 CASE WHEN frame % 40 <> 0 THEN CASE WHEN filter IN ('O', 'F') AND target % 20 < 3 THEN 'H' ELSE filter END END AS identity FROM frames)"""


@query("d23_preflight", "s:session,code,detail i:batch", f"""WITH {BATCH_SQL},
k AS (SELECT session, batch, filter, count(*) AS n, count(DISTINCT settings) AS ns, min(geometry) AS g0, max(geometry) AS g1, min(identity) AS identity FROM b GROUP BY ALL)
SELECT session, batch, 'mixed_settings' AS code, filter AS detail FROM k WHERE ns > 1 UNION ALL SELECT session, batch, 'bucket_too_small', filter FROM k WHERE n < 2
UNION ALL SELECT session, batch, 'missing_filter', '' FROM k WHERE filter IS NULL UNION ALL SELECT session, batch, 'alias_collision', identity FROM k WHERE identity IS NOT NULL GROUP BY session, batch, identity HAVING count(*) > 1
UNION ALL SELECT session, batch, 'mixed_geometry', '' FROM k GROUP BY session, batch HAVING min(g0) <> max(g1) UNION ALL SELECT session, batch, 'bucket_count', CAST(count(filter) AS VARCHAR) FROM k GROUP BY session, batch HAVING count(filter) NOT BETWEEN 2 AND 8""")
def _(s, d):
    f = V.frames(s, d)
    lab = F.when(F.col("frame") % 40 != 0, F.col("filter"))
    b = f.select("session", (F.col("target") % 20).alias("batch"), "frame", lab.alias("filter"),
                 F.concat((F.col("nstars") % 2).cast("string"), F.lit("|"), (F.col("frame") % 2).cast("string")).alias("settings"),
                 F.concat(F.lit("g"), (F.col("target") % 3).cast("string")).alias("geometry"),
                 F.when(lab.isNotNull(), F.when(lab.isin("O", "F") & (F.col("target") % 20 < 3), "H").otherwise(lab)).alias("identity"))
    return R.preflight(b, ["session", "batch"])


PRE_SQL = """WITH g AS (SELECT session, target % 20 AS batch, min(nstars)::DOUBLE AS min_stars, max(fwhm) / min(fwhm) AS fwhm_spread, max((frame % 11) * 0.06::DOUBLE) AS alignment_px,
 (max(background) - min(background)) / avg(background) AS sky_spread, stddev_pop(roundness) AS structure FROM frames GROUP BY ALL),
l AS (UNPIVOT g ON min_stars, fwhm_spread, alignment_px, sky_spread, structure INTO NAME metric VALUE value),
st AS (SELECT session, batch, metric, value, CASE metric WHEN 'min_stars' THEN CASE WHEN value < 5 THEN 'FAIL' ELSE 'PASS' END WHEN 'fwhm_spread' THEN CASE WHEN value > 3 THEN 'WARN' ELSE 'PASS' END
 WHEN 'alignment_px' THEN CASE WHEN value > 0.5 THEN 'FAIL' WHEN value > 0.15 THEN 'WARN' ELSE 'PASS' END WHEN 'sky_spread' THEN CASE WHEN value > 0.10 THEN 'FAIL' WHEN value > 0.02 THEN 'WARN' ELSE 'PASS' END
 ELSE CASE WHEN value > 0.12 THEN 'FAIL' WHEN value > 0.03 THEN 'WARN' ELSE 'PASS' END END AS status FROM l)"""


def _checked(s, d):
    f = V.frames(s, d).withColumn("batch", F.col("target") % 20).withColumn("alignment", (F.col("frame") % 11) * 0.06)
    return R.precheck(f, ["session", "batch"], s)


@query("d24_precheck", "s:session,metric,status i:batch d:value", f"{PRE_SQL} SELECT * FROM st")
def _(s, d):
    return _checked(s, d)


@query("d24_precheck_verdict", "s:session,verdict,blockers i:batch", f"""{PRE_SQL} SELECT session, batch, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS verdict,
 coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE status = 'FAIL'), '') AS blockers FROM st GROUP BY ALL""")
def _(s, d):
    return R.verdict(_checked(s, d), ["session", "batch"])


@query("g04_order_nulls", "i:frame s:filter", "SELECT frame, CASE WHEN frame % 10 <> 0 THEN filter END AS filter FROM frames")
def _(s, d):
    return R.order_nulls(V.frames(s, d).withColumn("filter", F.when(F.col("frame") % 10 != 0, F.col("filter"))), "filter", "frame")
