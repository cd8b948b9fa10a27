"""Source and sink queries; file contents are derived from the given tables with Spark expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolake import views as V
from astrolake.plans.registry import query
from astrolake.sources import files as FS
from astrolake.sources import headers as HD
from astrolake.sources import logs as LG
from astrolake.sources import sink as SK
from astrolake.sources import tables as TB
from astrolake.streaming.intake import work_folder

SUFFIX = (".fits", ".FIT", ".mp4", ".txt", ".fts", ".png")


@query("a01_list_frames", "i:id s:path,state", """WITH z AS (SELECT l_orderkey * 8 + l_linenumber AS id, ['.fits', '.FIT', '.mp4', '.txt', '.fts', '.png'][l_partkey % 6 + 1] AS sx, l_orderkey, l_partkey FROM lineitem)
SELECT id, concat('/data/', l_orderkey % 50, '/', CASE WHEN l_partkey % 9 = 0 THEN '.' ELSE '' END, 'f', l_partkey, sx) AS path, CASE WHEN sx IN ('.mp4', '.png') THEN 'error' ELSE 'frame' END AS state FROM z WHERE sx <> '.txt' AND l_partkey % 9 <> 0""")
def _(s, d):
    li = V.table(s, d, "lineitem")
    sx = F.element_at(F.array(*[F.lit(x) for x in SUFFIX]), (F.col("l_partkey") % 6 + 1).cast("int"))
    p = F.concat(F.lit("/data/"), (F.col("l_orderkey") % 50).cast("string"), F.lit("/"), F.when(F.col("l_partkey") % 9 == 0, ".").otherwise(""), F.lit("f"), F.col("l_partkey").cast("string"), sx)
    return FS.classify_paths(li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), p.alias("path")))


@query("a02_read_headers", "i:frame,card s:key,raw d:value", """SELECT id AS frame, 1 AS card, 'GAIN' AS key, CAST(k AS VARCHAR) AS raw, k::DOUBLE AS value FROM ev UNION ALL SELECT id, 2, 'OBJECT', concat('it''s M ', target), NULL FROM ev
UNION ALL SELECT id, 0, 'SIMPLE', 'T', NULL FROM ev UNION ALL SELECT id, 4, 'EXPTIME', concat(k, '.5D+01'), (k + 0.5) * 10 FROM ev UNION ALL SELECT id, 5, 'NOTE', concat('long ', kind, ' text'), NULL FROM ev""")
def _(s, d):
    e = V.ev(s, d)
    card = lambda c: F.rpad(c, 80, " ")
    k, t = F.col("k").cast("string"), F.col("target").cast("string")
    text = F.concat(
        card(F.lit("SIMPLE  =                    T / conforms")), card(F.concat(F.lit("GAIN    = "), k, F.lit(" / sensor gain"))), card(F.concat(F.lit("OBJECT  = 'it''s M "), t, F.lit("  ' / name"))),
        card(F.lit("COMMENT no value here")), card(F.concat(F.lit("EXPTIME = "), k, F.lit(".5D+01"))), card(F.concat(F.lit("NOTE    = 'long "), F.col("kind"), F.lit("&'"))), card(F.lit("CONTINUE  ' text'")),
        card(F.lit("END")), card(F.lit("LATER   = 1")))
    return HD.read_headers(e.select(F.col("id").alias("frame"), text.alias("content")))


def seq_lines(s, d):
    """Registration text per target: I rows on even lines, R rows on odd ones."""
    f = V.frames(s, d)
    k = F.col("frame")
    num = lambda c: F.round(c, 6).cast("string")
    r = F.concat_ws(" ", F.lit("R0"), num(F.col("fwhm")), num(F.col("wfwhm")), num(F.col("roundness")), F.lit("1"), F.when(k % 29 == 0, "nan?").otherwise(num(F.col("background"))), F.col("nstars").cast("string"),
                    F.when(k % 31 == 0, "X").otherwise("H"), *[F.lit(v) for v in ("1", "0")], (k % 97).cast("string"), *[F.lit(v) for v in ("0", "1")], F.when(k % 37 == 0, "?").otherwise((k % 89).cast("string")), *[F.lit(v) for v in ("0", "0", "1")])
    i = F.concat_ws(" ", F.lit("I"), k.cast("string"), (k % 2).cast("string"))
    base = f.select((F.col("target") % 100).alias("file"), k.alias("frame"), F.explode(F.array(F.struct((k * 2).alias("line"), i.alias("text")), F.struct((k * 2 + 1).alias("line"), r.alias("text")))).alias("z"))
    return base.select("file", "z.line", "z.text")


@query("a04_read_sequence", "i:file,index d:fwhm,roundness,background,nstars,tx,ty b:included,ok", """SELECT target % 100 AS file, frame AS index, round(fwhm, 6) AS fwhm, round(roundness, 6) AS roundness, CASE WHEN frame % 29 <> 0 THEN round(background, 6) END AS background, nstars, frame % 97 AS tx,
 CASE WHEN frame % 37 <> 0 THEN frame % 89 END AS ty, frame % 2 = 1 AS included, frame % 37 <> 0 AS ok FROM frames WHERE frame % 31 <> 0""")
def _(s, d):
    r = TB.read_sequence(seq_lines(s, d))
    return r.withColumn("tx", F.col("h")[2]).withColumn("ty", F.col("h")[5])


def star_lines(s, d):
    """Star tables per frame: settings, header and one row per measurement; some rows are broken."""
    m = V.meas(s, d)
    k = F.col("star")
    st = lambda c: c.cast("string")
    num = lambda c: F.round(c, 4).cast("string")
    row = F.concat_ws("\t", F.when(k % 41 == 0, "x").otherwise(st(k)), F.col("layer"), F.lit("0.1"), F.lit("2"), F.when(k % 43 == 0, "").otherwise(st(k % 50)), st(k % 40), F.when(k % 47 == 0, "-1").otherwise(num(F.col("fwhmx"))), num(F.col("fwhmy")), F.lit("10"), F.lit("0"),
                      F.when(k % 53 == 0, F.lit("G\textra")).otherwise(F.col("profile")))
    rows = m.select(F.col("frame").alias("file"), (F.col("line") + 10).alias("line"), row.alias("text"))
    heads = m.select("frame").distinct().select(F.col("frame").alias("file"), F.explode(F.array(
        F.struct(F.lit(0).alias("line"), F.lit("# gain=100").alias("text")), F.struct(F.lit(1).alias("line"), F.lit("\t".join(TB.STAR_COLUMNS)).alias("text")))).alias("z")).select("file", "z.line", "z.text")
    return rows.unionByName(heads)


@query("a05_read_stars", "i:file,line d:fwhmx,fwhmy,roundness", """WITH z AS (SELECT frame AS file, line + 10 AS line, CASE WHEN star % 47 = 0 THEN -1 ELSE round(fwhmx, 4) END AS fwhmx, round(fwhmy, 4) AS fwhmy FROM meas)
SELECT *, least(fwhmx, fwhmy) / greatest(fwhmx, fwhmy) AS roundness FROM z WHERE fwhmx > 0.1 AND fwhmx < 50 AND least(fwhmx, fwhmy) / greatest(fwhmx, fwhmy) BETWEEN 0 AND 1""")
def _(s, d):
    return TB.read_stars(star_lines(s, d))


STRICT = """zs AS (SELECT frame AS file, line + 10 AS line, star, layer, star % 50 AS x, star % 40 AS y, CASE WHEN star % 53 = 0 THEN 'column_count' WHEN star % 41 = 0 THEN 'bad_id' WHEN star % 43 = 0 THEN 'bad_position' WHEN star % 47 = 0 THEN 'bad_width' END AS reason FROM meas)"""


@query("a06_read_stars_strict", "i:file,line,star s:layer d:x,y b:duplicate", f"""WITH {STRICT} SELECT *, count(*) OVER (PARTITION BY file, star) > 1 OR count(*) OVER (PARTITION BY file, layer, x, y) > 1 AS duplicate FROM zs WHERE reason IS NULL""")
def _(s, d):
    return TB.read_stars_strict(star_lines(s, d))[0]


@query("a06_quarantine", "i:file,line s:reason", f"WITH {STRICT} SELECT file, line, reason FROM zs WHERE reason IS NOT NULL")
def _(s, d):
    return TB.read_stars_strict(star_lines(s, d))[1]


def log_lines(s, d):
    e = V.ev(s, d)
    st = lambda c: c.cast("string")
    text = F.when(F.col("kind") == "purchase", F.concat(F.lit("Reading image, domain "), st(F.col("k") + 1))).when(
        F.col("kind") == "error", F.concat(F.lit("fit K"), st(F.col("k") % 3), F.lit(": slope "), st(F.col("k") - 2), F.lit(" intercept 0.5 sigma "), st(F.col("k") % 30 / 100), F.lit(" used "), st(F.col("k") % 20), F.lit(" excluded "), st(F.col("k") % 7))).otherwise(
        F.concat(F.when(F.col("k") % 2 == 0, "Red").otherwise("Blue"), F.lit(": mean "), st(F.col("k")), F.lit(".5, median "), st(F.col("k")), F.lit(", sigma "), st(F.col("k") % 5)))
    return e.select("target", F.col("id").alias("line"), text.alias("text"))


@query("a07_read_stat_samples", "i:target,line,sample s:channel d:domain,mean,median,sigma", """WITH z AS (SELECT target, id AS line, kind, k, last_value(CASE WHEN kind = 'purchase' THEN k + 1 END IGNORE NULLS) OVER (PARTITION BY target ORDER BY id ROWS UNBOUNDED PRECEDING) AS domain, CASE WHEN k % 2 = 0 THEN 'Red' ELSE 'Blue' END AS channel FROM ev)
SELECT target, line, channel, row_number() OVER (PARTITION BY target, channel ORDER BY line) AS sample, domain, (k + 0.5) / domain AS mean, k / domain AS median, k % 5 / domain AS sigma FROM z WHERE kind NOT IN ('purchase', 'error')""")
def _(s, d):
    return LG.read_stat_samples(log_lines(s, d), "target")


@query("a08_read_fit_quality", "i:target,fits,used,excluded s:verdict d:sigma,gain_ratio", """WITH z AS (SELECT target, id, k % 3 AS ch, k - 2 AS slope, (k % 30) / 100.0::DOUBLE AS sigma, k % 20 AS used, k % 7 AS excluded FROM ev WHERE kind = 'error'), l AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY target, ch ORDER BY id DESC) = 1)
SELECT target, count(*) AS fits, sum(used) AS used, sum(excluded) AS excluded, max(sigma) AS sigma, CASE WHEN min(slope) > 0 THEN max(slope) / min(slope) END AS gain_ratio, CASE WHEN bool_or(slope <= 0 OR used < 3) THEN 'degenerate' WHEN bool_or(sigma > 0.2 OR excluded > used) THEN 'degraded' ELSE 'acceptable' END AS verdict FROM l GROUP BY target""")
def _(s, d):
    return LG.read_fit_quality(log_lines(s, d), "target")


@query("c17_asof_last", "i:id,target d:marker", "SELECT id, target, last_value(CASE WHEN kind = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY target ORDER BY id ROWS UNBOUNDED PRECEDING) AS marker FROM ev")
def _(s, d):
    e = V.ev(s, d).withColumn("m", F.when(F.col("kind") == "purchase", F.col("value")))
    return LG.asof_last(e, ["target"], "id", "m", "marker")


@query("a14_digest_files", "i:doc_id s:digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(s, d):
    return FS.digest_files(V.docs(s, d), "text")


@query("a14_digest_set", "s:source,digest i:files", """WITH c AS (SELECT source, doc_id // 10000 AS c, count(*) AS n, sha256(string_agg(concat(doc_id, '=', sha256(text)), chr(10) ORDER BY doc_id)) AS d FROM documents GROUP BY ALL) SELECT source, sum(n) AS files, sha256(string_agg(d, chr(10) ORDER BY c)) AS digest FROM c GROUP BY source""")
def _(s, d):
    return FS.digest_set(V.docs(s, d), ["source"], "doc_id", F.col("doc_id").cast("string"), F.sha2("text", 256))


@query("a15_publish", "s:version i:rows", "SELECT concat('v', filter) AS version, count(*) AS rows FROM frames GROUP BY filter")
def _(s, d):
    root = work_folder(s, "publish")
    return SK.publish_each(V.frames(s, d), root, "filter", "v", ["session"])


# labels that no list names, and rows without one
@query("a15_publish_labels", "s:version i:rows", "SELECT concat('day-', CASE WHEN frame % 10 = 0 THEN 'unlabelled' ELSE concat(session, ' ', CAST(extract(year FROM ts) AS VARCHAR)) END) AS version, count(*) AS rows FROM frames GROUP BY ALL")
def _(s, d):
    f = V.frames(s, d).withColumn("day", F.when(F.col("frame") % 10 != 0, F.concat_ws(" ", "session", F.year("ts").cast("string"))))
    return SK.publish_each(f, work_folder(s, "publish"), "day", "day-")


@query("a16_check_containers", "i:frame,expected s:container", """WITH z AS (SELECT frame, 100 + frame % 50 AS n1, 80 + frame % 40 AS n2, CASE WHEN frame % 71 = 0 THEN NULL WHEN frame % 2 = 0 THEN 16 ELSE -32 END AS bp FROM frames), y AS (SELECT *, n1 * n2 * abs(bp) / 8 AS data, 5760 + ceil(n1 * n2 * abs(bp) / 8 / 2880) * 2880 AS e FROM z),
x AS (SELECT *, CASE frame % 5 WHEN 0 THEN 5760 + data WHEN 1 THEN 5760 + data - 10 WHEN 2 THEN e + 2880 ELSE e END AS len FROM y)
SELECT frame, e AS expected, CASE WHEN bp IS NULL THEN 'unreadable' WHEN len < 5760 + data THEN 'truncated' WHEN len < e THEN 'unpadded' WHEN len > e THEN 'trailing' ELSE 'complete' END AS container FROM x""")
def _(s, d):
    k = F.col("frame")
    f = V.frames(s, d).select("frame", (100 + k % 50).alias("naxis1"), (80 + k % 40).alias("naxis2"), F.lit(None).cast("int").alias("naxis3"), F.when(k % 71 != 0, F.when(k % 2 == 0, 16).otherwise(-32)).alias("bitpix"), F.lit(2).alias("header_blocks"))
    data = F.col("naxis1") * F.col("naxis2") * F.abs("bitpix") / 8
    full = 5760 + F.ceil(data / 2880) * 2880
    return FS.check_containers(f.withColumn("length", F.when(k % 5 == 0, 5760 + data).when(k % 5 == 1, 5760 + data - 10).when(k % 5 == 2, full + 2880).otherwise(full)))
