"""WARC archives: write pages as records, read them back through a verified boundary chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from astrolake.llm.shared import id_filter, kept, maybe_in, scratch

#: A record begins with this line; files hold at most so many records.
MAGIC, RECORDS_PER_FILE = "WARC/1.1\r\n", 1_000
_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary payload: its 40 hex digits, five at a time, become four letters."""
    hexed = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per page into WARC files under ``path``.

    The payload is the html in UTF-8 (null: empty).  Of equal payloads of at least ``least_bytes`` the one with the smallest id is a
    response; the others are revisits that refer to it and hold no block.  Digests alone are grouped; payloads move
    only for pages that may be revisits.  Rows with a null id are responses without an id.  Rows that share an id are told apart by
    their payloads, each with its own record; of rows equal in both, all are responses, or all revisits.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    named = kept(rows.select("page_id", F.octet_length("payload").alias("bytes"), F.sha1(F.col("payload").cast("binary")).alias("sha")).where("page_id is not null"), "digests")
    first = named.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = kept(named.join(first, "sha").where("page_id <> refers_to").select("page_id", "sha", "refers_to").distinct(), "revisits")
    # a flag column splits the pages without moving payloads: strangers of the id filter are responses at once
    maybe = maybe_in(rows, F.col("page_id"), id_filter(again, "page_id")).withColumn("sha", F.sha1(F.col("payload").cast("binary"))).join(again, ["page_id", "sha"], "left")
    sure = _never_in(rows, again).withColumn("refers_to", F.lit(None).cast("long"))
    both = sure.select("page_id", "url", "payload", "refers_to").unionByName(maybe.select("page_id", "url", "payload", "refers_to"))
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "")
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), uri,
        F.coalesce(F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest(F.col("payload").cast("binary")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body)
    both.select(record.alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _never_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows that ``maybe_in`` would drop."""
    slot = rows.withColumn("__slot", F.pmod(F.xxhash64("page_id"), F.lit(1 << 23))).withColumn("__word", F.expr("cast(__slot div 64 as int)"))
    marked = slot.join(F.broadcast(id_filter(ids, "page_id")), "__word", "left")
    return marked.where("not coalesce(shiftrightunsigned(__bits, cast(__slot % 64 as int)) & 1 = 1, false)").drop("__slot", "__word", "__bits")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, mid, value): what lies between two magic lines, split by split; every chunk may begin a record or lie inside one."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), "value")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, url, payload_bytes, payload_digest) of every record under ``path``.

    Each task takes the chunks of its split as candidate records: header, declared length, and so the offset at which
    the next record must begin.  Pointer jumping from offset 0 of each file doubles the reached stretch every round;
    a magic line inside a payload is never reached.  A record's payload is checked over all chunks it spans, and a
    payload that disagrees with its declared digest keeps the digest of what was read.
    """
    head = F.substring_index("value", _END, 1)
    field = lambda name: F.regexp_extract("head", rf"(?mi)^{name}: *([^\r\n]*)", 1)
    page = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1)
    whole_number = lambda c: F.when(c.rlike(r"^-?\d{1,18}$"), c).cast("long")
    read = chunks(spark, path).withColumn("head", head).withColumn("skip", F.octet_length("head") + len(_END)).withColumn("length", whole_number(field("Content-Length")))
    parsed = kept(read.select(
        "file", "block", "mid", F.octet_length("value").cast("long").alias("size"), F.col("skip").cast("long").alias("skip"), "length", field("WARC-Type").alias("record_type"),
        whole_number(page("WARC-Record-ID")).alias("page_id"), whole_number(page("WARC-Refers-To")).alias("refers_to"), field("WARC-Target-URI").alias("url"),
        F.regexp_extract(field("WARC-Payload-Digest"), "sha1:([A-Z2-7]{32})", 1).alias("declared"),
        digest(F.expr("substring(cast(value as binary), skip + 1, cast(length as int))")).alias("own_digest")), "chunks")
    # where each chunk begins: sums of sizes within a split, and of the splits before it
    per = parsed.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("all"), F.min("mid").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("file", "block", "first", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept(
        parsed.withColumn("run", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(inside), F.lit(0))).join(per, ["file", "block"])
        .select("*", (F.col("base") + F.col("run") - len(MAGIC)).alias("at"), (F.col("mid") - F.col("first")).alias("seq")).where("at >= 0")
        .withColumn("next", F.when((F.col("skip") <= F.col("size")) & (F.col("length") >= 0), F.col("at") + len(MAGIC) + F.col("skip") + F.col("length") + len(_END))), "placed")
    reached = _reached(placed.where("next is not null").select("file", "at", "next"))
    good = placed.join(reached, ["file", "at"])
    whole = good.where("next = at + size + %d" % len(MAGIC)).select("page_id", "record_type", "refers_to", "url", "length", "declared", F.col("own_digest").alias("digest"))
    return _resolved(whole.unionByName(_spanning(spark, path, placed, good)))


def _reached(jump: DataFrame) -> DataFrame:
    """(file, at) of the candidates that pointer jumping reaches from offset 0."""
    jump = kept(jump, "jump")
    reach = kept(jump.where("at = 0").select("file", "at"), "reach")
    n = reach.count()
    while True:
        ahead = reach.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        reach = kept(reach.unionByName(ahead).distinct(), "reach")
        m = reach.count()
        if m == n:
            return reach
        n = m
        jump = kept(jump.join(jump.select("file", F.col("at").alias("next"), F.col("next").alias("far")), ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jump")


def _spanning(spark: SparkSession, path: str, placed: DataFrame, good: DataFrame) -> DataFrame:
    """Reached records that span several chunks because their payload holds magic lines: read those chunks again and join them."""
    about = ["page_id", "record_type", "refers_to", "url", "length", "declared", "skip"]
    long_ones = kept(good.where("next <> at + size + %d" % len(MAGIC)).select("file", F.col("at").alias("start"), "next", *about), "spanning")
    if long_ones.isEmpty():
        return long_ones.select(*about[:6], F.lit("").alias("digest"))
    key = F.xxhash64("file", "block", "seq").alias("key")
    pieces = kept(placed.select("file", "at", key).join(long_ones.select("file", "start", "next"), "file").where("at >= start and at < next").select("file", "start", "at", "key"), "pieces")
    again = chunks(spark, path)
    first = again.groupBy("file", "block").agg(F.min("mid").alias("first"))
    keyed = again.join(first, ["file", "block"]).withColumn("seq", F.col("mid") - F.col("first")).select(key, "value")
    met = maybe_in(keyed, F.col("key"), id_filter(pieces, "key")).join(pieces, "key")
    parts = met.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("at", F.hex(F.col("value").cast("binary")).alias("hexed")))).alias("parts"))
    joined = parts.join(long_ones, ["file", "start"])
    value = F.substring(F.array_join("parts.hexed", MAGIC.encode().hex().upper()), F.col("skip") * 2 + 1, F.col("length") * 2)
    return joined.select("page_id", "record_type", "refers_to", "url", "length", "declared", digest(F.unhex(value)).alias("digest"))


def _resolved(records: DataFrame) -> DataFrame:
    """Revisits name page and digest of the response they refer to, and take its payload size.

    A page with two payloads has two responses, so both are needed; a revisit whose response is nowhere keeps its declared digest, without a size.
    """
    records = kept(records, "records")
    plain = records.where("record_type <> 'revisit'").drop("declared")
    told = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "url", F.col("declared").alias("digest"))
    wanted = told.select(F.col("refers_to").alias("page_id"), "digest").distinct()
    theirs = plain.join(wanted, ["page_id", "digest"], "left_semi").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("length").alias("length"))
    back = told.join(theirs, ["refers_to", "digest"], "left").select("page_id", "record_type", "refers_to", "url", "length", "digest")
    return plain.select(*back.columns).unionByName(back).select("page_id", "record_type", "refers_to", "url", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"))


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC files in the shared folder and return what reading them back gives, one row per row.

    Null and empty html are empty payloads; rows without an id are responses without one; rows that share an id are told apart by payload (see
    ``write_warc``).  An empty table gives no rows; columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path, least_bytes)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
