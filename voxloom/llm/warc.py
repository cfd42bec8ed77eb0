"""Content-addressed WARC archive.

An archive is two tables below one folder: ``payloads`` (digest, payload), each distinct payload once under its
SHA-256, and ``headers`` (digest, header), the exact header bytes of every record.  Records are put together again by a
join on the digest.  A payload is verified twice: when it is stored, all payloads of one digest must agree in length
and in a second, independent hash; when it is read, its SHA-256 is computed from the stored bytes.

Digests are counted without their payloads; only payloads that occur more than once are dealt by digest, the others are
written where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, if_small, is_small, remove_folder, shared_folder

#: Payloads shorter than this are never revisited.
MIN_REVISIT_BYTES = 100
#: WARC needs a date; the pages carry none, and a fixed one keeps archives reproducible.
DATE = "1970-01-01T00:00:00Z"


def _header(field: str, value: Column) -> Column:
    """One header line, null (so left out) for a null value; line breaks in a value are percent-encoded."""
    value = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{field}: "), value)


def _record_id(page: str) -> Column:
    """The record's id: that of its page, with ``%``, ``>`` and line breaks percent-encoded; ``none`` has an empty one."""
    value = F.col(page).cast("string")
    for sign, code in (("%", "%25"), (">", "%3E"), ("\r", "%0D"), ("\n", "%0A")):
        value = F.replace(value, F.lit(sign), F.lit(code))
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.concat(F.lit("="), value), F.lit("")), F.lit(">"))


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES
) -> None:
    """Write one record per row of ``pages`` below ``path``.

    Of records with equal payloads of ``min_revisit`` bytes or more, the one of the smallest id is the response and the
    others are revisits that refer to it.  A null payload is empty, a null url has no WARC-Target-URI.  Rows that share
    the smallest id are responses all; a null id is never the smallest, unless all ids of the payload are null, when
    all its records are responses.  Rows that repeat an id have records of one WARC-Record-ID, so ids should be distinct.
    Other columns are not read.  An empty table gives an archive without records.
    """
    rows = pages.select(
        F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    other, size = F.xxhash64("payload"), F.octet_length("payload")
    keys = rows.groupBy("digest").agg(
        F.min("page").alias("first"), F.count(F.lit(1)).alias("n"), F.min(other).alias("low"), F.max(other).alias("high"), F.min(size).alias("short"), F.max(size).alias("long")
    )
    same = (F.col("low") == F.col("high")) & (F.col("short") == F.col("long"))
    keys = cut(keys.select(F.when(same, F.col("digest")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("digest"), "first", "n"))
    repeated = keys.where("n > 1").select("digest")
    once = lambda r: r.groupBy("digest").agg(F.first("payload").alias("payload"))
    if is_small(repeated, 128):
        repeated = F.broadcast(repeated)
        stored = rows.select("digest", "payload").join(repeated, "digest", "left_anti").unionByName(once(rows.join(repeated, "digest", "left_semi")))
    else:
        stored = once(rows)
    # zstd: the payloads are the bulk of an archive and are written once, read many times
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")

    records = rows.select("page", "url", "digest", F.octet_length("payload").alias("length")).join(if_small(keys.select("digest", "first"), 128), "digest")
    revisit = (F.col("length") >= min_revisit) & F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _record_id("page")),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, _record_id("first"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("length").cast("string"))),
    )
    records.select("digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Rows (digest, payload) of an archive; a payload whose bytes don't have its digest stops the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    return stored.select(F.when(good, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("digest"), "payload")


def read_headers(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Rows (header, page_id, url, record_type, digest, refers_to), parsed from the header bytes; ids are of ``id_type``."""
    text = F.decode("header", "UTF-8")

    def field(name: str, value: str) -> Column:
        return F.nullif(F.regexp_extract(text, f"\r\n{name}: {value}", 1), F.lit(""))

    def page(name: str) -> Column:
        value = F.regexp_extract(text, f"\r\n{name}: <urn:x-page:=([^>\r\n]*)>", 1)
        for sign, code in (("\n", "%0A"), ("\r", "%0D"), (">", "%3E"), ("%", "%25")):
            value = F.replace(value, F.lit(code), F.lit(sign))
        return F.when(text.rlike(f"\r\n{name}: <urn:x-page:="), value).cast(id_type)

    return spark.read.parquet(f"{path}/headers").select(
        "header",
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI", "([^\r\n]*)").alias("url"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]+)").alias("digest"),
        page("WARC-Refers-To").alias("refers_to"),
    )


def _rebuilt(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return read_headers(spark, path, id_type).join(read_payloads(spark, path), "digest").withColumn("record", F.concat("header", end, block, end))


def records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Rows (page_id, record): the complete bytes of every record; a revisit has no block of its own."""
    return _rebuilt(spark, path, id_type).select("page_id", "record")


def read_archive(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of every record that is stored.

    Each record is put together; length and digest are those of the block in it, for a revisit of the stored payload
    that its digest leads to.
    """
    in_record = F.expr("substring(record, octet_length(header) + 5, octet_length(record) - octet_length(header) - 8)")
    rows = _rebuilt(spark, path, id_type).withColumn("whole", F.when(F.col("record_type") == "response", in_record).otherwise(F.col("payload")))
    return rows.select("page_id", F.octet_length("whole").cast("long").alias("payload_bytes"), F.sha2("whole", 256).alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder, put all records together again, and remove the archive."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archive(pages, path, id_col, **options)
    out = cut(read_archive(spark, path, pages.schema[id_col].dataType.simpleString()))
    remove_folder(spark, path)
    return out
