"""Content-addressed web archive: payloads once by digest, record headers apart, records rebuilt by joins."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwell.llm.common import new_path, written

#: Payloads of fewer bytes are not worth a revisit record.
LEAST_BYTES = 1000
END = "\r\n"
HTTP = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}"


def record_id(page_id: Column) -> Column:
    """A name-based identifier, so that reruns write the same bytes."""
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, header (exact text of the record and HTTP headers), digest (SHA-256), of each page.

    Of pages with equal payloads of at least `least_bytes`, the one with the largest id is the response and the others
    revisit it. Null bodies are empty payloads, null addresses are written as `about:blank`, a null id loses to every
    other, and line ends inside an address are taken out, as they would break the header.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("about:blank")), "[\\r\\n]", "")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.sha2(body, 256).alias("digest"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("bytes"))
    rows = written(rows, "records")
    # Written first, so that the join reads plain exchanges and a much repeated payload can be split.
    first = written(rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id")), "first")
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    length = F.when(revisit, F.lit(len(HTTP))).otherwise(F.col("bytes") + len(HTTP)).cast("string")
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit("2020-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("first_id"))))).otherwise(""),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, line("X-Refers-To-Page-Id", F.col("first_id").cast("string"))).otherwise(""),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length),
        F.lit(END + HTTP),
    )
    return rows.select("page_id", header.alias("header"), "digest")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Writes `path`/headers, one exact header per page, and `path`/payloads, each distinct payload once.

    The stored payload comes from one row of its digest, picked before the bytes are shuffled, and is refused unless
    its bytes give the digest again.
    """
    spark = pages.sparkSession
    records(pages, id_col, url_col, body_col, least_bytes).write.parquet(f"{path}/headers")
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    # Rows of one digest hold the same bytes, so each task keeps one per digest before the shuffle.
    stored = pages.select(F.sha2(body, 256).alias("digest"), body.alias("payload")).dropDuplicates(["digest"])
    stored.write.parquet(f"{path}/payloads")
    kept = spark.read.parquet(f"{path}/payloads")
    if not kept.where(F.sha2("payload", 256) != F.col("digest")).isEmpty():
        raise ValueError("a stored payload does not match its digest")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header and payload of every record, rebuilt by a join; the payload of a revisit is the one it refers to."""
    headers = spark.read.parquet(f"{path}/headers")
    return headers.join(spark.read.parquet(f"{path}/payloads"), "digest").select("page_id", "header", "payload")


def field(header: Column, name: str) -> Column:
    """Value of a named header field, null where the record has none."""
    found = F.regexp_extract(header, f"\\r\\n{re.escape(name)}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def describe(restored: DataFrame) -> DataFrame:
    """What the rebuilt records say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are taken from the rebuilt bytes; a record whose header disagrees with them fails the job.
    """
    digest, length = F.sha1("payload"), F.octet_length("payload").cast("long")
    right = (field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)) & (field(F.col("header"), "X-Payload-Length").cast("long") == length)
    return restored.select(
        field(F.col("header"), "X-Page-Id").cast("long").alias("page_id"),
        length.alias("payload_bytes"),
        F.when(right, digest).otherwise(F.raise_error(F.lit("a record does not match its header"))).alias("payload_digest"),
        field(F.col("header"), "WARC-Type").alias("record_type"),
        field(F.col("header"), "X-Refers-To-Page-Id").cast("long").alias("refers_to"),
    )


def archived_pages(pages: DataFrame, **columns) -> DataFrame:
    """Archives the pages in the shared folder, reads the archive back and describes its records.

    One row per page, repeated rows included; an empty table gives no rows. Other columns are ignored.
    """
    path = new_path(pages.sparkSession, "archive")
    write_archive(pages, path, **columns)
    return describe(read_archive(pages.sparkSession, path))


def export_warc(spark: SparkSession, path: str, out: str, records_per_file: int = 20_000) -> None:
    """Writes an archive as plain WARC files: every record ends in two line ends, which serve as the row separator."""
    r = read_archive(spark, path)
    revisit = field(F.col("header"), "WARC-Type") == "revisit"
    text = F.concat("header", F.when(revisit, "").otherwise(F.col("payload").cast("string")))
    r.select(text).write.option("lineSep", END * 2).option("maxRecordsPerFile", records_per_file).text(out)


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """header and payload of each record of the files, in the exact bytes they hold; payloads of revisits are empty."""

    def split(batches):
        for batch in batches:
            rows = []
            for data in batch["content"]:
                at = 0
                while at < len(data):
                    top = data.index(b"\r\n\r\n", at) + 4
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", data[at:top])[1])
                    http = data.index(b"\r\n\r\n", top) + 4
                    rows.append((data[at:http].decode(), data[http : top + size]))
                    at = top + size + 4
            yield pd.DataFrame(rows, columns=["header", "payload"])

    files = spark.read.format("binaryFile").load(out).select("content")
    return files.mapInPandas(split, "header string, payload binary")
