"""WARC archives: writing captures as records, and assembling records into captures again.

A capture is written as three records: the request, the response (or a revisit, where an equal payload is archived
already), and metadata. Request and metadata name the response in WARC-Concurrent-To. Reading parses every record; the
transaction assembly joins them through these names into one nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import shared_dir, stored, table, text_of

#: Payloads of fewer bytes are archived again each time.
LEAST_REVISIT_BYTES = 1000
#: Records of a file at most, so that one file fits into a task.
FILE_RECORDS = 3000
#: Bytes of payloads that a worker gathers before it hands its rows on.
CHUNK_BYTES = 8_000_000
#: Equal payloads are numbered in so many groups.
SALTS = 64
#: Digests that are broadcast at most (about 70 bytes each).
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PRIMARY = ("response", "revisit", "resource")


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """c_id, c_url, c_html, c_bytes, c_digest, c_number (unlike for all rows of a digest), c_role, c_refers, c_refers_number.

    Of equal payloads of ``least`` bytes or more, the one with the largest id is the response. Rows that repeat an id
    and a payload have one response among them.
    """
    html = text_of(html_col)
    rows = pages.select(F.col(id_col).alias("c_id"), F.col(url_col).cast("string").alias("c_url"), html.alias("c_html"))
    rows = rows.withColumns({"c_digest": F.sha1(F.encode("c_html", "UTF-8")), "c_bytes": F.octet_length("c_html").cast("long"), "c_salt": F.pmod(F.xxhash64("c_id", "c_url"), F.lit(SALTS))})
    # only payloads that occur again need a number and a join; the others stay where they are read
    again = rows.groupBy(F.col("c_digest").alias("n_digest")).agg(F.count("*").alias("n_rows"), F.max(F.struct("c_id", "c_salt")).alias("n")).filter("n_rows > 1")
    again = stored(again.drop("n_rows"))
    small = again.count() <= BROADCAST_ROWS  # else both sides are dealt by digest
    rows = rows.join(F.broadcast(again) if small else again, F.col("c_digest") == F.col("n_digest"), "left")
    place = F.row_number().over(Window.partitionBy("c_digest", "c_salt").orderBy(F.desc_nulls_last("c_id"), F.desc_nulls_last("c_url")))
    rows = rows.filter("n_digest is null").withColumn("c_place", F.lit(1)).unionByName(rows.filter("n_digest is not null").withColumn("c_place", place))
    number = lambda salt, at: F.concat_ws("-", "c_digest", salt.cast("string"), at.cast("string"))
    first = F.col("c_id").eqNullSafe(F.col("n.c_id")) & (F.col("c_salt") == F.col("n.c_salt")) & (F.col("c_place") == 1)
    revisit = F.col("n").isNotNull() & (F.col("c_bytes") >= least) & ~first
    return rows.select(
        "c_id", "c_url", "c_html", "c_bytes", "c_digest", number(F.col("c_salt"), F.col("c_place")).alias("c_number"), F.when(revisit, "revisit").otherwise("response").alias("c_role"),
        F.when(revisit, F.col("n.c_id")).alias("c_refers"), F.when(revisit, number(F.col("n.c_salt"), F.lit(1))).alias("c_refers_number"),
    )


def _urn(kind: str, number: str) -> Column:
    md5 = F.md5(F.concat(F.lit(f"{kind}/"), F.col(number)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], body: Column) -> Column:
    """Headers with null values are left out."""
    lines = [F.concat(F.lit("WARC-Type: "), kind), *(F.concat(F.lit(f"{name}: "), value) for name, value in headers), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *lines), F.lit(END), body)


def write_archives(captures: DataFrame, path: str) -> None:
    """Write the rows of ``roles`` as gzipped WARC files of at most FILE_RECORDS records each."""
    url = F.regexp_replace(F.regexp_replace("c_url", "\r", "%0D"), "\n", "%0A")
    main, date, again = _urn("response", "c_number"), F.lit(DATE), F.col("c_role") == "revisit"
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("c_bytes").cast("string"), F.lit(END))
    fields = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("c_id").cast("string")), F.lit(""))
    request = _record(F.lit("request"), [("WARC-Record-ID", _urn("request", "c_number")), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))], F.lit(f"GET / HTTP/1.1{END}"))
    response = _record(
        F.col("c_role"),
        [("WARC-Record-ID", main), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "c_digest")),
         ("WARC-Refers-To", F.when(again, _urn("response", "c_refers_number"))), ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(head, F.when(again, "").otherwise(F.col("c_html"))),
    )
    metadata = _record(F.lit("metadata"), [("WARC-Record-ID", _urn("metadata", "c_number")), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], fields)
    records = captures.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(archive: bytes) -> Iterator[dict]:
    """The records of one archive, plain or gzipped: type, headers by lower-case name, and the bytes of the body.

    A gzipped archive is unpacked as it is read, so that one record is held at a time.
    """
    data = io.BytesIO(archive)
    if archive[:2] == b"\x1f\x8b":
        data = io.BufferedReader(gzip.GzipFile(fileobj=data), 1 << 20)
    while line := data.readline():
        if not line.startswith(b"WARC/"):
            continue  # the two line ends between records
        headers = {}
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield {"type": headers.get("warc-type"), "headers": headers, "body": data.read(int(headers.get("content-length", 0)))}


RECORDS = "record_id string, type string, concurrent_to string, uri string, date string, refers_to string, payload_digest string, payload_bytes long, verified boolean, fields map<string,string>, payload binary"


def read_archives(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """One row per record. A response's payload is hashed and held against its header; without ``payload`` it isn't kept."""

    def table_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RECORDS.split(", ")]).astype({"payload_bytes": "Int64", "verified": "boolean"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows, held = [], 0
                for record in parse(bytes(content)):
                    headers, body, kind = record["headers"], record["body"], record["type"]
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    size, fine, fields, kept = None, None, None, None
                    if kind in ("response", "revisit"):
                        http, _, kept = body.partition(END.encode())
                        size = len(kept)
                        if kind == "revisit":
                            named = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            size, kept = int(named[0]) if named else None, None
                        else:
                            own = hashlib.sha1(kept).hexdigest()
                            digest, fine = own, digest == own
                    elif kind == "metadata":
                        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in body.decode("utf-8").split("\r\n") if x)}
                    else:
                        kept = body
                    rows.append((headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-refers-to"), digest, size, fine, fields, kept if payload else None))
                    held += len(kept or b"") if payload else 0
                    if held >= CHUNK_BYTES:
                        yield table_of(rows)
                        rows, held = [], 0
                yield table_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: response (also revisits and resources), request, metadata (all of them, by record id).

    A record that names another request or metadata record in WARC-Concurrent-To belongs to that record's capture.
    Records that name none, or one that isn't there, make a capture without a response. Of several requests, the one
    with the smallest record id counts. No records, no captures.
    """
    main = records.filter(F.col("type").isin(*PRIMARY))
    side = records.filter(~F.col("type").isin(*PRIMARY))
    hop = side.select(F.col("record_id").alias("h_id"), F.col("concurrent_to").alias("h_to")).dropDuplicates(["h_id"])
    side = side.join(hop, F.col("concurrent_to") == F.col("h_id"), "left").withColumn("capture_id", F.coalesce("h_to", "concurrent_to", "record_id"))
    whole = F.struct(*(c for c in records.columns))
    sides = side.groupBy("capture_id").agg(
        F.min(F.when(F.col("type") == "request", F.struct("record_id", "uri", "date", "payload"))).alias("request"),
        F.array_sort(F.collect_list(F.when(F.col("type") != "request", F.struct("record_id", "uri", "date", F.map_entries("fields").alias("fields"))))).alias("metadata"),
    )
    main = main.select(F.col("record_id").alias("m_id"), whole.alias("response"))
    out = main.join(sides, F.col("m_id") == F.col("capture_id"), "full_outer")
    return out.select(F.coalesce("m_id", "capture_id").alias("capture_id"), "response", "request", F.coalesce("metadata", F.array()).alias("metadata"))


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT_BYTES) -> str:
    """Write all pages to fresh archives in the shared folder; the folder's path.

    Null html is an empty payload; a null url or id is left out of the records. An empty table writes no records.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(roles(pages, id_col, url_col, html_col, least), path)
    return path


def digested(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified of assembled captures.

    A revisit's refers_to is the page of the record that its WARC-Refers-To names; null if that isn't there. verified is
    false for a response whose payload doesn't have the digest that its header states; a revisit carries no payload.
    """
    page = F.get(F.filter(F.get("metadata", F.lit(0))["fields"], lambda e: e["key"] == "page-id"), F.lit(0))["value"].cast("long")
    each = stored(captures.select("capture_id", page.alias("page_id"), *(F.col(f"response.{c}").alias(c) for c in ("payload_bytes", "payload_digest", "type", "refers_to", "verified"))))
    # only the few responses that some revisit names are joined
    named = each.filter("refers_to is not null").select(F.col("refers_to").alias("n_id")).distinct()
    named = each.select(F.col("capture_id").alias("n_id"), F.col("page_id").alias("n_page")).join(named, "n_id")
    again = each.filter("refers_to is not null").join(named, F.col("refers_to") == F.col("n_id"), "left")
    rows = each.filter("refers_to is null").withColumn("n_page", F.lit(None).cast("long")).unionByName(again.drop("n_id"))
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("n_page").alias("refers_to"), F.coalesce("verified", F.lit(True)).alias("verified"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(assemble(stored(read_archives(spark, archive(table(spark, sf_dir, "pages")), payload=False))))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
 m AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN last <> page_id THEN last END AS refers_to, true AS verified FROM p LEFT JOIN m USING (d)"""
