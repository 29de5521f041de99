"""WARC archives: transactions of request, response (or revisit) and metadata records, and their assembly.

Writing: each capture becomes three records that name each other through WARC-Concurrent-To. Of captures with equal
payloads one is the response and the others are revisits without payload. Records go through Spark's text writer (the
record end is its line end), so archives land in whatever store the path names. Reading: archives are parsed by their
Content-Length, and the three records of a capture are joined through the concurrent-to identifiers into one nested row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm.shared import batch_rows, scratch, small_batches, stored

#: Fixed values of the format (WARC 1.1).
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELD_LINE = "\r\n"

#: Tiers of payload bytes (up to, the last without end) and captures of an archive in each. Archives are read whole, so
#: this bounds what a task holds: 128 MB, or a single larger payload.
TIERS = ((128 << 10, 1024), (2 << 20, 64), (None, 1))


def base32_sha1(binary: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, by groups of 20 bits."""
    digits = F.sha1(binary)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, fields: list[tuple[str, Column]], block: Column, mime: str) -> Column:
    lines = [F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields], F.lit(f"Content-Type: {mime}")]
    return F.concat(F.concat_ws(FIELD_LINE, *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block))), F.lit(END), block)


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> str:
    """Writes a transaction for each row of pages under path (a new one in the shared folder by default); returns path.

    Of rows with equal payloads of at least least_bytes bytes, those with the largest id are responses and the others
    revisits of it; all other rows are responses. Null html is an empty payload; a null id is smaller than any other
    and leaves its field out, as does a null url. Repeated rows are captures of their own, of the same type.
    """
    path = path or scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col), r"[\r\n]", "").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows, low = rows.withColumn("size", F.octet_length("payload").cast("long")), -1
    for high, captures_each in TIERS:
        # equal payloads are of one size, so tiers know nothing of each other
        tier = rows.where((F.col("size") > low) & (F.lit(True) if high is None else F.col("size") <= high))
        records = _records(tier, least_bytes, date)
        records.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_each).text(path)
        low = high
    return path


def _records(rows: DataFrame, least_bytes: int, date: str) -> DataFrame:
    """The text of three records for each row of id, url, payload and size."""
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("check", F.xxhash64("payload"))
    firsts = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size", "check").agg(F.max(F.struct("id", "url")).alias("f"))
    known = rows.join(firsts, ["digest", "size", "check"], "left").withColumn("first", F.col("f.id"))
    revisit = F.col("f").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    told = known.withColumn("refers_to", F.when(revisit, F.col("first"))).withColumn("first_url", F.col("f.url")).withColumn("me", F.uuid())

    urn = lambda tail: F.concat(F.lit("<urn:uuid:"), F.col("me"), F.lit(f"{tail}>"))
    number = lambda c: F.col(c).cast("string")
    shared = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), number("size"), F.lit(END))
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1"), F.lit(END))
    about = F.concat_ws("", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}: "), number(c), F.lit(FIELD_LINE))) for k, c in (("page-id", "id"), ("refers-to-page-id", "refers_to"))])
    reply = _record("response", [("WARC-Record-ID", urn("")), *shared, *digest], F.concat(head, F.col("payload")), "application/http; msgtype=response")
    again = _record("revisit", [("WARC-Record-ID", urn("")), *shared, *digest, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To-Target-URI", F.col("first_url")), ("WARC-Refers-To-Date", F.lit(date))], head, "application/http; msgtype=response")
    return told.select(F.explode(F.array(
        _record("request", [("WARC-Record-ID", urn("-q")), ("WARC-Concurrent-To", urn("")), *shared], asked, "application/http; msgtype=request"),
        F.when(F.col("refers_to").isNull(), reply).otherwise(again),
        _record("metadata", [("WARC-Record-ID", urn("-m")), ("WARC-Concurrent-To", urn("")), *shared], about, "application/warc-fields"),
    )).alias("value"))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive, by Content-Length."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at:stop].split(b"\r\n") if stop >= 0 else [b""]
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(fields["content-length"])
        if stop + 8 + size > len(data):
            raise ValueError(f"a record at byte {at} is cut off")
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 8 + size


RECORD = "id string, kind string, concurrent_to string, url string, date string, digest string, refers_to string, payload_bytes long, page_id long, refers_to_page long, payload string"


def _rows(with_payload: bool) -> Callable:
    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind = fields["warc-type"]
        size = page = first = payload = None
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            told = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(told[0]) if told else len(body)
            if kind == "response":
                size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                payload = body.decode(errors="replace") if with_payload else None
        elif kind == "metadata":
            own = {k: v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)}
            page, first = (int(own[k]) if k in own else None for k in ("page-id", "refers-to-page-id"))
        return fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), fields.get("warc-target-uri"), fields.get("warc-date"), digest, fields.get("warc-refers-to-target-uri"), size, page, first, payload

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        for frame in frames:
            for data in frame["content"]:
                rows = []
                for fields, block in parse(data):
                    rows.append(row(fields, block))
                    if len(rows) == 512:
                        yield pd.DataFrame(rows, columns=names).astype({k: "Int64" for k in ("payload_bytes", "page_id", "refers_to_page")})
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({k: "Int64" for k in ("payload_bytes", "page_id", "refers_to_page")})

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives under path. Digest and size of a response are those of the payload that is there;
    a revisit's are those it tells. Archives that are cut off or no WARC raise an error.

    Archives are parsed once, into a table that what follows reads as often as it needs."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    with batch_rows(spark, 1):
        return stored(files.mapInPandas(_rows(with_payload), RECORD), "records")


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: response (or revisit) with the request and metadata records that are concurrent to it.

    Captures without a request or metadata record have null there; records of other types take no part.
    """
    nested = F.struct(*[F.col(x.split(" ")[0]) for x in RECORD.split(", ")])
    side = lambda kind: records.where(F.col("kind") == kind).select(F.col("concurrent_to").alias("capture"), nested.alias(kind))
    replies = records.where(F.col("kind").isin("response", "revisit")).select(F.col("id").alias("capture"), nested.alias("reply"))
    return replies.join(side("request"), "capture", "left").join(side("metadata"), "capture", "left")
