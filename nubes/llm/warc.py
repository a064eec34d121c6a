"""Legacy web archives: ARC records parsed by their version's header line and
declared lengths, converted to WARC 1.1 records with synthesised identifiers,
timestamps, types and digests, written and read back.

A version block names the fields of the header lines that follow: version 1
has five, version 2 ten. Payload length always comes from the declared length,
so a payload may hold anything, separators included.

Defined cases: null html or url is empty; equal payloads of at least
MIN_REVISIT bytes are kept once, under the smallest id, and the others become
revisits; a row with a null id is a response and no revisit refers to it;
repeated rows (one id, one payload) give repeated records of one type, and rows
with one id and several payloads are told apart by payload; very long pages get
files of their own; other columns are ignored; an empty table gives no record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialise

MIN_REVISIT = 100
FILE_BYTES = 1 << 26
EPOCH = "20240101000000"
#: The field lines of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


# ----------------------------------------------------------------- reading ARC


def version_block(version: int, name: str = "pages.arc", date: str = EPOCH) -> bytes:
    body = f"{version} 0 nubes\n{FIELDS[version]}\n".encode()
    tail = f"text/plain 200 - - 0 {name} {len(body)}" if version == 2 else f"text/plain {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {date} {tail}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, date: str = EPOCH, ip: str = "0.0.0.0", mime: str = "text/html") -> bytes:
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    rest = f"200 - - 0 pages.arc {len(payload)}" if version == 2 else str(len(payload))
    return f"{url} {ip} {date} {mime} {rest}\n".encode() + payload + b"\n"


def parse_arc(data: bytes):
    """Dicts of field values and ``payload`` for each record after the version
    block. Raises ValueError on a bad header or a length beyond the data."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("ARC header line without end")
        if end == at:  # the blank line that ends each record
            at += 1
            continue
        line = data[at:end].decode("utf-8", "replace")
        at, parts = end + 1, line.split(" ")
        length = int(parts[-1])
        body = data[at : at + length]
        if length < 0 or len(body) < length:
            raise ValueError("ARC record shorter than declared")
        at += length
        if line.startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = FIELDS[version].split(" ")
        else:
            if fields is None or len(parts) != len(fields):
                raise ValueError("ARC header line does not fit its version")
            yield dict(zip(fields, parts, strict=True)) | {"payload": body}


PARSED = "page_id long, url string, ip string, date string, mime string, status int, payload binary, payload_bytes long, payload_digest string"


def read_arc(df: DataFrame) -> DataFrame:
    """Parse ``page_id, arc`` rows (each a whole ARC blob) to a row a record."""

    def run(batches):
        for b in batches:
            rows = []
            for k, blob in zip(b.column(0), b.column(1), strict=True):
                for r in parse_arc(blob.as_py() or b""):
                    p = r["payload"]
                    rows.append((k.as_py(), r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], int(r.get("Result-code", 200)), p, len(p), hashlib.sha256(p).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PARSED.split(", ")])

    return map_texts(df.select("page_id", "arc"), run, PARSED)


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """``page_id, arc``: each page as an ARC blob, odd ids as version 1 and the
    others as version 2."""

    def run(batches):
        for b in batches:
            out = []
            for k, u, h in zip(b.column(0), b.column(1), b.column(2), strict=True):
                v = 1 if (k.as_py() or 0) % 2 else 2
                out.append(version_block(v) + arc_record(v, u.as_py() or "", (h.as_py() or "").encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["page_id", "arc"])

    return map_texts(pages.select("page_id", "url", "html"), run, "page_id long, arc binary")


# ----------------------------------------------------------------- writing WARC


def payload_index(parsed: DataFrame) -> DataFrame:
    """``page_id, payload_digest, payload_bytes`` as a written table: all that
    is compared, without the payloads."""
    return materialise(parsed.select("page_id", "payload_digest", "payload_bytes"))


def mark_revisits(parsed: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Add ``refers_to``: null for a response, else the id of the response with
    the same payload. Only the index is grouped; copies are pre-aggregated, and
    the join back on the digest can be split when skewed. The payloads then
    move once, by id and digest."""
    narrow = (payload_index(parsed) if index is None else index).where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "payload_digest")
    first = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    revisits = narrow.join(first, "payload_digest").where("page_id > first_id").select("page_id", "payload_digest", F.col("first_id").alias("refers_to")).distinct()
    return parsed.join(revisits, ["page_id", "payload_digest"], "left")


def _uuid(h):
    """A version-8 UUID made of the first 32 digits of a hex digest."""
    s = lambda i, n: F.substring(h, i, n)
    return F.concat(F.lit("<urn:uuid:"), s(1, 8), F.lit("-"), s(9, 4), F.lit("-8"), s(14, 3), F.lit("-a"), s(18, 3), F.lit("-"), s(21, 12), F.lit(">"))


def warc_records(marked: DataFrame) -> DataFrame:
    """``value``: the text of each WARC record without the two line ends that
    close it. Identifiers follow from digest and id, so a rerun of a task
    writes the same record."""
    nl = "\r\n"
    d = F.col("date")
    part = lambda i, n: F.substring(d, i, n)
    stamp = F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2), F.lit("Z"))
    ident = lambda page: _uuid(F.sha2(F.concat_ws("/", F.col("payload_digest"), page.cast("string")), 256))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 "), F.col("status"), F.lit(f" OK{nl}Content-Type: "), F.col("mime"), F.lit(f"{nl}Content-Length: "), F.col("payload_bytes"), F.lit(nl + nl))
    body = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))
    refers = F.when(
        again,
        F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + nl),
            F.lit("WARC-Refers-To: "), ident(F.col("refers_to")), F.lit(f"{nl}X-Refers-To-Page: "), F.col("refers_to"), F.lit(nl),
        ),
    ).otherwise(F.lit(""))
    page = F.coalesce(F.concat(F.lit("X-Page: "), F.col("page_id"), F.lit(nl)), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{nl}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{nl}WARC-Record-ID: "), ident(F.coalesce(F.col("page_id"), F.lit(-1))), F.lit(f"{nl}WARC-Date: "), stamp,
        F.lit(f"{nl}WARC-Target-URI: "), F.col("url"), F.lit(f"{nl}WARC-IP-Address: "), F.col("ip"),
        F.lit(f"{nl}WARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit(nl), page, refers,
        F.lit(f"Content-Type: application/http;msgtype=response{nl}Content-Length: "), length, F.lit(nl + nl),
    )
    return marked.select(F.concat(head, http, body).alias("value"))


def write_warc(marked: DataFrame, path: str, index: DataFrame, file_bytes: int = FILE_BYTES) -> None:
    """Files of about ``file_bytes`` through Spark's text writer, whose line
    separator is the record separator: as many records a file as fit on
    average. Payloads of more than a sixteenth of that get files of their own."""
    long = F.col("payload_bytes") > file_bytes // 16
    n, size, n_long = index.agg(F.count_if(~long), F.coalesce(F.sum(F.when(~long, F.col("payload_bytes"))), F.lit(0)), F.count_if(long)).first()
    many = max(1, file_bytes * max(n, 1) // (size + 1000 * max(n, 1)))

    def write(rows: DataFrame, a_file: int) -> None:
        warc_records(rows).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", a_file).option("compression", "gzip").text(path)

    write(marked.where(~long) if n_long else marked, many)
    if n_long:
        write(marked.where(long), 1)


# ----------------------------------------------------------------- reading WARC


def parse_warc(stream):
    """(headers, block) of each record of a binary stream, by declared lengths."""
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError("bad WARC header")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8").rstrip("\r\n").partition(": ")
            head[k.lower()] = v
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) < length or stream.read(4) != b"\r\n\r\n":
            raise ValueError("WARC record shorter than declared")
        yield head, block


BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Read archives back. A response's length and digest come from its stored
    payload (and must equal the declared digest); a revisit's from its headers."""

    names = [x.split()[0] for x in BACK.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                data, rows = io.BytesIO(content.as_py()), []
                for head, block in parse_warc(gzip.GzipFile(fileobj=data) if data.getbuffer()[:2] == b"\x1f\x8b" else data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "revisit":
                        n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    else:
                        n = len(payload)
                        if digest != hashlib.sha256(payload).hexdigest():
                            raise ValueError("payload differs from its digest")
                    num = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
                    rows.append((num("x-page"), n, digest, kind, num("x-refers-to-page"), head["warc-record-id"], head["warc-target-uri"]))
                    if len(rows) >= 5000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    return map_texts(files.select("content"), run, BACK)
