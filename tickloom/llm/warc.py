"""WARC archives with revisit records: duplicates of a payload point to one original response.

Headers alone are shuffled by payload digest to choose the original of each payload; bodies move once, by record, into
the archive they are written to. Archives are written by Spark's text writer: a record is one "line" and the record
separator of the format, CR LF CR LF, is the line separator, so any file system Spark knows will do and a lost task is
written again by Spark's committer. They are read back as a stream of such pieces and cut by Content-Length, so a
payload may hold the separator itself; only one record is in memory at a time.

Defined cases. Null text is an empty payload. Payloads below `min_bytes` are always responses. Among equal payloads the
largest id is the response; rows that tie on it are all responses, a null id counts as smaller than any other, and
if all ids are null all are responses. Null or odd characters of a URL: no URI header, or percent-encoded controls.
Other columns of the input are ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\r\n\r\n"
#: Fixed values of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
#: Copies of one digest are dealt to so many tasks when its rows meet the original.
SALTS = 32

READ_SCHEMA = "record_id string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, uri string, payload binary"


def headers(pages: DataFrame, id_col: str = "page_id", text: str = "html") -> DataFrame:
    """id, size and SHA-1 of every payload; the payload itself stays where it is."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.length(body).cast("long").alias("payload_bytes"),
        F.sha1(body).alias("payload_digest"),
    )


def resolve(heads: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """One row (page_id, refers_to) for every id that is a revisit.

    The aggregate per digest combines before its shuffle. Only digests with copies are joined, and their rows are
    salted, so a payload with a third of all rows is spread over many tasks.
    """
    large = heads.where(F.col("payload_bytes") >= min_bytes)
    originals = (
        large.groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL").drop("n")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(originals, ["payload_digest", "payload_bytes", "salt"])
    return found.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(
        "page_id", "payload_digest", "refers_to"
    ).distinct()


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise(F.lit(""))


def records(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", text: str = "html", min_bytes: int = 1000,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """One column `value`: a whole record, without its final separator, under fresh headers."""
    body = F.coalesce(F.col(text), F.lit(""))
    held = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("uri"), body.alias("body"))
    held = held.withColumn("payload_digest", F.sha1(F.encode("body", "UTF-8")))
    back = resolve(headers(pages, id_col, text), min_bytes).withColumnRenamed("payload_digest", "_digest")
    # null ids tie as the smallest: they are revisits of any numbered copy, joined null-safely
    held = held.join(back, held.page_id.eqNullSafe(back.page_id) & (held.payload_digest == back["_digest"]), "left").drop(back.page_id)
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("body")
    head = F.concat(F.lit(HTTP_HEAD + "\r\nContent-Length: "), size.cast("string"), F.lit(SEPARATOR))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("body")))
    # urn of this record: from what identifies it, so a task that runs again writes the same record
    name = lambda c: F.concat(
        F.lit("<urn:sha1:"), F.sha1(F.concat_ws("|", F.coalesce(c.cast("string"), F.lit("null")), F.col("payload_digest")).cast("binary")), F.lit(">")
    )
    uri = F.regexp_replace(F.regexp_replace("uri", "[\\r\\n]+", "%0A"), "[\\x00-\\x1f]", "%20")
    fields = F.concat(
        F.lit(VERSION), _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", name(F.col("page_id"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, name(F.col("refers_to")))),
        _line("X-Page-Id", F.col("page_id").cast("string")), _line("X-Refers-To-Page", F.col("refers_to").cast("string")),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return held.select(F.concat(fields, F.lit(SEPARATOR), block).alias("value"))


def write_archives(record: DataFrame, path: str) -> None:
    """Gzipped archives below `path`, one per task."""
    record.write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below `path` (READ_SCHEMA); revisits have a null payload and the size of their original."""
    pieces = spark.read.option("lineSep", SEPARATOR).text(path)
    return pieces.mapInArrow(_parse, READ_SCHEMA)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("uri", pa.string()), ("payload", pa.binary()),
    ])
    out: list[tuple] = []
    held = 0
    for record in _records(batches):
        out.append(record)
        held += len(record[-1] or b"")
        if len(out) >= 2000 or held > 4 << 20:
            yield _rows(out, schema)
            out, held = [], 0
    if out:
        yield _rows(out, schema)


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    sep = SEPARATOR.encode()
    head: dict[str, str] | None = None
    block, left, over = [], 0, 0
    for batch in batches:
        for piece in batch.column(0):
            data = piece.as_py().encode()[over:]
            over = 0
            if head is None:
                if not data:  # the rest of a separator at the end of a file
                    continue
                lines = data.decode().split("\r\n")
                if lines[0] != VERSION:
                    raise ValueError(f"not a record: {lines[0][:80]!r}")
                head = dict(x.split(": ", 1) for x in lines[1:])
                block, left = [], int(head["Content-Length"])
                continue
            block.append(data)
            left -= len(data)
            if left >= len(sep):  # the separator was part of the block; a block that ends with it has an empty last piece
                block.append(sep)
                left -= len(sep)
                continue
            if left > 0:  # the block ends with the first bytes of what was taken for the separator
                block.append(sep[:left])
                over, left = left, 0
            if left < 0:
                raise ValueError(f"record {head.get('WARC-Record-ID')} is longer than its Content-Length")
            yield _fields(head, b"".join(block))
            head = None
    if head is not None:
        raise ValueError(f"record {head.get('WARC-Record-ID')} is cut off")


def _fields(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(SEPARATOR.encode())
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    revisit = head["WARC-Type"] == "revisit"
    number = lambda k: int(head[k]) if k in head else None
    return (
        head["WARC-Record-ID"], number("X-Page-Id"), head["WARC-Type"], number("X-Refers-To-Page"),
        head["WARC-Payload-Digest"].removeprefix("sha1:"), size, head.get("WARC-Target-URI"), None if revisit else payload,
    )
