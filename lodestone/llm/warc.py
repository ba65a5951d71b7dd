"""WARC archives: a sink, and a splittable reader.

Each record is a gzip member of its own. The sink hands whole blocks of members to Spark's text writer as
rows (bytes pass through unchanged), so archives go to any file system that Spark reaches, under Spark's commit
protocol: a lost or repeated task leaves no half-written file. The writer's line separator is an empty gzip
member, which is valid between members and reads as nothing.

The reader lists files with their sizes, cuts them into byte ranges, and deals the ranges to tasks. A task looks
for the gzip magic in its range, and takes a place for the start of a record only if a gzip member can be decoded
there whose content starts with a WARC header. It owns the records that start in its range, and reads on past the
range's end as far as the last one goes. (Text in UTF-8 cannot hold the magic, so not even a payload that was
stored without compression can hide a record.)
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, picked, small_batches, values

#: Payloads of fewer bytes are always stored. Bytes of a block of members, of a range, of one read, and of a task's ranges.
LEAST, BLOCK, RANGE, READ, TASK = 1000, 4 << 20, 8 << 20, 1 << 20, 128 << 20
#: Keys over which rows that can have no copy are spread in the search for copies.
SPREAD = 1 << 16
#: Schemes of file systems that Hadoop and Arrow name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
MAGIC, LEVEL = b"\x1f\x8b\x08", 5
#: An empty gzip member.
GAP = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
DATE = "2024-01-01T00:00:00Z"


def _line(text: str) -> str:
    """A header's value: no line breaks or other control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with a response record, or a revisit record without the payload if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + body + b"\r\n\r\n", LEVEL, mtime=0)


def _member_batches(batches):
    schema = pa.schema([("value", pa.binary())])
    held, size = [], 0
    for b in batches:
        for i, url, payload, digest, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), values(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()):
            held.append(record(i, url, payload, digest, refers))
            size += len(held[-1])
            if size >= BLOCK:
                yield batch(schema, [b"".join(held)])
                held, size = [], 0
    if held:
        yield batch(schema, [b"".join(held)])


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> None:
    """Writes a record for each row into archives in the folder `out`.

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of `least` bytes or more, the one with
    the largest id is a response and the others are revisits of it; smaller payloads are all responses. Rows that
    share the largest id, and rows with a null id, are responses. An empty table gives archives without records. A
    payload of any length is one record, held by one task.
    """
    small_batches(pages.sparkSession)
    rows = picked(pages, id=id_col, url=url_col, payload=payload_col).select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode("payload", "UTF-8"), F.lit(b"")).alias("payload"))
    rows, large = rows.withColumn("digest", F.sha1("payload")), F.octet_length("payload") >= least
    groups = rows.where(large).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    alone = F.concat(F.lit("-"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string"))  # no digest looks like that
    rows = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(alone)).join(groups.withColumnRenamed("digest", "key"), "key", "left")
    rows = rows.withColumn("refers", F.when(large & (F.col("id") < F.col("keeper")), F.col("keeper")))
    members = rows.select("id", "url", "payload", "digest", "refers").mapInArrow(_member_batches, "value binary")
    members.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", GAP.decode("latin-1")).option("compression", "none").text(out)


class Reader:
    """Bytes of a file from a place on, read piece by piece."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.data, self.at = b"", 0

    def get(self, a: int, n: int) -> bytes:
        if not self.at <= a or a + n > self.at + len(self.data):
            self.file.seek(a)
            self.data, self.at = self.file.read(min(max(n, READ), self.size - a)), a
        return self.data[a - self.at : a - self.at + n]

    def member(self, a: int) -> tuple[bytes, int] | None:
        """The content of the gzip member at a, and the place after it; None if there is none that ends well."""
        unzip, out, at = zlib.decompressobj(31), [], a
        try:
            while not unzip.eof:
                piece = self.get(at, min(1 << 16, self.size - at))
                if not piece:
                    return None
                out.append(unzip.decompress(piece))
                at += len(piece)
                if len(out) == 1 and out[0] and not out[0].startswith(b"WARC/"[: len(out[0])]):
                    return None
        except zlib.error:
            return None
        return b"".join(out), at - len(unzip.unused_data)


def records(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the records that start in [start, end)."""
    source, at = Reader(file, size), start
    while at < end:
        piece = source.get(at, min(1 << 16, size - at))
        k = piece.find(MAGIC)
        if k < 0:
            if at + len(piece) >= size:
                return
            at += max(1, len(piece) - len(MAGIC) + 1)
            continue
        at += k
        if at >= end:
            return
        found = source.member(at)
        if found is None:
            at += 1  # these bytes lie inside a member
            continue
        content, after = found
        if content.startswith(b"WARC/"):
            yield at, content
        at = after


def parsed(content: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload."""
    head, _, rest = content.partition(b"\r\n\r\n")

    def fields(block: bytes) -> dict[str, str]:
        lines = (x.split(":", 1) for x in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
        return {k.strip().lower(): v.strip() for k, v in lines}

    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _id(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


_FOUND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])


def opened(path: str):
    """A file at a URI as Spark names it, open for reading at any place."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    system, name = fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)
    return system.open_input_file(name)


def _range_batches(keep_payload: bool):
    def run(batches):
        for b in batches:
            for path, size, start, end in zip(*(b.column(k).to_pylist() for k in range(4))):
                rows, held = [], 0
                with opened(path) as file:
                    for at, content in records(file, size, start, end):
                        warc, http, payload = parsed(content)
                        kind, told = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                            if digest != told:
                                raise ValueError(f"{path} at {at}: the payload's digest is {digest}, the header's {told}")
                        else:
                            digest, n = told, int(http["content-length"])
                        rows.append((_id(warc["warc-record-id"]), warc.get("warc-target-uri"), kind, digest, n, _id(warc.get("warc-refers-to")), payload if keep_payload else None, path, at))
                        held += len(payload) if keep_payload else 0
                        if len(rows) >= 1000 or held > BLOCK:
                            yield batch(_FOUND, *zip(*rows))
                            rows, held = [], 0
                if rows:
                    yield batch(_FOUND, *zip(*rows))

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload, path, offset of each record.

    Ranges are dealt evenly to tasks whatever the sizes of files, TASK bytes to each if there are many. Digests of responses are computed from what was
    read and must equal their headers'. A revisit has an empty payload; its length is that of the original response.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, "length"))
    many = ranges.agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("size")).first()
    ranges = ranges.repartition(max(1, min(many["n"], 4 * spark.sparkContext.defaultParallelism), -(-(many["size"] or 0) // TASK)))
    return ranges.mapInArrow(_range_batches(payloads), "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, path string, offset long")
