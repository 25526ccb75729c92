"""WARC archives: a writer that deduplicates payloads, and a splittable reader.

Writing: payload digests are grouped without the payloads; of equal payloads of at least ``min_revisit`` bytes the one
with the smallest page id is a response and the others are revisits that refer to it (identical-payload-digest profile).
Every task writes one archive with a gzip member per record. Archives carry a fresh suffix for each attempt and only those
that the manifest names count, so lost executors, retries and speculative tasks are harmless.

Reading: archives are cut into byte ranges, a task for each group of ranges. A task looks for gzip magic from the start
of its range, accepts a candidate only if the member there decodes to a WARC header, and owns the records that start
inside its range; the last of them it reads to its end, past the range. Members have to follow each other without a gap: a
damaged or cut-off record fails the read instead of vanishing (strict=False passes over it).

Defined cases: a null html is an empty payload; a row without page id is a response without an id; rows of one smallest
id and payload are all responses; repeated rows are records each; a very long payload is one record, held whole by one task
when it is written and when it is read (2 GB at most, Spark's bound for a value); a null url leaves out the target URI; an empty table gives no archive and no rows;
other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.llm._common import materialize, partitions

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES, READ_BYTES = 8 << 20, 1 << 18
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_revisit: int = 100) -> DataFrame:
    """page_id, digest and refers_to of the pages that repeat the payload of a page with a smaller id."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = materialize(pages.select(F.col(id_col).alias("page_id"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("bytes")), "payloads").where(F.col("bytes") >= min_revisit)
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most")).where("most > refers_to").drop("most")
    return rows.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def _record(kind: str, page_id: int | None, url: str | None, date: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 100, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page to archives in out_dir and return the manifest: path and bytes of each archive."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.join(revisits(pages, id_col, html_col, min_revisit), ["page_id", "digest"], "left")
    rows = rows.select("page_id", "url", "digest", "refers_to", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        name, out, size = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for page_id, url, digest, refers_to, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (str(uuid.uuid4()).encode(), date.encode())
                    size += out.write(_gzip(info))
                kind = "response" if refers_to is None else "revisit"
                size += out.write(_gzip(_record(kind, page_id, url, date, digest, data, refers_to)))
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([size], pa.int64())], names=["name", "bytes"])

    written = rows.mapInArrow(write, "name string, bytes bigint")
    written.write.parquet(f"{out_dir}/manifest")
    return read_manifest(spark, out_dir)


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema("name string, bytes bigint").parquet(f"{out_dir}/manifest")


class _Window:
    """A file seen through a buffer that moves forward."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.start, self.data = file, start, b""
        file.seek(start)

    def more(self) -> bool:
        new = self.file.read(READ_BYTES)
        self.data += new
        return bool(new)

    def drop(self, n: int) -> None:
        self.data, self.start = self.data[n:], self.start + n


def _member(window: _Window) -> bytes | None:
    """The content of the gzip member at the window's start, which moves past it; None, and no move, if there is no WARC record."""
    z, out, fed = zlib.decompressobj(31), [], 0
    seen = b""
    try:
        while not z.eof:
            if fed == len(window.data) and not window.more():
                return None
            piece = z.decompress(window.data[fed : fed + READ_BYTES])
            fed = min(fed + READ_BYTES, len(window.data))
            out.append(piece)
            if len(seen) < 5:
                seen += piece[:5]
                if not b"WARC/".startswith(seen[:5]):
                    return None
    except zlib.error:
        return None
    if seen[:5] != b"WARC/":
        return None
    window.drop(fed - len(z.unused_data))
    return b"".join(out)


def records(file: pa.NativeFile, start: int, stop: int, strict: bool = True) -> Iterator[bytes]:
    """The records whose gzip member starts in [start, stop).

    Members follow each other without a gap, so once one is found the next begins where it ends. With strict, anything else there is an
    error, up to the first member behind the range: a record that does not decode is met by its own range or by the one before.
    """
    window, chained = _Window(file, start), start == 0
    while window.start < stop:
        at = window.data.find(MAGIC)
        if chained and strict and at != 0:
            if len(window.data) < len(MAGIC) and window.more():
                continue
            if not window.data:
                return
            raise ValueError(f"no record at byte {window.start}")
        if at < 0:
            window.drop(max(0, len(window.data) - 2))
            if not window.more():
                return
            continue
        window.drop(at)
        if window.start >= stop:
            return
        content = _member(window)
        if content is not None:
            chained = True
            yield content
        elif chained and strict:
            raise ValueError(f"damaged record at byte {window.start}")
        else:
            window.drop(1)
    if chained and strict and (window.data or window.more()) and _member(window) is None:
        raise ValueError(f"damaged record at byte {window.start}")


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.M)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v for k, v in _FIELD.findall(head)}


def _parsed(record: bytes) -> tuple | None:
    """A row of RECORD, or None for records other than responses and revisits."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = _fields(head)
    kind = warc.get(b"warc-type", b"").decode()
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = rest[: int(warc[b"content-length"])].partition(b"\r\n\r\n")
    number = lambda x: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", x or b"")) else None
    size = int(_fields(http)[b"content-length"])
    if kind == "response" and size != len(payload):
        raise ValueError(f"payload of {len(payload)} bytes where {size} are announced")
    url = warc.get(b"warc-target-uri")
    digest = warc[b"warc-payload-digest"].decode().removeprefix("sha256:")
    return number(warc[b"warc-record-id"]), url and url.decode(), kind, number(warc.get(b"warc-refers-to")), size, digest, payload if kind == "response" else None


def read_warc(spark: SparkSession, out_dir: str, split_bytes: int = SPLIT_BYTES, batch_bytes: int = 16 << 20, strict: bool = True) -> DataFrame:
    """The response and revisit records of the archives that the manifest names; payload is null for revisits. Damage is an error, or with strict=False left out."""
    ranges = read_manifest(spark, out_dir).withColumn("start", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)"))).select("name", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        rows: list[tuple] = []
        held = 0
        for r in (r for b in batches for r in b.to_pylist()):
            with fs.open_input_file(f"{root}/{r['name']}") as file:
                for content in records(file, r["start"], r["stop"], strict):
                    if row := _parsed(content):
                        rows.append(row)
                        held += len(content)
                        if held > batch_bytes:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return ranges.repartition(partitions(spark), "name", "start").mapInArrow(read, RECORD)
