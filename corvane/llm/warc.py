"""WARC archives: one gzip member per record, written through Spark's own sink and read back sequentially.

Writing: each partition becomes one archive. Records with equal payloads are found by digest: the
one with the smallest page id is a ``response``, the others are ``revisit`` records that refer to
it. Reading: an archive is taken as a stream; zlib decompresses one member at a time in small
blocks, headers give the content length that frames the record, and both digests are verified.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Payload bytes that an archive is aimed to hold, and bytes that the reader inflates at a time.
ARCHIVE_BYTES, BLOCK = 32 << 20, 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """The WARC record of a page; a revisit keeps the HTTP header, whose length is that of the full payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def page_id(self) -> int | None:
        own = self.headers["warc-record-id"][len("<urn:page:") : -1]
        return int(own) if own else None

    @property
    def refers_to(self) -> int | None:
        to = self.headers.get("warc-refers-to")
        return int(to[len("<urn:page:") : -1]) if to else None

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _fields(head.decode("latin-1").split("\r\n")[1:]), body


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def _members(stream: Iterable[bytes]) -> Iterator[bytearray]:
    """The inflated members of a gzip stream that comes in blocks; zlib gives BLOCK bytes at a time at most."""
    unzip, out, begun = zlib.decompressobj(31), bytearray(), False
    for block in stream:
        while block:
            out += unzip.decompress(block, BLOCK)
            begun = True
            if not unzip.eof:
                block = unzip.unconsumed_tail
                continue
            block = unzip.unused_data
            if out:  # an empty member only pads
                yield out
            unzip, out, begun = zlib.decompressobj(31), bytearray(), False
    while begun and not unzip.eof:  # what zlib still holds
        more = unzip.decompress(b"", BLOCK)
        out += more
        if not more and not unzip.eof:
            raise ValueError("the archive ends inside a member")
    if out:
        yield out


def read_records(stream: Iterable[bytes]) -> Iterator[Record]:
    """The records of an archive, each checked: one member, framed by its content length, with the digest of its block."""
    for data in _members(stream):
        head, _, rest = bytes(data).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        fields = _fields(lines)
        n = int(fields["content-length"])
        if not first.startswith("WARC/") or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise ValueError("a record is not framed by its content length")
        block = rest[:n]
        if fields["warc-block-digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"block digest of {fields['warc-record-id']}")
        yield Record(fields, block)


def read_page(r: Record) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; the payload of a response is verified."""
    http, body = r.http()
    kind, said, n = r.headers["warc-type"], r.headers["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    if kind == "response" and (len(body) != n or digest(body) != said):
        raise ValueError(f"payload of {r.headers['warc-record-id']}")
    return r.page_id, n, said, kind, r.refers_to


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = 0) -> None:
    """Writes the pages' WARC records to gzip archives under path. Null html: an empty payload.

    Payloads of at least least_bytes are deduplicated. The text sink writes a member's bytes as
    they are and then the separator byte 0; since a member ends with its size, whose last byte is 0
    below 16 MiB, that byte is left to the separator (after larger records an empty member's is).
    """
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    keyed = own.withColumn("sha1", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    total, rows = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # partial counts and minima meet, not rows; only groups of copies go on
    heads = keyed.filter(F.col("n") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("head"), F.count("*").alias("copies")).filter("copies > 1").select("sha1", "head")
    # only ids and digests meet the heads; the payloads are shuffled once, by page id
    revisits = keyed.select("page_id", "sha1").join(heads, "sha1").filter("page_id <> head").groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("sha1", "head"))).alias("heads"))
    n = max(1, -(-int(total) // archive_bytes), -(-int(rows) // 200_000))
    # rows without an id are dealt by their content, so that no archive takes all of them
    place = F.coalesce("page_id", F.xxhash64("sha1", "url"))
    dealt = keyed.withColumn("place", place).repartition(n, "place").join(revisits.withColumnRenamed("page_id", "place"), "place", "left")
    referred = dealt.withColumn("refers_to", F.when(F.col("page_id").isNotNull(), F.try_element_at("heads", F.col("sha1"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, payload, sha1, to in zip(*batch.columns, strict=True):
                name = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                data = member(record(page.as_py(), url.as_py(), payload.as_py(), name, to.as_py()))
                out.append(data[:-1] if data[-1] == 0 else data + EMPTY_MEMBER[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = referred.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records of the archives under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for archive in batch.column(0):
                data = memoryview(archive.as_buffer()) if archive.is_valid else memoryview(b"")
                rows = []
                for r in read_records(data[lo : lo + BLOCK] for lo in range(0, len(data), BLOCK)):
                    rows.append(read_page(r))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in PAGE.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PAGE)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads these back (see PAGE).

    Null html: an empty payload. Null urls: no target header. Of copies with the smallest page_id
    more than once, each such row is a response. A null page_id is written as an empty name and read
    back as null; if all of a group's ids are null, all are responses. Empty table: no record.
    Archives aim at 32 MiB of payload; one of over 2 GiB, as a single longer page would need, can't be
    read back by Spark's binary source.
    """
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archives")
    write_archives(pages, path, **options)
    return read_archives(spark, path)
