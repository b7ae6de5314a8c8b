"""Media columns: signature sniffing over stored bytes.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass; a validator for each
format then confirms structure and lengths. What is confirmed at offset 0 corrects the declared
type; what is confirmed further on is embedded media and can be carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

BLOCK, RATE = 64, 8000


class Found(NamedTuple):
    kind: str
    start: int
    length: int


class Stored:
    """Stored bytes, and what validators find out about them once for all places."""

    def __init__(self, data: bytes):
        self.data = data
        self._blocks: dict[int, int] = {}
        self._next: dict[bytes, tuple[int, int]] = {}
        self._last: dict[bytes, int] = {}

    def next(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on, or -1; a stretch without one is searched once."""
        begin, found = self._next.get(mark, (0, -2))
        if found == -2 or not begin <= at or 0 <= found < at:
            found = self.data.find(mark, at)
            self._next[mark] = at, found
        return found

    def last(self, mark: bytes) -> int:
        if mark not in self._last:
            self._last[mark] = self.data.rfind(mark)
        return self._last[mark]

    def gif_blocks(self, at: int) -> int:
        """The place behind a chain of sub-blocks; chains that meet are walked once."""
        pos, path = at, []
        while pos < len(self.data) and self.data[pos] and pos not in self._blocks:
            path.append(pos)
            pos += 1 + self.data[pos]
        end = self._blocks.get(pos, pos + 1)
        self._blocks.update(dict.fromkeys(path, end))
        return end


def _riff(s: Stored, at: int) -> Found | None:
    """RIFF/WAVE: the chunks must fill the declared length, with one fmt chunk before one data chunk."""
    b = s.data
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end, pos, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, []
    if end > len(b):
        return None
    while pos + 8 <= end:
        name, n = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        pos += 8 + n + n % 2
        seen.append(name)
        if pos > end:
            return None
    return Found("audio/wav", at, end - at) if pos == end and seen[:1] == [b"fmt "] and b"data" in seen else None


def _png(s: Stored, at: int) -> Found | None:
    b, view, pos, first = s.data, memoryview(s.data), at + 8, True
    while pos + 12 <= len(b):
        n, name = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        if pos + 12 + n > len(b) or first != (name == b"IHDR") or zlib.crc32(view[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if name == b"IEND":
            return Found("image/png", at, pos - at)
    return None


def _gif(s: Stored, at: int) -> Found | None:
    b = s.data
    if len(b) < at + 13:
        return None
    pos = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return Found("image/gif", at, pos + 1 - at)
        if b[pos] == 0x21:
            pos = s.gif_blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos = s.gif_blocks(pos + 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 128 else 0))
        else:
            return None
    return None


def _bmp(s: Stored, at: int) -> Found | None:
    b = s.data
    if len(b) < at + 30:
        return None
    size, _, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes = struct.unpack_from("<H", b, at + 26)[0]
    return Found("image/bmp", at, size) if header in (40, 108, 124) and planes == 1 and 14 + header <= offset <= size <= len(b) - at else None


def _jpeg(s: Stored, at: int) -> Found | None:
    b, pos = s.data, at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF and b[pos + 1] not in (0xD9, 0xDA):
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
    if pos + 4 > len(b) or b[pos] != 0xFF or b[pos + 1] != 0xDA:
        return None
    end = s.next(b"\xff\xd9", pos)
    return Found("image/jpeg", at, end + 2 - at) if end >= 0 else None


def _gzip(s: Stored, at: int) -> Found | None:
    b, d, pos = s.data, zlib.decompressobj(31), at
    try:
        while pos < len(b) and not d.eof:
            d.decompress(b[pos : pos + 65536])
            pos += 65536
    except zlib.error:
        return None
    return Found("application/gzip", at, min(pos, len(b)) - len(d.unused_data) - at) if d.eof else None


def _pdf(s: Stored, at: int) -> Found | None:
    end = s.last(b"%%EOF")
    return Found("application/pdf", at, end + 5 - at) if end > at else None


# The formats' magic bytes.
MAGIC: dict[bytes, Callable[[Stored, int], Found | None]] = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"BM": _bmp,
    b"\xff\xd8\xff": _jpeg,
    b"\x1f\x8b\x08": _gzip,
    b"%PDF-": _pdf,
}


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, check in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), check))
    a.make_automaton()
    return a


def sniff(stored: bytes) -> list[Found]:
    """The confirmed media in order of their start; what lies inside another one's bytes is listed too."""
    whole, out = Stored(stored), []
    for last, (n, check) in automaton().iter(stored.decode("latin-1")):
        if hit := check(whole, last - n + 1):
            out.append(hit)
    return sorted(out, key=lambda f: (f.start, -f.length))


def cover(samples: bytes) -> bytes:
    """A PNG of 16 x 16 grey points: how often each byte value occurs, relative to the most frequent one."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    grey = -(-255 * counts // max(1, int(counts.max()))).astype(np.uint8).reshape(16, 16)
    rows = np.hstack([np.zeros((16, 1), np.uint8), grey]).tobytes()  # each line without a filter

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 16, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def wav(samples: bytes, picture: bytes = b"") -> bytes:
    """Mono 8-bit PCM; a picture goes into a chunk of its own behind the samples."""
    if len(samples) + len(picture) > 0xFFFFFFFF - 64:
        raise ValueError("a RIFF file holds less than 4 GiB")
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    body = b"WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)) + chunk(b"data", samples) + (chunk(b"covr", picture) if picture else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(stored: bytes, start: int = 0) -> memoryview:
    view, pos, end = memoryview(stored), start + 12, len(stored)
    while pos + 8 <= end:
        name, n = bytes(view[pos : pos + 4]), struct.unpack_from("<I", view, pos + 4)[0]
        if name == b"data":
            return view[pos + 8 : pos + 8 + n]
        pos += 8 + n + n % 2
    raise ValueError("no data chunk")


def inspect(stored: bytes | None, declared: str | None) -> tuple[str, bool, list[Found]]:
    """The true type, whether the declared one was wrong, and the embedded media."""
    found = sniff(stored or b"")
    kind = next((f.kind for f in found if f.start == 0), "application/octet-stream")
    return kind, declared != kind, [f for f in found if f.start > 0]


INSPECTED = "id long, media_type string, corrected boolean, embedded array<struct<kind:string,start:long,length:long>>, carved array<binary>"


def inspect_media(df: DataFrame, id_col: str, media_col: str, type_col: str | None = None) -> DataFrame:
    """id, media_type, corrected, embedded, carved: one row per input row.

    Null or empty media, and bytes no validator confirms: ``application/octet-stream``, nothing
    embedded. A null declared type counts as wrong. Repeated rows are judged alike; an empty table
    gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind, wrong, inner = inspect(b, t)
                out.append((i, kind, wrong, [f._asdict() for f in inner], [bytes(b[f.start : f.start + f.length]) for f in inner]))
            yield _batch(out, ["id", "media_type", "corrected", "embedded", "carved"], [pa.int64(), pa.string(), pa.bool_(), FOUND, pa.list_(pa.binary())])

    kind = F.col(type_col) if type_col else F.lit(None)
    return df.select(F.col(id_col).cast("long"), F.col(media_col).cast("binary"), kind.cast("string")).mapInArrow(run, INSPECTED)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def features(samples: memoryview) -> str:
    """Mean, spread and entropy of the samples, rounded so that they are the same on every machine."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, at = int(counts.sum()), np.arange(256)
    mean = float((counts * at).sum()) / n
    var = float((counts * at * at).sum()) / n - mean * mean
    p = counts[counts > 0] / n
    return f"n={n};mean={mean:.4f};sd={max(0.0, var) ** 0.5:.4f};bits={abs(float(-(p * np.log2(p)).sum())):.4f}"


# Types that media are declared to have, by the remainder of their CRC-32.
DECLARED = ["audio/wav", "image/png", None]
MEDIA = "doc_id long, n_bytes long, declared_type string, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared_type string, media_type string, corrected boolean, embedded array<struct<kind:string,start:long,length:long>>, carved_sha256 array<string>"
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))


def media_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """MEDIA: each text's payload as samples with a picture of them, under a declared type that is right for some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for lo in range(0, len(ids), 128):  # few media at a time in memory
                rows = []
                for i, text in zip(ids[lo : lo + 128].to_pylist(), texts[lo : lo + 128], strict=True):
                    raw = text.as_py()
                    payload = raw + b"\0" * (BLOCK if not raw else -len(raw) % BLOCK)
                    stored = wav(payload, cover(payload))
                    rows.append((i, len(raw), DECLARED[zlib.crc32(stored) % len(DECLARED)], stored))
                yield _batch(rows, [x.split()[0] for x in MEDIA.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.binary()])

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).mapInArrow(run, MEDIA)


def read_media(media: DataFrame) -> DataFrame:
    """READ: sniffs stored media, corrects their types, carves what is embedded and reads the samples."""
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.bool_(), FOUND, pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for i, n, declared, value in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                stored = value.as_py()
                kind, wrong, inner = inspect(stored, declared)
                if kind != "audio/wav":
                    raise ValueError(f"the media of document {i} is no longer what was stored")
                back = wav_samples(stored)
                carved = [sha(stored[f.start : f.start + f.length]) for f in inner]
                rows.append((i, n, len(back), sha(back), zlib.crc32(back[-BLOCK:]), len(stored), sha(stored), features(back), declared, kind, wrong, [f._asdict() for f in inner], carved))
            yield _batch(rows, names, types)

    return media.select("doc_id", "n_bytes", "declared_type", "media").mapInArrow(run, READ)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """READ of each whole text, stored as 8-bit WAV samples in a table of the shared folder and read back from it.

    The payload is the text's UTF-8 bytes and bytes 0 up to a positive multiple of 64. A null text
    counts as empty (64 bytes 0). Equal texts get equal values; repeated rows stay. An empty table
    gives an empty result. Texts are as long as Spark's strings can be (2 GiB; a RIFF file holds 4).
    Other columns are not read. The table stays for the returned plan, which reads it.
    """
    return read_media(Scratch(docs.sparkSession, "media").save(media_of(docs, id_col, text_col), "stored"))
