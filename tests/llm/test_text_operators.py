import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from corvane.llm import bpe, media, packing, warc

MULTI, JSON, RANKS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'s", "'S", "1", "é", "ß", "\u00a0", "\u3000", "字", "😀", "\x1c", "!", "...", "the", "²", "\r\n", "\u0301", " 's", "ll", "<|endoftext|>", "\0"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    return [*made, None, "", " ", "a" * 20_000, " " * 5000, "ab" * 5000, "x" * 3000 + "y z" * 900, "same", "same", "".join(rng.choice("etaoin") for _ in range(6000))]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids_sha256 string")


def test_bpe_is_tiktoken(spark, texts):
    ranks = bpe.read_ranks(MULTI)
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.digest_texts(frame(spark, texts), MULTI, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), repr(t)[:80]
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_texts(frame(spark, ["the cat"]), MULTI, P.PATTERN).first().decoded == b"the cat"
    assert bpe.digest_texts(frame(spark, []), MULTI, P.PATTERN).count() == 0


def test_memo_generations_keep_results(texts):
    e = bpe.Encoder(MULTI, P.PATTERN)
    whole = e.encode([t or "" for t in texts])
    e.pieces.most = e.stretches.memo.most = 3
    assert [e.encode([t or ""])[0] for t in texts] == whole


def packed(spark, texts, capacity=packing.CAPACITY):
    return packing.pack_documents(frame(spark, texts), JSON, RANKS, P.PATTERN, capacity=capacity).collect()


@pytest.mark.parametrize("capacity", [1024, 7])
def test_packing(spark, texts, capacity):
    library = Tokenizer.from_file(JSON)
    got = packed(spark, texts, capacity)
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:]) and 0 < own[0].length <= capacity
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.02 * -(-total // capacity) + 1
    assert packed(spark, []) == []


def test_ranks_give_the_tokenizer_files_ids():
    """For every code point that text can hold, alone and between letters, and for long runs."""
    by_ranks, by_library = packing._encoders(JSON, RANKS, P.PATTERN)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 20_000):
        text = "".join(f"a{chr(c)} {chr(c)}" for c in points[lo : lo + 20_000 : 7 if lo > 80_000 else 1])
        assert by_ranks(text) == by_library(text), hex(points[lo])
    for text in (" " * 100_000, "中" * 50_000, "ab" * 50_000, "\n \n" * 20_000):
        assert by_ranks(text) == by_library(text)


def test_memo_is_bounded_by_bytes():
    memo = bpe.Memo(10_000, "test")
    for k in range(400):
        key = f"{k}" * 3
        got = memo.fill({key, "x" * 5000 + key}, lambda keys: [x.encode() for x in keys])
        assert got[key] == key.encode() and got["x" * 5000 + key]
    assert len(memo.young) + len(memo.old) < 120 and sum(len(k) > bpe.Memo.LONGEST for k in [*memo.young, *memo.old]) <= 2


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for capacity in (10, 64):
        sizes = sorted((rng.randint(1, capacity) for _ in range(500)), reverse=True)
        gaps = []
        for s in sizes:  # brute force, one piece after the other
            fit = min((g for g in gaps if g >= s), default=None)
            gaps.remove(fit) if fit is not None else None
            gaps.append((capacity if fit is None else fit) - s)
        counts = {s: sizes.count(s) for s in sizes}
        places = packing.plan(counts, capacity)
        assert sum(p[2] for p in places) == 500
        assert len({s for p in places for s in range(p[3], p[3] + p[2])}) == len(gaps)


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (5, None, "<p>x</p>"), (3, "u\r\nX: y", "é" * 100_000), (2, "v", None), (4, "w", ""), (9, "z", "\r\n\r\nWARC/1.1"), (5, None, "<p>x</p>"), (None, "n", "<p>x</p>")]
    got = warc.archive_pages(spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, head string")).collect()
    heads = {}
    for i, _, h in pages:
        if i is not None:
            heads[h or ""] = min(i, heads.get(h or "", i))
    want = sorted((repr(i), len((h or "").encode()), warc.digest((h or "").encode()), "response" if i in (None, heads[h or ""]) else "revisit", None if i in (None, heads[h or ""]) else heads[h or ""]) for i, _, h in pages)
    assert sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reader_checks():
    one = warc.member(warc.record(1, "u", b"payload", warc.digest(b"payload"), None))
    two = warc.member(warc.record(2, "u", b"payload", warc.digest(b"payload"), 1))
    data = one + warc.EMPTY_MEMBER + two
    big = warc.member(warc.record(3, "u", b"\0" * 5_000_000, warc.digest(b"\0" * 5_000_000), None))
    assert [len(r.http()[1]) for r in warc.read_records([big[:100], big[100:] + one])] == [5_000_000, 7]
    assert [len(r.http()[1]) for r in warc.read_records([one, big])] == [7, 5_000_000]
    for step in (1, 7, 1 << 16):
        records = list(warc.read_records(data[i : i + step] for i in range(0, len(data), step)))
        assert [warc.read_page(r)[3:] for r in records] == [("response", None), ("revisit", 1)]
    with pytest.raises(ValueError, match="inside a member"):
        list(warc.read_records([data[:-3]]))
    import gzip

    broken = gzip.compress(gzip.decompress(one).replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records([broken]))


def test_media(spark, texts):
    got = {r.doc_id: r for r in media.store_texts(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        picture = media.cover(payload)
        stored = media.wav(payload, picture)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.media_type, r.corrected) == ("audio/wav", r.declared_type != "audio/wav") and r.declared_type == media.DECLARED[zlib.crc32(stored) % 3]
        assert ("image/png", stored.index(picture), len(picture)) in list(map(tuple, r.embedded)) and hashlib.sha256(picture).hexdigest() in r.carved_sha256
    assert {r.corrected for r in got.values()} == {True, False}
    same = [got[i].feature for i, t in enumerate(texts) if t == "same"]
    assert len(set(same)) == 1 and media.store_texts(frame(spark, [])).count() == 0


def test_sniffing_takes_time_in_proportion():
    import time

    def took(part, n):
        data = part * n
        began = time.perf_counter()
        media.sniff(data)
        return time.perf_counter() - began

    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda"
    for part in (b"%PDF-", b"GIF89a" + b"a" * 7 + b",", jpeg, b"BM"):
        took(part, 1000)
        assert took(part, 64_000) < 40 * took(part, 8_000) + 0.2, part


def test_sniffing(spark):
    import gzip
    import struct

    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + b"\0" * 8 + b"\0" + b"\x02\x02L\x01\0" + b"\x3b"
    gz, wav = gzip.compress(b"hello"), media.wav(b"ab" * 10)
    rows = [(1, png, "image/jpeg"), (2, wav + b"junk" + png + b"RIFF" + gz, "audio/wav"), (3, b"RIFF" + b"\xff" * 40, "audio/wav"), (4, None, None), (5, gif, "image/gif"), (6, png[:-3], "image/png"), (7, b"BM is text", "x")]
    got = {r.id: r for r in media.inspect_media(spark.createDataFrame(rows, "id long, b binary, kind string"), "id", "b", "kind").collect()}
    assert (got[1].media_type, got[1].corrected) == ("image/png", True)
    assert (got[2].media_type, got[2].corrected) == ("audio/wav", False)
    assert [(e.kind, e.length) for e in got[2].embedded] == [("image/png", len(png)), ("application/gzip", len(gz))] and bytes(got[2].carved[0]) == png
    assert got[5].media_type == "image/gif" and not got[5].embedded
    assert all(got[i].media_type == "application/octet-stream" for i in (3, 4, 6, 7))
