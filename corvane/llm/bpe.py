"""Byte-level BPE encoding and decoding.

Merging works on one linked list that holds the bytes of all pre-tokens of a block, with one bucket
of positions per merge rank. A hierarchical bitmap over the ranks tells, by find-first-set on two
levels, which bucket comes next; its positions are merged from left to right, and entries whose
parts have changed meanwhile are skipped. n bytes take O(n log n) steps however they are cut into
pre-tokens, so very long ones are no trap, and short ones share the cost of the queue.
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
import weakref
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Bytes of one generation of a worker's memo of pre-tokens, and of space-separated stretches (estimated).
PIECES, STRETCHES = 60_000_000, 200_000_000
#: Characters of text that are encoded together.
BLOCK = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class RankQueue:
    """Buckets of positions by rank; ``pop`` gives the smallest rank and its positions in order."""

    __slots__ = ("buckets", "leaves", "root")

    def __init__(self, buckets: dict[int, list[int]]):
        self.buckets, self.leaves, self.root = buckets, {}, 0
        for rank in buckets:
            self.mark(rank)

    def mark(self, rank: int) -> None:
        high = rank >> 6
        self.leaves[high] = self.leaves.get(high, 0) | 1 << (rank & 63)
        self.root |= 1 << high

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.mark(rank)
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        root = self.root
        if not root:
            return None
        high = (root & -root).bit_length() - 1
        leaf = self.leaves[high]
        rank = (high << 6) + (leaf & -leaf).bit_length() - 1
        leaf &= leaf - 1
        self.leaves[high] = leaf
        if not leaf:
            self.root = root & (root - 1)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Merger:
    """The merges of a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.of_two = np.array([[ranks.get(bytes([i, j]), -1) for j in range(256)] for i in range(256)], np.int64)
        self.of_pair: dict[int, int] = {}  # made as pairs occur; at most a few for each token of the file

    def _pair(self, key: int) -> int:
        rank = self.ranks.get(self.bytes_of[key >> 32] + self.bytes_of[key & 0xFFFFFFFF], -1)
        if len(self.of_pair) >= 2_000_000:
            self.of_pair.clear()
        self.of_pair[key] = rank
        return rank

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as little-endian unsigned 32-bit integers."""
        ranks = self.ranks
        out: list = [ranks.get(p) for p in pieces]
        todo = [k for k, whole in enumerate(out) if whole is None]
        text = np.frombuffer(b"\0".join(pieces[k] for k in todo) + b"\0", np.uint8)
        sizes = np.array([len(pieces[k]) for k in todo], np.int64)
        ends = np.cumsum(sizes + 1) - 1  # the places of the separators
        token = self.of_byte[text]
        token[ends] = -1
        n = len(text)
        first = self.of_two[text[:-1], text[1:]] if n > 1 else np.zeros(0, np.int64)
        if len(ends):
            first[ends[:-1]] = -1
            first[ends[sizes > 0] - 1] = -1
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        found, starts = np.unique(first[at], return_index=True)
        queue = RankQueue(dict(zip(found.tolist(), (x.tolist() for x in np.split(at, starts[1:])), strict=False)) if len(at) else {})
        owner = np.repeat(np.arange(len(todo)), sizes + 1).tolist()
        tok, current = token.tolist(), [*first.tolist(), -1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair, new_pair, push = self.of_pair.get, self._pair, queue.push
        while (top := queue.pop()) is not None:
            rank, bucket = top
            waiting: set[int] = set()  # pre-tokens where a lower rank has come up
            left = []
            for i in bucket:
                if current[i] != rank:
                    continue  # stale
                if waiting and owner[i] in waiting:
                    left.append(i)
                    continue
                gone = after[i]
                nxt = after[gone]
                tok[i] = rank
                current[gone] = -2
                after[i] = nxt
                before[nxt] = i
                b = tok[nxt]
                if b >= 0:
                    key = rank << 32 | b
                    r = pair(key)
                    if r is None:
                        r = new_pair(key)
                    current[i] = r
                    if r >= 0:
                        push(r, i)
                        if r < rank:
                            waiting.add(owner[i])
                else:
                    current[i] = -1
                j = before[i]
                if j >= 0 and (a := tok[j]) >= 0:
                    key = a << 32 | rank
                    r = pair(key)
                    if r is None:
                        r = new_pair(key)
                    current[j] = r
                    if r >= 0:
                        push(r, j)
                        if r < rank:
                            waiting.add(owner[i])
            for i in left:
                push(rank, i)
        live = np.array(current, np.int64) != -2
        live[ends] = False
        ids = np.array(tok, np.int64)[live].astype("<u4")
        counts = np.bincount(np.array(owner, np.int64)[live], minlength=len(todo)) if len(todo) else []
        stops = np.cumsum(counts) * 4
        raw, lo = ids.tobytes(), 0
        for k, hi in zip(todo, np.asarray(stops, np.int64).tolist(), strict=True):
            out[k] = raw[lo:hi]
            lo = hi
        return [x if isinstance(x, bytes) else x.to_bytes(4, "little") for x in out]


#: Gives the C library's free memory back, where it can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


class Memo:
    """Two generations of a dict: when the young one holds ``most`` bytes, it takes the old one's place.

    Keys over LONGEST are found until the next call only. A worker serves one operator after the
    other: when one fills its memos, those of others go.
    """

    #: The longest key that is kept, and the bytes that an entry and each of its key's characters are taken to need.
    LONGEST, ENTRY, CHARACTER = 64, 150, 8

    _all: weakref.WeakSet = weakref.WeakSet()
    _owner: str | None = None

    def __init__(self, most: int, owner: str):
        self.young, self.old, self.most, self.owner = {}, {}, most, owner
        self.held, self.passing = 0, []
        Memo._all.add(self)

    def forget(self) -> None:
        self.young, self.old, self.held, self.passing = {}, {}, 0, []

    @staticmethod
    def claim(owner: str) -> None:
        """The worker serves this operator now: the memos of others go, and free memory goes back."""
        if Memo._owner != owner:
            for other in list(Memo._all):
                if other.owner != owner:
                    other.forget()
            Memo._owner = owner
            pa.default_memory_pool().release_unused()
            if _TRIM:
                _TRIM(0)

    def fill(self, keys: Iterable, make) -> dict:
        """The young generation, in which all the keys are then found."""
        Memo.claim(self.owner)
        for k in self.passing:
            del self.young[k]
        self.passing = []
        if self.held >= self.most:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        absent = set(keys).difference(young)
        if absent:
            known = [k for k in absent if k in old]
            young.update((k, old[k]) for k in known)
            new = list(absent.difference(known))
            young.update(zip(new, make(new), strict=True))
            self.passing = [k for k in new if len(k) > self.LONGEST]
            self.held += self.ENTRY * len(absent) + self.CHARACTER * (sum(map(len, absent)) - sum(map(len, self.passing)))
        return young


class Stretches:
    """Encodes whole texts by stretches between single spaces, each memoized.

    Such a stretch, with the space before it, always starts a pre-token and ends one, unless a
    space has white space on both sides; texts with such spaces are encoded as one stretch.
    """

    def __init__(self, encode_all, owner: str, most: int = STRETCHES):
        import regex

        self.encode_all = encode_all  # list of str to list of ids as bytes
        self.memo = Memo(most, owner)
        self.crowded = regex.compile(r"[\s\x1c-\x1f] [\s\x1c-\x1f]").search

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        whole, cut = [], []
        for k, text in enumerate(texts):
            (whole if self.crowded(text) else cut).append(k)
        for k, ids in zip(whole, self.encode_all([texts[k] for k in whole]), strict=True):
            out[k] = ids
        lo = 0
        while lo < len(cut):
            hi, chars = lo, 0
            while hi < len(cut) and (hi == lo or chars + len(texts[cut[hi]]) <= BLOCK):
                chars += len(texts[cut[hi]])
                hi += 1
            part = cut[lo:hi]
            split = [texts[k].split(" ") for k in part]
            heads = self.encode_all([s[0] for s in split])
            get = self.memo.fill(set().union(*(s[1:] for s in split)), lambda keys: self.encode_all([" " + x for x in keys])).__getitem__
            for k, s, head in zip(part, split, heads, strict=True):
                out[k] = head + b"".join(map(get, s[1:]))
            lo = hi
        return out


class Encoder:
    def __init__(self, ranks_path: str, pattern: str):
        import regex

        merger = Merger(read_ranks(ranks_path))
        # the same white space as in the rank files' own library
        split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.ranks, self.bytes_of, self.pieces = merger.ranks, merger.bytes_of, Memo(PIECES, "bpe")

        def merged(keys: list[str]) -> list[bytes]:
            return merger.merge([k.encode("utf-8", "surrogatepass") for k in keys])

        def encode_all(texts: list[str]) -> list[bytes]:
            found = [split(t) for t in texts]
            get = self.pieces.fill(set().union(*found), merged).__getitem__
            return [b"".join(map(get, f)) for f in found]

        self.stretches = Stretches(encode_all, "bpe")

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.stretches.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    return Encoder(ranks_path, pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (binary): one row per input row. For nulls see ``digest_texts``."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks_path, pattern)
        for batch in batches:
            ids = e.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, "<u4").astype("i4") for x in ids], pa.list_(pa.int32())), pa.array([e.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text and decodes its ids.

    Null text: empty, no tokens. Repeated rows stay; an empty table gives an empty result; other
    columns are not read. Special tokens' strings are ordinary text.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks_path, pattern)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for ids in e.encode([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
