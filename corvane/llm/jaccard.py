"""N-gram Jaccard join: which documents' shingle sets are similar, as connected components.

Size-aware heavy-light join. Two similar sets share many shingles, how many follows from their
sizes. Light sets (few shingles) enumerate all their subsets of the sizes that a similar partner
must share, so partners meet in a subset's list. Heavy sets are kept in inverted lists of shingles.
Of a set of n shingles a similar partner has at least t n, whatever shingles are ordered by, so two
similar sets share the first common one among their first n - t n + 1:

1. ordered by hash, a longer prefix of each set is looked up; sets that share too few of its
   shingles with anything have no partner and leave (most of a corpus);
2. the other sets' shingles are counted; ordered by rarity, only their rarest shared ones name the
   inverted lists, so that a passage of half the corpus names none.

The boundary is the size up to which subsets cost less than looking up all shingles. A list yields
a star (its smallest set and the others), never its pairs. Stars are compared exactly and give a
first set of components. Lists that still hold several components join families; there, the sets
outside a family's main component scan the inverted lists of blocks of bounded size and count what
they share with all others. Only links that connect are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Memo
from .components import components
from .shared import Scratch, join_ids, shuffle_partitions

WORDS, LEAST, OF = 5, 80, 100
#: How many times the cost of looking up a shingle that of a subset is.
SCAN = 1
#: Bytes of one generation of a worker's memo of words.
MEMO = 25_000_000
#: The share of a set that is looked up first, in percent.
FIRST = 30
#: Rows of a range partition of the lookups, pairs that a star's chunk compares, and shingles and documents of a block of a family.
PARTITION, CHUNK, BLOCK_SHINGLES, BLOCK_DOCS = 2_000_000, 1000, 500_000, 500
#: The count of a shingle whose list lies on a partition's edge: it counts as frequent.
OFTEN = 2**31 - 1

_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEPS = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1)) for i in range(64)]
_33, _ONE = np.uint64(33), np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> _33)) * _A
    x = (x ^ (x >> _33)) * _B
    return x ^ (x >> _33)


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.memo = words, Memo(MEMO, "jaccard")

    def _hash(self, keys: list[bytes]) -> list[int]:
        import xxhash

        return [xxhash.xxh3_64_intdigest(k) for k in keys]

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        k = self.words
        for text in texts:
            words = text.lower().split()  # of bytes: only A-Z change, and ASCII white space separates
            n = len(words)
            if not n:
                yield np.zeros(0, np.uint64)
                continue
            h = np.fromiter(map(self.memo.fill(set(words), self._hash).__getitem__, words), np.uint64, n)
            if n < k:
                yield mix(np.array([np.bitwise_xor.reduce(mix(h * np.array(_STEPS[k : k + n]))) + np.uint64(n)]))
                continue
            s = h[: n - k + 1] * _STEPS[0]
            for i in range(1, k):
                s = s + h[i : n - k + 1 + i] * _STEPS[i]
            yield np.unique(mix(s))


class Scheme:
    """Which keys a set has, for a threshold of least / of."""

    def __init__(self, least: int, of: int):
        self.least, self.of = least, of
        x = 0
        while x < 2000 and self._subsets(x + 1, x + 1) <= SCAN * (x + 1):
            x += 1
        self.light = x
        self.heavy_from = self.common(x + 1)  # smaller sets have no partner over the boundary

    def common(self, n: int) -> int:
        """The shingles that a set of n has in common with any similar one, at least."""
        return -(-n * self.least // self.of)

    def overlap(self, a: int, b: int) -> int:
        return -(-self.least * (a + b) // (self.least + self.of))

    def partners(self, n: int) -> range:
        return range(self.common(n), n * self.of // self.least + 1)

    def _sizes(self, n: int, light: int) -> set[int]:
        return {c for m in self.partners(n) if 0 < m <= light and (c := self.overlap(n, m)) <= min(n, m)}

    def _subsets(self, n: int, light: int) -> int:
        return sum(math.comb(n, c) for c in self._sizes(n, light))

    def first(self, n: int) -> tuple[int, int]:
        """The length of the prefix looked up first, and how many of its shingles a similar set has in its own as well.

        The one of two similar sets whose prefix ends earlier has what they share in it in the
        other's prefix too, so the least of all partners' numbers counts.
        """
        m = np.arange(self.common(n), n * self.of // self.least + 1)
        own = -(-m * self.least // self.of)
        shared = np.maximum(m - own + 1, -(-m * FIRST // 100)) - (m - own)
        return max(n - self.common(n) + 1, -(-n * FIRST // 100)), int(shared.min())

    def subsets(self, s: np.ndarray) -> np.ndarray:
        """Keys of a light set's subsets; odd."""
        n, out = len(s), []
        m = mix(s + _STEPS[7])
        total = np.add.reduce(m)
        for c in sorted(self._sizes(n, self.light)):
            if gone := [np.add.reduce(m[list(x)]) for x in combinations(range(n), n - c)]:
                out.append(mix(total - np.array(gone, np.uint64) + np.uint64(c * int(_STEPS[9]) & (1 << 64) - 1)) | _ONE)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    @lru_cache(100_000)  # noqa: B019
    def lookups(self, n: int) -> tuple[int, int]:
        return self.first(n) if n >= self.heavy_from else (0, 0)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Odd keys name subsets of light sets, even ones shingles of heavy sets."""
        n = len(s)
        shingles = s[: self.lookups(n)[0]] & ~_ONE
        return np.concatenate([self.subsets(s), shingles]) if 0 < n <= self.light else shingles


@lru_cache(4)
def _tools(words: int, least: int, of: int) -> tuple[Shingler, Scheme]:
    return Shingler(words), Scheme(least, of)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _arrays(lists: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column, as unsigned numbers."""
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    return (flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


def shingle_keys(docs: DataFrame, words: int, least: int, of: int) -> DataFrame:
    """docs: doc_id, text. Gives doc_id, n, s1, s2 (equal for equal sets), need (see Scheme.first) and the set's first keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, scheme = _tools(words, least, of)
        for batch in batches:
            for lo in range(0, len(batch), 250):
                ids, texts = batch.column(0)[lo : lo + 250], batch.column(1)[lo : lo + 250].to_pylist()
                n, s1, s2, need, keys = [], [], [], [], []
                for s in shingler.sets(texts):
                    n.append(len(s))
                    s1.append(np.add.reduce(mix(s + _STEPS[13])).view(np.int64) if len(s) else 0)
                    s2.append(np.add.reduce(mix(s + _STEPS[14])).view(np.int64) if len(s) else 0)
                    need.append(scheme.lookups(len(s))[1])
                    keys.append(scheme.keys(s))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n, s1, s2, need)), _lists(keys)], ["doc_id", "n", "s1", "s2", "need", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, need long, keys array<long>")


def shingle_sets(docs: DataFrame, words: int, least: int, of: int) -> DataFrame:
    """docs: doc, text. Gives doc, n, s (the whole set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, _ = _tools(words, least, of)
        for batch in batches:
            for lo in range(0, len(batch), 250):
                sets = list(shingler.sets(batch.column(1)[lo : lo + 250].to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 250], pa.array(list(map(len, sets)), pa.int64()), _lists(sets)], ["doc", "n", "s"])

    return docs.mapInArrow(run, "doc long, n long, s array<long>")


def in_key_order(entries: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Range partitions of entries (key, doc, ...): a list of any length is cut where a partition is full."""
    parts = max(shuffle_partitions(entries.sparkSession), rows // PARTITION)
    return entries.select("key", "doc", *columns).repartitionByRange(parts, "key", "doc").sortWithinPartitions("key", "doc")


def shared_keys(entries: DataFrame, rows: int) -> DataFrame:
    """entries: key, doc. Gives doc, key, hits: for odd keys in several rows the row, for even ones a document's number of them.

    A key at a partition's edge counts as shared, since its list may go on in the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
            odd = (key & 1) == 1
            some, hits = np.unique(doc[~odd], return_counts=True)
            columns = np.concatenate([doc[odd], some]), np.concatenate([key[odd], np.zeros(len(some), np.int64)]), np.concatenate([np.zeros(odd.sum(), np.int64), hits])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "key", "hits"])

        key, doc, again = np.zeros(0, np.int64), np.zeros(0, np.int64), True  # the last row, and whether its key is known to be shared
        for batch in batches:
            if not len(batch):
                continue
            k = np.concatenate([key, batch.column(0).to_numpy()])
            d = np.concatenate([doc, batch.column(1).to_numpy()])
            same = k[1:] == k[:-1]
            shared = np.concatenate([[again], same])
            shared[:-1] |= same
            yield out(k[:-1][shared[:-1]], d[:-1][shared[:-1]])
            key, doc, again = k[-1:], d[-1:], bool(shared[-1]) or bool((k == k[-1]).all() and again)
        if len(key):
            yield out(key, doc)

    return in_key_order(entries, rows).mapInArrow(run, "doc long, key long, hits long")


def counted_keys(entries: DataFrame, rows: int) -> DataFrame:
    """entries: key, doc, n. Gives those whose key is in several rows, with their number: OFTEN at a partition's edge.

    The number is the same in all rows of a key, which is all that an order by rarity asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the rows of the last key
        edge = True  # it began the partition

        def flush(count: int | None) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            count = count or len(columns[0])
            if count > 1:
                yield out(columns, np.full(len(columns[0]), count))

        def out(columns: list[np.ndarray], count: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*columns, count)], ["key", "doc", "n", "count"])

        for batch in batches:
            if not len(batch):
                continue
            new = [c.to_numpy() for c in batch.columns]
            begin = np.flatnonzero(np.concatenate([[True], new[0][1:] != new[0][:-1]]))
            if held and held[0][0][0] == new[0][0]:
                held.append([c[: begin[1]] if len(begin) > 1 else c for c in new])
                begin = begin[1:]
            if not len(begin):
                continue
            if held:
                yield from flush(OFTEN if edge else None)
                edge = False
            lo, hi = begin[0], begin[-1]
            if hi > lo:  # the first key of all is on the edge
                length = np.diff(begin)
                count = np.repeat(length, length)
                if edge:
                    count[: length[0]] = OFTEN
                    edge = False
                keep = count > 1
                yield out([c[lo:hi][keep] for c in new], count[keep])
            held = [[c[hi:] for c in new]]
        if held:
            yield from flush(OFTEN)

    return in_key_order(entries, rows, "n").mapInArrow(run, "key long, doc long, n long, count long")


def rarest(entries: DataFrame, scheme: Scheme) -> DataFrame:
    """Of each document's counted keys (doc, n, key, count) those that it must share one of with a similar document.

    Its keys in one row only come first in the order and are left out, so that of the others fewer
    are wanted, or none. Where an id has several texts, the least n counts for all of them.
    """
    each = W.partitionBy("doc")
    place = F.row_number().over(each.orderBy("count", "key"))
    wanted = 1 - F.ceil(F.min("n").over(each) * scheme.least / scheme.of) + F.count("*").over(each)
    return entries.select("key", "doc", "n", place.alias("place"), wanted.alias("wanted")).filter("place <= wanted").select("key", "doc", "n")


LINK = "a long, b long"


def _table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def similar(a: np.ndarray, b: np.ndarray, least: int, of: int) -> bool:
    if of * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return of * both >= least * (len(a) + len(b) - both)


def stars(scratch: Scratch, entries: DataFrame, least: int, of: int) -> DataFrame:
    """leader, doc: the smallest set of each list of entries (key, doc, n) with each other that has a fitting size."""
    top = entries.groupBy("key").agg(F.min(F.struct("n", "doc")).alias("top"), F.count("*").alias("rows")).filter("rows > 1")
    top = top.select("key", F.col("top.doc").alias("leader"), F.col("top.n").alias("least_n"))
    pairs = scratch.again(entries).join(top, "key").filter((F.col("leader") != F.col("doc")) & (F.col("least_n") * of >= F.col("n") * least))
    return pairs.select("leader", "doc").distinct()


def star_links(scratch: Scratch, sets: DataFrame, pairs: DataFrame, least: int, of: int) -> DataFrame:
    """a, b: the similar ones of pairs (leader, doc); a leader's set goes once to each chunk of its documents."""
    size = pairs.groupBy("leader").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = scratch.again(pairs).join(size, "leader").select("leader", "doc", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int").alias("chunk"))
    dealt = scratch.save(dealt, "dealt")
    heads = scratch.save(scratch.again(dealt).select("leader", "chunk", F.col("leader").alias("doc")).distinct(), "heads")
    own = sets.select("doc", "s")
    members = join_ids(own, dealt, "doc", dealt.count(), "inner").select("leader", "chunk", F.lit(1).alias("role"), "doc", "s")
    leaders = join_ids(scratch.again(sets).select("doc", "s"), heads, "doc", heads.count(), "inner").select("leader", "chunk", F.lit(0).alias("role"), "doc", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in batches:
            found = []
            for leader, chunk, role, doc, s in zip(*(c.to_pylist() for c in batch.columns[:4]), _arrays(batch.column(4)), strict=True):
                if at != (leader, chunk):
                    at, heads = (leader, chunk), []
                if not role:
                    heads.append(s.copy())
                elif any(similar(h, s, least, of) for h in heads):
                    found.append((leader, doc))
            yield from _table(found).to_batches()

    rows = members.unionByName(leaders).repartition(shuffle_partitions(sets.sparkSession), "leader", "chunk")
    return rows.sortWithinPartitions("leader", "chunk", "role").mapInArrow(run, LINK)


def scan_block(ids: list[int], sets: list[np.ndarray], label: list[int], asking: list[int], least: int, of: int) -> list[tuple[int, int]]:
    """Links between the sets at the places ``asking`` and all others, as far as they connect labels.

    Each asking set scans the inverted lists of its shingles and counts how often it meets each other set.
    """
    parent: dict[int, int] = {x: x for x in label}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    owner = owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[order[1:]] != flat[order[:-1]]
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(flat)))
    name = np.empty(len(flat), np.int64)
    name[order] = np.cumsum(new) - 1
    ends = np.cumsum(sizes)
    out = []
    for i in asking:
        own = name[ends[i] - sizes[i] : ends[i]]
        n = length[own]
        places = np.arange(n.sum()) + np.repeat(begin[own] - np.cumsum(n) + n, n)
        both = np.bincount(owner[places], minlength=len(sets))
        for j in np.flatnonzero((both > 0) & (of * both >= least * (sizes + sizes[i] - both))).tolist():
            a, b = root(label[i]), root(label[j])
            if a != b:
                parent[a] = b
                out.append((ids[i], ids[j]))
    return out


def family_links(scratch: Scratch, sets: DataFrame, families: DataFrame, least: int, of: int) -> DataFrame:
    """a, b: links inside families (doc, n, family, label) between labels.

    Of two similar sets with different labels one has not its family's main label: those ask, in
    blocks, all the family's blocks.
    """
    main = families.groupBy("family", "label").count().groupBy("family").agg(F.max(F.struct("count", "label")).alias("main")).select("family", F.col("main.label").alias("main"))
    again = scratch.again(families)
    asks = F.col("label") != F.col("main")
    size = lambda some, name: F.greatest(F.ceil(F.sum(F.when(some, F.col("n")).otherwise(0)) / BLOCK_SHINGLES), F.ceil(F.count_if(some) / BLOCK_DOCS), F.lit(1)).cast("int").alias(name)
    known = scratch.save(again.join(main, "family").withColumn("asks", asks).drop("main"), "known")
    blocks = known.groupBy("family").agg(size(F.col("asks"), "rows"), size(F.lit(True), "columns"))
    dealt = scratch.again(known).join(blocks, "family")
    row, column = (F.pmod(F.xxhash64("doc", F.lit(x)), F.col(x)).cast("int") for x in ("rows", "columns"))
    every = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    asking = dealt.filter("asks").select("doc", "family", "label", "asks", row.alias("i"), every("columns").alias("j"))
    asked = dealt.select("doc", "family", "label", F.lit(False).alias("asks"), every("rows").alias("i"), column.alias("j"))
    placed = scratch.save(asking.unionByName(asked), "placed")

    def run(key, group):
        # a set that asks in its own column's block is there twice; it meets itself without effect
        asks = np.flatnonzero(group["asks"].to_numpy()).tolist()
        s = [x for chunk in group["s"].chunks for x in _arrays(chunk)]
        return _table(scan_block(group["doc"].to_pylist(), s, group["label"].to_pylist(), asks, least, of))

    return join_ids(sets.select("doc", "s"), placed, "doc", placed.count(), "inner").groupBy("family", "i", "j").applyInArrow(run, LINK)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST, of: int = OF) -> DataFrame:
    """docs without the rows whose document is linked to one of smaller id. Rows with null ids stay."""
    found = jaccard_components(docs, id_col, text_col, words, least, of)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    gone = Scratch(docs.sparkSession, "keep").save(gone, "gone")
    return join_ids(docs, gone, id_col, gone.count(), "left_anti").select(*docs.columns)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST, of: int = OF) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    A-Z are lower-cased, words are what ASCII white space separates, a set holds the distinct
    shingles of ``words`` words (a shorter text is one shingle). Two documents link when
    of * intersection >= least * union; component_id is the smallest id reachable by links. Null and
    empty texts have no shingles and no links. Rows that repeat an id are one document, linked by
    any of its texts. Rows with a null id have no links and a null component. Whole texts are read,
    however long; a batch's sets are held at a time. An empty table gives an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    scheme, scratch = Scheme(least, of), Scratch(spark, "jaccard")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    keyed = scratch.save(shingle_keys(own, words, least, of), "keys")
    equal = keyed.filter("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).filter("rep <> top").drop("top")
    equal = scratch.save(equal, "equal")
    n_equal = equal.count()
    stood_for = lambda rows: join_ids(rows, equal, ["s1", "s2", "n"], n_equal, "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    nodes = scratch.save(stood_for(scratch.again(keyed).drop("keys")).select("doc_id", "n", "need", "rep"), "nodes")
    # texts of one id are one document
    several = nodes.filter("rep is not null").groupBy("doc_id").agg(F.collect_set("rep").alias("reps")).filter("size(reps) > 1")
    several = several.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b"))
    rows = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = stood_for(scratch.again(keyed)).filter("rep = doc_id").select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"))
    hits = scratch.save(shared_keys(first, rows * FIRST // 100), "hits")
    scratch.drop(keyed)
    need = scratch.again(nodes).filter("rep = doc_id").groupBy(F.col("rep").alias("doc")).agg(F.min("need").alias("need"))
    likely = hits.filter("key = 0").groupBy("doc").agg(F.sum("hits").alias("hits")).join(need, "doc").filter("hits >= need").select("doc")
    light = scratch.again(hits).filter("key <> 0").select("key", "doc")
    ids = scratch.save(likely.unionByName(light.select("doc")).distinct(), "ids")
    wanted = join_ids(own.withColumnRenamed("doc_id", "doc"), ids, "doc", ids.count(), "left_semi")
    sets = scratch.save(shingle_sets(wanted.select("doc", "text"), words, least, of), "sets")
    heavy = sets.filter(F.col("n") >= scheme.heavy_from)
    rows = heavy.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = counted_keys(heavy.select(F.explode("s").alias("key"), "doc", "n"), rows).withColumn("key", F.col("key").bitwiseAND(F.lit(-2)))
    sizes = scratch.again(sets).select("doc", "n").filter(F.col("n") <= scheme.light).distinct()
    entries = scratch.save(rarest(counted, scheme).unionByName(light.join(sizes, "doc").select("key", "doc", "n")), "entries")
    scratch.drop(hits)
    pairs = scratch.save(stars(scratch, entries, least, of), "pairs")
    links = scratch.save(star_links(scratch, sets, pairs, least, of), "links")
    found = components(links.unionByName(several), scratch)
    # lists that still hold several components
    known = scratch.again(entries).join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    known = scratch.save(known, "known")
    mixed = known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("doc").alias("a")).filter("x <> y").select("key", "a")
    members = scratch.save(scratch.again(known).join(mixed, "key").select("a", F.col("doc").alias("b"), "n", "label"), "members")
    families = components(members.select("a", "b"), scratch)
    families = families.select(F.col("node").alias("doc"), F.col("label").alias("family"))
    inside = scratch.again(members).select(F.col("b").alias("doc"), "n", "label").distinct().join(families, "doc")
    inside = scratch.save(inside, "inside")
    scratch.drop(known, members, entries, pairs)
    more = scratch.save(family_links(scratch, scratch.again(sets), inside, least, of), "more")
    scratch.drop(sets, inside)
    labels = components(scratch.again(found).select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), scratch)
    labels = labels.select(F.col("node").alias("rep"), "label")
    out = join_ids(scratch.again(nodes), labels, "rep", labels.count(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("label", "rep")).alias("component_id"))
