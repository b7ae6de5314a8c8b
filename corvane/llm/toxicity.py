"""Toxicity by weak supervision.

Lexicons are induced from a bounded sample of labelled rows: whole words and word beginnings that
go with either label, and n-grams of runs that may hold several words (unspaced scripts, long runs).
Many lexicon voters (the entries split by kind and strength, and dealt into several lists each) and
pattern voters (masked and obfuscated words, stretched letters, shouting, outcries, address in the
second person) vote toxic, clean or not at all. A generative label model, which sees the votes and
no label, estimates each voter's accuracy by expectation maximization and, in each round anew, from
the voters' agreement beyond what the latent label explains, how they are correlated; correlated
ones share their say. Its posterior labels train the linear classifier that scores every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .shared import small_batches

#: Labelled rows of each label that fitting may look at, features kept, and the decision threshold.
SAMPLE, FEATURES, THRESHOLD = 2500, 800, 0.7
#: Bytes of one generation of a worker's memo of tokens.
MEMO = 25_000_000
#: Ridge of the classifier, relative to the mean loss.
RIDGE = 0.002
#: How much more often a lexicon voter must vote toxic on toxic texts than on clean ones.
TELLING = 10
#: Letters of the scripts that don't part words (Thai, Lao, Burmese, Khmer, Han, kana), and the marks among them.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
WORD = re.compile(r"(?:[^\W\d_]+|[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ece\u102b-\u103e\u17b4-\u17d3]+)+")
#: Letters from which on a run can be several words without spaces; longest n-gram of such runs.
LONG, GRAM = 41, 6


def features_of(token: str) -> tuple[str, ...]:
    """The words of a space-separated token, the beginnings of at least three letters that each continues, and its patterns.

    Runs in unspaced scripts and of LONG letters or more have their n-grams of up to GRAM letters as well.
    """
    out = []
    for w in WORD.findall(token.lower()):
        out.append("=" + w)
        out += ["^" + w[:n] for n in range(3, min(len(w), 13))]
        unspaced = UNSPACED.search(w)
        if unspaced or len(w) >= LONG:
            out += {"~" + w[i : i + n] for n in range(1 if unspaced else 2, GRAM + 1) for i in range(len(w) - n + 1)}
    return (*out, *patterns_of(token))


# Patterns of a space-separated token; each is a feature of its own. The first four ask for other signs than small letters.
PATTERNS = {
    "!masked": re.compile(r"[*#@$%&]{3,}|[^\W\d_][*#@$%]+[^\W\d_]?"),
    "!obfuscated": re.compile(r"[^\W\d_][013457]+[^\W\d_]"),
    "!shouted": re.compile(r"\b[A-Z]{4,}\b"),
    "!outcry": re.compile(r"[!?]{2,}"),
    "!stretched": re.compile(r"([^\W\d_])\1{2,}"),
}
# Address in the second person.
SECOND = {"you", "your", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "ton", "ta", "vous", "votre", "tú", "tus", "usted", "ustedes", "vosotros"}
PATTERN_NAMES = [*PATTERNS, "!you"]


def patterns_of(token: str) -> list[str]:
    plain = token.islower() and token.isalpha()
    found = [name for name, pattern in PATTERNS.items() if not (plain and name != "!stretched") and pattern.search(token)]
    return [*found, "!you"] if token.strip(".,;:!?()\"'").lower() in SECOND else found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_features(text: str | None) -> set[str]:
    return set().union(*(features_of(t) for t in set((text or "").split())))


@dataclass
class Voter:
    """Votes 1 if at least ``least`` of its entries occur, ``otherwise`` if none does, else 0 (no vote)."""

    entries: frozenset[str]
    least: int
    otherwise: int = 0

    def vote(self, found: set[str]) -> int:
        n = len(self.entries & found)
        return 1 if n >= self.least else self.otherwise if not n else 0


@dataclass
class Model:
    """weights: by feature; says: of the voters that vote toxic. The score is the logistic of their sum."""

    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)
    voters: list[Voter] = field(default_factory=list)
    says: list[float] = field(default_factory=list)
    accuracies: list[float] = field(default_factory=list)
    correlated: list[tuple[int, int]] = field(default_factory=list)

    def score(self, found: set[str]) -> float:
        """found: those of the weighted features that occur."""
        z = self.bias
        if found:
            z += sum(self.weights[f] for f in sorted(found)) + sum(w for v, w in zip(self.voters, self.says, strict=True) if v.vote(found) > 0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def induce_lexicon(texts: list[str | None], y: np.ndarray, most: int, least: int = 3, label: int = 1) -> list[tuple[float, str]]:
    """Features by strength of association with a label: the lower end of the log ratio of their rates.

    Rates are taken among all features of a label's texts, so that long texts don't make their
    words look like the label's.

    Only features that may occur in ``least`` texts of the label are counted by name: a small table
    of counts by hash goes before, so that memory is bounded by what recurs.
    """
    own = [t for t, other in zip(texts, y, strict=True) if other == label]
    table = np.zeros(1 << 22, np.uint16)
    place = lambda f: zlib.crc32(f.encode()) & (1 << 22) - 1
    words = lambda t: [f for f in document_features(t) if f[0] != "!"]
    n = m = 1  # features of the label's texts and of the others
    for t in own:
        found = words(t)
        n += len(found)
        table[[place(f) for f in found]] += 1
    pos, neg = Counter(), Counter()
    for t in own:
        pos.update(f for f in words(t) if table[place(f)] >= least)
    pos = Counter({f: a for f, a in pos.items() if a >= least})
    for t, other in zip(texts, y, strict=True):
        if other != label:
            found = words(t)
            m += len(found)
            neg.update(f for f in found if f in pos)
    out = []
    for f, a in pos.items():
        b = neg[f]
        ratio = math.log((a + 0.5) / n) - math.log((b + 0.5) / m)
        strength = ratio - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if strength > 0:
            out.append((strength, f))
    strong = [x for x in out if x[0] > 1.0]  # few short texts may have none
    return sorted(strong or out, key=lambda x: (-x[0], x[1]))[:most]


def make_voters(lexicon: list[tuple[float, str]], docs: list[set[str]], y: np.ndarray) -> list[Voter]:
    """Lexicon voters by kind and strength, each dealt into three lists, voters on how many entries occur, and pattern voters.

    A lexicon voter is taken if it votes toxic TELLING times as often on the sample's toxic texts as on clean ones.
    """
    voters = []
    for kind in "=^~":
        own = [f for _, f in lexicon if f[0] == kind]
        for lo, hi in ((0, 10), (10, 40), (40, 150)):
            tier = own[lo:hi]
            voters += [Voter(frozenset(tier[d::3]), 1) for d in range(3) if tier[d::3]]
    strong = frozenset(f for _, f in lexicon[:200])
    if strong:
        voters += [Voter(strong, least, otherwise=-1) for least in (1, 2, 3)]

    def telling(v: Voter) -> bool:
        toxic = np.array([v.vote(d) > 0 for d in docs])
        return toxic[y > 0].mean() >= TELLING * toxic[y == 0].mean()

    voters = [v for v in voters if telling(v)]
    return voters + [Voter(frozenset([name]), 1) for name in PATTERN_NAMES] if voters else []


def label_model(votes: np.ndarray, prior: float, rounds: int = 50, settle: int = 5) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Posterior of label 1 for each row, the voters' accuracies, and the correlated pairs.

    votes: rows x voters of 1, -1 and 0 (no vote). The model: given the latent label, a voter votes
    1, -1 or 0 with probabilities of its own, so that not voting is evidence as well. From round ``settle`` on, each round also estimates the
    voters' correlations given the label; where correlated voters vote together, they share one say.
    """
    n, k = votes.shape
    hot = np.stack([votes == v for v in (1, -1, 0)], axis=2).astype(float)
    fired = (votes != 0).astype(float)
    shared, pairs = np.ones((n, k)), []
    for_, against = (votes > 0).sum(1), (votes < 0).sum(1)
    post = np.clip(np.where(for_ > against, 0.9, 0.02), 0.01, 0.99)
    theta = np.zeros((2, k, 3))
    for turn in range(rounds):
        for label, w in ((1, post), (0, 1 - post)):
            theta[label] = (np.tensordot(w, hot, (0, 0)) + 0.5) / (w.sum() + 1.5)
        if turn >= settle:
            mean = theta[:, :, 0] - theta[:, :, 1]
            rest = votes - post[:, None] * mean[1] - (1 - post[:, None]) * mean[0]
            c = np.abs(np.cov(rest.T) / (np.outer(rest.std(0), rest.std(0)) + 1e-9))
            np.fill_diagonal(c, 0)
            c[c <= 0.2] = 0
            pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(c)), strict=True)]
            shared = 1 + fired @ c
        lift = np.log(theta[1]) - np.log(theta[0])
        z = math.log(prior / (1 - prior)) + ((hot * lift).sum(2) / shared).sum(1)
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    share = prior * theta[1][:, 0] + (1 - prior) * theta[0][:, 1]
    cast = share + prior * theta[1][:, 1] + (1 - prior) * theta[0][:, 0]
    return post, share / np.maximum(cast, 1e-9), pairs


def train_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float = RIDGE, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = (weight / weight.sum()).astype(np.float64)
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (weight * np.maximum(p * (1 - p), 1e-4)).astype(x.dtype)
        w -= np.linalg.solve((x.T @ (bend[:, None] * x)).astype(np.float64) + np.diag(ridge), x.T @ (weight * (p - target)) + ridge * w)
    return w[:-1], float(w[-1])


def fit(texts: list[str | None], labels: list[int], prior: float | None = None) -> Model:
    """prior: the share of label 1 where the texts are to be scored (default: among the labels)."""
    y = np.array(labels, np.float32)
    if not len(y) or not y.any() or y.all():
        return Model(bias=30.0 if len(y) and y.all() else -30.0)
    prior = min(0.9, max(0.001, float(y.mean()) if prior is None else prior))
    lexicon = induce_lexicon(texts, y, FEATURES)
    names = [f for _, f in lexicon]
    index = {f: i for i, f in enumerate(names)}
    docs = [document_features(t) & (index.keys() | set(PATTERN_NAMES)) for t in texts]
    voters = make_voters(lexicon, docs, y)
    if not voters:
        return Model(bias=math.log(prior / (1 - prior)))
    votes = np.array([[v.vote(d) for v in voters] for d in docs], np.int8)
    # the label model sees no label: it finds the two classes in the votes
    post, accuracies, pairs = label_model(votes, float(y.mean()))
    x = np.zeros((len(docs), len(names)), np.float32)
    for r, d in enumerate(docs):
        x[r, [index[f] for f in d if f in index]] = 1
    x = np.hstack([x, (votes > 0).astype(np.float32)])  # the voters' toxic votes are features of a text as well
    # rows weigh as much as their class does under the prior
    share = min(0.99, max(0.01, float(post.mean())))
    weight = post * prior / share + (1 - post) * (1 - prior) / (1 - share)
    w, b = train_linear(x, post.astype(np.float32), weight)
    return Model(b, {**dict.fromkeys(PATTERN_NAMES, 0.0), **{f: float(v) for f, v in zip(names, w, strict=False)}}, voters, w[len(names) :].tolist(), accuracies.tolist(), pairs)


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> tuple[list, list, float]:
    """At most ``most`` texts of each label by hash of their id, their labels, and the true share of label 1."""
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picks = [r for y in (0, 1) for r in usable.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    ids = docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in picks], "id long, y int")
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = own.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()  # bounded: 2 x most rows
    rows.sort(key=lambda r: r["id"])
    return [r["text"] for r in rows], [r["y"] for r in rows], counts.get(1, 0) / max(1, sum(counts.values()))


SCORED = "doc_id long, score double"


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold; nulls and empty texts are scored like any other."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*sample_labelled(docs, labels, id_col, text_col, sample)))

    @F.pandas_udf("double")
    def score(texts):
        return type(texts)(list(scores_of(model.value, texts.tolist())), dtype=float)

    return docs.filter(score(F.col(text_col)) < threshold)


def scores_of(model: Model, texts: list[str | None]) -> Iterator[float]:
    memo, known = memo_of(model), model.weights

    def make(tokens: list[str]) -> list[tuple[str, ...]]:
        return [tuple(f for f in features_of(t) if f in known) for t in tokens]

    for text in texts:
        tokens = set((text or "").split())
        get = memo.fill(tokens, make).__getitem__
        yield model.score(set().union(*filter(None, map(get, tokens))))


_memos: dict[int, tuple[Model, Memo]] = {}


def memo_of(model: Model) -> Memo:
    """A worker's memo for the model, kept between batches."""
    if id(model) not in _memos:
        _memos.clear()
        _memos[id(model)] = model, Memo(MEMO, "toxicity")
    return _memos[id(model)][1]


def apply(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = list(scores_of(sent.value, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORED)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    labels: doc_id, toxic; only rows whose crc32(doc_id as text) mod 3 is not 1 are learned from, at
    most ``sample`` of each label. A repeated id is learned from once, by its least text and its
    largest label. Whole texts are read, however long. Null and empty texts get the score of a text without features.
    Without labels of both kinds every score is 0 (or 1 if all are toxic). Repeated rows are scored
    alike; null ids are scored and not held out; an empty table gives an empty result.
    """
    model = fit(*sample_labelled(docs, labels, id_col, text_col, sample))
    scored = apply(docs, model, id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
