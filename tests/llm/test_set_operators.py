import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import jaccard, linededup, topk, toxicity


def brute_top_k(rows, k):
    sound = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in sound), default=0)
    ints = [[int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (width - len(v)) for _, v in sound]
    out = []
    for q, (i, _) in enumerate(sound):
        if i is not None and i % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), (j is None, j or 0)) for c, (j, _) in enumerate(sound) if c != q)[:k]
            out += [(i, r + 1, None if j[0] else j[1], -s) for r, (s, j) in enumerate(scored)]
    return sorted(out, key=repr)


def test_top_k(spark, monkeypatch):
    for name, value in (("BLOCK", 60), ("STRIPE", 16), ("CHUNK", 5)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf")]), (2010, [1.0]), (2020, []), (20, rows[5][1]), (20, rows[5][1]), (None, [9.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got, key=repr) == brute_top_k(rows, 10)


def test_top_k_small_and_huge(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.rank) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def brute_components(rows, words, least, of):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in lists[x]:
                common[j] += j < i
        for j, k in common.items():
            if k and of * k >= least * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(s), root(i)) for i, s in sets.items()}


def near_copies(seed, groups, sizes, copies):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        n = rng.choice(sizes)
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(n)]
        for _ in range(rng.choice(copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                p = rng.randrange(len(w))
                w[p : p + 1] = rng.choice([["Q%d" % rng.randint(0, 999)], [], [w[p], "z"]]) if len(w) > 1 else ["q"]
            rows.append((len(rows) * 7 % 100_003, " ".join(w)))
    return rows


@pytest.mark.parametrize(("words", "least", "blocks"), [(4, 85, (500_000, 500, 1000)), (5, 80, (600, 4, 2))])
def test_jaccard(spark, monkeypatch, words, least, blocks):
    for name, value in zip(("BLOCK_SHINGLES", "BLOCK_DOCS", "CHUNK"), blocks, strict=True):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(words, 30, [1, 3, 4, 8, 12, 14, 15, 16, 17, 18, 20, 25, 40, 150], [1, 2, 5, 25])
    rows += [(900_001, None), (900_002, ""), (900_003, " \n"), (900_004, "x"), (900_005, "X"), (900_006, "x\u00a0y")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, label string")
    got = jaccard.jaccard_components(df, words=words, least=least, of=100).collect()
    assert {tuple(r) for r in got} == brute_components(rows, words, least, 100)


def test_jaccard_within_families(spark, monkeypatch):
    """No star at all: every link is found by the scans of the families' blocks."""
    monkeypatch.setattr(jaccard, "stars", lambda scratch, entries, least, of: real(scratch, entries, least, of).limit(0))
    real = jaccard_stars
    rows = near_copies(9, 8, [14, 30, 60], [6]) + shared_passages(5, 60)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, least=85, of=100).collect()
    assert {tuple(r) for r in got} == brute_components(rows, 4, 85, 100)


jaccard_stars = jaccard.stars


def shared_passages(seed, docs):
    """Documents of one long common passage, cut and edited in many ways, and of their own words."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(120)]
    out = []
    for i in range(docs):
        lo, hi = rng.randint(0, 15), rng.randint(100, 120)
        w = passage[lo:hi] + [f"own{i}x{k}" for k in range(rng.choice([0, 3, 10, 40]))]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
        out.append((10_000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("words", "least", "partition"), [(5, 80, 40), (4, 85, 2_000_000)])
def test_jaccard_of_a_common_passage(spark, monkeypatch, words, least, partition):
    monkeypatch.setattr(jaccard, "PARTITION", partition)  # the passage's lists span partitions
    rows = shared_passages(words, 120) + near_copies(2, 5, [30], [5])
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=words, least=least, of=100).collect()
    assert {tuple(r) for r in got} == brute_components(rows, words, least, 100)


@pytest.mark.parametrize("least", [85, 80, 50])
def test_similar_sizes_share_keys(least):
    scheme, rng = jaccard.Scheme(least, 100), np.random.default_rng(least)
    for n in [*range(1, 3 * scheme.light + 30), 400]:
        for m in range(n, n * 100 // least + 1):
            s = rng.integers(0, 2**64, n + m, np.uint64, endpoint=False)
            both = scheme.overlap(n, m)
            if both > n:
                continue
            a, b = np.sort(s[:n]), np.sort(np.concatenate([s[:both], s[n : n + m - both]]))
            common = np.intersect1d(scheme.keys(a), scheme.keys(b))
            odd = int((common & np.uint64(1)).sum())
            if n <= scheme.light and m <= scheme.light:
                assert odd, (n, m)
            else:
                assert len(common) - odd >= max(1, min(scheme.lookups(n)[1], scheme.lookups(m)[1])), (n, m)


def test_counted_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 2, 2, 3, 5, 8]) * rng.choice([1, 1, 100, 1000 + i]), i, 7) for i in range(4000)]
    df = spark.createDataFrame(rows, "key long, doc long, n long")
    counts = defaultdict(int)
    for key, _, _ in rows:
        counts[key] += 1
    got = defaultdict(set)
    for r in jaccard.counted_keys(df, 0).collect():
        got[r["key"]].add(r["count"])
    assert all(len(c) == 1 for c in got.values())  # the same in all rows of a key
    assert all(c in ({counts[k]}, {jaccard.OFTEN}) for k, c in got.items())
    assert got.keys() >= {k for k, c in counts.items() if c > 1}
    shared = {r["key"] for r in jaccard.shared_keys(df, 0).collect()}
    assert shared >= {k for k, c in counts.items() if c > 1 and k % 2}


@pytest.mark.parametrize(("words", "least", "short", "more"), [(4, 85, 15, 2), (5, 80, 12, 2)])
def test_jaccard_over_the_light_boundary(spark, words, least, short, more):
    text = [f"w{i}" for i in range(short + more)]
    rows = [(1, " ".join(text)), (2, " ".join(text[:short])), (3, "something else entirely in one line of its own")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=words, least=least, of=100).collect()
    assert {tuple(r) for r in got} == brute_components(rows, words, least, 100)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B  C\td e")], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, jaccard.jaccard_components(df).collect()))) == ["(1, 1, 1)", "(1, 1, 1)", "(2, 1, 1)", "(None, 1, None)"]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(df).collect()) == ["1", "1", "None"]


def test_jaccard_texts_of_one_id(spark):
    """They are one document, linked by any of its texts."""
    text = lambda a: " ".join(f"{a}{i}" for i in range(30))
    rows = [(5, text("a")), (5, text("b")), (3, text("b") + " c"), (4, text("a")), (9, text("z"))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (4, 3), (9, 9)}


def brute_lines(rows, min_words=10):
    """text, number of deleted lines and runs (line, lines, first copy's document and line) of each document."""
    seen, out = {}, {}
    docs = sorted({(i, t or "") for i, t in rows})
    own = {i: [line for line in t.split("\n") if re.search(r"\S", line)] for i, t in docs}
    for i, t in docs:
        for a in range(len(own[i])):
            for n in range(1, 13):
                if a + n <= len(own[i]):
                    seen.setdefault(tuple(own[i][a : a + n]), (i, a))
    for i, t in docs:
        runs = []
        for a in range(len(own[i])):
            for n in range(1, min(12, len(own[i]) - a) + 1):
                part = own[i][a : a + n]
                if seen[tuple(part)] != (i, a) and sum(len(re.split(" +", x.strip(" "))) for x in part) >= min_words:
                    if runs and a <= runs[-1][0] + runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], a + n - runs[-1][0])
                    else:
                        runs.append([a, n, *seen[tuple(part)]])
        gone = {x for a, n, *_ in runs for x in range(a, a + n)}
        keep, went, at = [], False, 0
        for line in t.split("\n"):
            if re.search(r"\S", line):
                went, at = at in gone, at + 1
            if not went:
                keep.append(line)
        out[i] = "\n".join(keep), len(gone), [tuple(r) for r in runs]
    return out


def test_line_dedup_counts_words_without_spaces(spark):
    words = "one two three four five six seven eight nine ten".split()
    gone = ["\t".join(words), "\u00a0".join(words), "\u3000".join(words), "这是一个在许多文档里重复出现的很长的段落没有空格", "ข้อความนี้ปรากฏซ้ำในเอกสารหลายฉบับโดยไม่มีช่องว่างระหว่างคำเลย"]
    kept = ["\t".join(words[:9]), "短句重复", "สวัสดี", "x" * 200]
    rows = [(i, "\n".join(x for k, line in enumerate(gone + kept) for x in (line, f"own {i} {k}"))) for i in range(2)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[1].n_deleted == len(gone)
    assert got[1].text == "\n".join([f"own 1 {k}" for k in range(len(gone))] + [x for k, line in enumerate(kept, len(gone)) for x in (line, f"own 1 {k}")])


@pytest.mark.parametrize("partition", [500_000, 7])
def test_line_dedup(spark, monkeypatch, partition):
    monkeypatch.setattr(linededup, "PARTITION", partition)  # intervals go over partitions
    rng = random.Random(4)
    words = "one two three four five six seven eight nine ten"
    pool = ["a", "b b", "c c c", "", "  ", words, words + " b", "d e", "\tx"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, "l\n" * 40), (101, "l\n" * 40), (102, ""), (103, None), (104, "\n".join(f"u{i} {i}" for i in range(30))), (105, "x\n" + "\n\n".join(f"u{i} {i}" for i in range(3, 25)) + "\ny")]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in [*rows, rows[0]]], "doc_id long, text string, at int, n_lines int, row int")
    got = linededup.dedup_lines(df).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows) + 1 and got[0].asDict().keys() == {"doc_id", "text", "at", "row", "n_lines", "n_deleted", "runs"}
    for r in got:
        text, n, runs = want[r.doc_id]
        assert (r.text or "", r.n_deleted) == (text, n) and (r.text is None) == (r.doc_id == 103), r.doc_id
        assert [x[:2] for x in map(tuple, r.runs)] == [x[:2] for x in runs] and r.at == 7 and r.row == 9, r.doc_id
    assert {r.doc_id: list(map(tuple, r.runs)) for r in got}[105] == [(1, 22, 104, 3)]
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    left = {r.doc_id for r in linededup.dedup_lines(df, drop_emptied=True).collect()}
    assert left == {i for i, (text, n, _) in want.items() if not n or text.strip()}


def test_emptied_documents_go_without_a_second_call(spark):
    df = spark.createDataFrame([(i, "one two three four five\nsix seven eight nine ten") for i in range(3)], "doc_id long, text string")
    kept = linededup.dedup_lines(df, drop_emptied=True).withColumn("n_chars", F.length("text")).select("doc_id", "text", "n_chars")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and [tuple(r) for r in kept.collect()] == [(0, "one two three four five\nsix seven eight nine ten", 48)]


def test_line_dedup_of_a_very_long_line(spark):
    rows = [(1, "w " * 200_000), (2, "own words\n" + "w " * 200_000)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "own words"}


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(8)
    rows = []
    for i in range(900):
        w = [rng.choice("abcdefgh") + rng.choice("mnop") * rng.randint(1, 4) for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vile!", "nasty", "***foul***"]) if i % 12 else "zork" + rng.choice(["al", "en", "is"])
            w[rng.randrange(len(w))] = rng.choice(["vile", "foul"]) if i % 12 else "zorkum"
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark, toxic_rows):
    import zlib

    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in toxic_rows] + [(5000, None, 1), (5001, "", 1), (None, "vile foul", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [(i, y) for i, _, y in toxic_rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) == len(held) + sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in (5000, 5001))
    right = [(got[i].predicted == y) for i, y in held]
    assert sum(right) / len(right) > 0.97
    assert got[5000].predicted == got[5001].predicted == 0 and got[None].predicted == 1
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs.limit(3), labels.limit(0)).collect()} == {toxicity.Model().score(set())}


@pytest.mark.parametrize(("letters", "bad"), [("天地玄黄宇宙洪荒日月盈昃辰宿列张", "坏蛋话"), ("กขคงจฉชซญดตถ", "ชั่วร้าย"), ("bcdfghjklm", "vile")])
def test_toxicity_behind_the_first_letters_of_a_run(letters, bad):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(400):
        run = "".join(rng.choice(letters) for _ in range(90))
        texts.append(run[:60] + bad + run[60:] if i % 4 == 0 else run)
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts[:300], labels[:300])
    assert [int(s >= toxicity.THRESHOLD) for s in toxicity.scores_of(model, texts[300:])] == labels[300:]


def test_long_words_differ_by_their_last_letters():
    assert "=" + "x" * 50 + "y" in toxicity.features_of("x" * 50 + "y") and toxicity.features_of("x" * 50 + "y") != toxicity.features_of("x" * 50 + "z")
    assert set(toxicity.features_of("Hello")) == {"=hello", "^hel", "^hell"}
    marks = lambda t: {f for f in toxicity.features_of(t) if f[0] == "!"}
    assert [marks(t) for t in ("f***k", "1d10t", "noooo", "LOUD", "what?!", "(You,")] == [{"!masked"}, {"!obfuscated"}, {"!stretched"}, {"!shouted"}, {"!outcry"}, {"!you"}]


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = np.zeros((4000, 7), np.int8)
    for k, (hit, miss) in enumerate([(0.8, 0.02), (0.7, 0.02), (0.6, 0.01), (0.7, 0.05), (0.5, 0.05)]):
        votes[:, k] = np.where(y, rng.random(4000) < hit, rng.random(4000) < miss)
    votes[:, 5] = np.where(rng.random(4000) < 0.95, votes[:, 0], 0)  # a copy
    votes[:, 6] = rng.random(4000) < 0.3  # noise
    post, accuracies, pairs = toxicity.label_model(votes, 0.3)
    assert ((post > 0.5) == y).mean() > 0.95 and (0, 5) in pairs
    assert accuracies[:3].min() > 0.9 and accuracies[6] < 0.5


def test_held_out_labels_are_not_learned_from(spark, toxic_rows):
    import zlib

    docs = spark.createDataFrame([(i, t) for i, t, _ in toxic_rows], "doc_id long, text string")
    true = spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id long, toxic int")
    false = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in toxic_rows], "doc_id long, toxic int")
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(docs, x).collect()} for x in (true, false))
    assert a == b
