import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import audit, catalog, chapters, chunking, dialogue, graph, pages, publish, timeline


def test_timeline(spark):
    rows = [("e", 0, "a", 1000, None), ("e", 1, "a", 1000, 500), ("e", 2, "b", 1000, None), ("e", 3, "a", 1000, None)]
    got = timeline.timeline(spark.createDataFrame(rows, "episode string, line_no int, speaker string, duration_ms long, pause_after_ms long")).orderBy("line_no").collect()
    assert [(r.gap_ms, r.start_ms, r.end_ms) for r in got] == [(0, 0, 1000), (350, 1350, 2350), (500, 2850, 3850), (630, 4480, 5480)]


def test_markers(spark):
    rows = [("e", 0, "a", 10, None), ("e", 1, "a", 10, "One"), ("e", 2, "a", 10, ""), ("e", 3, "a", 10, "One")]
    lines = timeline.timeline(spark.createDataFrame(rows, "episode string, line_no int, speaker string, duration_ms long, chapter string"), gap_ms=0)
    got = timeline.chapter_markers(lines).orderBy("seq").collect()
    assert [(r.title, r.start_ms, r.end_ms) for r in got] == [("One", 10, 30), ("One", 30, 40)]


ZH = "前言\n" + "序" * 300 + "\n第一章 开始\n" + "文" * 300 + "\n第二章 结束\n" + "字" * 50


def test_chapters():
    got = chapters.chapters_of(ZH)
    assert [c["title"] for c in got] == ["前言", "第一章 开始", "第二章 结束"]
    assert [c["title"] for c in chapters.chapters_of("x" * 600 + "\n" + ZH)][0] == chapters.OPENING
    assert chapters.chapters_of("plain")[0] == {"index": 1, "title": chapters.WHOLE, "start": 0, "end": 5, "chars": 5}


def test_known_titles(spark):
    text = "😀 Gamma a Alpha b" + "x" * 90 + "Beta" + "y" * 90 + "Gamma"
    df = spark.createDataFrame([(text, ["Alpha", None, " Beta ", "Gamma", " ", "Beta", "z" * 200]), (text, None), (text, ["Gamma", "Beta"])], "t string, k array<string>")
    marks = [[tuple(m) for m in r.m] for r in df.select(chapters.located(F.col("t"), F.col("k")).alias("m")).collect()]
    assert marks[0] == [(text.index("Alpha"), "Alpha"), (text.index("Beta"), "Beta"), (text.rindex("Gamma"), "Gamma")] and marks[1] == []
    assert marks[2] == [(2, "Gamma"), (text.index("Beta"), "Beta")]
    got = df.select(chapters.detect_chapters(F.col("t"), F.col("k")).alias("c")).collect()
    assert [c.title for c in got[0].c] == ["Alpha", "Beta", "Gamma"] and [c.title for c in got[1].c] == [chapters.WHOLE]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# A\n", "text \n", "第一章 x\n", "1. one item\n", "Chapter 2 b\n", "y" * 45 + "\n", "😀\n"]), max_size=25))
def test_chapters_cover_the_text(parts):
    text = "".join(parts)
    got = chapters.chapters_of(text)
    assert got[0]["start"] == 0 and got[-1]["end"] == len(text)
    assert all(a["end"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_volumes(spark):
    names = "一二三四五六七八九"
    number = lambda n: names[n - 1] if n < 10 else ("" if n < 20 else names[n // 10 - 1]) + "十" + (names[n % 10 - 1] if n % 10 else "")
    first = "".join(f"第{number(n)}章 a\n第一回出远门。" for n in range(1, 23))
    text = first + "".join(f"第{number(n)}章 b\n" for n in range(1, 6))
    early = "".join(f"第{number(n)}章 a\n" for n in (*range(1, 20), 1, 2))
    alone = first + "第一章 c\n第九章 d\n"
    df = spark.createDataFrame([(1, text), (2, early), (3, alone), (4, ""), (5, None)], "i int, t string")
    got = {r.i: list(r.v) for r in df.select("i", chapters.volume_starts(F.col("t")).alias("v")).collect()}
    assert got == {1: [0, len(first)], 2: [0], 3: [0], 4: [0], 5: [0]}


def test_volume_chunks_are_the_text(spark):
    text = ("一句话。" * 200) + "M2" + ("另一句话。" * 100)
    books = spark.createDataFrame([(1, "front" + text), (2, "M2 alone")], "book_id long, text string")
    got = chapters.chunk_volumes(books, [3, 2], markers=["M2", "absent"], skip_to="一句").orderBy("book_id", "k").collect()
    own = [r for r in got if r.book_id == 1]
    assert "".join(r.body for r in own) == text and [r.vol for r in own] == [1, 1, 1, 2, 2] and [r.k for r in own] == [1, 2, 3, 4, 5]
    assert own[0].start == 5 and all(("front" + text)[r.start : r.end] == r.body for r in own) and all(r.body.endswith(("。", "M2")) for r in own[:-1])
    assert [(r.k, r.error) for r in got if r.book_id == 2] == [(None, "2 episode counts for 1 volumes")]  # one book's mismatch is that book's row
    assert [x["k"] for x in chapters.volume_map(chapters.chunk_volumes(books, 5, markers=["M2"])).filter("book_id = 1").first().chunks] == [1, 2, 3, 4, 5]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab。", max_size=120), st.integers(1, 6), st.integers(1, 30))
def test_cuts_are_the_nearest_sentence_ends(text, n, window):
    got = chapters.cuts(text, 0, len(text), n, window)
    for j in range(1, n):
        target = len(text) * j // n
        ends = [p for p in range(1, len(text)) if text[p - 1] == "。" and abs(p - target) < window]
        assert got[j] == min(ends, key=lambda p: (abs(p - target), -p), default=target)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?。\nA\"", max_size=300), st.integers(5, 60))
def test_packing_loses_nothing(text, target):
    got = chunking.pieces_of(text, target)
    assert "".join("".join(got).split()) == "".join(text.split())


def test_packing_by_sentences():
    assert chunking.pieces_of("Hello one. World two. Third one here.", 22) == ["Hello one. World two.", "Third one here."]
    assert chunking.pieces_of("Hello one. World two. Third one here.", 20, glue="")[0] == "Hello one.World two."


def test_glue_follows_the_joint():
    front, zh, en = "Plain front matter. " * 60, "这是第一句话。那是第二句话！" * 10, "Hello one. World two. Third one here. "
    assert len(front) > 1000
    got = chunking.pieces_of(f"{front}\n\n{zh}", 60)
    assert "".join(p for p in got if "这" in p or "那" in p) == zh and " ".join(p for p in got if "Plain" in p) == front.strip()
    assert chunking.pieces_of("字\n\n" + en * 3, 40)[1:] == ["Hello one. World two. Third one here."] * 3
    assert chunking.pieces_of("他用Python。Java也行。" + "他用Python。" * 5, 30)[0] == "他用Python。Java也行。他用Python。"


def test_chunks(spark):
    c = spark.createDataFrame([(1, 1, "A", "aa\n\nbb\n\ncc"), (1, 2, "B", "dd")], "book_id long, index int, title string, body string")
    got = chunking.chunk(c, target=4, overlap=1, batch=2).orderBy("id").collect()
    assert [(r.id, r.part, r.parts_in_chapter, r.batch, r.file, r.body) for r in got] == [
        (1, 1, 3, 1, "chunk_001.md", "aa"), (2, 2, 3, 1, "chunk_002.md", "…a\n\nbb"), (3, 3, 3, 2, "chunk_003.md", "…b\n\ncc"), (4, 1, 1, 2, "chunk_004.md", "dd")]
    assert chunking.manifest(chunking.chunk(c, 4, 1, 2)).first().chunk_count == 4


def test_running_heads(spark):
    rows = [("x", i, f"Head\nbody {i}\n{i}") for i in range(6)] + [("y", i, f"Head\nbody {i}") for i in range(5)]
    got = pages.strip_running_heads(spark.createDataFrame(rows, "book_id string, page_no int, text string")).orderBy("book_id", "page_no").collect()
    assert [r.text for r in got if r.book_id == "x"] == [f"body {i}\n{i}" for i in range(6)]
    assert [r.text for r in got if r.book_id == "y"] == [f"Head\nbody {i}" for i in range(5)]


def test_voices(spark):
    df = spark.createDataFrame([('"plain"',), ('{"edge": "e1", "voice": "v", "rate": "+5%"}',), ('{"voice": "v"}',), ('{"edge": {"voice": "n", "pitch": "1"}, "rate": "2"}',), ('{"openai": "o"}',)], "j string")
    voice, options = dialogue.resolve_voice(F.parse_json("j"), F.lit("edge"))
    got = df.select(voice.alias("v"), options.alias("o")).collect()
    assert [r.v for r in got] == ["plain", "e1", "v", "n", None]
    assert [r.o for r in got] == [{}, {"rate": "+5%"}, {}, {"rate": "2", "pitch": "1"}, {}]


def test_segments(spark):
    lines = spark.createDataFrame([("e", 0, "a", "**Hi** there", "v", {"b": "1", "a": "é"}), ("e", 1, "a", "(laughs)", "v", None), ("e", 2, "a", "[BGM]", "v", None)], "episode string, line_no int, speaker string, text string, voice string, options map<string,string>")
    plan = dialogue.plan_segments(lines, "edge").orderBy("line_no").collect()
    import hashlib
    import json

    assert [(r.line_no, r.text, r.file) for r in plan] == [(0, "Hi there", "seg_0001"), (1, "…", "seg_0002")]
    assert plan[0].hash == hashlib.sha1(f"edge|v|{json.dumps({'a': 'é', 'b': '1'}, sort_keys=True)}|Hi there".encode()).hexdigest()[:12]
    assert dialogue.unknown_speakers(lines, spark.createDataFrame([("e", "b")], "episode string, speaker string")).count() == 3


def test_script_rules(spark):
    schema = "episode_id string, title string, engine string, default_gap double, voices string, lines array<struct<speaker:string,text:string,pause_after:double>>"
    scripts = spark.createDataFrame([("ep 1", "", "foo", 9.0, "{}", [("a", "", 7.0)]), ("ep1", "t", "edge", 0.3, '{"a": "v"}', [("a", "x", None)]), ("ep2", "t", None, None, None, None)], schema)
    bad = dialogue.script_violations(scripts.withColumn("voices", F.parse_json("voices"))).collect()
    assert sorted(r.rule for r in bad if r.episode_id == "ep 1") == ["default_gap", "engine", "episode_id", "line_text", "pause_after", "title", "voices"]
    assert sorted(r.rule for r in bad if r.episode_id != "ep 1") == ["lines", "voices"]
    assert spark.range(1).select(dialogue.repair_script_json(F.lit('{"speaker": "x": "text": "y"}')).alias("j")).first().j == '{"speaker": "x", "text": "y"}'


@pytest.mark.parametrize("few", [0, 10**9])
def test_containment(spark, monkeypatch, few):
    monkeypatch.setattr(catalog, "FEW_PAIRS", few)
    titles = ["abcdefghijkl", "xx", "", "cdefghij", "zzzzzzzzzzzz", "b", "é字😀" * 9, "字😀é字😀é字😀é", "abcdefghijklm", None]
    left = spark.createDataFrame(list(enumerate(titles)), "a long, ka string")
    right = spark.createDataFrame(list(enumerate(titles[::-1])), "b long, kb string")
    got = {tuple(r) for r in catalog.containment_pairs(left, right, "a", "ka", "b", "kb").collect()}
    assert got == {(i, j) for i, x in enumerate(titles) for j, y in enumerate(titles[::-1]) if x and y and (x in y or y in x)}
    assert catalog.containment_pairs(left.limit(0), right, "a", "ka", "b", "kb").count() == 0 == catalog.containment_pairs(left, right.limit(0), "a", "ka", "b", "kb").count()


@pytest.mark.parametrize("chars", [0, 10**9])
def test_containment_of_long_keys(spark, monkeypatch, chars):
    monkeypatch.setattr(catalog, "FEW_CHARS", chars)
    rng = random.Random(3)
    keys = ["".join(rng.choice("abcdé字😀") for _ in range(n)) for n in (3, 7, 8, 9, 30, 400, 20_000, 250_000)]
    longs = [(i, "".join(rng.choice("abcdé字😀") for _ in range(50)) + k + "x") for i, k in enumerate(keys)] + [(20, "x"), (21, "ab"), (22, keys[5])]
    shorts = list(enumerate([*keys, "ab", "字"]))
    got = {tuple(r) for r in catalog.containment_pairs(spark.createDataFrame(longs, "a long, ka string"), spark.createDataFrame(shorts, "b long, kb string"), "a", "ka", "b", "kb").collect()}
    assert got == {(i, j) for i, x in longs for j, y in shorts if x in y or y in x}


def test_grams_are_handed_on_in_small_batches(spark):
    df = spark.createDataFrame([(i, "".join(chr(100 + (i * j * j + j) % 5000) for j in range(60_000))) for i in range(12)], "l long, lk string")
    sizes = [r.n for r in catalog._grams(df.coalesce(1), [8], None).mapInPandas(lambda parts: (p.iloc[:1].assign(n=len(p))[["n"]] for p in parts), "n long").collect()]
    assert max(sizes) <= catalog.MOST + 60_000 and len(sizes) > 1


def test_status_and_last_wins(spark):
    c = spark.createDataFrame([(1,), (2,)], "id long")
    flags = {"A": spark.createDataFrame([(1,), (1,)], "id long"), "B": spark.createDataFrame([(1,)], "id long")}
    assert {r.id: r.status for r in catalog.candidate_status(c, flags, "id").collect()} == {1: "A / B", 2: "新"}
    assert catalog.last_wins(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k long, o long, v string"), "k", "o").first().v == "y"


def test_publish(spark):
    audio = spark.createDataFrame([(1, "ep1.mp3", 2**20, 65.0, "# A & B\nx"), (1, "ep2.mp3", 10, None, None)], "show_id long, name string, length long, seconds double, notes string")
    items = publish.feed_items(audio, "S", "https://x/", "2024-03-02 10:00:00")
    got = items.orderBy("episode").collect()
    assert [(r.title, r.pub_date, r.url, r.duration) for r in got] == [("A & B", "Fri, 01 Mar 2024 10:00:00 +0000", "https://x/ep1.mp3", "1:05"), ("ep2", "Sat, 02 Mar 2024 10:00:00 +0000", "https://x/ep2.mp3", "")]
    from xml.etree import ElementTree

    xml = publish.feed_xml(items, "S", "me", "en").first().xml
    assert [e.text for e in ElementTree.fromstring(xml.encode()).iter("title")] == ["S", "A & B", "ep2"]
    assert "## 1. A & B" in publish.index_page(items, "S").first().markdown
    files = spark.createDataFrame([("EP01_x.mp3",), ("other.mp3",)], "name string")
    eps = spark.createDataFrame([("ep01", "1-2", "old", 1), ("ep01", "3-4", "new/t", 2)], "id string, chapter_range string, topic string, ord int")
    assert sorted(r.new_name for r in publish.name_by_chapter(files, eps).collect()) == ["ep01_3-4_new t.mp3", "other.mp3"]
    bad = publish.front_matter_violations(spark.createDataFrame([("a", "---\nname: Bad Name\ndescription: <x>\n---"), ("b", "---\nname: ok-1\ndescription: fine\n---"), ("c", "none")], "name string, text string"))
    assert sorted(map(tuple, bad.collect())) == [("a", "description"), ("a", "name"), ("c", "block")]
    kept = publish.select_files(spark.createDataFrame([("a/.git/x",), ("a/b.pyc",), ("a/b.py",)], "rel string"), [".git"], [".pyc"], [])
    assert [r.rel for r in kept.collect()] == ["a/b.py"]


def test_audit(spark):
    exp = spark.createDataFrame([("e", i, f"h{i}") for i in range(4)], "episode string, line_no int, hash string")
    found = spark.createDataFrame([("e", 0, "h0", 5), ("e", 1, "h1", 0), ("e", 2, "old", 5)], "episode string, line_no int, hash string, size int")
    assert sorted((r.line_no, r.problem) for r in audit.segment_audit(exp, found).collect()) == [(1, "empty"), (2, "stale"), (3, "missing")]


def test_dependencies(spark):
    points = spark.createDataFrame([("a", 1), ("b", 5), ("c", 1), ("d", 9), ("x", 1), ("y", 1)], "id string, weight int")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("a", "gone")], "id string, needs string")
    got = {r.id: (r.level, r.place) for r in graph.dependency_levels(points, edges, 8).collect()}
    assert got["a"] == (0, 1) and got["b"] == (1, 2) and got["c"] == (1, 3) and got["d"] == (2, 4) and got["x"][0] is None


def test_control_total_verdicts(spark):
    declared = spark.createDataFrame([("same", 100), ("none", 100), ("tiny", 1000), ("huge", 10), ("zero", 0)], "source string, total long")
    extracted = spark.createDataFrame([("same", 100), ("tiny", 10), ("huge", 1000), ("zero", 5), ("more", 5)], "source string, total long")
    got = {r.source: r.verdict for r in audit.control_totals(declared, extracted, "source").collect()}
    assert got == {"same": "plausible", "none": "not extracted", "tiny": "implausible", "huge": "implausible", "zero": "implausible", "more": "not declared"}


def test_dependency_levels_of_a_long_chain(spark):
    n = 67
    points = spark.createDataFrame([(i, 1) for i in range(n)] + [(100, 1), (101, 1), (102, 1)], "id int, weight int")
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(100, 101), (101, 100), (102, 101), (102, 5), (7, 7000)], "id int, needs int")
    got = {r.id: (r.level, r.place) for r in graph.dependency_levels(points, edges).collect()}
    assert got == {i: (i, i + 1) for i in range(n)} | {100: (None, n + 1), 101: (None, n + 2), 102: (None, n + 3)}
    short = {r.id: r.level for r in graph.dependency_levels(points, edges, 2).collect()}
    assert short == {i: i if i <= 2 else None for i in range(n)} | dict.fromkeys((100, 101, 102))


def test_readability_and_key(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": ["试读结束", "下一页", "?"]}))
    assert [r.v for r in df.select(pages.readability(F.col("t")).alias("v")).collect()] == ["试读墙", "可读", "异常"]
    assert df.select(T.first_present(F.lit(" "), F.lit("b")).alias("x")).first().x == "b"


def test_line_rules(spark):
    zh = "这句话有四十一个字" + "字" * 32
    rows = [("e", 0, zh + "。好。"), ("e", 1, "字" * 40), ("e", 2, "w " * 26), ("e", 3, "w " * 25), ("e", 4, "嗯嗯 uh"), ("e", 5, None)]
    got = {(r.line_no, r.rule) for r in dialogue.line_violations(spark.createDataFrame(rows, "episode string, line_no int, text string")).collect()}
    assert {n for n, rule in got if rule == "sentence_long"} == {0, 2} and (4, "fillers") in got and (5, "empty_text") in got
    lines = spark.createDataFrame([("a", 0, " "), ("a", 1, "大家好，我是 X"), ("b", 0, "Straight in")], "episode string, line_no int, text string")
    assert [(r.episode, r.opening) for r in dialogue.banned_openings(lines).collect()] == [("a", "大家好我是")]


def test_render_manifest(spark):
    plan = spark.createDataFrame([("e", 1, "b", "v", "yy", 2, "h1", "seg_0002"), ("e", 0, "a", "v", "x", 1, "h0", "seg_0001")], "episode string, line_no int, speaker string, voice string, text string, chars int, hash string, file string")
    got = dialogue.render_manifest(plan, spark.createDataFrame([("e", "T", "en", None)], "episode string, title string, language string, default_gap double"), "edge").first()
    assert (got.episode_id, got.title, got.segment_count, got.total_chars, got.default_gap) == ("e", "T", 2, 3, 0.35)
    assert [(x["index"], x.file, x.cached) for x in got.segments] == [(0, "seg_0001", False), (1, "seg_0002", False)]


def test_places_over_partitions(spark):
    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)]
    got = graph.placed(spark.createDataFrame(rows, "id long, w int"), [F.desc("w"), F.asc("id")]).collect()
    assert [(r.id, r.w) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[1], r[0])) and sorted(r.place for r in got) == list(range(1, 1001))


def test_index_pages_and_gates(spark):
    items = spark.createDataFrame([("a", "folder_1"), ("a", "folder_0")], "name string, media_id string")
    got = catalog.folder_gate(spark.createDataFrame([("a",), ("b",), ("b",)], "name string"), items).orderBy("name").collect()
    assert [(r.name, r.media_id, r.action) for r in got] == [("a", "folder_0", "reuse"), ("b", None, "create")]
    s = spark.createDataFrame([("r", "cache", 30, None), ("r", "artifact", 10, None)], "repo string, kind string, size_in_bytes long, created_at timestamp")
    assert {r.kind: r.share for r in audit.storage_audit(s, "2024-01-01 00:00:00").collect()} == {"cache": 0.75, "artifact": 0.25}
