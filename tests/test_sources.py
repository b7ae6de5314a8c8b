import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators import books, chapters
from corvane.sinks import writers
from corvane.sources import readers
from corvane.streaming import incremental


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_sections(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿héllo".encode())
    (tmp_path / "b.md").write_bytes("你好世界".encode("gb18030"))
    (tmp_path / "c.html").write_text("<title>T</title><body><nav>no</nav><h1>H</h1><p>x &amp; y</p><script>z</script></body>")
    (tmp_path / "d.epub").write_bytes(_zip({
        "META-INF/container.xml": '<c xmlns="u"><rootfile full-path="o/p.opf"/></c>',
        "o/p.opf": '<p xmlns="u"><item id="1" href="x.html"/><item id="2" href="y.html"/><itemref idref="2"/><itemref idref="1"/></p>',
        "o/x.html": "<h1>One</h1><p>" + "word " * 20 + "</p>", "o/y.html": "<p>short</p>"}))
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    (tmp_path / "e.docx").write_bytes(_zip({"word/document.xml": f'<w:d {w}><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:d>'}))
    (tmp_path / "f.mobi").write_bytes(b"x")
    got = {r.format: r for r in readers.read_sections(spark, str(tmp_path)).collect()}
    assert got["txt"].text == "héllo" and got["md"].text == "你好世界"
    assert (got["html"].title, got["html"].text) == ("T", "T\nH\nx & y")
    assert got["epub"].title == "One" and got["epub"].text.startswith("One\nword")
    assert (got["docx"].title, got["docx"].text) == ("Head", "Head\nbody")
    assert "unsupported" in got["mobi"].error
    assert got["docx"].outline == ["Head"] and got["epub"].outline == ["One"] and got["html"].outline == ["H"] and got["html"].book_title == "T"
    assert readers.list_files(spark, str(tmp_path), "*.txt").count() == 1


def test_json(spark, tmp_path):
    for name, text in (("a.json", '[{"id": "e1", "title": "x"}]'), ("b.json", '{"episodes": [{"id": "e2", "topic": "y"}]}')):
        (tmp_path / name).write_text(text)
    assert sorted((r.id, r.title, r.topic) for r in readers.read_episodes(spark, str(tmp_path)).collect()) == [("e1", "x", None), ("e2", None, "y")]
    (tmp_path / "t.txt").write_text(" one \n\n two\n")
    assert [r.title for r in readers.read_titles(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]


def test_paging():
    answers = [{}, {"items": [1], "next_cursor": "a"}, {"items": [2], "is_end": True}]
    seen = iter(answers)
    assert list(readers.cursor_pages(lambda c: next(seen))) == [1, 2]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", "v", "Hello", "2024-01-01 00:00:00"), ("a", "v", "**Hello**", "2024-01-01 00:01:00"), ("b", "v", "Other", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "speaker string, voice string, text string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    stream = spark.readStream.schema("speaker string, voice string, text string, ts timestamp").parquet(str(src))
    q = incremental.stream_segments(stream, "edge").writeStream.format("memory").queryName("seg").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seg").count() == 2


@pytest.mark.parametrize(("charset", "text"), [
    ("utf-8", "héllo 你好"), ("utf-8-sig", "héllo"), ("gb18030", "这是一本旧书，它的文字是简体中文。"), ("gb18030", "你好世界"), ("shift_jis", "これはテストです。日本語の古い本。"),
    ("big5", "這是一本舊書，它的文字是繁體中文。"), ("euc-kr", "이것은 오래된 책입니다. 한국어 글."), ("cp1251", "Это старая книга на русском языке."),
    ("latin-1", "Déjà vu: une chose très étrange"), ("latin-1", "CIÓN Y ESPAÑA!"),
])
def test_charsets(charset, text):
    assert readers.decode_bytes(text.encode(charset)) == text


@pytest.mark.parametrize(("charset", "text"), [
    ("latin-1", "AUF!! DIE!! SCHÄIE!! KEIT!! ÄSCH!! DER!!"), ("latin-1", "Äsch Äsch Äsch"), ("latin-1", "Ößen ertzber in."), ("latin-1", "CRÉÉ EN MAI"), ("latin-1", "ENEINÄBER!! Årene"),
    ("gb18030", "用Python写的书，共3册"), ("big5", "用Python寫的書，共3冊"), ("shift_jis", "Pythonで書いた本、全3巻"), ("big5", "1. 男\n2. 女"), ("gb18030", "Vitamin C，Vitamin D"), ("euc-kr", "그 책 A권"),
])
def test_ideographs_in_latin_words(charset, text):
    assert readers.decode_bytes(text.encode(charset)) == text


def test_undecodable_bytes():
    assert readers.decode_bytes(None) == "" and readers.decode_bytes(b"\xff\xfe\x00") and readers.decode_bytes(b"plain") == "plain"


def test_paged_source(spark):
    class Shelf(readers.PagedListing):
        def folders(self):
            return ["a", "b"]

        def fetch(self, folder, cursor):
            page = int(cursor or 0)
            return {"items": [{"media_id": f"{folder}{page}", "name": "n"}], "next_cursor": str(page + 1), "is_end": folder == "a" and page == 1}

    spark.dataSource.register(Shelf)
    got = spark.read.format("shelf").option("pages", "3").load()
    assert sorted((r.folder, r.media_id, r.title) for r in got.collect()) == [("a", "a0", None), ("a", "a1", None), ("b", "b0", None), ("b", "b1", None), ("b", "b2", None)]


def test_answers(spark):
    raw = spark.createDataFrame([('{"books": [{"bookInfo": {"bookId": "1", "name": "N", "newRating": 876}}, {"bookInfo": {"bookId": "2", "title": "T"}}]}',), ("broken",)], "json string")
    assert sorted((r.bookId, r.title, r.score) for r in readers.candidates_of(raw).collect()) == [("1", "N", 87.6), ("2", "T", None)]
    ci = spark.createDataFrame([("r", '{"artifacts": [{"id": 1, "name": "a", "size_in_bytes": 5, "expired": true}], "actions_caches": [{"id": 2, "key": "k", "size_in_bytes": 7}]}')], "repo string, json string")
    assert sorted((r.kind, r.name, r.size_in_bytes, r.expired) for r in readers.ci_storage_of(ci).collect()) == [("artifact", "a", 5, True), ("cache", "k", 7, None)]


def test_prepare_and_sinks(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    body = "".join(f"This is sentence {i} of the text and it goes on. " for i in range(30))
    (src / "one.md").write_text(f"# First\n{body}\n# Second\n{body}")
    (src / "bad.mobi").write_bytes(b"x")
    made, chunks, manifests = books.prep(spark, str(src), target=600, overlap=20)
    rows = {r.title: r for r in made.collect()}
    one = rows["one"]
    assert one.language.code == "en" and one.language.forced is False and [c.title for c in one.chapters] == ["First", "Second"] and one.sufficient and one.error is None
    assert "unsupported" in rows["bad"].error and rows["bad"].chapter_count == 0 and not rows["bad"].sufficient
    assert [f.name for f in books.structure(made).schema] == [c.split(" ")[0] for c in schemas.BOOK.replace(", text_file", ", text_file").split(", ") if " " in c][: len(books.structure(made).columns)]
    assert books.extract(readers.read_sections(spark, str(src)), "de").filter("title = 'one'").first().language.asDict()["forced"] is True
    m = manifests.first()
    assert (m.book_title, m.language, m.chunk_count) == ("one", "en", chunks.count()) and [b.chunks for b in m.reading_batches][0] == [1, 2, 3, 4]
    for _ in range(2):  # the second run replaces what the first left
        writers.write_books(made.filter("error is null"), books.structure(made.filter("error is null")), f"{out}/books")
        writers.write_chunks(chunks, manifests, f"{out}/chunks")
    files = sorted(p.name for p in (tmp_path / "out/chunks/chunks/folder=one.md").iterdir())
    assert files == [f"file=chunk_{i:03d}.md" for i in range(1, chunks.count() + 1)]
    text = "".join(p.read_text() for p in (tmp_path / "out/chunks/chunks/folder=one.md/file=chunk_001.md").glob("part-*"))
    assert text.startswith("<!-- chunk 1 | 章节 1: First | 分片 1 | ") and "\n\n# First" in text
    kept = json.loads("".join(p.read_text() for p in (tmp_path / "out/chunks/manifest/folder=one.md").glob("part-*")))
    assert kept["chunk_count"] == m.chunk_count and kept["reading_batches"][0]["chunks"] == [1, 2, 3, 4]
    assert json.loads("".join(p.read_text() for p in (tmp_path / "out/books/structure/folder=one.md").glob("part-*")))["chapter_count"] == 2
    volumes = chapters.chunk_volumes(spark.createDataFrame([(1, "文。" * 50)], "book_id long, text string"), 2)
    writers.write_volume_map(chapters.volume_map(volumes), f"{out}/map")
    assert [x["k"] for x in json.loads(next((tmp_path / "out/map/book=1").glob("part-*")).read_text())["chunks"]] == [1, 2]
    writers.write_candidates(spark.createDataFrame([("1", "新")], "bookId string, status string"), f"{out}/candidates")
    assert spark.read.json(f"{out}/candidates").first().status == "新"
    writers.write_table(chunks, f"{out}/table", "book_id")
    assert spark.read.parquet(f"{out}/table").count() == chunks.count()


def test_finish(spark):
    audio = spark.createDataFrame([(1, "ep01.mp3", 2**20, 65.0), (1, "ep02.mp3", 5, None)], "show_id long, name string, length long, seconds double")
    notes = spark.createDataFrame([(1, "ep01_1-2_a.md", "# Noted")], "show_id long, name string, text string")
    episodes = spark.createDataFrame([("ep01", "1-2", "a", 1)], "id string, chapter_range string, topic string, ord int")
    got = books.finish(audio, notes, episodes, "Show", "me", "en", "https://x", "2024-03-02 10:00:00")
    assert sorted((r.title, r.url) for r in got["items"].collect()) == [("Noted", "https://x/ep01_1-2_a.mp3"), ("ep02", "https://x/ep02.mp3")]
    assert "Noted" in got["feed"].first().xml and "Noted" in got["index"].first().markdown


def test_stream_collect(spark, tmp_path):
    rows = [("u1", "2024-01-01 00:00:00"), ("u1", "2024-01-01 00:10:00"), ("u2", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "url string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in"))
    q = incremental.stream_collect(stream, "url").writeStream.format("memory").queryName("urls").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.url for r in spark.table("urls").collect()) == ["u1", "u2"]


def test_references(spark, tmp_path):
    from corvane.plans import catalog_queries

    page = "<title>a &lt;&amp;amp; b &am</title><h1>c &quot;&amp</h1><p>x &lt; y & z &#39;&gt</p>"
    assert readers.parse_html(page) == ("a <&amp; b &am", "a <&amp; b &am\nc \"&\nx < y & z '>", ['c "&'])
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [tuple(r) for r in catalog_queries.q_html_pages(spark, str(tmp_path)).collect()] == [(1, "a <&amp; b &am", 'c "&amp', len("a <&amp; b &am\nc \"&amp\nx < y & z '&gt"))]
    assert [tuple(r) for r in catalog_queries.q_html_titles(spark, str(tmp_path)).collect()] == [(1, "a &lt;&amp;amp; b &am")]
