"""Readers: files of several formats to sections (path, section_no, title, text), and JSON documents.

Binary formats come through Spark's binaryFile source, so any store that Spark reads will do; the
bytes are parsed in Arrow-batched Python with the standard library alone.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane import schemas
from corvane.functions import text as T

SECTIONS = "path string, format string, section_no int, title string, text string, book_title string, author string, outline array<string>, error string"
# Charsets of text that isn't UTF-8, in the order that settles ties; for each the first bytes of its frequent
# characters (punctuation, and the letters or the first level of ideographs), and the stricter charset that has all of these.
CHARSETS = {
    "gb18030": ("gb2312", [(0xA1, 0xA3), (0xB0, 0xD7)]),
    "big5": ("big5", [(0xA1, 0xA2), (0xA4, 0xC6)]),
    "shift_jis": ("shift_jis", [(0x81, 0x83), (0x88, 0x97)]),
    "euc-kr": ("euc-kr", [(0xA1, 0xA1), (0xB0, 0xC8)]),
    "cp1251": ("cp1251", [(0x97, 0x97), (0xAB, 0xAB), (0xB8, 0xB8), (0xBB, 0xBB), (0xE0, 0xFF)]),
    "latin-1": ("latin-1", [(0xA1, 0xA1), (0xAB, 0xAB), (0xBB, 0xBB), (0xBF, 0xFF)]),
}
#: Characters beyond ASCII without another one beside them, and the weight of those that look like a part of a Latin word.
ALONE, DOUBTFUL = re.compile(r"(?<![^\x00-\x7f])[^\x00-\x7f](?![^\x00-\x7f])"), 0.1
DROPPED = {"script", "style", "nav", "footer"}
#: The ampersands that stay as they are when all references become characters as in browsers (also some that end without
#: a semicolon), when closed ones do, and when none does.
REFERENCES = {"all": re.compile(r"(?!)"), "closed": re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)"), "none": re.compile("&")}


def _in_latin_words(text: str, strict: str) -> Counter:
    """The ideographs that stand alone at a Latin letter, or whose second byte is one: so looks an accented letter with its neighbour."""
    out = Counter()
    for m in ALONE.finditer(text):
        around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        if m[0].isalpha() and (any(c.isalpha() for c in around) or m[0].encode(strict, "ignore")[1:].isalpha()):
            out[m[0]] += 1
    return out


def _plausibility(text: str, strict: str, ranges: list[tuple[int, int]]) -> float:
    """The share of frequent characters among those beyond ASCII; ideographs in Latin words have little weight."""
    counts = Counter(c for c in text if c > "\x7f")
    wide = strict not in ("cp1251", "latin-1")
    doubtful = _in_latin_words(text, strict) if wide else Counter()
    frequent = 0
    for c, n in counts.items():
        try:
            lead = c.encode(strict)[0]
        except UnicodeEncodeError:
            continue
        frequent += (n - doubtful[c] * (1 - DOUBTFUL)) * any(lo <= lead <= hi for lo, hi in ranges)
    letters = sum(n for c, n in counts.items() if c.isalpha())
    # single bytes above ASCII are rare in Latin text, and Cyrillic text is made of them
    mixed = sum(c.isascii() and c.isalpha() for c in text)
    if strict == "latin-1" and letters > mixed or strict == "cp1251" and letters < mixed:
        return 0.0
    return frequent / max(1, sum(counts.values())) * (1.0 if wide else 0.9)


def decode_bytes(raw: bytes | None) -> str:
    """UTF-8 without its mark, else the charset that fits and whose characters are the most plausible ones."""
    raw = raw or b""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    best, text = -1.0, None
    for charset, (strict, ranges) in CHARSETS.items():
        try:
            found = raw.decode(charset)
        except UnicodeDecodeError:
            continue
        score = _plausibility(found, strict, ranges)
        # all frequent syllables of Korean have first bytes of Chinese ideographs as well; Korean parts words by spaces
        if score > best or (score == best and charset == "euc-kr" and " " in found):
            best, text = score, found
    return text if text is not None else raw.decode("utf-8", "replace")


class _Html(HTMLParser):
    def __init__(self, dropped: set[str], heads: set[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.heads = dropped, heads
        self.skip, self.open, self.texts, self.titles, self.title = 0, None, [], [], ""

    def handle_starttag(self, tag, attrs):
        if tag in self.dropped:
            self.skip += 1
        elif tag == "title" or tag in self.heads:
            self.open = (tag, [])

    def handle_endtag(self, tag):
        if tag in self.dropped:
            self.skip = max(0, self.skip - 1)
        elif self.open and self.open[0] == tag:
            text = " ".join("".join(self.open[1]).split())
            if tag == "title":
                self.title = self.title or text
            elif text:
                self.titles.append(text)
            self.open = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.open:
            self.open[1].append(data)
        if data.strip():
            self.texts.append(data.strip())


def parse_html(html: str | None, dropped: set[str] = DROPPED, heads: tuple[str, ...] = ("h1", "h2"), references: str = "all") -> tuple[str, str, list[str]]:
    """(title, text with a line per text node, headings). references: those to characters that become them (see REFERENCES)."""
    parser = _Html(dropped, set(heads))
    parser.feed(REFERENCES[references].sub("&amp;", html or ""))
    parser.close()
    return parser.title, "\n".join(parser.texts), parser.titles


HTML = S.StructType([S.StructField("title", S.StringType()), S.StructField("text", S.StringType()), S.StructField("headings", S.ArrayType(S.StringType()))])


def html_parts(html: Column | str, references: str = "all") -> Column:
    """title, text and headings of each page, as parse_html has them."""

    @F.pandas_udf(HTML)
    def parts(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_html(h, references=references) for h in html], columns=["title", "text", "headings"])

    return parts(html)


@F.pandas_udf(S.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(decode_bytes)


def _stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


class Section(NamedTuple):
    """A section; the file's title, author and outline stand with its first one."""

    title: str
    text: str
    book_title: str | None = None
    author: str | None = None
    outline: list[str] | None = None


def _read_text(path: str, raw: bytes) -> Iterator[Section]:
    yield Section(_stem(path), decode_bytes(raw))


def _read_html(path: str, raw: bytes) -> Iterator[Section]:
    title, text, heads = parse_html(decode_bytes(raw))
    yield Section(title or _stem(path), text, title or None, None, heads)


def _read_epub(path: str, raw: bytes, least: int = 30) -> Iterator[Section]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("}rootfile"))
        package, folder = ElementTree.fromstring(z.read(opf)), opf.rpartition("/")[0]
        files = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if e.tag.endswith("}item")}
        about = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in reversed(list(package.iter())) if "purl.org/dc/" in e.tag}
        sections = []
        for ref in (e for e in package.iter() if e.tag.endswith("}itemref")):
            name = "/".join(filter(None, [folder, files[ref.attrib["idref"]]]))
            _, text, heads = parse_html(decode_bytes(z.read(name)), {"script", "style"}, ("h1", "h2", "h3"))
            title = heads[0] if heads else ""
            if len(text) >= least:
                sections.append(Section(title, text if not title or title in text else f"{title}\n\n{text}"))
    if sections:
        first = Section(sections[0].title, sections[0].text, about.get("title") or None, about.get("creator") or None, [s.title for s in sections if s.title])
        yield from [first, *sections[1:]]


def _read_docx(path: str, raw: bytes) -> Iterator[Section]:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    about = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        if "docProps/core.xml" in z.namelist():
            about = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in ElementTree.fromstring(z.read("docProps/core.xml")).iter()}
    lines, titles = [], []
    for p in body.iter(f"{w}p"):
        text = "".join(t.text or "" for t in p.iter(f"{w}t"))
        style = next((s.attrib.get(f"{w}val", "") for s in p.iter(f"{w}pStyle")), "").lower()
        if text.strip():
            lines.append(text)
            if style.startswith("heading") or style in ("title", "subtitle"):
                titles.append(text.strip())
    yield Section(titles[0] if titles else _stem(path), "\n".join(lines), about.get("title") or None, about.get("creator") or None, titles)


def _outline_titles(entries: list) -> Iterator[str]:
    """The titles of a nested outline in reading order; an entry without a title is skipped."""
    for e in entries:
        if isinstance(e, list):
            yield from _outline_titles(e)
        elif title := str(getattr(e, "title", "") or "").strip():
            yield title


def _read_pdf(path: str, raw: bytes) -> Iterator[Section]:
    from pypdf import PdfReader  # an optional plug-in

    reader = PdfReader(io.BytesIO(raw))
    if reader.is_encrypted:
        reader.decrypt("")
    about = reader.metadata or {}
    try:
        outline = list(_outline_titles(reader.outline))
    except Exception:  # noqa: BLE001  a broken outline is none
        outline = []
    own = str(about.get("/Title") or "").strip() or None, str(about.get("/Author") or "").strip() or None, outline
    for k, page in enumerate(reader.pages):
        try:
            text = page.extract_text() or ""
        except Exception:  # noqa: BLE001  a page that fails stays, without text
            text = ""
        yield Section("", text, *(own if k == 0 else ()))


#: Readers by extension; more can be registered, also ones that give (title, text).
READERS: dict[str, Callable[[str, bytes], Iterator[tuple]]] = {
    **dict.fromkeys(["txt", "md", "markdown", "rtf"], _read_text), **dict.fromkeys(["html", "htm", "xhtml"], _read_html),
    "epub": _read_epub, "docx": _read_docx, "pdf": _read_pdf,
}


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """SECTIONS of all files under path; an unknown or broken file gives one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    readers = dict(READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                kind = name.rpartition(".")[2].lower()
                try:
                    if kind not in readers:
                        raise ValueError(f"unsupported format .{kind}")
                    rows += [(name, kind, i + 1, *Section(*found), None) for i, found in enumerate(readers[kind](name, bytes(raw)))]
                except Exception as e:  # noqa: BLE001  one file's fault is that file's row
                    rows.append((name, kind, None, *[None] * 5, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SECTIONS.split(", ")])
            yield out.astype({"section_no": "Int32"})

    return files.mapInPandas(run, SECTIONS)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("title")).filter("title <> ''")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON under an explicit schema; what doesn't parse is kept in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episodes from files that hold an array of them, or an object with it under ``episodes``."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    wrapped = F.try_variant_get("v", "$.episodes", "variant")
    rows = raw.select(F.to_json(F.coalesce(wrapped, F.col("v"))).alias("j"))
    return rows.select(F.explode(F.from_json("j", f"array<struct<{', '.join(f'{a}:{b}' for a, b in (c.split(' ', 1) for c in schemas.EPISODE.split(', ')))}>>")).alias("e")).select("e.*")


def image_urls(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, url: distinct image addresses without inline data."""
    found = F.regexp_extract_all(html_col, F.lit(r'<img[^>]*\ssrc="([^"]+)"'), F.lit(1))
    return pages.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(found)).alias("url")).filter(~F.startswith("url", F.lit("data:")))


def voice_catalogue(voices: DataFrame, prefix: str = "") -> DataFrame:
    return voices.filter(F.startswith(F.lower("Locale"), F.lit(prefix.lower()))).orderBy("Locale", "ShortName")


def cursor_pages(fetch: Callable[[str], dict], limit: int = 100, first_retries: int = 1) -> Iterator[dict]:
    """Items of a paged listing until its end, a blank cursor or the limit of pages; a blank first page is asked for again."""
    cursor = ""
    for page in range(limit):
        answer = fetch(cursor)
        for _ in range(first_retries if page == 0 else 0):
            if not answer.get("items"):
                answer = fetch(cursor)
        yield from answer.get("items") or []
        cursor = answer.get("next_cursor") or ""
        if answer.get("is_end") or not cursor:
            return


class PagedListing(DataSource):
    """A listing by cursor as a Spark source: subclasses say what to list (``folders``) and how to ask (``fetch``).

    Each folder is a partition; executors page through it until its end, a blank cursor or the limit.
    """

    @classmethod
    def name(cls) -> str:
        return cls.__name__.lower()

    def schema(self) -> str:
        return f"folder string, {schemas.KB_ITEM}"

    def folders(self) -> list[str]:
        raise NotImplementedError

    def fetch(self, folder: str, cursor: str) -> dict:
        """{"items": [...], "next_cursor": str, "is_end": bool}"""
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self, [f.name for f in schema.fields][1:])


class _PagedReader(DataSourceReader):
    def __init__(self, source: PagedListing, fields: list[str]):
        self.source, self.fields, self.limit = source, fields, int(source.options.get("pages", "100"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.source.folders()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder = partition.value
        for item in cursor_pages(lambda cursor: self.source.fetch(folder, cursor), self.limit):
            yield (folder, *(None if item.get(f) is None else str(item[f]) for f in self.fields))


def candidates_of(raw: DataFrame, json_col: str = "json", limit: int = 20) -> DataFrame:
    """CANDIDATE rows of search answers (``{"books": [{"bookInfo": {...}}]}``), the first ``limit`` of each; title falls back to name.

    An answer that can't be read gives none.
    """
    book = "struct<bookId:string,title:string,name:string,author:string,publisher:string,price:double,newRating:double,newRatingTitle:string,intro:string>"
    found = F.from_json(json_col, f"struct<books:array<struct<bookInfo:{book}>>>")["books"]
    each = raw.select(F.explode(F.slice(found, 1, limit)).alias("b")).select("b.bookInfo.*").filter("bookId is not null")
    return each.select("bookId", T.first_present(F.col("title"), F.col("name")).alias("title"), "author", "publisher", "price", T.score_of(F.col("newRating")).alias("score"), F.col("newRatingTitle").alias("label"), "intro")


def shelf_of(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """bookId of the books of shelf answers (``{"books": [...]}``); a failed answer is an empty shelf."""
    return raw.select(F.explode(F.from_json(json_col, "struct<books:array<struct<bookId:string>>>")["books"]).alias("b")).select("b.bookId").filter("bookId is not null").distinct()


def ci_storage_of(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Caches and artifacts (repo, kind, id, name, size_in_bytes, expired, created_at) of a repository's listings (repo, json)."""
    one = "struct<id:bigint,name:string,key:string,size_in_bytes:bigint,expired:boolean,created_at:timestamp>"
    parsed = F.from_json(json_col, f"struct<actions_caches:array<{one}>,artifacts:array<{one}>>")
    kinds = F.array(F.struct(F.lit("cache").alias("kind"), parsed["actions_caches"].alias("rows")), F.struct(F.lit("artifact").alias("kind"), parsed["artifacts"].alias("rows")))
    each = raw.select("repo", F.explode(kinds).alias("k")).select("repo", "k.kind", F.explode("k.rows").alias("r"))
    return each.select("repo", "kind", "r.id", F.coalesce("r.name", "r.key").alias("name"), "r.size_in_bytes", "r.expired", "r.created_at")
