"""Chunks of texts at paragraph and sentence ends, with context of the chunk before, and reading batches."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET, OVERLAP, BATCH = 12_000, 400, 4
PARAGRAPHS, BETWEEN = re.compile(r"\n{2,}"), "\n\n"
# Fixed value: where sentences end.
SENTENCE = re.compile(r"(?<=[。！？!?；;…])\s*|(?<=[.!?])\s+(?=[A-Z\"'“])")
CJK = re.compile(r"[、-〿぀-ヿ㐀-鿿가-힯豈-﫿！-｠\U00020000-\U0003ffff]")
TO_LETTER = re.compile(r"[\W\d_]*[^\W\d_]?")


def joint(before: str, after: str) -> str:
    """What joins two sentences: nothing where the last letter before, the first after or what lies between is CJK, else a space."""
    return "" if CJK.search(TO_LETTER.match(before[::-1])[0]) or CJK.search(TO_LETTER.match(after)[0]) else " "


def packed(sizes: list[int], between: Callable[[int], int], target: int) -> list[tuple[int, int]]:
    """Ranges of items, each as many as fit into target; between(k): the size of what joins item k to the one before."""
    ranges, begin, size = [], 0, 0
    for k, n in enumerate(sizes):
        more = n + (between(k) if k > begin else 0)
        if k > begin and size + more > target:
            ranges.append((begin, k))
            begin, size, more = k, 0, n
        size += more
    return [*ranges, (begin, len(sizes))] if sizes else []


def sentence_pieces(paragraph: str, target: int, glue: str | None) -> list[str]:
    """A paragraph's sentences gathered up to the target, each piece with what joins them."""
    sentences = [s for s in SENTENCE.split(paragraph) if s.strip()]
    joints = ["" if k == 0 else joint(sentences[k - 1], sentences[k]) if glue is None else glue for k in range(len(sentences))]
    ranges = packed([len(s) for s in sentences], lambda k: len(joints[k]), target)
    return [sentences[a] + "".join(joints[k] + sentences[k] for k in range(a + 1, b)) for a, b in ranges]


def pieces_of(text: str, target: int, glue: str | None = None) -> list[str]:
    """Paragraphs gathered up to target characters; a longer paragraph is gathered by sentences.

    glue joins sentences (default: a space unless Chinese, Japanese or Korean meets the joint). A
    sentence over the target is a piece of its own; a paragraph that fits behind the last sentences
    of a longer one joins them.
    """
    if len(text) <= target:
        return [text]
    items: list[tuple[str, int]] = []  # pieces, and the size of what joins each to the one before
    for paragraph in filter(None, map(str.strip, PARAGRAPHS.split(text))):
        if len(paragraph) <= target:
            items.append((paragraph, len(BETWEEN)))
        else:
            items += [(piece, target) for piece in sentence_pieces(paragraph, target, glue)]  # these join nothing before them
    ranges = packed([len(x) for x, _ in items], lambda k: items[k][1], target)
    return [BETWEEN.join(x for x, _ in items[a:b]) for a, b in ranges] or [text]


def chunk(chapters: DataFrame, target: int = TARGET, overlap: int = OVERLAP, batch: int = BATCH, glue: str | None = None) -> DataFrame:
    """book_id, id, chapter_index, chapter_title, part, parts_in_chapter, batch, file, chars, is_oversize, preview, body.

    chapters: book_id, index, title, body. Each chunk but a chapter's first starts with the last
    ``overlap`` characters of the piece before it.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces_of(t or "", target, glue) for t in texts], dtype=object)

    parts = chapters.select("book_id", F.col("index").alias("chapter_index"), F.col("title").alias("chapter_title"), F.posexplode(split(F.col("body"))).alias("place", "piece"))
    chapter = W.partitionBy("book_id", "chapter_index")
    before = F.lag("piece").over(chapter.orderBy("place"))
    context = F.when(before.isNotNull() & F.lit(overlap > 0), F.concat(F.lit("…"), F.right(before, F.lit(overlap)), F.lit("\n\n"))).otherwise("")
    number = F.row_number().over(W.partitionBy("book_id").orderBy("chapter_index", "place"))
    out = parts.select(
        "book_id", number.alias("id"), "chapter_index", "chapter_title", (F.col("place") + 1).alias("part"),
        F.count("*").over(chapter).alias("parts_in_chapter"), (F.length("piece") > target).alias("is_oversize"), F.concat(context, F.col("piece")).alias("body"),
    )
    preview = F.substring(F.regexp_replace(F.substring("body", 1, 100), r"(?U)\s+", " "), 1, 100)
    return out.withColumns({"batch": F.floor((F.col("id") - 1) / batch).cast("int") + 1, "file": F.format_string("chunk_%03d.md", "id"), "chars": F.length("body"), "preview": preview})


def reading_batches(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("book_id", "batch").agg(F.sort_array(F.collect_list("id")).alias("chunks"), F.sum("chars").alias("chars"))


def manifest(chunks: DataFrame, target: int = TARGET, books: DataFrame | None = None) -> DataFrame:
    """One row per book: counts, its reading batches and its chunks in order, as nested columns.

    With books (book_id, title, language: a struct with its code) also the book's title and language.
    """
    each = F.struct("id", "file", "chapter_index", "chapter_title", "part", "chars", "preview", "parts_in_chapter")
    out = chunks.groupBy("book_id").agg(
        F.sum("chars").alias("total_chars"), F.count("*").alias("chunk_count"), F.lit(target).alias("target_chars"),
        F.max("batch").alias("batch_count"), F.sort_array(F.collect_list(each)).alias("chunks"),
    )
    batches = reading_batches(chunks).groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("batch", "chunks"))).alias("reading_batches"))
    out = out.join(batches, "book_id")
    return out if books is None else out.join(books.select("book_id", F.col("title").alias("book_title"), F.col("language.code").alias("language")), "book_id")
