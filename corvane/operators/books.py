"""Whole steps over books: extract, prepare, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import text as T
from corvane.operators import chapters, chunking, pages, publish
from corvane.scratch import settled
from corvane.sources import readers


def extract(sections: DataFrame, language: str | None = None) -> DataFrame:
    """A row per file of read_sections: book_id (its path), title, author, language, text, chapters, counts, sufficient, error.

    Running heads of paged formats go, sections are joined, the language is found (or forced), the
    text cleaned and cut into chapters by its outline or its headings. A file that can't be read
    keeps its error and has no text.
    """
    good = sections.filter("error is null")
    paged, whole = good.filter("format = 'pdf'"), good.filter("format <> 'pdf'")
    kept = pages.strip_running_heads(paged, "path").unionByName(whole)
    joined = pages.join_pages(kept, "path", "section_no")
    about = sections.groupBy("path").agg(
        F.max("format").alias("format"), F.max("book_title").alias("book_title"), F.max("author").alias("author"), F.max_by("outline", F.when(F.col("outline").isNotNull(), 1)).alias("outline"), F.max("error").alias("error"),
    )
    found = T.detect_language(F.col("text"))
    if language:
        found = T.forced_language(found, language)
    else:
        found = T.with_field(found, "forced", F.lit(False))
    stem = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]*$", "")
    books = about.join(joined, "path", "left").withColumn("raw", F.coalesce("text", F.lit(""))).withColumn("language", found)
    # written once: chapters, structure and chunks all read it
    clean = settled(books.withColumn("text", T.clean_text(F.col("raw"), F.col("language.code"))))
    marked = pages.sufficiency(clean).withColumn("chapters", F.when(F.col("text") != "", chapters.detect_chapters(F.col("text"), F.col("outline"))))
    return marked.select(
        F.col("path").alias("book_id"), F.col("path").alias("source_file"), "format", T.first_present(F.col("book_title"), stem).alias("title"), F.coalesce(F.trim("author"), F.lit("")).alias("author"),
        "language", F.length("text").alias("total_chars"), T.reading_minutes(F.col("text"), F.col("language.code")).alias("est_read_minutes"),
        F.coalesce(F.size("chapters"), F.lit(0)).alias("chapter_count"), F.coalesce("chapters", F.array().cast(f"array<{schemas.CHAPTER}>")).alias("chapters"), "text", "sufficient", "error",
    )


def chapter_rows(books: DataFrame) -> DataFrame:
    """book_id, index, title, body of the chapters of extract's books that have text."""
    each = books.select("book_id", "text", F.explode("chapters").alias("c"))
    body = F.regexp_replace(F.substring("text", F.col("c.start") + 1, F.col("c.chars")), r"(?U)^\s+|\s+$", "")
    return each.select("book_id", "c.index", "c.title", body.alias("body")).filter("body <> ''")


def structure(books: DataFrame) -> DataFrame:
    """schemas.BOOK rows of extract's books, with the name of the text file."""
    return books.select("source_file", "format", "title", "author", "language", "total_chars", "est_read_minutes", "chapter_count", "chapters", F.concat("book_id", F.lit(".txt")).alias("text_file"))


def prep(spark: SparkSession, path: str, target: int = chunking.TARGET, overlap: int = chunking.OVERLAP, language: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books, chunks and manifests of all files under path."""
    books = extract(readers.read_sections(spark, path), language)
    chunks = chunking.chunk(chapter_rows(books), target, overlap)
    return books, chunks, chunking.manifest(chunks, target, books)


def finish(audio: DataFrame, notes: DataFrame, episodes: DataFrame, show: str, author: str, language: str, base_url: str, now: str) -> dict[str, DataFrame]:
    """What is published of audio (show_id, name, length, seconds): new names, items, the feed and the index of each show."""
    named = publish.name_by_chapter(audio, episodes)
    renamed = named.withColumn("name", F.col("new_name")).drop("new_name", "ep")
    items = publish.feed_items(publish.with_notes(renamed, notes), show, base_url, now)
    return {"names": named.select("show_id", "name", "new_name"), "items": items, "feed": publish.feed_xml(items, show, author, language), "index": publish.index_page(items, show)}
