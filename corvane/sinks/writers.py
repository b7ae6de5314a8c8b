"""Sinks: canonical Parquet, and exports with the names and forms that readers of the files expect.

Everything is written by Spark's own writers, so a lost task writes its part again and any store
will do. An overwrite replaces what an earlier run left. Exports are partitioned by book or episode:
each has a folder of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """The canonical form."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def json_document(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """key, value: one JSON document per row, without null fields, letters beyond ASCII as they are."""
    return df.select(F.col(key), F.to_json(F.struct(*(columns or [c for c in df.columns if c != key]))).alias("value"))


def write_documents(documents: DataFrame, path: str, key: str) -> None:
    """key, value: a text per key, each under ``path/key=.../``."""
    documents.repartition(key).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def write_books(books: DataFrame, structure: DataFrame, path: str) -> None:
    """The text of each book and its structure."""
    write_documents(books.select(_folder("book_id"), F.col("text").alias("value")), f"{path}/book", "folder")
    write_documents(json_document(structure.withColumn("folder", _folder("source_file")), "folder"), f"{path}/structure", "folder")


def _folder(c: str) -> Column:
    """A path as a folder's name."""
    return F.regexp_replace(F.regexp_replace(c, "^.*/", ""), r"[^\w.-]+", "_").alias("folder")


def chunk_text(chunks: DataFrame) -> Column:
    """A chunk's file: a comment that says where it belongs, a blank line, and its body."""
    head = F.format_string("<!-- chunk %d | 章节 %d: %s | 分片 %d | %d 字 -->", "id", "chapter_index", "chapter_title", "part", "chars")
    return F.concat(head, F.lit("\n\n"), F.col("body"))


def write_chunks(chunks: DataFrame, manifests: DataFrame, path: str) -> None:
    """The chunks' texts and the manifest of each book; what an earlier run left is replaced."""
    texts = chunks.select(_folder("book_id"), "file", chunk_text(chunks).alias("value"))
    texts.repartition("folder").write.mode("overwrite").partitionBy("folder", "file").text(f"{path}/chunks")
    write_documents(json_document(manifests.withColumn("folder", _folder("book_id")), "folder"), f"{path}/manifest", "folder")


def write_volume_map(maps: DataFrame, path: str) -> None:
    """The map of each book's volume chunks."""
    write_documents(json_document(maps.withColumn("book", F.col("book_id")), "book", "chunks"), path, "book")


def write_render_manifests(manifests: DataFrame, path: str) -> None:
    """The render manifest of each episode, whole."""
    write_documents(json_document(manifests.withColumn("episode", F.col("episode_id")), "episode"), path, "episode")


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Candidates as JSON lines."""
    candidates.write.mode("overwrite").json(path)
