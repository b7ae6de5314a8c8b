"""Pages of a book: joining, running heads, sufficiency, readability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PAGES, LEAST_COUNT, SHARE, LONGEST = 6, 3, 0.35, 80
LEAST_CHARS, LEAST_SECTION = 200, 30


def _edge_lines(text: Column) -> tuple[Column, Column]:
    lines = F.filter(F.transform(F.split(text, "\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    return F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(-1))


def running_heads(pages: DataFrame, book_col: str = "book_id", text_col: str = "text") -> DataFrame:
    """book, kind (head, foot), line, n: lines that open or close at least max(3, 35 %) of a book's six or more pages."""
    head, foot = _edge_lines(F.col(text_col))
    edges = pages.select(F.col(book_col).alias("book"), F.explode(F.array(F.struct(F.lit("head").alias("kind"), head.alias("line")), F.struct(F.lit("foot").alias("kind"), foot.alias("line")))).alias("e"))
    counts = edges.select("book", "e.*").filter("line is not null").groupBy("book", "kind", "line").agg(F.count("*").alias("n"))
    sizes = pages.groupBy(F.col(book_col).alias("book")).agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= LEAST_PAGES)
    enough = F.col("n") >= F.greatest(F.lit(float(LEAST_COUNT)), F.col("n_pages") * SHARE)
    return counts.join(sizes, "book").filter(enough & (F.length("line") < LONGEST)).select("book", "kind", "line", "n")


def strip_running_heads(pages: DataFrame, book_col: str = "book_id", text_col: str = "text") -> DataFrame:
    """pages without at most one head and one foot line each."""
    bad = running_heads(pages, book_col, text_col)
    heads = bad.filter("kind = 'head'").select(F.col("book").alias(book_col), F.col("line").alias("_head"), F.lit(1).alias("_has_head"))
    feet = bad.filter("kind = 'foot'").select(F.col("book").alias(book_col), F.col("line").alias("_foot"), F.lit(1).alias("_has_foot"))
    head, foot = _edge_lines(F.col(text_col))
    joined = pages.withColumns({"_head": head, "_foot": foot}).join(heads, [book_col, "_head"], "left").join(feet, [book_col, "_foot"], "left")
    opened = F.regexp_replace(text_col, r"(?d)\A(?:[^\S\n]*\n)*", "")
    opened = F.when(F.col("_has_head") == 1, F.regexp_replace(opened, r"(?d)\A[^\n]*\n?", "")).otherwise(opened)
    closed = F.regexp_replace(opened, r"(?d)(?:\n[^\S\n]*)*\z", "")
    closed = F.when(F.col("_has_foot") == 1, F.regexp_replace(closed, r"(?d)\n?[^\n]*\z", "")).otherwise(closed)
    size = pages.groupBy(book_col).agg(F.count("*").alias("_n"))
    out = joined.join(size, book_col).withColumn(text_col, F.when(F.col("_n") >= LEAST_PAGES, closed).otherwise(F.col(text_col)))
    return out.select(*pages.columns)


def join_pages(pages: DataFrame, book_col: str = "book_id", page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """book_id, text: the non-blank pages in order, with blank lines between."""
    kept = pages.filter(F.col(text_col).rlike(r"(?U)\S"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"), F.col(text_col).alias("t"))))
    return kept.groupBy(book_col).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"))


def sufficiency(books: DataFrame, text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """Adds n_text (characters without outer white space) and sufficient."""
    n = F.length(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return books.withColumns({"n_text": n, "sufficient": n >= least})


def drop_short_sections(sections: DataFrame, text_col: str = "text", least: int = LEAST_SECTION) -> DataFrame:
    return sections.filter(F.length(F.trim(text_col)) >= least)


def known_titles(titles: DataFrame, book_col: str = "book_id", order_col: str = "ord", title_col: str = "title", longest: int = 120) -> DataFrame:
    """The first place of each title that is neither blank nor too long."""
    kept = titles.withColumn(title_col, F.trim(title_col)).filter((F.col(title_col) != "") & (F.length(title_col) <= longest))
    return kept.groupBy(book_col, title_col).agg(F.min(order_col).alias(order_col))


# What a page shows behind a pay wall, and what a readable one shows.
WALL = "试读结束|购买后阅读|开通会员|购买本书|付费阅读"
NAVIGATION = "下一页|下一章|上一页|目录"


def readability(text: Column, wall: str = WALL, navigation: str = NAVIGATION) -> Column:
    return F.when(text.rlike(wall), "试读墙").when(text.rlike(navigation), "可读").otherwise("异常")
