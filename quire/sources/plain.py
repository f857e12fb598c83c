"""Plain-text and Markdown books: one file a book, headings start chapters, blank lines end paragraphs."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, is_blank, py_strip

SUFFIXES = (".txt", ".md", ".markdown", ".text")
#: Line breaks as str.splitlines knows them, and chapter marks at the start of a line.
LINE_BREAK = r"\r\n|[\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
CHAPTER_MARK = "(?:第[0-9０-９一二三四五六七八九十百千]+[章話节節回部巻]|序章|終章|序幕|終幕|プロローグ|エピローグ|あとがき|まえがき)"


def heading_of(line: Column) -> Column:
    """Title of a heading line (one to three hashes, or a chapter mark); null for other lines."""
    title = py_strip(F.regexp_extract(line, rf"^#{{1,3}}{BLANK}([\s\S]*)$", 1))
    return F.when(title != "", title).when(line.rlike(f"^{BLANK}*{CHAPTER_MARK}"), py_strip(line))


def paragraphs(body: Column) -> Column:
    """Parts between blank lines, without line feeds at their ends; blank parts go."""
    parts = F.filter(F.split(body, rf"\n{BLANK}*\n"), lambda p: ~is_blank(p))
    return F.transform(parts, lambda p: F.regexp_replace(p, r"^\n+|\n+\z", ""))


def segments(books: DataFrame, key: str, text: str, name: Column) -> DataFrame:
    """Segments of books: key, chapter, title, seg, kind ('heading' or 'text'), source.

    Text before the first heading is a chapter under the book's name, without a heading segment.
    A chapter without segments gives no row but keeps its number. Null or empty text: no rows.
    """
    found = F.split(text, LINE_BREAK)
    found = F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)
    rows = books.select(key, name.alias("book"), F.posexplode(found).alias("pos", "line")).withColumn("head", heading_of(F.col("line")))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("no", F.count("head").over(so_far)).withColumn("chapter", (F.col("no") - F.min("no").over(so_far)).cast("int"))
    body = F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("pos", "line"))))
    got = rows.groupBy(key, "chapter").agg(F.max("head").alias("head"), F.first("book").alias("book"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("body"))
    item = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("source"))
    texts = F.transform(paragraphs(F.col("body")), lambda p: item("text", p))
    every = F.when(F.col("head").isNotNull(), F.concat(F.array(item("heading", F.col("head"))), texts)).otherwise(texts)
    out = got.select(key, "chapter", F.coalesce("head", "book").alias("title"), F.posexplode(every).alias("seg", "x"))
    return out.select(key, "chapter", "title", "seg", "x.kind", "x.source")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Segments of the text or Markdown files at ``path`` (UTF-8), keyed by ``path``."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix and suffix not in SUFFIXES:
        raise ValueError(f"no reader for {suffix} files")
    books = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")
    known = F.lower("file").rlike("(" + "|".join(SUFFIXES).replace(".", r"\.") + r")\z")
    return segments(books.where(known), "path", "value", F.regexp_replace("file", r"(?<=.)\.[^.]*\z", ""))
