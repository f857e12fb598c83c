"""FB2 books: chapters and segments of the first unnamed body.

A section without sections is a chapter; one with sections is a chapter of its own only for its title and
direct text. Files that are no XML raise, with the path in the message.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements whose text is a segment, a heading, or to be looked into.
TEXT = {"p", "v", "text-author"}
HEADING = {"subtitle"}
INNER = {"epigraph", "cite", "poem", "stanza", "title", "annotation"}
TITLE_CHARS = 80
DECLARED = re.compile(rb"<\?xml[^>]*?encoding\s*=\s*['\"]([^'\"]+)['\"]")


class Chapter(NamedTuple):
    title: str
    segments: list[tuple[str, str]]


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _text(e: ET.Element) -> str:
    return "".join(e.itertext()).strip()


def _blocks(e: ET.Element) -> Iterator[tuple[str, str]]:
    kind = _name(e)
    if kind in TEXT | HEADING:
        yield ("text" if kind in TEXT else "heading"), _text(e)
    elif kind in INNER:
        for child in e:
            yield from _blocks(child)


def _of_section(section: ET.Element) -> tuple[str, list[tuple[str, str]]]:
    """Title and segments of a section, without those of its sections."""
    title, found = "", []
    for child in section:
        if _name(child) == "title":
            title = _text(child)
            found.append(("heading", title))
        elif _name(child) != "section":
            found += _blocks(child)
    return title, [x for x in found if x[1]]


def _sections(section: ET.Element, number: int) -> Iterator[Chapter]:
    """Chapters of a section in order; ``number`` chapters come before."""
    title, segments = _of_section(section)
    inner = [c for c in section if _name(c) == "section"]
    own = title or any(kind == "text" for kind, _ in segments) if inner else segments
    if own:
        # The title of a chapter that has none.
        yield Chapter(title or (segments[0][1][:TITLE_CHARS] if segments else f"第{number + 1}章"), segments)
        number += 1
    for child in inner:
        for chapter in _sections(child, number):
            number += 1
            yield chapter


def parse(data: bytes, path: str) -> tuple[str, list[Chapter]]:
    """Title and chapters of a book."""
    declared = DECLARED.search(data)
    try:
        text = data.decode(declared[1].decode("ascii", "replace") if declared else "utf-8")
    except (UnicodeDecodeError, LookupError):
        text = data.decode("utf-8", "replace")
    try:
        root = ET.fromstring(text.lstrip("﻿"))
    except (ET.ParseError, ValueError) as e:
        raise ValueError(f"{path} is no FB2 file: {e}") from e
    title = PurePosixPath(path).stem
    for info in (e for e in root.iter() if _name(e) == "title-info"):
        title = next(((e.text or "").strip() or title for e in info if _name(e) == "book-title"), title)
    chapters: list[Chapter] = []
    body = next((e for e in root if _name(e) == "body" and not e.get("name")), None)
    if body is not None:
        head = next((e for e in body if _name(e) == "title"), None)
        lines = [t for e in head if _name(e) == "p" and (t := _text(e))] if head is not None else []
        if lines:
            chapters.append(Chapter(lines[-1], [("heading", t) for t in lines]))
        for section in (e for e in body if _name(e) == "section"):
            chapters += _sections(section, len(chapters))
    if not chapters:
        whole = [("text", t) for e in root.iter() if _name(e) == "p" and (t := _text(e))]
        chapters = [Chapter(title, whole)] if whole else []
    return title, chapters


SCHEMA = "path string, title string, chapter int, chapter_title string, seg int, kind string, source string, anchor string"


def read_fb2(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a segment of each book, in order by (path, chapter, seg)."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                title, chapters = parse(data, path)
                rows = [(path, title, c, x.title, i, kind, text, f"tn{c}_{i}") for c, x in enumerate(chapters) for i, (kind, text) in enumerate(x.segments)]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
                cols = list(zip(*rows)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return files.mapInArrow(run, SCHEMA)


def load_books(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a book by its suffix: text, Markdown, FB2 or EPUB; another suffix raises."""
    from .epub import read_epub
    from .plain import read_books

    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".fb2":
        return read_fb2(spark, path)
    if suffix == ".epub":
        return read_epub(spark, path).select("path", "title", F.explode("segments").alias("s")).select("path", "title", "s.*")
    return read_books(spark, path)
