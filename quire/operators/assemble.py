"""Segments back to books: paragraphs, texts, pages, EPUB files."""

from __future__ import annotations

import zipfile
from html import escape
from io import BytesIO

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import epub_language, is_blank, number_heading
from ..sources.markup import filled


def shown(source: Column, target: Column) -> Column:
    """The target, or the source where there is none."""
    return F.when(is_blank(target), source).otherwise(target)


def paragraphs(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, par, kind, target, source): continued segments joined to the paragraph before them.

    Blank sources go; untranslated segments show their source; numbers of headings become Chinese.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = segments.where(~is_blank(F.col("source"))).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    d = d.withColumn("par", F.sum(F.when(F.coalesce(F.col("cont"), F.lit(False)) & (F.col("_n") > 1), 0).otherwise(1)).over(w).cast("int") - 1)
    part = F.struct("_n", shown(F.col("source"), F.col("target")).alias("t"), F.col("source").alias("s"), "kind")
    d = d.groupBy(*keys, "par").agg(F.array_sort(F.collect_list(part)).alias("p"))
    joined = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "")
    kind = F.col("p")[0]["kind"]
    return d.select(*keys, "par", kind.alias("kind"), F.when(kind == "heading", number_heading(joined("t"))).otherwise(joined("t")).alias("target"), joined("s").alias("source"))


def bilingual_source(source: Column, target: Column) -> Column:
    """The source, empty where it is blank or the target repeats it."""
    return F.when(is_blank(source) | (source == target), "").otherwise(source)


def texts(pars: DataFrame, book: str, chapter: str, bilingual: bool = False, source_first: bool = False) -> DataFrame:
    """(book, text): a book's paragraphs and chapters with blank lines between, and a line feed at the end."""
    source = bilingual_source(F.col("source"), F.col("target")) if bilingual else F.lit("")
    both = F.array(source, F.col("target")) if source_first else F.array(F.col("target"), source)
    said = F.when((F.col("kind") != "heading") & (source != ""), F.array_join(both, "\n\n")).otherwise(F.col("target"))
    rows = pars.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(chapter, "par", said.alias("t")))).alias("p"))
    return rows.select(book, F.concat(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("text"))


def out_name(source_path: Column, kind: str, bilingual: bool = False) -> Column:
    """The name of a book's output beside its source: .zh or .zh-bi before the suffix."""
    return F.concat(F.regexp_replace(source_path, r"(?<=[^/])\.[^./]*\z", ""), F.lit((".zh-bi" if bilingual else ".zh") + (".epub" if kind == "epub" else ".txt")))


def bilingual_name(out: Column) -> Column:
    """An explicit name of a book's output, with -bi before the suffix."""
    return F.concat(F.regexp_replace(out, r"(?<=[^/])\.[^./]*\z", ""), F.lit("-bi"), F.regexp_extract(out, r"(?<=[^/])(\.[^./]*)\z", 1))


def filled_pages(resources: DataFrame, segments: DataFrame, bilingual: bool = False, source_first: bool = False) -> DataFrame:
    """(book, href, html): marked pages with their targets; continued segments belong to the anchor before them.

    ``resources``: (book, href, template); ``segments``: (book, resource_href, pos, anchor, source, target).
    Pages without a segment come back as they are, without marks.
    """
    w = Window.partitionBy("book", "resource_href").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = segments.withColumn("anchor", F.last("anchor", ignorenulls=True).over(w))
    part = F.struct("pos", shown(F.col("source"), F.col("target")).alias("t"), F.col("source").alias("s"))
    d = d.groupBy("book", F.col("resource_href").alias("href"), "anchor").agg(F.array_sort(F.collect_list(part)).alias("p"))
    joined = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "")
    d = d.groupBy("book", "href").agg(F.collect_list(F.struct("anchor", joined("t").alias("t"), bilingual_source(joined("s"), joined("t")).alias("s"))).alias("blocks"))

    @F.udf("string", useArrow=True)
    def page(template, blocks):
        blocks = blocks or []
        sources = {b["anchor"]: b["s"] for b in blocks if b["s"]} if bilingual else None
        return filled(template, {b["anchor"]: b["t"] for b in blocks}, sources, source_first)

    return resources.join(d, ["book", "href"], "left").select("book", "href", page("template", "blocks").alias("html"))


def new_epubs(pars: DataFrame, titles: DataFrame, book: str, chapter: str, bilingual: bool = False, source_first: bool = False) -> DataFrame:
    """(book, epub binary): books made anew of their paragraphs, a page a chapter.

    ``titles``: (book, title, lang). One book is one row, as it is one file.
    """
    source = bilingual_source(F.col("source"), F.col("target")) if bilingual else F.lit("")
    rows = pars.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(F.col(chapter).alias("c"), "par", "kind", "target", source.alias("source")))).alias("p"))

    @F.udf("binary", useArrow=True)
    def made(title, lang, parts):
        return epub_bytes(title or "", lang, [tuple(p[k] for k in ("c", "kind", "target", "source")) for p in parts or []], source_first)

    return titles.join(rows, book, "left").select(book, made("title", epub_language(F.col("lang")), "p").alias("epub"))


def epub_bytes(title: str, lang: str, parts: list[tuple], source_first: bool = False) -> bytes:
    """An EPUB file of (chapter, kind, target, source); the same input gives the same bytes."""
    pages: dict = {}
    for chapter, kind, target, source in parts:
        pages.setdefault(chapter, []).append((kind, target, source))
    head = lambda t: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="{escape(lang)}"><head><title>{escape(t)}</title></head><body>'
    files, toc = {}, []
    for k, blocks in enumerate(pages.values()):
        body = []
        for kind, target, source in blocks:
            tag = "h1" if kind == "heading" else "p"
            two = [f"<{tag}>{escape(target)}</{tag}>"] + ([f'<p class="tn-source">{escape(source)}</p>'] if source and kind != "heading" else [])
            body += two[::-1] if source_first else two
        name = next((t for kind, t, _ in blocks if kind == "heading"), f"{k + 1}")
        toc.append(f'<li><a href="c{k}.xhtml">{escape(name)}</a></li>')
        files[f"c{k}.xhtml"] = head(name) + "".join(body) + "</body></html>"
    files["nav.xhtml"] = head(title) + f'<nav epub:type="toc"><ol>{"".join(toc)}</ol></nav></body></html>'
    items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"{" properties=" + chr(34) + "nav" + chr(34) if n == "nav.xhtml" else ""}/>' for k, n in enumerate(files))
    spine = "".join(f'<itemref idref="i{k}"/>' for k, n in enumerate(files) if n != "nav.xhtml")
    files["book.opf"] = (
        f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{escape(lang)}</dc:language></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    )
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        put = lambda name, text, how: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, how)
        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", '<?xml version="1.0"?>\n<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>', zipfile.ZIP_DEFLATED)
        for name, text in files.items():
            put(f"OEBPS/{name}", text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_texts(books: DataFrame, path: str, book: str = "book", text: str = "text") -> None:
    """A folder a book below ``path`` with its text as one file, by Spark's own commit."""
    books.select(book, text).write.partitionBy(book).mode("overwrite").option("lineSep", "").text(path)
