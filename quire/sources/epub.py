"""EPUB books: one row a book with its segments, table of contents and fragments, ready to be exploded."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from io import BytesIO
from typing import NamedTuple
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from .markup import Node, Page, annotate, nav_list, nav_scopes

HTML = (".xhtml", ".html", ".htm")
NCX_TYPE = "application/x-dtbncx+xml"
DECLARED = re.compile(rb"(?:<\?xml[^>]*?encoding\s*=\s*['\"]|<meta[^>]*?charset\s*=\s*['\"]?)([\w.:-]+)", re.I)

SEGMENT = "struct<resource:int,seg:int,kind:string,source:string,anchor:string,resource_href:string,inline:array<struct<id:string,tag:string,offset:int,placement:string>>>"
ENTRY = "struct<toc_path:string,toc_order:int,node_index:int,node_id:string,parent_index:int,depth:int,kind:string,title:string,raw_href:string,resource_href:string,fragment:string,target_key:string,external:boolean>"
SCHEMA = (
    f"path string, title string, opf_path string, toc_paths array<string>, resources array<struct<resource:int,href:string,title:string,n:int,template:string>>, "
    f"segments array<{SEGMENT}>, toc array<{ENTRY}>, fragments array<struct<href:string,fragment:string,anchor:string>>"
)


class Href(NamedTuple):
    resource: str
    fragment: str
    external: bool


def resolve(base: str, raw: str) -> Href:
    """A link of the file ``base``: percent signs decoded, plus signs kept, relative to the file's folder."""
    url = urlsplit(raw or "")
    fragment = unquote(url.fragment)
    if url.scheme or url.netloc:
        return Href("", fragment, True)
    path = unquote(url.path)
    if path.startswith("/"):
        path = path.lstrip("/")
    else:
        path = posixpath.join(posixpath.dirname(base), path) if path else base
    path = posixpath.normpath(path)
    return Href("" if path == "." else path, fragment, False)


def _name(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def opf_path(container: bytes) -> str:
    for e in ET.fromstring(container).iter():
        if _name(e.tag) == "rootfile" and e.get("full-path", "").strip():
            return e.get("full-path").strip()
    raise ValueError("the container names no package file")


def package(opf: bytes, path: str) -> tuple[str, list[str], list[str]]:
    """Title, pages in reading order, and tables of contents: nav documents, then the spine's, then other NCX files."""
    every = list(ET.fromstring(opf).iter())
    named = lambda n: [e for e in every if _name(e.tag) == n]
    items = {e.get("id").strip(): e for e in named("item") if e.get("id", "").strip()}
    to = lambda e: resolve(path, e.get("href", "")).resource
    title = next((e.text.strip() for e in named("title") if e.text), "")
    spine = [items[i] for e in named("itemref") if (i := e.get("idref", "").strip()) in items]
    pages = [to(e) for e in spine if "html" in e.get("media-type", "") or e.get("href", "").endswith(HTML)]
    tocs = [e for e in items.values() if "nav" in e.get("properties", "").split()]
    tocs += [items[t] for e in named("spine") if (t := e.get("toc")) in items]
    tocs += [e for e in items.values() if e.get("media-type") == NCX_TYPE]
    once = lambda xs: list(dict.fromkeys(x for x in xs if x))
    return title, once(pages), once(map(to, tocs))


def decoded(data: bytes) -> str:
    """Text of a page by its byte order mark or declared encoding, else UTF-8 with replacements."""
    marks = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
    mark = next((v for k, v in marks.items() if data.startswith(k)), None)
    declared = DECLARED.search(data[:1024])
    for encoding in (mark, declared and declared[1].decode("ascii", "replace"), "utf-8"):
        try:
            if encoding:
                return data.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("utf-8", "replace")


def _ncx(root: ET.Element) -> Iterator[tuple]:
    """(id, parent, depth, title, href) of the points, before what is below them."""
    top = next((e for e in root.iter() if _name(e.tag) == "navMap"), None)
    points = lambda e: [c for c in e if _name(c.tag) == "navPoint"]
    number = 0
    stack = [(p, None, 0) for p in reversed(points(top))] if top is not None else []
    while stack:
        p, parent, depth = stack.pop()
        child = lambda n: next((c for c in p if _name(c.tag) == n), None)  # noqa: B023, E731
        label = child("navLabel")
        text = next((e for e in label.iter() if _name(e.tag) == "text"), None) if label is not None else None
        content = child("content")
        yield p.get("id", ""), parent, depth, "".join(text.itertext()).strip() if text is not None else "", content.get("src", "") if content is not None else ""
        stack += [(c, number, depth + 1) for c in reversed(points(p))]
        number += 1


def _nav(html: str) -> Iterator[tuple]:
    number = 0
    items = lambda ol: [c for c in ol.parts if isinstance(c, Node) and c.tag == "li"]
    lists = [x for s in nav_scopes(Page(html).root) if (x := nav_list(s)) is not None]
    stack = [(li, None, 0) for ol in reversed(lists) for li in reversed(items(ol))]
    while stack:
        li, parent, depth = stack.pop()
        label = li.first("a") or li.first("span")
        if label is not None:
            texts = [t for t in (x.strip() for x in _strings(label)) if t]
            yield li.attrs.get("id") or "", parent, depth, " ".join(texts), (label.attrs.get("href") or "") if label.tag == "a" else ""
            parent, number = number, number + 1
        inner = li.first("ol")
        if inner is not None:
            stack += [(c, parent, depth + 1) for c in reversed(items(inner))]


def _strings(node: Node) -> Iterator[str]:
    for p in node.parts:
        if isinstance(p, Node):
            yield from _strings(p)
        elif type(p) is str:
            yield p


def toc_entries(data: bytes, path: str, order: int = 0) -> list[dict]:
    """Entries of one table of contents, in preorder; a file that cannot be read gives none."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        root = None
    is_ncx = path.lower().endswith(".ncx") or root is not None and any(_name(e.tag) in ("ncx", "navMap") for e in root.iter())
    if is_ncx and root is None:
        return []
    out = []
    for k, (node_id, parent, depth, title, raw) in enumerate(_ncx(root) if is_ncx else _nav(decoded(data))):
        to = resolve(path, raw) if raw else Href("", "", False)
        key = f"{to.resource}#{to.fragment}" if to.resource and to.fragment else to.resource
        out.append(
            {"toc_path": path, "toc_order": order, "node_index": k, "node_id": node_id, "parent_index": parent, "depth": depth, "kind": "ncx" if is_ncx else "nav",
             "title": title, "raw_href": raw, "resource_href": to.resource, "fragment": to.fragment, "target_key": key, "external": to.external}
        )
    return out


def parse(data: bytes, path: str) -> dict:
    """A book as a row of ``SCHEMA``."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = set(z.namelist())
        opf = opf_path(z.read("META-INF/container.xml"))
        title, pages, tocs = package(z.read(opf), opf)
        toc = [e for k, t in enumerate(tocs) if t in names for e in toc_entries(z.read(t), t, k)]
        resources, segments, fragments = [], [], []
        for k, href in enumerate(pages):
            if href in names:
                head, found, anchors, template = annotate(decoded(z.read(href)), k, href, title, href in tocs)
                resources.append({"resource": k, "href": href, "title": head, "n": len(found), "template": template})
                segments += [{"resource": k} | s for s in found]
                fragments += [{"href": href, "fragment": f, "anchor": a} for f, a in anchors.items()]
    return {"path": path, "title": title or posixpath.basename(path).rpartition(".")[0], "opf_path": opf, "toc_paths": tocs, "resources": resources, "segments": segments, "toc": toc, "fragments": fragments}


def read_epub(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a book; see ``SCHEMA``. A file that is no EPUB raises, with its path in the message."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(SCHEMA))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    row = parse(data, path)
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError) as e:
                    raise ValueError(f"{path} is no EPUB file: {e}") from e
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return files.mapInArrow(run, SCHEMA)
