"""A small element tree of XHTML pages, and their annotated text blocks.

``Page`` holds the tree as it is written: no end tag is supplied but at the end of the element around it.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

# Text blocks, headings, and inline elements that are kept as they are.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote td th dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ATOMS = frozenset("audio br canvas embed hr iframe img math object svg video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ID = "data-tn-id"
INLINE_ID = "data-tn-inline-id"


class Node:
    """An element; its parts are elements, texts, and raw markup such as comments."""

    __slots__ = ("attrs", "parts", "tag", "up")

    def __init__(self, tag: str, attrs: dict | None = None, up: Node | None = None):
        self.tag, self.attrs, self.parts, self.up = tag, attrs or {}, [], up

    def nodes(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [iter(self.parts)]
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
            elif isinstance(part, Node):
                yield part
                stack.append(iter(part.parts))

    def above(self) -> Iterator[Node]:
        at = self.up
        while at is not None:
            yield at
            at = at.up

    def text(self) -> str:
        return "".join(p.text() if isinstance(p, Node) else p for p in self.parts if not isinstance(p, Raw))

    def first(self, tag: str, deep: bool = False) -> Node | None:
        return next((n for n in (self.nodes() if deep else self.parts) if isinstance(n, Node) and n.tag == tag), None)

    def markup(self) -> str:
        inner = "".join(p.markup() if isinstance(p, Node) else p if isinstance(p, Raw) else escape(p, quote=False) for p in self.parts)
        if not self.tag:
            return inner
        attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}/>" if self.tag in VOID and not inner else f"<{self.tag}{attrs}>{inner}</{self.tag}>"


class Raw(str):
    """Markup that is no text: comments, declarations."""


class Page(HTMLParser):
    """Parses a page; ``root`` is a node without a tag."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.feed(html)
        self.close()

    def _add(self, part) -> None:
        self.at.parts.append(part)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self._add(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self._add(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        for node in (self.at, *self.at.above()):
            if node.tag == tag:
                self.at = node.up
                return

    def handle_data(self, data):
        self._add(data)

    def handle_comment(self, data):
        self._add(Raw(f"<!--{data}-->"))

    def handle_decl(self, decl):
        self._add(Raw(f"<!{decl}>"))

    def handle_pi(self, data):
        self._add(Raw(f"<?{data}>"))

    def unknown_decl(self, data):
        self._add(Raw(f"<![{data}]>"))


def nav_scopes(root: Node) -> list[Node]:
    """The elements that hold a table of contents: nav typed toc, else the first nav, else the page."""
    navs = [n for n in root.nodes() if n.tag == "nav"]
    typed = [n for n in navs if "toc" in (n.attrs.get("epub:type") or n.attrs.get("type") or "").split()]
    return typed or navs[:1] or [root]


def nav_list(scope: Node) -> Node | None:
    return scope.first("ol") or scope.first("ol", deep=True)


def _kept_roots(block: Node) -> list[Node]:
    """Inline elements to keep as they are, each widened to the wrappers around it that hold no text."""
    roots: dict[int, Node] = {}
    for n in block.nodes():
        if n.tag in ATOMS or (n.tag == "a" and ("id" in n.attrs or "name" in n.attrs) and not n.text().strip()):
            while n.up is not block and n.up.tag not in BLOCKS and not n.up.text().strip():
                n = n.up
            roots.setdefault(id(n), n)
    return list(roots.values())


def _runs(node: Node, kept: set[int]) -> Iterator[str | Node]:
    for p in node.parts:
        if isinstance(p, Node):
            yield from [p] if id(p) in kept else _runs(p, kept)
        elif not isinstance(p, Raw):
            yield p


def _content(block: Node, anchor: str) -> tuple[str, list[dict]]:
    """Stripped text of a block, and the kept elements with their offsets in it."""
    raw, spots = "", []
    for part in _runs(block, set(map(id, _kept_roots(block)))):
        if isinstance(part, Node):
            spots.append((part, len(raw)))
        else:
            raw += part
    text = raw.strip()
    if not text:
        return "", []
    lead, found = len(raw) - len(raw.lstrip()), []
    for k, (node, at) in enumerate(spots):
        at = min(max(at - lead, 0), len(text))
        node.attrs[INLINE_ID] = name = f"{anchor}_inline_{k}"
        found.append({"id": name, "tag": node.tag, "offset": at, "placement": "before" if at == 0 else "after" if at == len(text) else "inline"})
    return text, found


def _lift_names(block: Node) -> None:
    """Ids of elements with text move to an empty anchor before them, which is kept."""
    for n in list(block.nodes()):
        if n.text().strip():
            names = {k: n.attrs.pop(k) for k in ("id", "name") if k in n.attrs}
            if names:
                n.up.parts.insert(next(i for i, p in enumerate(n.up.parts) if p is n), Node("a", names, n.up))


def annotate(html: str, number: int, href: str, book: str = "", is_nav: bool = False) -> tuple[str, list[dict], dict[str, str | None], str]:
    """Title, segments, anchors of fragments and the marked page of one resource.

    Segments have seg, kind, source, anchor, resource_href and inline (kept elements). A fragment after the
    last block has the anchor None. With ``is_nav``, items of the table of contents are no segments.
    """
    root = Page(html).root
    lists = [x for s in nav_scopes(root) if (x := nav_list(s)) is not None] if is_nav else []
    segments: list[dict] = []
    for n in list(root.nodes()):
        if n.tag not in BLOCKS:
            continue
        above = list(n.above())
        if any(a is x for a in above for x in lists) and (n.tag == "li" or any(a.tag == "li" for a in above)):
            continue
        if any(a.tag in BLOCKS for a in above):
            continue
        _lift_names(n)
        anchor = f"tn{number}_{len(segments)}"
        text, inline = _content(n, anchor)
        if text:
            n.attrs[ID] = anchor
            segments.append({"seg": len(segments), "kind": "heading" if n.tag in HEADINGS else "text", "source": text, "anchor": anchor, "resource_href": href, "inline": inline})
    title = next((s["source"] for s in segments if s["kind"] == "heading"), "")
    own = root.first("title", deep=True)
    if not title and own is not None:
        said = own.text().strip()
        stem = posixpath.basename(href).rpartition(".")[0] or posixpath.basename(href)
        title = "" if said in (stem, book.strip() or None) else said
    return title, segments, fragment_anchors(root), root.markup()


def fragment_anchors(root: Node) -> dict[str, str | None]:
    """Of each id or name, the anchor of the marked block it is in, else of the next one."""
    nodes = list(root.nodes())
    after: list[str | None] = [None] * (len(nodes) + 1)
    for k in range(len(nodes) - 1, -1, -1):
        after[k] = nodes[k].attrs.get(ID) or after[k + 1]
    out: dict[str, str | None] = {}
    for k, n in enumerate(nodes):
        names = [x for x in (n.attrs.get("id"), n.attrs.get("name")) if x]
        if names:
            around = next((a.attrs[ID] for a in (n, *n.above()) if ID in a.attrs), None)
            for x in names:
                out.setdefault(x, around or after[k])
    return out


def filled(template: str, targets: dict[str, str], sources: dict[str, str] | None = None, source_first: bool = False) -> str:
    """The marked page with the texts of the blocks in ``targets`` replaced; kept elements stand at rescaled offsets.

    With ``sources``, a block is joined by a copy that holds the source. Marks go.
    """
    root = Page(template).root
    for n in list(root.nodes()):
        anchor = n.attrs.pop(ID, None)
        if anchor is None:
            continue
        if anchor not in targets:
            for x in n.nodes():
                x.attrs.pop(INLINE_ID, None)
            continue
        raw, spots = "", []
        for part in _runs(n, {id(x) for x in n.nodes() if INLINE_ID in x.attrs}):
            if isinstance(part, Node):
                spots.append((part, len(raw)))
            else:
                raw += part
        text = raw.strip()
        lead = len(raw) - len(raw.lstrip())
        target = targets[anchor]
        parts, at = [], 0
        for node, offset in spots:
            node.attrs.pop(INLINE_ID)
            offset = min(max(offset - lead, 0), len(text))
            to = max(at, min(len(target), round(offset * len(target) / len(text)) if text else 0))
            parts += [target[at:to], node]
            at, node.up = to, n
        n.parts = [p for p in [*parts, target[at:]] if not isinstance(p, str) or p]
        if sources and anchor in sources and n.tag not in HEADINGS:
            copy = Node(n.tag, {"class": "tn-source"}, n.up)
            copy.parts = [sources[anchor]]
            place = next(i for i, p in enumerate(n.up.parts) if p is n)
            n.up.parts.insert(place + (not source_first), copy)
    return root.markup()
