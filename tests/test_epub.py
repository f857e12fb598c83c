"""FB2 and EPUB books, tables of contents, assembly."""

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quire.operators import assemble, toc
from quire.sources import epub, fb2, markup

FB2 = """<?xml version="1.0" encoding="{enc}"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><book-title> Книга </book-title></title-info></description>
<body><title><p>Автор</p><p>Книга</p></title><section><title><p>Часть 1</p></title><section><title><p>Глава 1</p></title><p>Один <b>два</b></p><subtitle>* * *</subtitle><poem><stanza><v>стих</v></stanza><text-author>А</text-author></poem><empty-line/></section>
<section><p>{long}</p><image/></section></section><section><epigraph><p>эпиграф</p></epigraph><section><p>три</p></section></section><section><title/></section></body><body name="notes"><section><p>примечание</p></section></body></FictionBook>"""


def test_fb2(spark, tmp_path):
    (tmp_path / "a.fb2").write_bytes(FB2.format(enc="windows-1251", long="я" * 100).encode("windows-1251"))
    (tmp_path / "b.fb2").write_text("<FictionBook><body name='x'><section><p>one</p></section></body></FictionBook>")
    rows = fb2.read_fb2(spark, str(tmp_path / "*.fb2")).orderBy("path", "chapter", "seg").collect()
    a = [(r.chapter, r.chapter_title, r.seg, r.kind, r.source) for r in rows if r.path.endswith("a.fb2")]
    assert a == [
        (0, "Книга", 0, "heading", "Автор"), (0, "Книга", 1, "heading", "Книга"), (1, "Часть 1", 0, "heading", "Часть 1"), (2, "Глава 1", 0, "heading", "Глава 1"), (2, "Глава 1", 1, "text", "Один два"), (2, "Глава 1", 2, "heading", "* * *"),
        (2, "Глава 1", 3, "text", "стих"), (2, "Глава 1", 4, "text", "А"), (3, "я" * 80, 0, "text", "я" * 100), (4, "эпиграф", 0, "text", "эпиграф"), (5, "три", 0, "text", "три"),
    ]
    assert [(r.title, r.chapter_title, r.source) for r in rows if r.path.endswith("b.fb2")] == [("b", "b", "one")] and {r.title for r in rows} == {"Книга", "b"}
    with pytest.raises(ValueError, match="no FB2"):
        fb2.parse(b"no xml", "x.fb2")
    assert fb2.load_books(spark, str(tmp_path / "b.fb2")).count() == 1
    with pytest.raises(ValueError):
        fb2.load_books(spark, "x.doc")


def test_hrefs():
    r = epub.resolve
    assert r("OEBPS/toc.ncx", "a%20b+c.html#x%21") == ("OEBPS/a b+c.html", "x!", False) and r("OEBPS/t/nav.xhtml", "../c.html") == ("OEBPS/c.html", "", False)
    assert r("a/b.html", "#f") == ("a/b.html", "f", False) and r("a/b.html", "/c.html") == ("c.html", "", False) and r("a", "http://x/y#z") == ("", "z", True) and r("a", "mailto:x").external


def test_blocks_and_anchors():
    html = '<html><head><title>ch1</title></head><body><p> A <b id="k">bold</b><img src="x"/> end </p><blockquote><p>in</p></blockquote><!-- no --><p><!-- no --> </p><div id="d"><h2>Head</h2></div><p>last<br/></p><a id="z"></a></body></html>'
    title, segs, anchors, page = markup.annotate(html, 3, "x/ch1.html")
    assert title == "Head" and [(s["kind"], s["source"], s["anchor"]) for s in segs] == [("text", "A bold end", "tn3_0"), ("text", "in", "tn3_1"), ("heading", "Head", "tn3_2"), ("text", "last", "tn3_3")]
    assert anchors == {"k": "tn3_0", "d": "tn3_2", "z": None}
    assert [(i["tag"], i["offset"], i["placement"]) for i in segs[0]["inline"]] == [("a", 2, "inline"), ("img", 6, "inline")] and segs[3]["inline"][0]["placement"] == "after"
    out = markup.filled(page, {"tn3_0": "甲乙丙丁戊", "tn3_3": "末"})
    assert '<p>甲<a id="k"></a>乙丙<img src="x"/>丁戊</p>' in out and "<p>末<br/></p>" in out and "data-tn" not in out and "<p>in</p>" in out
    two = markup.filled(page, {"tn3_1": "内"}, {"tn3_1": "in", "tn3_2": "Head"})
    assert '<blockquote>内</blockquote><blockquote class="tn-source">in</blockquote>' in two and two.count("tn-source") == 1
    assert markup.annotate("<title>ch1</title><p>x</p>", 0, "a/ch1.html")[0] == "" and markup.annotate("<title>T</title>", 0, "a.html", "T")[0] == "" and markup.annotate("<title>T</title>", 0, "a.html")[0] == "T"


def book(nav=True):
    text = "word " * 900
    files = {
        "META-INF/container.xml": '<container xmlns="urn:x"><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>',
        "O/b.opf": '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="d"><dc:title>Book</dc:title></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="x" href="t.ncx" media-type="application/x-dtbncx+xml"/>'
        + "".join(f'<item id="c{i}" href="c%20{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(4))
        + '</manifest><spine toc="x"><itemref idref="n"/><itemref idref="c0"/><itemref idref="c1"/><itemref idref="c0"/><itemref idref="c2"/><itemref idref="c3"/><itemref idref="gone"/></spine></package>',
        "O/t.ncx": '<ncx xmlns="n"><navMap><navPoint id="p"><navLabel><text>Only</text></navLabel><content src="c%200.xhtml"/></navPoint></navMap></ncx>',
        "O/c 0.xhtml": f"<body><h1>Front</h1><p>{text}</p></body>",
        "O/c 1.xhtml": f'<body><h1 id="one">One</h1><p>{text}</p><h1 id="two">Two</h1><p>{text}</p></body>',
        "O/c 2.xhtml": "<body><img/></body>",
        "O/c 3.xhtml": f'<body><p>{text}</p><a id="end"></a></body>',
    }
    if nav:
        files["O/nav.xhtml"] = (
            '<html><body><nav epub:type="toc"><h2>Contents</h2><ol><li><span>Part</span><ol><li><a href="c%201.xhtml#one">First</a><ol><li><a href="c%201.xhtml#two">Second</a></li></ol></li><li><a href="c%201.xhtml#lost">Lost</a></li></ol></li>'
            '<li><a href="c%202.xhtml">Third</a></li><li><a href="http://x.y">Out</a></li><li><a href="c%203.xhtml#end">End</a></li></ol></nav></body></html>'
        )
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_epub_to_chapters(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    (tmp_path / "b.epub").write_bytes(book(nav=False))
    books = epub.read_epub(spark, str(tmp_path)).cache()
    rows = {r.path[-6:]: r for r in books.collect()}
    a = rows["a.epub"]
    assert a.title == "Book" and [r.href for r in a.resources] == ["O/nav.xhtml", "O/c 0.xhtml", "O/c 1.xhtml", "O/c 2.xhtml", "O/c 3.xhtml"] and a.toc_paths == ["O/nav.xhtml", "O/t.ncx"]
    assert [(e.title, e.depth, e.parent_index, e.external) for e in a.toc if e.toc_order == 0] == [("Part", 0, None, False), ("First", 1, 0, False), ("Second", 2, 1, False), ("Lost", 1, 0, False), ("Third", 0, None, False), ("Out", 0, None, True), ("End", 0, None, False)]
    assert [s.source for s in a.segments if s.resource == 0] == ["Contents"]  # items of the contents are no text
    t = toc.book_tables(books)
    entries = toc.with_groups(toc.located(t["toc"], t["resources"], t["fragments"], t["segments"]))
    got = {r.title: (r.position, r.anchor) for r in entries.where("book LIKE '%a.epub' AND toc_order = 0").collect()}
    assert got == {"Part": (3, None), "First": (3, "tn2_0"), "Second": (5, "tn2_2"), "Lost": (None, None), "Third": (7, None), "Out": (None, None), "End": (8, None)}
    out = toc.logical_chapters(t["toc"], t["resources"], t["fragments"], t["segments"]).select("book", "pos", "chapter", "seg_in_chapter", "chapter_title", "strategy").orderBy("book", "pos").collect()
    a = [(r.chapter, r.seg_in_chapter, r.chapter_title) for r in out if r.book.endswith("a.epub")]
    assert a == [(0, 0, "Contents"), (0, 1, "Contents"), (0, 2, "Contents"), (1, 0, "First"), (1, 1, "First"), (2, 0, "Second"), (2, 1, "Second"), (3, 0, "Third")]
    assert {r.strategy for r in out if r.book.endswith("a.epub")} == {"toc-depth-2"}
    b = [(r.chapter, r.chapter_title, r.strategy) for r in out if r.book.endswith("b.epub")]
    assert b[0] == (0, "Only", "toc-depth-0") and len({c for c, *_ in b}) == 1
    none = t["toc"].where("book LIKE '%b.epub' AND false")
    plain = toc.logical_chapters(none, t["resources"], t["fragments"], t["segments"].where("book LIKE '%b.epub'")).orderBy("pos").collect()
    assert [(r.chapter, r.chapter_title) for r in plain] == [(0, "Front"), (0, "Front"), (1, "One"), (1, "One"), (1, "One"), (1, "One"), (2, "")] and plain[0].strategy == "spine-fallback"
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    with pytest.raises(Exception, match="no EPUB"):
        epub.read_epub(spark, str(tmp_path / "bad.epub")).collect()


def test_depth_by_median(spark):
    rows = [("b", "t", 10, 0, 3000.0), ("b", "t", 11, 1, 10.0), ("b", "t", 12, 2, 3000.0), ("c", "t", 1, 1, 5.0), ("c", "t", 1, 2, 6.0)]
    d = spark.createDataFrame(rows, "book string, toc_path string, x int, depth int, median_chars double")
    assert {(r.book, r.depth) for r in toc.chosen_depths(d).collect()} == {("b", 2), ("c", 1)}


def test_back_matter(spark):
    yes = ["Notes", "INDEX", "About the Authors", "Works Cited", "注释与索引", "A Note: References", "Title Page"]
    no = ["Indexes", "Notebook", "about the author's dog x".replace("author's", "authority"), "", None, "正文", "Contentment"]
    d = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert [r[0] for r in d.select(toc.is_back_matter(F.col("t"))).collect()] == [True] * len(yes) + [False] * len(no)
    g = spark.createDataFrame([(i, 21) for i in (0, 3, 4, 12, 13, 20)] + [(0, 1)], "i int, n int")
    assert [r[0] for r in g.select(toc.is_back_matter(F.lit("Notes"), F.col("i"), F.col("n"))).collect()] == [True, True, False, False, True, True, True]
    assert [r[0] for r in d.limit(1).select(toc.bypass(F.lit(True), "light"), ).collect()] == ["light"]
    m = spark.createDataFrame([("skip",), ("light",), ("full",)], "mode string")
    assert [r.mode for r in toc.reopened(m, "full").collect()] == ["skip", "light"] and toc.reopened(m, "skip").count() == 0


def test_assembly(spark):
    rows = [(1, 0, 0, "heading", False, "Ch", "第5章"), (1, 0, 1, "text", False, "one ", "一"), (1, 0, 2, "text", True, "two", ""), (1, 0, 3, "text", False, "  ", "x"), (1, 0, 4, "text", False, "same", "same"), (1, 1, 0, "text", True, "alone", None), (2, 0, 0, "text", False, "only", "仅")]
    d = spark.createDataFrame(rows, "book int, chapter int, seg int, kind string, cont boolean, source string, target string")
    p = assemble.paragraphs(d, ["book", "chapter"], "seg")
    assert {r.book: r.text for r in assemble.texts(p, "book", "chapter").collect()} == {1: "第五章\n\n一two\n\nsame\n\nalone\n", 2: "仅\n"}
    assert {r.book: r.text for r in assemble.texts(p, "book", "chapter", bilingual=True).collect()}[1] == "第五章\n\n一two\n\none two\n\nsame\n\nalone\n"
    titles = spark.createDataFrame([(1, "T & t", "zh"), (2, None, None), (3, "none", "en")], "book int, title string, lang string")
    made = {r.book: r.epub for r in assemble.new_epubs(p, titles, "book", "chapter", bilingual=True).collect()}
    row = epub.parse(bytes(made[1]), "x.epub")
    assert row["title"] == "T & t" and [s["source"] for s in row["segments"]][:3] == ["第五章", "一two", "one two"] and len(row["toc"]) == 2 and epub.parse(bytes(made[3]), "y.epub")["segments"] == []
    names = spark.createDataFrame([("/a/b.epub",), ("x.tar.txt",), ("n",)], "p string")
    assert [tuple(r) for r in names.select(assemble.out_name(F.col("p"), "epub", True), assemble.bilingual_name(F.col("p"))).collect()] == [("/a/b.zh-bi.epub", "/a/b-bi.epub"), ("x.tar.zh-bi.epub", "x.tar-bi.txt"), ("n.zh-bi.epub", "n-bi")]


def test_pages_are_filled(spark):
    _, segs, _, page = markup.annotate("<body><p>a</p><p>b</p></body>", 0, "p.html")
    r = spark.createDataFrame([("k", "p.html", page), ("k", "q.html", "<p>z</p>")], "book string, href string, template string")
    s = spark.createDataFrame([("k", "p.html", 0, "tn0_0", "a", "甲"), ("k", "p.html", 1, None, "more", "乙"), ("k", "p.html", 2, "tn0_1", "b", None)], "book string, resource_href string, pos int, anchor string, source string, target string")
    got = {x.href: x.html for x in assemble.filled_pages(r, s).collect()}
    assert got == {"p.html": "<body><p>甲乙</p><p>b</p></body>", "q.html": "<p>z</p>"}
