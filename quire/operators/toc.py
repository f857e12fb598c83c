"""Tables of contents to chapters, as joins and windows over all books at once.

Tables: ``segments`` (book, pos, anchor, resource_href, kind, source), ``resources`` (book, href, start, n,
title), ``toc`` (book, toc_path, toc_order, node_index, parent_index, depth, title, raw_href,
resource_href, fragment, external), ``fragments`` (book, href, fragment, anchor). ``pos`` counts a book's
segments from 0; ``start`` is the pos of a resource's first segment and ``n`` their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_CHAPTER_CHARS = 3000
NODE = ["book", "toc_path", "node_index"]


def book_tables(books: DataFrame, key: str = "path") -> dict[str, DataFrame]:
    """The tables above, of rows as the EPUB reader gives them."""
    one = lambda c: books.select(F.col(key).alias("book"), F.explode(c).alias("x")).select("book", "x.*")
    so_far = Window.partitionBy("book").orderBy("resource").rowsBetween(Window.unboundedPreceding, -1)
    resources = one("resources").withColumn("start", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    at = Window.partitionBy("book").orderBy("resource", "seg")
    segments = one("segments").withColumn("pos", (F.row_number().over(at) - 1).cast("bigint"))
    return {"segments": segments, "resources": resources, "toc": one("toc"), "fragments": one("fragments")}


def located(toc: DataFrame, resources: DataFrame, fragments: DataFrame, segments: DataFrame) -> DataFrame:
    """Links of ``toc`` with ``position`` and ``anchor``; entries whose target does not exist have neither.

    A fragment stands at its block; one after the last block at the resource's end, without an anchor. A
    link without a fragment stands at the resource's start, with the anchor of its first segment, if any.
    """
    r = resources.select("book", F.col("href").alias("resource_href"), "start", "n")
    f = fragments.select("book", F.col("href").alias("resource_href"), "fragment", F.col("anchor").alias("at"), F.lit(True).alias("there"))
    s = segments.where(F.col("anchor").isNotNull()).groupBy("book", F.col("anchor").alias("at")).agg(F.max("pos").alias("at_pos"))
    first = segments.select("book", F.col("pos").alias("start"), F.col("anchor").alias("first"))
    d = toc.join(r, ["book", "resource_href"], "left").join(f, ["book", "resource_href", "fragment"], "left").join(s, ["book", "at"], "left").join(first, ["book", "start"], "left")
    inside = F.coalesce(F.col("fragment"), F.lit("")) != ""
    ok = F.col("start").isNotNull()
    position = F.when(ok & inside & F.col("there"), F.coalesce("at_pos", F.col("start") + F.col("n"))).when(ok & ~inside, F.col("start"))
    anchor = F.when(inside, F.when(F.col("at_pos").isNotNull(), F.col("at"))).when(F.col("n") > 0, F.col("first"))
    return d.select(*toc.columns, position.alias("position"), F.when(position.isNotNull(), anchor).alias("anchor"))


def with_groups(links: DataFrame) -> DataFrame:
    """``links`` (located) with the positions of groups: entries without a link stand where the first entry
    below them stands that is reached over such entries only. They have no anchor."""
    groups = links.where(F.coalesce(F.col("raw_href"), F.lit("")) == "").select(*NODE, F.col("parent_index").alias("up"))
    deepest = links.agg(F.max("depth")).first()[0] or 0
    reached = links.where(F.col("position").isNotNull()).select("book", "toc_path", F.col("parent_index").alias("node_index"), "position", F.col("node_index").alias("by"))
    levels = []
    for _ in range(deepest):  # one join a level of the contents, which are few
        reached = reached.join(groups, NODE)
        levels.append(reached.select(*NODE, "position", "by"))
        reached = reached.select("book", "toc_path", F.col("up").alias("node_index"), "position", "by")
    if not levels:
        return links.withColumn("inherited_from", F.lit(None).cast("int"))
    first = reduce(DataFrame.unionByName, levels).groupBy(*NODE).agg(F.min_by("position", "by").alias("below"), F.min("by").alias("inherited_from"))
    d = links.join(first, NODE, "left")
    return d.withColumn("inherited_from", F.when(F.col("position").isNull(), F.col("inherited_from"))).withColumn("position", F.coalesce("position", "below")).drop("below")


def _inner(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("position").isNotNull() & ~F.coalesce(F.col("external"), F.lit(False)))


def one_a_position(entries: DataFrame) -> DataFrame:
    """Of entries at one position of a table of contents the first with an anchor, else the last."""
    rest = [c for c in entries.columns if c not in ("book", "toc_path", "position")]
    row = F.struct(*rest)
    anchored = F.col("anchor").isNotNull()
    kept = F.coalesce(F.min_by(F.when(anchored, row), F.when(anchored, F.col("node_index"))), F.max_by(row, "node_index"))
    return entries.groupBy("book", "toc_path", "position").agg(kept.alias("e")).select("book", "toc_path", "position", "e.*")


def slice_medians(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """(book, toc_path, depth, median_chars): of the slices that all entries down to a depth make.

    Text before the first entry is a slice; empty slices do not count.
    """
    inner = _inner(entries)
    depths = inner.select("book", "toc_path", F.col("depth").alias("d")).distinct()
    cuts = inner.groupBy("book", "toc_path", "position").agg(F.min("depth").alias("from"))
    at = Window.partitionBy("book").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = segments.select("book", "pos", F.length("source").alias("chars")).withColumn("before", F.coalesce(F.sum("chars").over(at), F.lit(0)))
    total = upto.groupBy("book").agg(F.sum("chars").alias("total"), F.count("*").alias("n"))
    every = depths.join(cuts, ["book", "toc_path"]).where(F.col("from") <= F.col("d")).select("book", "toc_path", F.col("d").alias("depth"), "position")
    every = every.unionByName(depths.select("book", "toc_path", F.col("d").alias("depth"), F.lit(0).cast("bigint").alias("position"))).distinct()
    every = every.join(upto.select("book", F.col("pos").alias("position"), "before"), ["book", "position"], "left").join(total, "book")
    every = every.withColumn("before", F.coalesce("before", "total"))
    w = Window.partitionBy("book", "toc_path", "depth").orderBy("position")
    size = F.coalesce(F.lead("before").over(w), F.col("total")) - F.col("before")
    width = F.coalesce(F.lead("position").over(w), F.col("n")) - F.col("position")
    sliced = every.select("book", "toc_path", "depth", size.alias("chars"), width.alias("width")).where("width > 0")
    medians = sliced.groupBy("book", "toc_path", "depth").agg(F.median("chars").alias("median_chars"))
    return depths.withColumnRenamed("d", "depth").join(medians, ["book", "toc_path", "depth"], "left").withColumn("median_chars", F.coalesce("median_chars", F.lit(0.0)))


def chosen_depths(medians: DataFrame, least: int = MIN_CHAPTER_CHARS) -> DataFrame:
    """(book, toc_path, depth): the deepest whose slices have a median of ``least`` characters, else the shallowest."""
    fit = F.max(F.when(F.col("median_chars") >= least, F.col("depth")))
    return medians.groupBy("book", "toc_path").agg(F.coalesce(fit, F.min("depth")).alias("depth"))


def boundaries(toc: DataFrame, resources: DataFrame, fragments: DataFrame, segments: DataFrame, least: int = MIN_CHAPTER_CHARS) -> DataFrame:
    """(book, toc_path, position, ..., chosen_depth): where chapters start, by each book's first usable table of contents."""
    entries = with_groups(located(toc, resources, fragments, segments))
    depths = chosen_depths(slice_medians(entries, segments), least).withColumnRenamed("depth", "chosen_depth")
    cuts = _inner(entries).join(depths, ["book", "toc_path"]).where(F.col("depth") <= F.col("chosen_depth"))
    used = cuts.groupBy("book").agg(F.min_by("toc_path", "toc_order").alias("toc_path"))
    return one_a_position(cuts.join(used, ["book", "toc_path"], "left_semi"))


def logical_chapters(toc: DataFrame, resources: DataFrame, fragments: DataFrame, segments: DataFrame, least: int = MIN_CHAPTER_CHARS) -> DataFrame:
    """``segments`` with chapter, seg_in_chapter, chapter_title, toc_entry (node_index) and strategy.

    Segments before the first boundary are a chapter of their own, titled by a heading it starts with.
    Books without a boundary have a chapter a resource.
    """
    cuts = boundaries(toc, resources, fragments, segments, least)
    starts = cuts.select("book", F.col("position").alias("pos"), F.lit(0).alias("o"), F.struct("position", F.col("title").alias("title"), "node_index", "chosen_depth").alias("cut"))
    rows = segments.select("book", "pos", F.lit(1).alias("o"), F.struct(*[c for c in segments.columns if c not in ("book", "pos")]).alias("seg_"))
    both = starts.withColumn("seg_", F.lit(None).cast(rows.schema["seg_"].dataType)).unionByName(rows.withColumn("cut", F.lit(None).cast(starts.schema["cut"].dataType)))
    so_far = Window.partitionBy("book").orderBy("pos", "o").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("book")
    d = both.withColumn("cut", F.last("cut", ignorenulls=True).over(so_far)).withColumn("any", F.max("cut.chosen_depth").over(whole)).where("o = 1")
    d = d.select("book", "pos", "seg_.*", "cut", "any").join(resources.select("book", F.col("href").alias("resource_href"), F.col("title").alias("own_title"), F.col("start").alias("own_start")), ["book", "resource_href"], "left")
    begin = F.when(F.col("any").isNull(), F.col("own_start")).otherwise(F.coalesce(F.col("cut.position"), F.lit(-1)))
    w = Window.partitionBy("book").orderBy("begin")
    d = d.withColumn("begin", begin).withColumn("chapter", (F.dense_rank().over(w) - 1).cast("int"))
    inside = Window.partitionBy("book", "begin").orderBy("pos")
    d = d.withColumn("seg_in_chapter", (F.row_number().over(inside) - 1).cast("int"))
    head = F.first(F.when(F.col("kind") == "heading", F.col("source")).otherwise("")).over(inside)
    title = F.when(F.col("any").isNull(), F.col("own_title")).when(F.col("cut").isNull(), head).otherwise(F.col("cut.title"))
    strategy = F.when(F.col("any").isNull(), "spine-fallback").otherwise(F.concat(F.lit("toc-depth-"), F.col("any")))
    return d.select(*segments.columns, "chapter", "seg_in_chapter", title.alias("chapter_title"), F.col("cut.node_index").alias("toc_entry"), strategy.alias("strategy"))


def titled(chapters: DataFrame, entries: DataFrame) -> DataFrame:
    """(book, chapter, title_translated): the translated title of a chapter's entry wins over its own."""
    e = entries.select("book", F.col("node_index").alias("toc_entry"), F.col("title_translated").alias("of_entry"))
    return chapters.join(e, ["book", "toc_entry"], "left").withColumn("title_translated", F.coalesce("of_entry", "title_translated")).drop("of_entry")


def reused_headings(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """(book, chapter, title_translated): the target of a chapter's first segment where it is a heading equal to the title."""
    first = segments.where((F.col("seg_in_chapter") == 0) & (F.col("kind") == "heading") & (F.length("target") > 0)).select("book", "chapter", F.col("source").alias("s"), F.col("target").alias("title_translated"))
    return chapters.join(first, ["book", "chapter"]).where(F.trim("s") == F.trim("title")).select("book", "chapter", "title_translated")


def titles_to_translate(entries: DataFrame) -> DataFrame:
    """(title, nth): the different titles of entries that want a translation, in order of their first sighting."""
    want = (F.length(F.trim("title")) > 0) & ~F.coalesce(F.col("external"), F.lit(False)) & (F.length(F.coalesce("title_translated", F.lit(""))) == 0)
    first = entries.where(want).groupBy("book", "title").agg(F.min(F.struct("toc_order", "node_index")).alias("at"))
    return first.select("book", "title", F.row_number().over(Window.partitionBy("book").orderBy("at")).alias("nth"))


def undeclared(used: DataFrame, declared: DataFrame) -> DataFrame:
    """Resources that segments name and the book does not declare."""
    return used.select("book", F.col("resource_href").alias("href")).distinct().join(declared.select("book", "href"), ["book", "href"], "left_anti")


# Words of titles before and after a book's text.
BACK_WORDS = "notes endnotes footnotes index bibliography references acknowledgment acknowledgments acknowledgement acknowledgements copyright contents epigraph dedication".split()
BACK_WORDS += ["works cited", "title page", "about the author", "about the authors"]
BACK_MARKS = "注释 尾注 脚注 索引 参考文献 参考书目 引用文献 致谢 鸣谢 版权 关于作者 作者简介 目录 扉页 献词 题词".split()
#: Shares of a book between which, both excluded, no chapter is taken for one of these.
FRONT, BACK = 0.15, 0.65


def is_back_matter(title, index=None, total=None):
    """Whether a title is one of matter before or after the text; with place and number of chapters, not in the middle."""
    words = "|".join(BACK_WORDS)
    edge = r"[\p{L}\p{N}_]"
    found = F.coalesce(title.rlike(f"(?iU)(?<!{edge})(?:{words})(?!{edge})") | title.rlike("|".join(BACK_MARKS)), F.lit(False))
    if index is None or total is None:
        return found
    share = F.when(total > 1, index / F.greatest(total - 1, F.lit(1)))
    return found & ~F.coalesce((share > FRONT) & (share < BACK), F.lit(False))


def bypass(is_back, mode: str):
    """'skip' or 'light' where a chapter is not translated in full; null elsewhere and in mode 'full'."""
    if mode not in ("skip", "light", "full"):
        raise ValueError(f"unknown mode {mode}")
    return F.when(is_back, mode) if mode != "full" else F.lit(None).cast("string")


def reopened(chapters: DataFrame, mode: str) -> DataFrame:
    """Chapters bypassed under a lesser mode than ``mode`` now asks for: to be translated anew."""
    rank = F.create_map(*[F.lit(x) for kv in {"skip": 0, "light": 1, "full": 2}.items() for x in kv])
    return chapters.where(rank[F.col("mode")] < rank[F.lit(mode)])
