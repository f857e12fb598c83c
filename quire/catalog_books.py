"""Queries on checks, books and tables of contents, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numbers
from .functions import text as tx
from .operators import assemble, lint, segments, terms, toc, usage, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Checks on pairs.

_PAIRS = """(SELECT conv_id, turn, source, CASE WHEN turn % 8 = 0 THEN replace(source, ' ', '  ') WHEN turn % 8 = 4 THEN '  ' ELSE target END AS target FROM (SELECT conv_id, turn, text AS source, target FROM (
  SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'))"""


def _pairs(spark, sf_dir):
    """Turn pairs; every fourth target is the source with wider blanks, or blank, so that each rule has cases."""
    p = lint.turn_pairs(_t(spark, sf_dir, "conversations"))
    return p.withColumn("target", F.when(F.col("turn") % 8 == 0, F.replace("source", F.lit(" "), F.lit("  "))).when(F.col("turn") % 8 == 4, "  ").otherwise(F.col("target")))


_WORD = r"regexp_extract(text, '^[^ ]*?([A-Za-z]+)', 1)"
_ASKED = rf"(SELECT DISTINCT {_WORD} AS w, {_WORD} || '!' AS t FROM benchmark)"


def _asked(spark, sf_dir):
    w = F.regexp_extract("text", "^[^ ]*?([A-Za-z]+)", 1)
    return _t(spark, sf_dir, "benchmark").select(w.alias("source"), F.concat(w, F.lit("!")).alias("target")).where("source <> ''")


_DETAIL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lint.DETAILS.items()) + " END"
_KEPT = f"[{lint.KEPT}]"


@_query(rf"""WITH p AS (SELECT conv_id, turn, trim(source) AS s, trim(coalesce(target, '')) AS t, source, coalesce(target, '') AS target FROM {_PAIRS}),
i AS (SELECT conv_id, turn, 0 AS place, CASE WHEN length(t) = 0 THEN 'empty' WHEN length(t) / length(s) < 0.3 THEN 'too_short' ELSE 'too_long' END AS kind FROM p
  WHERE length(s) > 0 AND (length(t) = 0 OR length(t) / length(s) > 3 OR (length(t) / length(s) < 0.15 AND length(s) >= 120))
UNION ALL SELECT conv_id, turn, 1, 'quote_loss' FROM p WHERE substr(s, 1, 1) IN ('"', '“', '「', '『', '«') AND NOT regexp_matches(target, '{_KEPT}')
UNION ALL SELECT conv_id, turn, 4, 'untranslated' FROM p WHERE NOT (s <> '' AND NOT regexp_matches(s, '\s') AND regexp_matches(s, '^(?i:isbn)|[.@/#]'))
  AND ((regexp_replace(s, '\s+', '', 'g') <> '' AND lower(regexp_replace(s, '\s+', '', 'g')) = lower(regexp_replace(t, '\s+', '', 'g'))) OR len(list_filter(regexp_extract_all(target, '[A-Za-z]{{40,}}'), lambda x: contains(source, x))) > 0))
SELECT conv_id, turn, place, kind, {_DETAIL} AS detail FROM i
UNION ALL SELECT DISTINCT conv_id, turn, 3, 'term_miss', '锁定术语「' || w || '」应译为「' || a.t || '」，译文未出现该译名，请核对后重译' FROM p JOIN {_ASKED} a ON w <> '' AND contains(source, w)
  AND regexp_matches(source, '(^|[^\p{{L}}\p{{N}}_])' || w || '($|[^\p{{L}}\p{{N}}_])') WHERE NOT contains(target, a.t)""")
def lint_rules(spark, sf_dir):
    """All rules of the lint but those on numbers, which SQL cannot tell."""
    return lint.lint_targets(_pairs(spark, sf_dir), ["conv_id", "turn"], _asked(spark, sf_dir), numbers=False)


@_query()
def lint_targets(spark, sf_dir):
    return lint.lint_targets(_pairs(spark, sf_dir), ["conv_id", "turn"], _asked(spark, sf_dir))


@_query()
def number_mismatches(spark, sf_dir):
    """Documents whose text without its digits is taken for their translation."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace("text", "[0-9]{3,}", "").alias("target"))
    return d.select("doc_id", numbers.number_mismatch(F.col("text"), F.col("target")).alias("detail")).where("detail IS NOT NULL")


@_query(f"""WITH p AS (SELECT DISTINCT turn, kind FROM (SELECT turn, CASE WHEN length(trim(coalesce(target, ''))) = 0 THEN 'empty' ELSE 'filled' END AS kind FROM {_PAIRS})),
b AS (SELECT DISTINCT turn, CASE WHEN length(trim(source)) = 0 THEN 'empty' ELSE 'filled' END AS kind FROM {_PAIRS}) SELECT turn, kind FROM p EXCEPT SELECT turn, kind FROM b""")
def introduced_issues(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    kind = lambda c: F.when(tx.is_blank(F.col(c)), "empty").otherwise("filled").alias("kind")
    return lint.introduced(p.select("turn", kind("source")), p.select("turn", kind("target")), ["turn"])


@_query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{6,}}')) AS term FROM benchmark),
r AS (SELECT run, count(*) AS times FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{{6,}}')) AS run FROM documents) GROUP BY run),
v AS (SELECT variant, sum(times) AS n FROM (SELECT substr(run, CAST(i AS INTEGER), CAST(l AS INTEGER)) AS variant, times FROM r, (SELECT DISTINCT length(term) AS l FROM w) x, unnest(range(1, length(run) - l + 2)) t(i) WHERE length(run) >= l) GROUP BY variant),
m AS (SELECT term, variant, n, count(*) OVER (PARTITION BY term) AS k FROM w JOIN v ON length(variant) = length(term) AND hamming(variant, term) = 1)
SELECT term, variant, CAST(n AS BIGINT) AS n FROM m WHERE k <= {variants.MAX_VARIANTS}""")
def variant_hamming1(spark, sf_dir):
    words = _t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), 0)).alias("term"))
    return variants.one_off(words, "term", _t(spark, sf_dir, "documents"), "text", alphabet="a-z", least=6)


# Terms of texts.

_PEOPLE = r"(SELECT DISTINCT regexp_extract(text, '^([A-Za-z]+) ([A-Za-z]+)', 1) AS a, regexp_extract(text, '^([A-Za-z]+) ([A-Za-z]+)', 2) AS b FROM benchmark WHERE regexp_matches(text, '^[A-Za-z]{2,} [A-Za-z]{2,}'))"


@_query(rf"""WITH p AS (SELECT a || ' ' || upper(substr(b, 1, 1)) || substr(b, 2) AS source, unnest([a, upper(substr(b, 1, 1)) || substr(b, 2)]) AS part FROM {_PEOPLE}),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\p{{L}}+')) AS word FROM documents)
SELECT DISTINCT doc_id, source FROM w JOIN p ON word = part AND regexp_matches(part, '^\p{{Lu}}')""")
def people_mentioned(spark, sf_dir):
    """People: the first two words of the benchmark's items, the second capitalised."""
    w = lambda i: F.regexp_extract("text", "^([A-Za-z]+) ([A-Za-z]+)", i)
    named = _t(spark, sf_dir, "benchmark").where(F.col("text").rlike("^[A-Za-z]{2,} [A-Za-z]{2,}"))
    capital = F.concat(F.upper(F.substring(w(2), 1, 1)), F.substring(w(2), 2, 1 << 30))
    people = named.select(F.concat_ws(" ", w(1), capital).alias("source"), F.array().cast("array<string>").alias("aliases")).distinct()
    return terms.people_in(_t(spark, sf_dir, "documents"), people, ["doc_id"], "text")


@_query("""WITH k AS (SELECT lower(substr(text, 1, 12)) AS source, lower(substr(text, 20, 15)) AS alias FROM benchmark)
SELECT DISTINCT doc_id, k.source FROM documents d JOIN k ON contains(lower(d.text), k.source) OR contains(lower(d.text), alias)""")
def terms_by_alias(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark").select(F.lower(F.substring("text", 1, 12)).alias("source"), F.array(F.upper(F.substring("text", 20, 15))).alias("aliases"), F.lit("术语").alias("type"))
    return terms.terms_in(_t(spark, sf_dir, "documents"), b, ["doc_id"], "text")


# Segments.

@_query("""WITH RECURSIVE l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn, length(text) AS n FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, k, turn, n, n AS used, 0 AS pack, 0 AS nth FROM l WHERE k = 1
 UNION ALL SELECT l.conv_id, l.k, l.turn, l.n, CASE WHEN p.used + l.n > 5400 THEN l.n ELSE p.used + l.n END, CASE WHEN p.used + l.n > 5400 THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.used + l.n > 5400 THEN 0 ELSE p.nth + 1 END FROM p JOIN l ON l.conv_id = p.conv_id AND l.k = p.k + 1)
SELECT conv_id, turn, CAST(pack AS INTEGER) AS pack, CAST(nth AS INTEGER) AS nth FROM p""")
def review_chunks_3x(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return segments.pack_rows(c.select("conv_id", "turn", F.length("text").alias("n")), "conv_id", "turn", F.col("n"), 3 * 1800).select("conv_id", "turn", "pack", "nth")


@_query("""WITH d AS (SELECT source, doc_id, text, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE length(text) > 200 WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, CASE WHEN i = 0 THEN 'first' WHEN i = n // 2 THEN 'middle' ELSE 'last' END AS place, CASE WHEN i = n - 1 AND i <> 0 AND i <> n // 2 THEN right(text, 2800) ELSE substr(text, 1, 2800) END AS sample FROM d WHERE i = 0 OR i = n // 2 OR i = n - 1""")
def sample_text_picks(spark, sf_dir):
    return segments.samples(_t(spark, sf_dir, "documents"), "source", "doc_id", "text")


_LONGER = "CASE WHEN turn % 3 = 0 THEN text ELSE NULL END"


@_query(f"SELECT conv_id, turn, last_value({_LONGER} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS anchor FROM conversations")
def forward_fill_anchor(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("text")).alias("anchor"))
    return segments.forward_filled(c, "conv_id", "turn", "anchor")


@_query("SELECT conv_id, turn, CAST(sum(length(text)) OVER w AS BIGINT) AS upto, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def segment_prefix_sums(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return segments.prefix_sums(c, "conv_id", "turn", F.col("n")).select("conv_id", "turn", "upto", "before")


_SEGMENTS = "(SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'heading' ELSE 'text' END AS kind, turn % 4 = 2 AS cont, text AS source, CASE WHEN turn % 5 = 3 THEN '' ELSE lower(text) END AS target FROM conversations)"


def _segments(spark, sf_dir):
    t = F.col("turn")
    return _t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(t == 0, "heading").otherwise("text").alias("kind"), (t % 4 == 2).alias("cont"), F.col("text").alias("source"), F.when(t % 5 == 3, "").otherwise(F.lower("text")).alias("target")
    )


@_query(f"""SELECT conv_id, turn FROM (SELECT *, coalesce(lead(cont) OVER (PARTITION BY conv_id ORDER BY turn), false) AS nc FROM {_SEGMENTS})
WHERE kind = 'text' AND NOT cont AND NOT nc AND trim(target) <> '' AND (length(target) - length(regexp_replace(target, '[a-z]', '', 'g'))) / length(target) > 0.2""")
def rewrite_candidates(spark, sf_dir):
    return segments.rewrite_candidates(_segments(spark, sf_dir), "conv_id", "turn", alphabet="a-z").select("conv_id", "turn")


_PARS = f"""(SELECT conv_id, par, string_agg(CASE WHEN trim(target) = '' THEN source ELSE target END, '' ORDER BY turn) AS target, string_agg(source, '' ORDER BY turn) AS source, arg_min(kind, turn) AS kind FROM (
  SELECT *, CAST(sum(CASE WHEN cont AND n > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS par FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {_SEGMENTS} WHERE trim(source) <> '')) GROUP BY conv_id, par)"""


@_query(f"SELECT conv_id, par, kind, target, source FROM {_PARS}")
def merged_paragraphs(spark, sf_dir):
    return assemble.paragraphs(_segments(spark, sf_dir), ["conv_id"], "turn")


@_query(f"""SELECT conv_id % 7 AS book, string_agg(CASE WHEN kind <> 'heading' AND trim(source) <> '' AND source <> target THEN source || chr(10) || chr(10) || target ELSE target END, chr(10) || chr(10) ORDER BY conv_id, par) || chr(10) AS text FROM {_PARS} GROUP BY 1""")
def bilingual_texts(spark, sf_dir):
    p = assemble.paragraphs(_segments(spark, sf_dir), ["conv_id"], "turn").withColumn("book", F.col("conv_id") % 7)
    return assemble.texts(p, "book", "conv_id", bilingual=True, source_first=True)


# Tables of contents: a source is a book, a document a page with one segment.

_BOOKS = """d AS (SELECT source AS book, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS total FROM documents WHERE text IS NOT NULL),
e AS (SELECT book, 2 * k AS node_index, CAST(NULL AS BIGINT) AS parent_index, 0 AS depth, 'Part ' || k AS title, '' AS raw_href, false AS external, '' AS href, '' AS fragment, k FROM d WHERE k % 10 = 0
 UNION ALL SELECT book, 2 * k + 1, 2 * (k - k % 10), 1, 'Chapter ' || k, 'x', k % 7 = 3, CASE WHEN k % 7 = 3 THEN '' ELSE 'doc' || doc_id END, CASE k % 5 WHEN 1 THEN 'end' WHEN 2 THEN 'gone' WHEN 3 THEN 'a' ELSE '' END, k FROM d),
l AS (SELECT *, CASE WHEN href = '' OR fragment = 'gone' THEN NULL WHEN fragment = 'end' THEN k + 1 ELSE k END AS own, CASE WHEN href <> '' AND fragment IN ('', 'a') THEN 's' || k END AS anchor FROM e),
g AS (SELECT book, parent_index AS node_index, min(node_index) AS by_, arg_min(own, node_index) AS below FROM l WHERE own IS NOT NULL GROUP BY book, parent_index),
b AS (SELECT l.*, coalesce(own, below) AS position, CASE WHEN own IS NULL THEN by_ END AS inherited_from FROM l LEFT JOIN g ON l.book = g.book AND l.node_index = g.node_index AND l.depth = 0)"""


def _books(spark, sf_dir):
    w = Window.partitionBy("book").orderBy("doc_id")
    d = _t(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("source").alias("book"), "doc_id", "text").withColumn("k", (F.row_number().over(w) - 1).cast("bigint"))
    href = F.concat(F.lit("doc"), "doc_id")
    k, no = F.col("k"), lambda t: F.lit(None).cast(t)
    common = [F.lit("nav").alias("toc_path"), F.lit(0).alias("toc_order")]
    groups = d.where(k % 10 == 0).select("book", *common, (2 * k).alias("node_index"), no("bigint").alias("parent_index"), F.lit(0).alias("depth"), F.concat(F.lit("Part "), k).alias("title"), F.lit("").alias("raw_href"), F.lit("").alias("resource_href"), F.lit("").alias("fragment"), F.lit(False).alias("external"))
    outside = k % 7 == 3
    fragment = F.when(k % 5 == 1, "end").when(k % 5 == 2, "gone").when(k % 5 == 3, "a").otherwise("")
    links = d.select("book", *common, (2 * k + 1).alias("node_index"), (2 * (k - k % 10)).alias("parent_index"), F.lit(1).alias("depth"), F.concat(F.lit("Chapter "), k).alias("title"), F.lit("x").alias("raw_href"), F.when(outside, "").otherwise(href).alias("resource_href"), fragment.alias("fragment"), outside.alias("external"))
    anchor = F.concat(F.lit("s"), k)
    tables = {
        "toc": groups.unionByName(links),
        "resources": d.select("book", href.alias("href"), k.alias("start"), F.lit(1).alias("n"), F.concat(F.lit("Document "), "doc_id").alias("title")),
        "fragments": d.select("book", href.alias("href"), F.lit("end").alias("fragment"), no("string").alias("anchor")).unionByName(d.select("book", href.alias("href"), F.lit("a").alias("fragment"), anchor.alias("anchor"))),
        "segments": d.select("book", k.alias("pos"), anchor.alias("anchor"), href.alias("resource_href"), F.when(k % 10 == 0, "heading").otherwise("text").alias("kind"), F.col("text").alias("source")),
    }
    return tables, toc.with_groups(toc.located(tables["toc"], tables["resources"], tables["fragments"], tables["segments"]))


@_query(f"WITH {_BOOKS} SELECT book, node_index, depth, title, position, anchor, inherited_from FROM b")
def toc_boundary_join(spark, sf_dir):
    return _books(spark, sf_dir)[1].select("book", "node_index", "depth", "title", "position", "anchor", "inherited_from")


_CUTS = f"""{_BOOKS}, i AS (SELECT * FROM b WHERE position IS NOT NULL AND NOT external),
c AS (SELECT book, position, min(depth) AS lo FROM i GROUP BY 1, 2),
x AS (SELECT DISTINCT * FROM (SELECT c.book, t.d AS depth, position FROM c JOIN (SELECT DISTINCT book, depth AS d FROM i) t ON c.book = t.book AND lo <= t.d UNION ALL SELECT DISTINCT book, depth, 0 FROM i)),
s AS (SELECT book, depth, position, coalesce(lead(position) OVER (PARTITION BY book, depth ORDER BY position), (SELECT max(total) FROM d WHERE d.book = x.book)) AS stop FROM x),
m AS (SELECT s.book, s.depth, s.position, sum(length(text)) AS chars FROM s JOIN d ON d.book = s.book AND d.k >= s.position AND d.k < s.stop GROUP BY 1, 2, 3),
n AS (SELECT book, depth, median(chars) AS median_chars FROM m GROUP BY 1, 2)"""


@_query(f"WITH {_CUTS} SELECT book, depth, median_chars, depth = coalesce(max(CASE WHEN median_chars >= 3000 THEN depth END) OVER (PARTITION BY book), min(depth) OVER (PARTITION BY book)) AS chosen FROM n")
def median_slice_depth(spark, sf_dir):
    tables, entries = _books(spark, sf_dir)
    m = toc.slice_medians(entries, tables["segments"])
    best = toc.chosen_depths(m).select("book", F.col("depth").alias("best"))
    return m.join(best, "book").select("book", "depth", "median_chars", (F.col("depth") == F.col("best")).alias("chosen"))


@_query(f"""WITH {_CUTS}, h AS (SELECT book, coalesce(max(CASE WHEN median_chars >= 3000 THEN depth END), min(depth)) AS depth FROM n GROUP BY book),
u AS (SELECT i.book, position, arg_min(title, node_index) FILTER (WHERE anchor IS NOT NULL) AS t1, arg_max(title, node_index) AS t2 FROM i JOIN h ON i.book = h.book AND i.depth <= h.depth GROUP BY 1, 2),
z AS (SELECT d.book, d.k AS pos, d.text, max(u.position) AS at FROM d LEFT JOIN u ON u.book = d.book AND u.position <= d.k GROUP BY 1, 2, 3)
SELECT z.book, z.pos, CAST(dense_rank() OVER (PARTITION BY z.book ORDER BY coalesce(z.at, -1)) - 1 AS INTEGER) AS chapter, CASE WHEN z.at IS NULL THEN CASE WHEN first_value(z.pos) OVER (PARTITION BY z.book ORDER BY z.pos) % 10 = 0 THEN first_value(z.text) OVER (PARTITION BY z.book ORDER BY z.pos) ELSE '' END ELSE coalesce(t1, t2) END AS chapter_title
FROM z LEFT JOIN u ON u.book = z.book AND u.position = z.at""")
def logical_chapters(spark, sf_dir):
    tables, _ = _books(spark, sf_dir)
    return toc.logical_chapters(tables["toc"], tables["resources"], tables["fragments"], tables["segments"]).select("book", "pos", "chapter", "chapter_title")


_TITLES = ["Notes", "The Index Case", "ABOUT the authors", "Bibliography", "注释一", "indexes"]
_TITLE = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLES)) + " ELSE substr(text, 1, 30) END"


@_query(rf"""SELECT doc_id, (regexp_matches(title, '(?i)(^|[^\p{{L}}\p{{N}}_])({"|".join(toc.BACK_WORDS)})($|[^\p{{L}}\p{{N}}_])') OR regexp_matches(title, '{"|".join(toc.BACK_MARKS)}'))
 AND NOT (n > 1 AND i / greatest(n - 1, 1) > 0.15 AND i / greatest(n - 1, 1) < 0.65) AS is_back FROM (
  SELECT doc_id, coalesce({_TITLE}, '') AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def back_matter_titles(spark, sf_dir):
    title = F.lit(None)
    for i, t in enumerate(_TITLES):
        title = F.when(F.col("doc_id") % 8 == i, t) if i == 0 else title.when(F.col("doc_id") % 8 == i, t)
    w = Window.partitionBy("source")
    d = _t(spark, sf_dir, "documents").select("doc_id", title.otherwise(F.substring("text", 1, 30)).alias("title"), (F.row_number().over(w.orderBy("doc_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return d.select("doc_id", toc.is_back_matter(F.col("title"), F.col("i"), F.col("n")).alias("is_back"))


@_query(f"WITH {_BOOKS}, f AS (SELECT book, k % 3 AS t, min(node_index) AS a FROM e WHERE NOT external GROUP BY 1, 2) SELECT book, 'T' || t AS title, CAST(row_number() OVER (PARTITION BY book ORDER BY a) AS INTEGER) AS nth FROM f")
def titles_once(spark, sf_dir):
    tables, _ = _books(spark, sf_dir)
    k = F.floor(F.col("node_index") / 2)
    e = tables["toc"].withColumn("title", F.concat(F.lit("T"), k % 3)).withColumn("title_translated", F.lit(None).cast("string"))
    return toc.titles_to_translate(e).select("book", "title", "nth")


@_query("SELECT source AS book, CAST(d.doc_id AS VARCHAR) AS href FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def undeclared_resources(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").cast("string").alias("resource_href"))
    known = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("book"), F.col("doc_id").cast("string").alias("href"))
    return toc.undeclared(d, known)


# Names, keys, accounts.

@_query(r"""SELECT page_id, CASE WHEN s = '' THEN 'book' ELSE s END AS slug, CASE WHEN f = '' THEN 'translated' ELSE f END AS file_name, regexp_extract(split_part(url, '#', 1), '[^/]*$') AS base_name FROM (
  SELECT page_id, url, regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_一-鿿぀-ヿ-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s,
    substr(regexp_replace(regexp_replace(trim(regexp_replace(url, '[\\/:*?"<>|\r\n\t]+', ' ', 'g')), '^[.]+|[.]+$', '', 'g'), '\s+', ' ', 'g'), 1, 120) AS f FROM pages)""")
def page_names(spark, sf_dir):
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", tx.slug(u).alias("slug"), tx.safe_filename(u).alias("file_name"), tx.base_name(u).alias("base_name"))


_TAGS = ["English", " DE ", "français", "zh-CN", "und", "12", "日语", "x"]
_CODES = ["en", "de", "fr", "zh", "", "", "ja", "x"]


@_query("SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END AS code, CASE WHEN doc_id % 8 = 3 THEN 'zh-Hans' ELSE CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_TAGS)) + " END END AS tag FROM documents")
def language_codes(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, _TAGS)), (F.col("doc_id") % 8 + 1).cast("int")).alias("c"))
    return d.select("doc_id", tx.language_code(F.col("c")).alias("code"), tx.epub_language(F.col("c")).alias("tag"))


_CALLS = "(SELECT CASE WHEN user_id % 3 = 0 THEN 'strong' WHEN user_id % 3 = 1 THEN 'cheap' ELSE 'fast' END AS tier, 'stage' || user_id % 5 AS stage, event_type AS operation, CAST(floor(value) AS BIGINT) AS v, CASE event_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' END AS outcome FROM events)"
_SUMS = "count(*) AS calls, CAST(sum(v) AS BIGINT) AS prompt_tokens, CAST(sum(2 * v) AS BIGINT) AS completion_tokens, CAST(sum(3 * v) AS BIGINT) AS total_tokens, CAST(sum(v // 3) AS BIGINT) AS cache_hit_tokens, CAST(sum(v - v // 3) AS BIGINT) AS cache_miss_tokens, CASE WHEN sum(v) > 0 THEN round(sum(v // 3) / sum(v), 4) ELSE 0.0 END AS cache_hit_rate, count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome = 'rejected') AS rejected"


@_query(" UNION ALL ".join(f"SELECT '{c}' AS by, {c} AS name, {_SUMS} FROM {_CALLS} GROUP BY {c}" for c in ("tier", "stage", "operation")) + f" UNION ALL SELECT 'total', NULL, {_SUMS} FROM {_CALLS}")
def usage_summary(spark, sf_dir):
    v = F.floor("value").cast("bigint")
    hit = F.floor(v / 3).cast("bigint")
    u = F.col("user_id")
    calls = _t(spark, sf_dir, "events").select(
        F.when(u % 3 == 0, "strong").when(u % 3 == 1, "cheap").otherwise("fast").alias("tier"), F.concat(F.lit("stage"), u % 5).alias("stage"), F.col("event_type").alias("operation"), v.alias("prompt_tokens"), (2 * v).alias("completion_tokens"),
        (3 * v).alias("total_tokens"), hit.alias("cache_hit_tokens"), (v - hit).alias("cache_miss_tokens"), F.when(F.col("event_id") % 4 == 0, "accepted").when(F.col("event_id") % 4 == 1, "rejected").alias("outcome"),
    )
    return usage.summary(calls)


@_query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def replay_events_dedupe(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@_query("""SELECT count(*) FILTER (WHERE t = 1 AND f = 1) AS hits, count(*) FILTER (WHERE t = 1 AND f IS NULL) AS missed, count(*) FILTER (WHERE t IS NULL) AS false_positives FROM
 (SELECT doc_id, 1 AS t FROM labels WHERE quality = 0) a FULL JOIN (SELECT doc_id, 1 AS f FROM documents WHERE length(text) < 400) b ON a.doc_id = b.doc_id""")
def injected_found(spark, sf_dir):
    return usage.found_of(_t(spark, sf_dir, "labels").where("quality = 0"), _t(spark, sf_dir, "documents").where("length(text) < 400"), ["doc_id"])


@_query("""SELECT count(*) AS pairs, count(*) FILTER (WHERE v = 'a') AS a_wins, count(*) FILTER (WHERE v = 'b') AS b_wins, count(*) FILTER (WHERE v = 'tie') AS ties,
 round((count(*) FILTER (WHERE v = 'b') - count(*) FILTER (WHERE v = 'a')) / count(*), 6) AS margin, (count(*) FILTER (WHERE v = 'b') - count(*) FILTER (WHERE v = 'a')) / count(*) >= -0.1 AS passes
 FROM (SELECT CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'tie' END AS v FROM events)""")
def ab_margin(spark, sf_dir):
    t = F.col("event_type")
    return usage.ab_margin(_t(spark, sf_dir, "events").select(F.when(t == "click", "a").when(t == "view", "b").otherwise("tie").alias("verdict")))
