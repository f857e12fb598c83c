from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import glossary, lint, segments, terms
from quire.sources.html import blocks_of


def test_heading_numbers(spark):
    rows = [("第5章", "第五章"), ("第1024章", "第一千零二十四章"), ("第0章", "第0章"), ("第10000章", "第10000章"), ("第１０章", "第十章"), ("第五章", "第五章")]
    got = spark.createDataFrame(rows, "a string, b string").select(tx.number_heading(F.col("a")).alias("x"), "b").collect()
    assert all(r.x == r.b for r in got)


def test_strip_is_pythons(spark):
    texts = ["　a b ", "\x1c x\x1f", "\n\t", "é "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.py_strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in got)


def test_pack_closes_before_it_overflows(spark):
    d = spark.createDataFrame([([1000, 900, 5000, 10, 20],)], "n array<int>")
    assert d.select(segments.pack_ids(F.col("n"), 1800).alias("k")).first().k == [0, 1, 2, 3, 3]


def test_length_flags(spark):
    rows = [("a" * 10, "", "empty"), ("a" * 10, "aa", "too_short"), ("a" * 10, "a" * 31, "too_long"), ("a" * 10, "a" * 30, "ok"), ("  ", "x", "ok"), ("a" * 10, None, "empty")]
    d = spark.createDataFrame(rows, "s string, t string, e string")
    assert all(r.f == r.e for r in d.select(lint.length_flag(F.col("s"), F.col("t")).alias("f"), "e").collect())


def test_upsert_fold(spark):
    rows = [("x", "a", "low", 1), ("x", "b", "high", 2), ("x", "c", "high", 3), ("x", "b", "low", 4), ("y", "q", "odd", 1), ("y", "r", "medium", 2)]
    steps = glossary.fold(spark.createDataFrame(rows, "source string, target string, confidence string, seq long"))
    got = {r.source: (r.target, r.confidence, r.status) for r in glossary.terms(steps).collect()}
    assert got == {"x": ("b", "high", "conflict"), "y": ("q", "odd", "conflict")}  # the loser leaves a conflict too
    assert [(r.source, r.result) for r in steps.orderBy("source", "seq").collect()] == [("x", "inserted"), ("x", "updated"), ("x", "conflict"), ("x", "unchanged"), ("y", "inserted"), ("y", "conflict")]


def test_contained_by_both_ways(spark, monkeypatch):
    d = spark.createDataFrame([(1, "An Artful party"), (2, None), (3, "nothing")], "d long, text string")
    t = spark.createDataFrame([(7, "artful"), (8, "party"), (9, "absent")], "k long, term string")
    want = {(1, 7), (1, 8)}
    assert {tuple(r) for r in terms.contained(d, t, ["d"], "text", ["k"], "term").collect()} == want
    monkeypatch.setattr(terms, "TERM_BYTES", 100)  # some passes
    assert {tuple(r) for r in terms.contained(d, t, ["d"], "text", ["k"], "term").collect()} == want


def test_contained_finds_short_terms_both_ways(spark, monkeypatch):
    d = spark.createDataFrame([(1, "An Artful party"), (2, None), (3, "art"), (4, ""), (5, "日本語の本")], "d long, text string")
    t = spark.createDataFrame(list(enumerate(["a", "rt", "art", "Part", "artful", "y", "本", "日本", "absent", "", "zz"])), "k long, term string")
    find = lambda: sorted(tuple(r) for r in terms.contained(d, t, ["d"], "text", ["k"], "term").collect())
    want = find()
    assert {(1, 0), (3, 1), (1, 2), (1, 3), (5, 6), (5, 7)} <= set(want)
    monkeypatch.setattr(terms, "TERM_BYTES", 100)  # some passes
    assert find() == want


def test_blocks_are_outermost():
    title, blocks = blocks_of("<title>T</title><h1>A</h1><p>x <b>y</b></p><ul><li>one<p>in</p></li><li>two</li></ul><script>p</script>")
    assert title == "A" and blocks == [("h1", "A"), ("p", "x y"), ("li", "onein"), ("li", "two")]


def test_untranslated(spark):
    d = spark.createDataFrame([("Same Text", "same  text", True), ("a.b@c", "a.b@c", False), ("one", "two", False)], "s string, t string, e boolean")
    assert all(r.u == r.e for r in d.select(lint.untranslated(F.col("s"), F.col("t")).alias("u"), "e").collect())
