import random

from pyspark.sql import functions as F

from quire.operators import splits, variants
from quire.sources import plain


def test_chapters_and_paragraphs(spark, tmp_path):
    (tmp_path / "Book.one.md").write_text("before\r\n\n# First \nA\nB\n\n \nC\n#### no\n第三章 x\n\n", encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "skip.bin").write_text("# no")
    got = [tuple(r) for r in plain.read_books(spark, str(tmp_path)).drop("path").orderBy("chapter", "seg").collect()]
    assert got == [
        (0, "Book.one", 0, "text", "before"),
        (1, "First", 0, "heading", "First"),
        (1, "First", 1, "text", "A\nB"),
        (1, "First", 2, "text", "C\n#### no"),
        (2, "第三章 x", 0, "heading", "第三章 x"),
    ]


def test_book_that_starts_with_a_heading(spark):
    d = spark.createDataFrame([(1, "## A\nx"), (2, None), (3, ""), (4, "#\n##  \ny")], "k int, t string")
    got = {tuple(r) for r in plain.segments(d, "k", "t", F.lit("name")).collect()}
    assert got == {(1, 0, "A", 0, "heading", "A"), (1, 0, "A", 1, "text", "x"), (4, 0, "name", 0, "text", "#\n##  \ny")}


def cut(text, limit):
    """The rule of split_long, character by character."""
    sents, now = [], ""
    for c in text:
        now += c
        if c in splits.ENDS:
            sents, now = sents + [now], ""
    out, pack = [], ""
    for s in sents + [now] * bool(now):
        if pack and len(pack) + len(s) > limit:
            out, pack = out + [pack], ""
        if len(s) <= limit:
            pack += s
            continue
        while len(s) > limit:
            at = next((p for p in (s.rfind(c, 0, limit + 1) for c in " \t\n") if p > 0), limit)
            out, s = out + [s[:at]], s[at:]
        out += [s] * bool(s)
    return out + [pack] * bool(pack)


def test_split_long(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("ab é😀 \t.。\n") if r.random() < 0.4 else "x" for _ in range(r.randrange(0, 200))) for _ in range(150)]
    rows = [(i, t, "z") for i, t in enumerate([*texts, None, "", "y" * 5000])]
    for limit in (1, 7, 30):
        got = {}
        for x in splits.split_long(spark.createDataFrame(rows, "k int, t string, piece string"), "t", limit).orderBy("k", "piece").collect():
            assert x.cont == (x.piece > 0)
            got.setdefault(x.k, []).append(x.t)
        for k, t, _ in rows:
            assert got[k] == (cut(t, limit) if t and len(t) > limit else [t])


def test_one_off_spellings(spark):
    names = spark.createDataFrame([("佳子花",), ("甲乙",), (None,), ("佳子花",), ("ab",), ("春夏秋冬",)], "t string")
    corpus = spark.createDataFrame([("佳予花来了，佳子花",), ("x佳予花y",), (None,), ("",), ("春夏秋东春夏秋冬",)], "c string")
    got = {tuple(r) for r in variants.one_off(names, "t", corpus, "c").collect()}
    assert got == {("佳子花", "佳予花", 2), ("春夏秋冬", "春夏秋东", 1)}
    many = spark.createDataFrame([("".join(["春夏", chr(0x4E00 + i)]),) for i in range(9)], "c string")
    assert variants.one_off(spark.createDataFrame([("春夏秋",)], "t string"), "t", many, "c").count() == 0
