"""Numbers, punctuation, headings, names and the lint, case by case."""

import pytest
from pyspark.sql import functions as F

from quire.functions import numbers
from quire.functions import text as tx
from quire.operators import lint, terms


def column(spark, values, f):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in d.orderBy("i").select(f(F.col("v"))).collect()]


CASES = [  # source, target, missing numbers
    ("He walked thirty miles.", "他走了三英里。", [30]),
    ("It cost $25,000.", "花费2.5万美元。", []),
    ("A couple of weeks passed.", "过了两三周。", []),
    ("It happened in 1958.", "发生在1958年。", []),
    ("He climbed the Forty Steps.", "他爬上了四十级台阶。", []),
    ("Sales went from $500,000 in 1958 to $21 million two years later, with one thousand hires.", "销售额从1958年的50万美元升至两年后的2100万美元，多了千名员工。", []),
    ("Exports rose from $600 million in 1965 to $60 billion around two decades later.", "出口额从1965年的6亿美元升至大约二十年后的600亿美元。", []),
    ("Silicon with 1.2 million switches.", "集成了 120 万个开关的硅片。", []),
    ("The rise of the Taiwan Semiconductor 164Manufacturing Company.", "台积电的崛起。", []),
    ("He had not come since fleeing nearly four decades earlier.", "他近四十年前逃离后再没来过。", []),
    ("A built-in advantage, 169improving its yield.", "享有先天优势，能提高良率。", []),
    ("China had only fifteen hundred computers.", "中国仅有一千五百台计算机。", []),
    ("Good for 216his health.", "有益于健康。", []),
    ("Over 60 percent of all profits.", "逾六成利润。", []),
    ("A wave of COVID-19 cases.", "新冠病例激增。", []),
    ("About fifty percent of the inhabitants.", "大约一半人。", []),
    ("She gives him a high five.", "她跟他击了个掌。", [5]),
    ("Between $30 to $50 billion.", "在300亿到500亿美元之间。", []),
    ("In the 1980s", "20世纪80年代", []),
    ("In the 1600s", "十七世纪", []),
    ("Born in 1943", "生于一九四几年", []),
    ("eight hundred and thirty-six men", "八百三十六人", []),
    ("five grand", "五千", []),
    ("seven hundred and then some", "七百多", []),
    ("Chapter 12 of 99", "第十二章", [99]),
    ("３ and 17", "十七", []),
    ("", "", []),
]


@pytest.mark.parametrize("source, target, missing", CASES)
def test_numbers(source, target, missing):
    assert numbers.missing_numbers(source, target) == missing


def test_number_quirks():
    assert numbers.target_numbers("50万") == {500000, 0} and numbers.target_numbers("2千") == {2000, 1000}
    assert numbers.han_value("三万亿") == 30000 and numbers.target_numbers("零零") == set() and numbers.target_numbers("一九二二") == {1922}
    assert numbers.source_numbers("第3章と５", "ja") == set() and numbers.source_numbers("3 五", "ja") == {3}
    assert numbers.figures("AD-A955 F-16 9-7 3.5 1,500") == {9, 7, 3.5, 1500} and numbers.spoken("twenty-one thousand hundred") == {21000}


def test_number_column(spark):
    d = spark.createDataFrame([(a, b) for a, b, _ in CASES] + [(None, "3"), ("12", None)], "s string, t string")
    got = {(r.s, r.t): r.d for r in d.withColumn("d", numbers.number_mismatch(F.col("s"), F.col("t"))).collect()}
    assert all((got[a, b] is not None) == bool(m) for a, b, m in CASES) and got[None, "3"] is None
    assert got["12", None] == "原文数值 12 未在译文中出现，请核对数字后重译"
    assert got["He walked thirty miles.", "他走了三英里。"] == "原文数值 30 未在译文中出现，请核对数字后重译——译文出现了 3"


def test_punctuation(spark):
    cases = {
        "「你好」": "“你好”", "『书名』": "‘书名’", "他说,真的吗?": "他说，真的吗？", "9.11 vs 9.8": "9.11 vs 9.8", "等等...走了--他笑了": "等等……走了——他笑了",
        "a---b": "a——b", "—": "——", "…": "……", "。。。。": "……", 'x "a" "b" "': "x “a”“b”“", "it's 'so' it's": "it’s ‘so’it’s", "中,.": "中，.", "好。 　他": "好。他", "a\tb": "a\tb", "": "",
    }
    got = column(spark, [*cases, None], tx.normalize_zh)
    assert dict(zip(cases, got)) == cases and got[-1] is None
    again = [v for v in cases.values() if v != "中，."]
    assert column(spark, again, tx.normalize_zh) == again


def test_heading_numbers(spark):
    cases = {
        "第5章 雨": "第五章 雨", "第10章": "第十章", "第22章": "第二十二章", "第100章": "第一百章", "第105章": "第一百零五章", "第110章": "第一百一十章", "第1024章": "第一千零二十四章", "第５章 全角": "第五章 全角",
        "第五章": "第五章", "第3部": "第三部", "第7节": "第七节", "第2卷": "第二卷", "第9回": "第九回", "番外：第5章": "番外：第5章", "第0章": "第0章", "第10000章": "第10000章", "": "", " 　第1010回x": " 　第一千零一十回x",
        "第 5 章": "第 5 章", "第5集": "第5集", "第5篇": "第5篇", "第007章": "第七章", "第99999999999999999999章": "第99999999999999999999章",
    }
    assert column(spark, cases, tx.number_heading) == list(cases.values())


def test_names(spark):
    assert column(spark, ["a b/c", "--", None, "日本_語!", "é 1"], tx.slug) == ["a_b_c", "--", "book", "日本_語", "é_1"]
    assert column(spark, ['.a:b  "c".', None, "...", "x" * 200], tx.safe_filename) == ["a b c ", "translated", "translated", "x" * 120]
    assert column(spark, ["English", " zh-CN ", "auto", "pt-br", "1x", None, "日文"], tx.language_code) == ["en", "zh", "", "pt", "", "", "ja"]
    assert column(spark, ["", None, "ZH_cn", "en-GB"], tx.epub_language) == ["zh-Hans", "zh-Hans", "zh-Hans", "en-GB"]
    assert column(spark, ["ＡＢＣ ß", "İ", None], tx.match_key) == ["abc ss", "i̇", None]
    assert column(spark, ["a/b.xhtml#x", "", "b"], tx.base_name) == ["b.xhtml", "", "b"]
    assert column(spark, ["Li Po", "李", "a1", "O.-x"], tx.latin_name) == [True, False, False, True]
    d = spark.createDataFrame([("ch1", "a/ch1.xhtml", None), ("Book", "x.html", " Book "), ("One", "x.html", "Book")], "t string, h string, b string")
    assert [r[0] for r in d.select(tx.echoes_name(F.col("t"), F.col("h"), F.col("b"))).collect()] == [True, True, False]
    n = spark.createDataFrame([(5, 10, 5), (7, 10, 5), (3, 0, 4), (20, 10, 5)], "o int, s int, t int")
    assert [r[0] for r in n.select(tx.rescaled(F.col("o"), F.col("s"), F.col("t"))).collect()] == [2, 4, 0, 5]


def issues(spark, pairs, asked=None, lang="en"):
    d = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(pairs)], "i int, source string, target string")
    asked = spark.createDataFrame(asked, "source string, target string") if asked else None
    out = {i: [] for i in range(len(pairs))}
    for r in lint.lint_targets(d, ["i"], asked, lang).orderBy("i", "place", "detail").collect():
        out[r.i].append(r.kind)
    return list(out.values())


def test_lint_rules(spark):
    long = "x" * 130
    run = "a" * 40
    pairs = [
        ("“Good morning,” she said.", "早上好，她说道。很好很好。"), ("“Good morning,” she said.", "“早上好，”她说道。"), ("「おはよう」", "「早上好」"), ("“The Book”", "《书》"), ('"Hi" he said', '"嗨"他说道的'), ("He said “hi.", "他说嗨。他说嗨"),
        ("“Hi”", None), ("isbn123", "isbn123"), ("a@b.c", "a@b.c"), ("same  Text", "sametext"), (f"{run} b", f"前 {run}"), (f"{'ab, ' * 20}", f"{'ab, ' * 20}后"), (long, "x" * 10), ("x" * 110, "xx"), ("ab", "abcdefgh"), ("  ", None), (None, "x"),
    ]
    got = issues(spark, pairs)
    assert got == [["quote_loss"], [], [], [], ["quote_loss"], [], ["empty", "quote_loss"], [], [], ["untranslated"], ["untranslated"], [], ["too_short"], [], ["too_long"], [], []]
    assert issues(spark, [("same", "same"), ("中文文本", "短")], lang="zh") == [[], ["too_short"]]
    assert "untranslated" not in issues(spark, [("same", "same")], lang="zh")[0]


def test_lint_terms_and_order(spark):
    asked = [("Li", "李"), ("堀北", "堀北铃音"), ("art", "艺术"), ("none", ""), ("Bob", "鲍勃")]
    pairs = [("“Li and 30 Bob", "某人和某人去了很远的地方"), ("Liya, party", "利亚和聚会"), ("堀北さん", "堀北同学"), ("看Li了", "看了"), ("Li", "李")]
    got = issues(spark, pairs, asked)
    assert got[0] == ["quote_loss", "number_mismatch", "term_miss", "term_miss"] and got[1] == [] and got[2] == ["term_miss"] and got[3] == [] and got[4] == []


def test_introduced_and_feedback(spark):
    b = spark.createDataFrame([(1, "empty"), (2, "empty")], "i int, kind string")
    a = spark.createDataFrame([(1, "empty"), (1, "too_long"), (1, "too_long")], "i int, kind string")
    assert [tuple(r) for r in lint.introduced(b, a, ["i"]).collect()] == [(1, "too_long")]
    f = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "i int, o int, d string")
    assert lint.feedback(f, ["i"], "o", "d").first().feedback == "a；b"


@pytest.mark.parametrize("weight", [16 << 20, 40])
def test_contained_by_brute_force(spark, monkeypatch, weight):
    monkeypatch.setattr(terms, "TERM_BYTES", weight)  # one pass, or one a term or two
    texts = ["An Artful party", "art", "ＡＲＴ deco", None, "", "Straße", "STRASSE", "state_art art2", "art.", "李art", "x art y"]
    asked = [("t1", "art"), ("t1", "art"), ("t2", "party"), ("t3", ""), ("t4", None), ("t5", "strasse"), ("t6", "李"), ("t7", "art")]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, "art")], "i int, t string")
    q = spark.createDataFrame(asked, "k string, term string")
    got = lambda m: sorted(map(tuple, terms.contained(d, q, ["i"], "t", ["k"], "term", match=m).collect()))
    want = lambda f: sorted({(i, k) for i, t in enumerate(texts) if t for k, a in asked if a and f(a, t)})
    assert got("lower") == want(lambda a, t: a.lower() in t.lower())
    assert got("exact") == want(lambda a, t: a in t)
    assert got("fold") == want(lambda a, t: tx.fold_text(a) in tx.fold_text(t)) and (2, "t1") in got("fold") and (5, "t5") in got("fold")
    import re

    assert got("word") == want(lambda a, t: a in t if terms.unspaced(a) else re.search(rf"\b{re.escape(a)}\b", t))


def test_people_and_aliases(spark):
    d = spark.createDataFrame([(1, "Greg left. catherine the great"), (2, "田中さん"), (3, "Greg's"), (4, "gregory van"), (5, "头 衔")], "i int, t string")
    p = spark.createDataFrame([("Greg McKeown", []), ("田中太郎", []), ("Catherine the Great", ["Kate Van"]), ("太郎 頭", None)], "source string, aliases array<string>")
    assert sorted(map(tuple, terms.people_in(d, p, ["i"], "t").collect())) == [(1, "Greg McKeown"), (2, "田中太郎"), (3, "Greg McKeown")]
    t = spark.createDataFrame([("GREG", ["x"], "人物", True), ("zz", ["gregory"], "称谓", False), ("yy", ["VAN"], "术语", False), ("田中太郎", [], "人物", True)], "source string, aliases array<string>, type string, locked boolean")
    assert sorted(map(tuple, terms.chapter_terms(d, t, ["i"], "t").collect())) == [(1, "GREG"), (2, "田中太郎"), (3, "GREG"), (4, "GREG"), (4, "yy")]


def test_candidates_by_hand(spark):
    text = "But Phoebe Smith met the Bank of England. Phoebe went. I saw Phoebe. The TSMC and III. TSMC of the Old Town; yes! Don't Jean-Paul O'Brien. “Yes?” Do you."
    d = spark.createDataFrame([(1, text), (2, "Then Phoebe left Cornwall. We like Cornwall.")], "k int, text string")
    got = {r.surface: (r.n, r.n_docs, r.first_doc) for r in terms.candidates(d, "k").collect()}
    assert got["Phoebe Smith"] == (1, 1, 1) and got["Bank of England"] == (1, 1, 1) and got["Phoebe"] == (3, 2, 1) and got["TSMC"] == (2, 1, 1) and got["Cornwall"] == (2, 1, 2) and got["Old Town"] == (1, 1, 1)
    assert not {"But", "III", "Don", "Do", "Yes", "The"} & set(got)
    assert [r.context for r in terms.contexts(d, "k").where("surface = 'Phoebe'").orderBy("nth").collect()] == ["Phoebe went.", "I saw Phoebe."]


def test_candidates_of_runs_of_any_length(spark):
    """A greedy group in a Java pattern recurses, so that such runs overflowed the stack and ended executors."""
    n = 20_000
    names, stops = " ".join(["Alpha The"] * n), " ".join(["The"] * n)
    letters = "A" + "b\U00010428" * n  # letters in one and in two Java characters
    d = spark.createDataFrame([(1, f"The {names} Beta And Of"), (2, f"{stops} Gamma {stops} Delta {stops}"), (3, stops), (4, f"saw {letters} or {letters}")], "k int, text string")
    got = {r.surface: (r.n, r.n_docs, r.first_doc) for r in terms.candidates(d, "k").collect()}
    assert got == {f"{names} Beta": (1, 1, 1), f"Gamma {stops} Delta": (1, 1, 2), letters: (2, 1, 4)}
