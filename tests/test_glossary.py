"""The ordered glossary fold, residue and rewrites."""

import random

from quire.operators import glossary as g

FIELDS = "source string, seq long, op string, target string, confidence string, locked boolean, aliases array<string>, gender string"


def folded(spark, rows):
    return g.fold(spark.createDataFrame(rows, FIELDS))


def test_rules(spark):
    rows = [
        ("a", 1, None, "甲", "medium", None, ["x"], "m"), ("a", 2, None, "甲", "high", True, ["y", "x"], "f"), ("a", 3, None, "乙", "medium", None, [], ""), ("a", 4, None, "丙", "high", None, [], None), ("a", 5, None, "丁", "low", True, [], None),
        ("b", 1, "lock", None, None, None, None, None), ("b", 2, None, "一", "odd", None, None, None), ("b", 3, "confirm", "二", None, None, None, None), ("b", 4, "confirm", "一", None, None, None, None), ("b", 5, "confirm", "一", None, None, None, None), ("b", 6, None, "三", "high", None, None, None),
        ("c", 9, "resolve", "终", None, None, None, None), ("d", 1, None, "旧", "low", None, None, None), ("d", 2, None, "新", "low", None, None, None), ("d", 3, "resolve", "定", None, None, None, None), (None, 1, None, "x", None, None, None, None),
    ]
    steps = folded(spark, rows).cache()
    got = {}
    for r in steps.orderBy("source", "seq").collect():
        got.setdefault(r.source, []).append(r.result)
    assert got == {"a": ["inserted", "unchanged", "conflict", "updated", "updated"], "b": ["ignored", "inserted", "ignored", "confirmed", "ignored", "conflict"], "c": ["resolved"], "d": ["inserted", "conflict", "resolved"]}
    t = {r.source: r for r in g.terms(steps).collect()}
    assert (t["a"].target, t["a"].confidence, t["a"].locked, t["a"].status, t["a"].aliases, t["a"].gender) == ("丁", "low", False, "conflict", ["x", "y"], "f")
    assert (t["b"].target, t["b"].locked, t["b"].confidence, t["b"].status) == ("一", True, "high", "conflict")
    assert (t["c"].target, t["c"].locked) == ("终", True) and (t["d"].target, t["d"].status) == ("定", "ok")
    assert {(r.source, r.seq, r.existing_target, r.proposed_target) for r in g.open_conflicts(steps).collect()} == {("a", 3, "甲", "乙"), ("a", 4, "甲", "丙"), ("a", 5, "丙", "丁"), ("b", 6, "一", "三")}
    assert {r.result: r.n for r in g.results(steps).collect()}["updated"] == 2
    assert [r.source for r in g.low_confidence(g.terms(steps)).collect()] == ["a", "b"]


def test_a_losing_proposal_leaves_a_conflict(spark):
    (t,) = g.terms(folded(spark, [("a", 1, None, "甲", "high", None, None, None), ("a", 2, None, "乙", "low", None, None, None)])).collect()
    assert (t.target, t.status) == ("甲", "conflict")


def test_fold_equals_steps_in_order(spark):
    r = random.Random(2)
    rows = [(f"s{r.randrange(9)}", i, r.choice([None, None, "confirm", "lock", "resolve"]), r.choice("甲乙丙"), r.choice(["low", "medium", "high", None]), r.random() < 0.1, [r.choice("xyz")], r.choice(["", "m"])) for i in range(400)]
    state = {}
    for x in rows:
        e = dict(zip([f.split()[0] for f in FIELDS.split(", ")], x)) | dict.fromkeys(("reading", "note", "kind", "chapter"))
        state[x[0]], _ = g.step(state.get(x[0]), e)
    got = {t.source: (t.target, t.confidence, t.locked, t.status, t.aliases) for t in g.terms(folded(spark, rows)).collect()}
    assert got == {s: (t["target"], t["confidence"], t["locked"], t["status"], t["aliases"]) for s, t in state.items() if t}
    assert g.terms(folded(spark, [])).count() == 0


def test_memory_and_seeds(spark):
    d = spark.createDataFrame([(" a　", "1", 1), ("a", "2", 2), ("b", "3", 1)], "s string, t string, o int")
    assert sorted((r.seq, r.target) for r in g.memory(d, "s", "t", "o").collect()) == [(1, "3"), (2, "2")]
    people = spark.createDataFrame([(0, "Ann", "安", "f"), (1, "", "x", "")], "nth int, source string, target string, gender string")
    rest = spark.createDataFrame([(0, "City", "城", "地点")], "nth int, source string, target string, kind string")
    assert [(r.source, r.seq, r.kind) for r in g.seeds(people, rest).orderBy("seq").collect()] == [("Ann", 1, "人物"), ("City", 2, "地点")]


def test_residue(spark):
    assert g.latin_residue("他是 Mark 的朋友", "Mark", "马克") == "他是马克的朋友"
    assert g.latin_residue("马克 (Mark)", "Mark", "马克") is None and g.latin_residue("only Mark here", "Mark", "马克") is None
    assert g.latin_residue("看Liya了", "Li", "李") is None and g.latin_residue("他是Mark。", "Mark", "马克") is None
    far = "中文" + "x" * 20 + " Mark " + "y" * 20
    assert g.latin_residue(far, "Mark", "马克") is None
    d = spark.createDataFrame([(1, "他是 Mark 和 Ann 的朋友"), (2, "无"), (3, None)], "i int, t string")
    t = spark.createDataFrame([("Mark", "马克", True), ("Ann", "安", True), ("的", "x", True), ("朋", "y", False)], "source string, target string, locked boolean")
    assert [tuple(r) for r in g.fix_residue(d, ["i"], "t", t).collect()] == [(1, "他是 Mark 和 Ann 的朋友", "他是马克和安的朋友")]


def test_literal_rewrites(spark):
    d = spark.createDataFrame([("佳木子和佳木",), ("none",), (None,)], "t string")
    got = g.literal_rewrites(d, "t", [("佳木", "甲"), ("佳木子", "乙"), ("甲", "丙")]).collect()
    assert [tuple(r) for r in got] == [("乙和甲", 2), ("none", 0), (None, 0)]
