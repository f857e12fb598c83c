"""JSON out of answers, model operators with a stub, streams, usage."""

import json

import pytest
from pyspark.sql import functions as F

from quire import streaming
from quire.functions import json_loose as jl
from quire.operators import model, segments, usage

READ = [
    ('{"a": 1}', {"a": 1}), ('x ```json\n[1, 2]\n``` y', [1, 2]), ("```\n{\"a\": 2}\n```", {"a": 2}), ('Here: [1, 2] done', [1, 2]), ('so {"a": [1]} end', [1]), ('{"a": 1}}', {"a": 1}), ('{"t": "he said "hi" now"}', {"t": 'he said "hi" now'}),
    ('{"t": ["a "b" c", "d"]}}', {"t": ['a "b" c', "d"]}), ('{"a": "x\\"y"}', {"a": 'x"y'}), (" 3 ", 3), ('["他说"好"。"]', ['他说"好"。']),
]


@pytest.mark.parametrize("text, value", READ)
def test_loose_json(text, value):
    assert jl.parse(text) == value


def test_no_json(spark):
    for t in ("", None, "nothing", "{", '{"a": '):
        with pytest.raises(ValueError):
            jl.parse(t)
    assert jl.keyed({"a": 1}, "a") == 1 and jl.keyed({}, "a", 5) == 5 and jl.keyed([1], "a") == [1] and jl.keyed([], "a", 0) == 0
    assert jl.reasoning_tokens({"completion_tokens_details": {"reasoning_tokens": "7"}}) == 7 and jl.reasoning_tokens({"reasoning_tokens": None}) == 0 and jl.usage_int({"x": "q"}, "x") == 0 and jl.reasoning_tokens(None) == 0
    d = spark.createDataFrame([(t,) for t, _ in READ] + [("none",), (None,)], "t string")
    got = [r[0] for r in d.select(jl.parsed(F.col("t"))).collect()]
    assert [json.loads(x) for x in got[:-2]] == [v for _, v in READ] and got[-2:] == [None, None]
    assert d.limit(1).select(jl.parsed(F.col("t"), "a")).first()[0] == "1"


def test_answers_are_kept(spark, tmp_path):
    class Counting:
        def __init__(self, path):
            self.path = path

        def complete(self, prompt, operation):
            with open(self.path, "a") as f:
                f.write(prompt + "\n")
            if prompt == "bad":
                raise RuntimeError("no")
            return prompt.upper()

    log = tmp_path / "log"
    log.write_text("")
    d = spark.createDataFrame([(1, "op", "a"), (2, "op", "a"), (3, "op", "bad"), (4, "op2", "a")], "i int, operation string, prompt string")
    ask = lambda: {r.i: r.answer for r in model.answered(spark, d, Counting(str(log)), str(tmp_path / "t"), tries=2).collect()}
    assert ask() == {1: "A", 2: "A", 3: None, 4: "A"} and sorted(log.read_text().split()) == ["a", "a", "bad", "bad"]
    assert ask() == {1: "A", 2: "A", 3: None, 4: "A"} and log.read_text().split().count("a") == 2


def test_alignment():
    asked = []

    def ask(some):
        asked.append(len(some))
        return json.dumps({"translations": [s.upper() for s in some] if len(some) < 3 else ["x"]})

    assert model.aligned(["a", "b"], ask) == ["A", "B"] and asked == [2]
    asked.clear()
    assert model.aligned(["a", "b", "c"], ask, retries=1) == ["A", "B", "C"] and asked == [3, 3, 1, 1, 1]
    with pytest.raises(model.Misaligned):
        model.aligned(["a"], lambda _: '[" "]')


def test_batches_and_rules(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "i int, sources array<string>")
    stub = model.Stub({"translate.batch": lambda p: json.dumps([x * 2 for x in json.loads(p)])})
    assert [r.targets for r in model.translated(d, stub).orderBy("i").collect()] == [["aa", "bb"], []] and stub.complete("x", "other") == "[]"
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert v(model.fix_taken(F.lit(2), F.lit(1), F.lit("x"))) and not v(model.fix_taken(F.lit(2), F.lit(2), F.lit("x"))) and not v(model.fix_taken(F.lit(2), F.lit(1), F.lit(" ")))
    assert v(model.polish_taken(a("x"), a())) and not v(model.polish_taken(a("x"), a("x", "y"))) and v(model.polished(a("1"), a("2", "3"))) == ["1"]
    assert v(model.pair_taken(F.lit("new"), F.lit("new"))) and not v(model.pair_taken(F.lit("new"), F.lit("tie"))) and not v(model.pair_taken(F.lit(None), F.lit("new")))
    assert v(model.titles_taken(a("x", "y"), a("1", ""))) == ["1", "y"] and v(model.titles_taken(a("x"), a())) is None
    assert v(model.numbered(a("p", "q"))) == "[1] p\n[2] q" and v(model.tier_model(F.lit("fast"), {"strong": "S", "cheap": "C"})) == "C"
    r = spark.createDataFrame([(1, 3, '[{"index": "2", "type": "missing"}, {"index": 3}, {"index": "x"}, {"index": 0}]'), (2, 1, "[]"), (3, 1, None)], "k int, n int, answer string")
    assert sorted((x.k, x["index"]) for x in model.review_rows(r, ["k"], "n").collect()) == [(1, 0), (1, 2)]
    p = spark.createDataFrame([(1, '[{"source": " A ", "target": "甲", "gender": "未知"}, {"source": "B", "target": ""}]')], "k int, answer string")
    assert [(x.source, x.target, x.gender) for x in model.proposal_rows(p, ["k"]).collect()] == [("A", "甲", "")]
    c = spark.createDataFrame([(True, True, True, True), (True, True, True, False), (True, True, False, False), (True, False, False, False), (False, False, False, False)], "suspect boolean, rewritten boolean, faithful boolean, preferred boolean")
    assert tuple(model.rewrite_counters(c).first()) == (5, 4, 3, 1, 1, 1, 1)


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    line = lambda b, c, s, t: json.dumps({"book": b, "chapter": c, "seg": s, "source": "s", "target": t})
    (src / "a.json").write_text("\n".join([line("x", 0, 1, "two"), line("x", 0, 0, "one"), line("y", 0, 0, "why"), "no json"]))

    def run(name):
        stream = streaming.rolling_contexts(streaming.events(spark, str(src)).where("book IS NOT NULL"), shown=2, kept=2)
        q = streaming.append_once(stream, out, str(tmp_path / name), ["book", "chapter", "seg"]).trigger(availableNow=True).start()
        q.awaitTermination()

    run("c1")
    (src / "b.json").write_text("\n".join([line("x", 1, 0, " "), line("x", 1, 1, "three"), line("x", 1, 2, "four")]))
    run("c1")
    want = {("x", 0, 0): "", ("x", 0, 1): "one", ("y", 0, 0): "", ("x", 1, 0): "one\ntwo", ("x", 1, 1): "one\ntwo", ("x", 1, 2): "two\nthree"}
    rows = lambda: sorted((tuple(r)[:3], r.context) for r in spark.read.parquet(out).collect())
    assert rows() == sorted(want.items())
    run("c2")  # everything is sent again
    assert rows() == sorted(want.items())
    done = spark.read.parquet(out)
    assert streaming.pending(spark.createDataFrame([("x", 0), ("z", 0)], "book string, chapter int"), done, ["book", "chapter"]).collect() == [("z", 0)]


def test_packs_and_samples(spark):
    d = spark.createDataFrame([(1, [5, 5, 1, 20, 3]), (2, []), (3, None)], "i int, n array<int>")
    assert [r.p for r in d.select("i", segments.pack_ids(F.col("n"), 10).alias("p")).orderBy("i").collect()] == [[0, 0, 1, 2, 3], [], None]
    assert [r.p for r in d.select("i", segments.pack_ids(F.col("n"), 10, more=1).alias("p")).orderBy("i").collect()][0] == [0, 1, 1, 2, 3]
    rows = spark.createDataFrame([(k, i, n) for k in "ab" for i, n in enumerate([5, 5, 1, 20, 3])], "k string, i int, n int")
    assert [(r.pack, r.nth) for r in segments.pack_rows(rows, "k", "i", F.col("n"), 10).where("k = 'b'").orderBy("i").collect()] == [(0, 0), (0, 1), (1, 0), (2, 0), (3, 0)]
    c = spark.createDataFrame([("b", i, t) for i, t in enumerate(["x", "a" * 3000, "m" * 300 + "n", "z" * 2800 + "end"])], "book string, i int, t string")
    assert {r.place: r.sample for r in segments.samples(c, "book", "i", "t").collect()} == {"first": "a" * 2800, "middle": "m" * 300 + "n", "last": "z" * 2797 + "end"}
    n = segments.hash_sample(spark.range(10_000), ["id"], 0.2, 3)
    assert 1800 < n.count() < 2200 and n.count() == segments.hash_sample(spark.range(10_000), ["id"], 0.2, 3).count()
    split = segments.seeded_split(spark.range(10).selectExpr("id % 2 AS g", "id"), ["g"], "id", 2)
    assert split.where("part = 'mutated'").count() == 4
    assert segments.until(spark.range(6).selectExpr("1 AS k", "id"), "k", F.col("id"), F.lit(2), 5).count() == 3


def test_usage(spark):
    calls = spark.createDataFrame([("strong", "s", "a", 10, 1, 11, 3, 1, "accepted"), ("cheap", "s", "b", 1, None, 1, 0, 0, None)], "tier string, stage string, operation string, prompt_tokens int, completion_tokens int, total_tokens int, cache_hit_tokens int, cache_miss_tokens int, outcome string")
    got = {(r.by, r.name): r for r in usage.summary(calls).collect()}
    assert got["total", None].calls == 2 and got["total", None].total_tokens == 12 and got["tier", "strong"].cache_hit_rate == 0.75 and got["operation", "b"].cache_hit_rate == 0 and len(got) == 6
    s = lambda *rows: spark.createDataFrame(rows, "k string, n long")
    assert sorted(map(tuple, usage.flushed(s(("a", 1)), s(("a", 3), ("b", 2)), s(("a", 10)), "k", "n").collect())) == [("a", 12), ("b", 2)]
