"""Stages of the corpus pipeline and its whole run against plain Python."""

import random
import re
from pathlib import Path

import pytest

import corpus_pipeline as cp
from quire.llm import common as c
from quire.llm import op05_mixing as o5

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else 0) for i, t, s in rows], SCHEMA)


def test_mixing_meets_the_targets(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(r.randint(150, 350))), f"s{i % 20:02}") for i in range(1200)] + [(9000, "null source words", None), (9001, None, "s00"), (9002, "", "s01")]
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in {s for *_, s in rows}}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = {s: p["target"] for s, p in zip(order, o5.plan([size[s] for s in order]))}
    got = dict.fromkeys(order, 0)
    copies = {}
    for x in cp.mixed(spark, frame(spark, rows), "").collect():
        got[x.source] += len(x.text.split())
        copies[x.doc_id] = copies.get(x.doc_id, 0) + 1
    assert all(abs(got[s] - target[s]) <= 2 * 350 for s in order), {s: (got[s], target[s]) for s in order}
    assert abs(sum(got.values()) - 1.5 * sum(size.values())) < 0.03 * sum(size.values())
    assert 0 < len(copies) < 1200 and max(copies.values()) == 2


def test_one_row_of_each_group_stays(spark):
    r = random.Random(6)
    text = lambda: " ".join(f"w{r.randrange(900)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(5, a, "s"), (5, a, "s"), (3, a + " end", "s"), (None, a, "s"), (None, b, "s"), (7, c, "s"), (7, d, "s"), (2, d, "s"), (None, e, "s"), (None, e, "s"), (8, e + " x", None), (9, "", "s"), (9, "", "s"), (None, None, "s")]
    got = [(x.doc_id, x.text) for x in cp.distinct_texts(spark, frame(spark, rows), "").collect()]
    want = [(3, a + " end"), (None, b), (7, c), (2, d), (8, e + " x"), (9, ""), (9, ""), (None, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_secrets_keep_rows_and_lengths(spark):
    rows = [(1, "pwd: h!X9#qLm2@z end", "a"), (1, "pwd: h!X9#qLm2@z end", "a"), (None, "plain", None), (2, None, "a"), (3, "", "b")]
    got = sorted(((x.doc_id, x.text, x.source, x.n_chars) for x in cp.without_secrets(spark, frame(spark, rows), "").collect()), key=repr)
    want = [(i, t and t.replace("h!X9#qLm2@z", "[SECRET]"), s) for i, t, s in rows]
    assert got == sorted(((i, t, s, None if t is None else len(t)) for i, t, s in want), key=repr)


def test_language_rejects_noise_and_corrects_labels(spark):
    r = random.Random(3)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    rows = [(i, " ".join(word("abcde") for _ in range(30)), "en") for i in range(60)] + [(100 + i, " ".join(word("vwxyz") for _ in range(30)), "de") for i in range(60)]
    odd = [(500, "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(400)), "en"), (501, None, "en"), (502, "123 456", None), (None, " ".join(word("vwxyz") for _ in range(30)), None), (503, "abc", "de")]
    d = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows + odd], SCHEMA)
    got = {x.doc_id: x.lang for x in cp.known_language(spark, d, "").collect()}
    assert set(got) == {i for i, *_ in rows} | {None, 503}
    assert all(got[i] == lang for i, _, lang in rows) and got[None] == "de" and got[503] == "en"
    assert [x.doc_id for x in cp.known_language(spark, d.withColumn("lang", cp.F.lit(None).cast("string")).where("doc_id > 499"), "").collect()] == [500, 503]
    assert cp.known_language(spark, d.limit(0), "").count() == 0


def test_steps_return_free_memory_of_the_driver(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    mb = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024
    c.written(spark.range(9), str(tmp_path / "first"))
    made = [jvm.java.util.zip.Deflater() for _ in range(1000)]
    for x in made[:-1]:  # the last one keeps what is freed below it from going back by itself
        x.end()
    jvm.System.gc()
    before = mb()
    assert c.written(spark.range(9), str(tmp_path / "second")).count() == 9
    heap = jvm.java.lang.Runtime.getRuntime()
    total, used = heap.totalMemory() >> 20, (heap.totalMemory() - heap.freeMemory()) >> 20
    assert (mb() < before - 10, total < 2.5 * used) == (True, True), (before, mb(), total, used)
