"""Model operators over packed batches: prompts, a client, kept answers, and rules on what is taken.

There is no network here, so the only client is ``Stub``, a deterministic function of the prompt; any
picklable object with ``complete(prompt, operation) -> str`` serves as well. Answers are kept in a table
by the hash of operation and prompt, and only prompts without an answer are asked: a task or run that is
repeated costs nothing twice and cannot change what was taken.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json_loose
from ..functions.text import is_blank

# Tiers, and the tier that answers where one is not configured.
FALLBACK = {"fast": ("fast", "cheap", "strong"), "cheap": ("cheap", "strong"), "strong": ("strong",)}


def tier_model(tier: Column, models: dict[str, str]) -> Column:
    """The model of a tier, or of the next one that is configured."""
    pick = {t: next(models[x] for x in chain if models.get(x)) for t, chain in FALLBACK.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pick.items() for x in kv]), tier)


class Stub:
    """Answers by operation, from functions of the prompt; an empty list for operations without one."""

    def __init__(self, handlers: dict[str, Callable[[str], str]] | None = None):
        self.handlers = handlers or {}

    def complete(self, prompt: str, operation: str) -> str:
        return self.handlers.get(operation, lambda _: "[]")(prompt)


ANSWERS = "hash string, operation string, answer string, prompt_chars bigint, answer_chars bigint"


def prompt_hash(operation: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", operation, prompt), 256)


def answered(spark: SparkSession, prompts: DataFrame, client, path: str, tries: int = 3) -> DataFrame:
    """``prompts`` (operation, prompt, ...) with ``answer``, null where ``tries`` attempts failed.

    New answers are appended to the table at ``path``; failures are not kept, so a later run asks again.
    """
    known = _table(spark, path)
    todo = prompts.select("operation", "prompt").distinct().withColumn("hash", prompt_hash(F.col("operation"), F.col("prompt"))).join(known, "hash", "left_anti")

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            rows = []
            for operation, prompt, key in zip(*(b.column(k).to_pylist() for k in range(3))):
                for _ in range(tries):
                    try:
                        answer = client.complete(prompt, operation)
                    except Exception:  # a client may fail in any way; the prompt stays unanswered
                        continue
                    rows.append((key, operation, answer, len(prompt), len(answer)))
                    break
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in ANSWERS.split(", ")])

    todo.select("operation", "prompt", "hash").mapInArrow(run, ANSWERS).write.mode("append").parquet(path)
    answers = _table(spark, path).groupBy("hash").agg(F.min("answer").alias("answer"))
    return prompts.withColumn("hash", prompt_hash(F.col("operation"), F.col("prompt"))).join(answers, "hash", "left").drop("hash")


def _table(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException:  # the first run
        return spark.createDataFrame([], ANSWERS)


def numbered(texts: Column) -> Column:
    """Lines [1] text, [2] text, ... of an array."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n")


def glossary_lines(terms: Column) -> Column:
    """Lines 'source → target' of an array of (source, target, note), the note in brackets."""
    return F.array_join(F.transform(terms, lambda t: F.concat(t["source"], F.lit(" → "), t["target"], F.when(F.length(t["note"]) > 0, F.concat(F.lit("（"), t["note"], F.lit("）"))).otherwise(""))), "\n")


class Misaligned(ValueError):
    """A batch whose answer has another number of texts, or a blank one, and cannot be asked one by one."""


def aligned(sources: list[str], ask: Callable[[list[str]], str], retries: int = 2, key: str = "translations") -> list[str]:
    """As many non-blank texts as sources: the whole batch some times, then one by one, then ``Misaligned``."""

    def once(some: list[str]) -> list[str] | None:
        try:
            got = json_loose.keyed(json_loose.parse(ask(some)), key, [])
        except ValueError:
            return None
        fine = isinstance(got, list) and len(got) == len(some) and all(isinstance(t, str) and t.strip() for t in got)
        return got if fine else None

    for _ in range(retries + 1):
        if (got := once(sources)) is not None:
            return got
    if len(sources) == 1:
        raise Misaligned(f"no usable answer for {sources[0][:80]!r}")
    return [t for s in sources for t in aligned([s], ask, retries, key)]


def translated(batches: DataFrame, client, operation: str = "translate.batch", retries: int = 2) -> DataFrame:
    """(key columns, sources, targets): each packed batch (an array ``sources``) answered text by text."""
    schema = T.StructType([*batches.schema.fields, T.StructField("targets", T.ArrayType(T.StringType()))])
    at = batches.columns.index("sources")

    def run(parts: Iterator):
        import pyarrow as pa

        ask = lambda some: client.complete(json.dumps(some, ensure_ascii=False), operation)
        for b in parts:
            got = [aligned(s, ask, retries) if s else [] for s in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.string()))], names=[*b.schema.names, "targets"])

    return batches.mapInArrow(run, schema)


# What is taken.


def fix_taken(issues_before: Column, issues_after: Column, new: Column) -> Column:
    """A new try at a segment: taken only if it is not blank and has fewer issues."""
    return ~is_blank(new) & (issues_after < issues_before)


def review_fix_taken(new: Column, flag: Column) -> Column:
    """A correction after a review: taken if it is not blank and its length is plausible."""
    return ~is_blank(new) & (flag == "ok")


def polished(targets: Column, new: Column) -> Column:
    """The polished batch, or the old one where their sizes differ."""
    return F.when(F.size(targets) == F.size(new), new).otherwise(targets)


def polish_taken(kinds_before: Column, kinds_after: Column) -> Column:
    """A polished segment is taken unless it has a kind of issue that it had not before."""
    return F.size(F.array_except(kinds_after, kinds_before)) == 0


def pair_taken(first_order: Column, second_order: Column) -> Column:
    """A rewrite judged in both orders ('new', 'old', 'tie') is taken only if it wins both."""
    return F.coalesce((first_order == "new") & (second_order == "new"), F.lit(False))


def titles_taken(titles: Column, answers: Column) -> Column:
    """All translated titles or none: null unless there are as many; an empty one falls back on its title."""
    both = F.zip_with(titles, answers, lambda t, a: F.when(is_blank(a), t).otherwise(a))
    return F.when(F.size(titles) == F.size(answers), both)


def outcomes(rows: DataFrame, operation: str, taken: str) -> DataFrame:
    """(operation, accepted, rejected)."""
    return rows.groupBy(operation).agg(F.count_if(F.col(taken)).alias("accepted"), F.count_if(~F.col(taken)).alias("rejected"))


def rewrite_counters(rows: DataFrame) -> DataFrame:
    """One row of counts of a rewrite pass: (suspect, rewritten, faithful, preferred) booleans a screened segment."""
    c = lambda e: F.count_if(F.expr(e))
    return rows.agg(
        F.count("*").alias("screened"), c("suspect").alias("suspects"), c("suspect AND rewritten").alias("rewritten"), c("suspect AND NOT rewritten").alias("rejected_same"),
        c("rewritten AND NOT faithful").alias("rejected_fidelity"), c("rewritten AND faithful AND NOT preferred").alias("rejected_pair"), c("suspect AND rewritten AND faithful AND preferred").alias("applied"),
    )


def review_rows(answers: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, index, kind, detail): issues of review answers (JSON lists) whose index, a number or its text, is in the batch."""
    rows = F.from_json("answer", "array<struct<index:string,type:string,detail:string>>")
    d = answers.select(*keys, n, F.explode(rows).alias("r")).select(*keys, n, F.col("r.index").try_cast("int").alias("index"), F.col("r.type").alias("kind"), F.col("r.detail").alias("detail"))
    return d.where(F.col("index").between(0, F.col(n) - 1)).drop(n)


def proposal_rows(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, target, gender, kind): terms of answers (JSON lists) with both sides; an unknown gender is none."""
    rows = F.from_json("answer", "array<struct<source:string,target:string,gender:string,type:string>>")
    d = answers.select(*keys, F.explode(rows).alias("r")).select(*keys, F.trim("r.source").alias("source"), F.trim("r.target").alias("target"), F.when(F.col("r.gender") == "未知", "").otherwise(F.coalesce("r.gender", F.lit(""))).alias("gender"), F.col("r.type").alias("kind"))
    return d.where((F.length("source") > 0) & (F.length("target") > 0))
