"""Checks on aligned source and target texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import number_mismatch
from ..functions.text import BLANK, compare_key, py_strip
from .terms import contained

TOO_SHORT, TOO_LONG = 0.30, 3.0
GATE_RATIO, GATE_CHARS = 0.15, 120
LATIN_RUN = 40

# Opening quotation marks of a source, marks that show a quotation was kept.
OPENING = '“"「『«'
KEPT = "“”「」『』《》"
# Kinds of issues, those worth a new try, and their wording.
KINDS = ("quote_loss", "number_mismatch", "term_miss", "untranslated", "empty", "too_short", "too_long")
ACTIONABLE = KINDS[:5]
SEVERE = ("missing", "mistranslation")
DETAILS = {
    "empty": "译文为空，疑似漏译，请补全",
    "too_short": "译文明显过短，疑似漏译，请核对补全",
    "too_long": "译文明显过长，疑似译文失控或误增译，请核对精简",
    "quote_loss": "原文含直接引语，译文丢失引号，必须保留成对引号",
    "untranslated": "译文与原文高度重合，疑似整段未译，请重新翻译",
}


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """A user turn and the assistant turn that follows it directly."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = conversations.withColumn("nr", F.lead("role").over(w)).withColumn("target", F.lead("text").over(w))
    return d.where("role = 'user' AND nr = 'assistant'").select("conv_id", "turn", F.col("text").alias("source"), "target")


def _size(c: Column) -> Column:
    return F.length(py_strip(F.coalesce(c, F.lit(""))))


def length_flag(source: Column, target: Column) -> Column:
    """'empty', 'too_short', 'too_long' or 'ok'; a blank source is 'ok'."""
    s, t = _size(source), _size(target)
    return F.when(s == 0, "ok").when(t == 0, "empty").when(t / s < TOO_SHORT, "too_short").when(t / s > TOO_LONG, "too_long").otherwise("ok")


def length_ratio(source: Column, target: Column) -> Column:
    return F.round(F.try_divide(_size(target).cast("double"), _size(source).cast("double")), 6)


def hard_short(source: Column, target: Column) -> Column:
    """The stricter gate for English sources."""
    s, t = _size(source), _size(target)
    return (s >= GATE_CHARS) & (t / s < GATE_RATIO)


def quote_loss(source: Column, target: Column) -> Column:
    """A source that starts with an opening quotation mark and a target without any Chinese one, or null."""
    return F.coalesce(F.substring(py_strip(source), 1, 1).isin(list(OPENING)), F.lit(False)) & ~F.coalesce(target, F.lit("")).rlike(f"[{KEPT}]")


def identifier(c: Column) -> Column:
    """A single token that starts with ISBN, in any case, or holds one of . @ / #."""
    t = py_strip(F.coalesce(c, F.lit("")))
    return (t != "") & ~t.rlike(BLANK) & (t.rlike("(?i)^ISBN") | t.rlike("[.@/#]"))


def untranslated(source: Column, target: Column, least: int = LATIN_RUN) -> Column:
    """Equal apart from case and white space, or ``least`` Latin letters on end of the target stand in the source."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    runs = F.regexp_extract_all(t, F.lit(f"[A-Za-z]{{{least},}}"), 0)
    return ~identifier(s) & (((compare_key(s) != "") & (compare_key(s) == compare_key(t))) | F.exists(runs, lambda x: F.contains(s, x)))


def actionable(kind: Column) -> Column:
    return kind.isin(*ACTIONABLE)


def severe(kind: Column) -> Column:
    return kind.isin(*SEVERE)


def missed_terms(pairs: DataFrame, key: list[str], terms: DataFrame) -> DataFrame:
    """``key``, term_source, term_target: terms that the source holds and whose target the pair's target lacks.

    ``pairs``: (key, source, target); ``terms``: (source, target). A source is found as whole words, or
    anywhere where it has a Chinese or Japanese character. Terms without a target ask for nothing.
    """
    asked = terms.where((F.length("source") > 0) & (F.length("target") > 0)).select(F.col("source").alias("term_source"), F.col("target").alias("term_target")).distinct()
    return contained(pairs, asked, [*key, "target"], "source", ["term_source", "term_target"], "term_source", match="word").where(~F.contains(F.coalesce("target", F.lit("")), F.col("term_target"))).drop("target")


def lint_targets(pairs: DataFrame, key: list[str], terms: DataFrame | None = None, lang: str = "en", numbers: bool = True) -> DataFrame:
    """One row an issue: ``key``, place, kind, detail.

    ``place`` orders the issues of a pair: its length first, then quotation, numbers, terms, untranslated
    text. For English sources a short target counts only below the stricter gate. ``pairs``: (key, source,
    target); null targets are empty ones, null sources have no issue but terms.
    """
    s, t = F.col("source"), F.col("target")
    flag = length_flag(s, t)
    if lang == "en":
        flag = F.when((flag == "too_short") & ~hard_short(s, t), "ok").otherwise(flag)
    detail = F.create_map(*[F.lit(x) for kv in DETAILS.items() for x in kv])
    issue = lambda when, place, kind, text: F.when(when, F.struct(F.lit(place).alias("place"), kind.alias("kind"), text.alias("detail")))
    fixed = lambda when, place, kind: issue(when, place, F.lit(kind), detail[F.lit(kind)])
    d = pairs.select(*key, "source", "target", flag.alias("flag_"))
    found = [issue(F.col("flag_") != "ok", 0, F.col("flag_"), detail[F.col("flag_")]), fixed(quote_loss(s, t), 1, "quote_loss")]
    if numbers:
        d = d.withColumn("lost_", number_mismatch(s, t, lang))
        found.append(issue(F.col("lost_").isNotNull(), 2, F.lit("number_mismatch"), F.col("lost_")))
    if lang != "zh":
        found.append(fixed(untranslated(s, t), 4, "untranslated"))
    out = d.select(*key, F.explode(F.array_compact(F.array(*found))).alias("issue_")).select(*key, "issue_.place", "issue_.kind", "issue_.detail")
    if terms is not None:
        told = F.concat(F.lit("锁定术语「"), "term_source", F.lit("」应译为「"), "term_target", F.lit("」，译文未出现该译名，请核对后重译"))  # Fixed values: wording.
        out = out.unionByName(missed_terms(pairs, key, terms).select(*key, F.lit(3).alias("place"), F.lit("term_miss").alias("kind"), told.alias("detail")))
    return out


def feedback(issues: DataFrame, key: list[str], order: str, detail: str) -> DataFrame:
    """Details of a segment in order, joined: one string of all that is to be told about it."""
    joined = F.transform(F.array_sort(F.collect_list(F.struct(order, detail))), lambda x: x[detail])
    return issues.groupBy(*key).agg(F.array_join(joined, "；").alias("feedback"))


def introduced(before: DataFrame, after: DataFrame, key: list[str], kind: str = "kind") -> DataFrame:
    """(key, kind) of kinds of issues that a segment has after a change and had not before."""
    return after.select(*key, kind).distinct().join(before.select(*key, kind).distinct(), [*key, kind], "left_anti")


def replaced_stage(issues: DataFrame, stage: str, new: DataFrame) -> DataFrame:
    """``issues`` with those of a stage replaced by ``new``."""
    return issues.where(~F.col("stage").eqNullSafe(F.lit(stage))).unionByName(new)
