"""The glossary as an ordered fold of events, each source on its own.

Events have (source, seq, op, target, confidence, locked, reading, gender, note, kind, aliases, chapter);
op is 'propose' (the default), 'lock', 'confirm' or 'resolve'. ``fold`` deals them by source, sorted by
seq, and walks them with one state at a time, so no group is ever held, whatever its size. It gives a row
a step, of which the state, the conflict log and the counts are simple selections.

Rules. The first proposal inserts; one with the same target leaves it unchanged but fills in reading,
gender and note where it has them and unites the aliases. Another target is logged as a conflict and the
term's status becomes 'conflict' whoever wins; the proposal wins only if (locked, confidence) is higher,
and then brings target, confidence, reading and gender. 'lock' locks (with a target, replaces it),
'confirm' locks only the very target, 'resolve' locks a target, making the term where there is none, and
like 'lock' closes the source's conflicts. Unknown confidences rank as medium. Null sources are no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip

# Confidences by rank.
RANK = {"low": 0, "medium": 1, "high": 2}
#: Fields of an event and what stands for those that a table lacks.
FIELDS = {
    "source": "string", "seq": "bigint", "op": "string", "target": "string", "confidence": "string", "locked": "boolean",
    "reading": "string", "gender": "string", "note": "string", "kind": "string", "aliases": "array<string>", "chapter": "bigint",
}
TERM = "target string, confidence string, locked boolean, status string, reading string, gender string, note string, kind string, aliases array<string>, first_chapter bigint"
STEP = f"source string, seq bigint, result string, changed boolean, old_target string, new_target string, chapter bigint, last boolean, {TERM}"


def _propose(term: dict | None, e: dict) -> tuple[dict, str]:
    if term is None:
        new = {k: e[k] or "" for k in ("target", "reading", "gender", "note", "kind")}
        return new | {"confidence": e["confidence"] or "medium", "locked": bool(e["locked"]), "status": "ok", "aliases": list(e["aliases"] or []), "first_chapter": e["chapter"]}, "inserted"
    said = {k: e[k] for k in ("reading", "gender", "note") if e[k]}
    if e["target"] == term["target"]:
        return term | said | {"aliases": sorted({*term["aliases"], *(e["aliases"] or [])})}, "unchanged"
    weight = lambda x: (bool(x["locked"]), RANK.get(x["confidence"], 1))
    if weight(e) <= weight(term):
        return term | {"status": "conflict"}, "conflict"
    said.pop("note", None)
    return term | said | {"target": e["target"], "confidence": e["confidence"] or "medium", "status": "conflict"}, "updated"


def step(term: dict | None, e: dict) -> tuple[dict | None, str]:
    """The term after an event, and what the event came to."""
    op = e["op"] or "propose"
    if op == "propose":
        return _propose(term, e)
    firm = {"locked": True, "confidence": "high", "status": "ok"}
    if op == "confirm":
        sure = term is None or term["target"] != e["target"] or (term["locked"] and term["confidence"] == "high")
        return (term, "ignored") if sure else (term | firm, "confirmed")
    if op not in ("lock", "resolve"):
        raise ValueError(f"unknown operation {op}")
    if term is None:
        return (None, "ignored") if op == "lock" else (_propose(None, e | {"confidence": "high", "locked": True})[0], "resolved")
    return term | firm | ({"target": e["target"]} if e["target"] is not None else {}), op + ("ed" if op == "lock" else "d")


def fold(events: DataFrame) -> DataFrame:
    """A row for each event: what it came to, the targets before and after, and the term after it; ``last`` of its source."""
    cols = [F.col(k).cast(t).alias(k) if k in events.columns else F.lit(None).cast(t).alias(k) for k, t in FIELDS.items()]
    names, schema = [f.split()[0] for f in TERM.split(", ")], _arrow_schema()

    def run(batches: Iterator):
        import pyarrow as pa

        source, term, held = None, None, None
        for b in batches:
            rows = []
            for e in b.to_pylist():
                if held is not None:
                    rows.append(held | {"last": e["source"] != source})
                if e["source"] != source:
                    source, term = e["source"], None
                old = term["target"] if term else None
                term, result = step(term, e)
                state = term or dict.fromkeys(names)
                held = {"source": source, "seq": e["seq"], "result": result, "changed": result in ("inserted", "updated"), "old_target": old, "new_target": e["target"], "chapter": e["chapter"], **state}
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | {"last": True}], schema=schema)

    src = events.select(*cols).where(F.col("source").isNotNull())
    return src.repartition("source").sortWithinPartitions("source", "seq", "target").mapInArrow(run, STEP)


def _arrow_schema():
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(STEP))


def terms(steps: DataFrame) -> DataFrame:
    """The glossary: the last state of each source."""
    return steps.where(F.col("last") & F.col("target").isNotNull()).select("source", *[f.split()[0] for f in TERM.split(", ")])


def conflicts(steps: DataFrame) -> DataFrame:
    """The conflict log: (source, seq, existing_target, proposed_target, chapter, resolved)."""
    closed = steps.where(F.col("result").isin("locked", "resolved")).groupBy(F.col("source").alias("s_")).agg(F.max("seq").alias("closed_"))
    log = steps.where(F.col("result").isin("conflict", "updated")).join(closed, F.col("source") == F.col("s_"), "left")
    return log.select("source", "seq", F.col("old_target").alias("existing_target"), F.col("new_target").alias("proposed_target"), "chapter", F.coalesce(F.col("closed_") > F.col("seq"), F.lit(False)).alias("resolved"))


def open_conflicts(steps: DataFrame) -> DataFrame:
    return conflicts(steps).where(~F.col("resolved")).drop("resolved").orderBy("seq", "source")


def results(steps: DataFrame) -> DataFrame:
    """How many events came to what."""
    return steps.groupBy("result").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


def low_confidence(glossary: DataFrame) -> DataFrame:
    """Terms to look at: of low confidence or in conflict, by source."""
    return glossary.where((F.col("confidence") == "low") | (F.col("status") == "conflict")).orderBy("source")


def all_terms(glossary: DataFrame) -> DataFrame:
    return glossary.orderBy("kind", "source")


def memory(pairs: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """Translation memory: (source_hash, seq, target), the last write of each stripped source."""
    hashed = pairs.select(F.sha2(py_strip(F.col(source)), 256).alias("source_hash"), F.col(order).alias("seq"), F.col(target).alias("target"))
    return hashed.groupBy("source_hash").agg(F.max("seq").alias("seq"), F.max_by("target", "seq").alias("target"))


def store_stats(steps: DataFrame, tm: DataFrame) -> DataFrame:
    """(terms, open_conflicts, tm_entries) in one row."""
    a = terms(steps).agg(F.count("*").alias("terms"))
    b = conflicts(steps).agg(F.count_if(~F.col("resolved")).alias("open_conflicts"))
    return a.join(b).join(tm.agg(F.count("*").alias("tm_entries")))  # one row each


def seeds(characters: DataFrame, found: DataFrame) -> DataFrame:
    """Proposals from an analysis, people before terms: medium confidence, chapter 0, seq in that order."""
    people = characters.select(F.lit(0).alias("part"), "nth", "source", "target", F.lit("人物").alias("kind"), "gender")
    rest = found.select(F.lit(1).alias("part"), "nth", "source", "target", "kind", F.lit(None).cast("string").alias("gender"))
    seq = F.row_number().over(Window.orderBy("part", "nth"))  # a book's analysis: some dozens of rows
    both = people.unionByName(rest).where((F.length("source") > 0) & (F.length("target") > 0))
    return both.select("source", seq.cast("bigint").alias("seq"), "target", "kind", "gender", F.lit("medium").alias("confidence"), F.lit(0).cast("bigint").alias("chapter"))


def literal_rewrites(texts: DataFrame, text: str, rewrites: list[tuple[str, str]]) -> DataFrame:
    """``text`` with all variants replaced at once, the longest first at each place; ``n_rewrites`` counts them.

    No replacement is looked at again. The list is one book's confirmed variants.
    """
    import re

    by = dict(rewrites)
    if not by:
        return texts.withColumn("n_rewrites", F.lit(0))
    some = "|".join(re.escape(v) for v in sorted(by, key=lambda v: (-len(v), v)))
    table = F.create_map(*[F.lit(x) for kv in by.items() for x in kv])
    hits, gaps = F.regexp_extract_all(text, F.lit(some), 0), F.split(text, some, -1)
    new = F.array_join(F.flatten(F.zip_with(gaps, F.transform(hits, lambda h: table[h]), lambda g, h: F.array(g, F.coalesce(h, F.lit(""))))), "")
    return texts.withColumn("n_rewrites", F.coalesce(F.size(hits), F.lit(0))).withColumn(text, F.when(F.col("n_rewrites") > 0, new).otherwise(F.col(text)))


#: Characters around a hit among which a Han character must stand.
REACH = 12


def latin_residue(text: str | None, source: str, target: str) -> str | None:
    """The text with a locked term's Latin source replaced; None where nothing is to be replaced.

    Only in texts with Han characters that lack the target, only whole words, and only where a Han
    character stands within ``REACH`` characters on a side. Blanks between Han characters then go.
    """
    import re

    han = re.compile("[一-鿿]")
    if not text or target in text or not han.search(text):
        return None

    def fix(m: re.Match) -> str:
        near = text[max(0, m.start() - REACH) : m.start()], text[m.end() : m.end() + REACH]
        return target if any(map(han.search, near)) else m[0]

    new = re.sub(rf"\b{re.escape(source)}\b", fix, text)
    return re.sub("(?<=[一-鿿])[ \t]+(?=[一-鿿])", "", new) if new != text else None


def fix_residue(pairs: DataFrame, key: list[str], text: str, glossary: DataFrame) -> DataFrame:
    """(``key``, before, after): texts changed by the Latin sources of locked terms, one term after another by source."""
    import re

    from .terms import contained

    latin = re.compile(r"[A-Za-z][A-Za-z .\-]*")
    locked = glossary.where("locked").select("source", "target").where(F.col("source").rlike(rf"^{latin.pattern}\z"))
    hits = contained(pairs, locked, [*key, text], text, ["source", "target"], "source", match="word")
    found = hits.groupBy(*key, text).agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("terms"))  # a text's own terms

    @F.udf("string", useArrow=True)
    def fixed(value, terms):
        for t in terms:
            value = latin_residue(value, t["source"], t["target"]) or value
        return value

    return found.select(*key, F.col(text).alias("before"), fixed(text, "terms").alias("after")).where("before <> after")
