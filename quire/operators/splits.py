"""Long texts cut into pieces at sentence ends, or between words where a sentence is too long itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import pack_ids

#: Characters that end a sentence and stay with it.
ENDS = "。．.!！？?…\n"


def sentences(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{ENDS}]*[{ENDS}]|[^{ENDS}]+"), F.lit(0))


def cut_words(c: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, each as long as can be: before a blank, else before a
    tab, else before a line feed, else of just ``limit`` characters."""
    some = rf"[\s\S]{{1,{limit}}}"
    return F.regexp_extract_all(c, F.lit(rf"{some}\z|{some}(?= )|{some}(?=\t)|{some}(?=\n)|{some}"), F.lit(0))


def split_long(df: DataFrame, text: str, limit: int) -> DataFrame:
    """``df`` with texts over ``limit`` characters in several rows; adds ``piece`` and ``cont``.

    Sentences are packed greedily in order. The pieces of a text joined give the text. Rows with
    short, empty or null text stay as they are, as piece 0.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    keep = [c for c in df.columns if c not in ("piece", "cont")]
    long = F.length(text) > limit
    d = df.select(*keep, F.when(long, sentences(F.col(text))).alias("_s"))
    d = d.withColumn("_k", pack_ids(F.transform("_s", F.length), limit))
    d = d.withColumn("_at", F.filter(F.sequence(F.lit(1), F.size("_s")), lambda i: (i == 1) | (F.get("_k", i - 1) != F.get("_k", i - 2))))
    last = F.size("_s") + 1
    packs = F.transform("_at", lambda s, j: F.array_join(F.slice("_s", s, F.coalesce(F.get("_at", j + 1), last) - s), ""))
    d = d.withColumn("_p", packs)
    pieces = F.flatten(F.transform("_p", lambda p: F.when(F.length(p) > limit, cut_words(p, limit)).otherwise(F.array(p))))
    d = d.withColumn("_p", F.when(F.col("_s").isNull(), F.array(F.col(text))).otherwise(pieces))
    out = d.select(*[c for c in keep if c != text], F.posexplode("_p").alias("piece", text))
    return out.select(*keep, "piece", (F.col("piece") > 0).alias("cont"))
