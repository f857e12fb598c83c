"""Spellings of a corpus that differ from a term in just one character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HAN = r"\p{IsHan}"
MIN_LENGTH = 3
MAX_VARIANTS = 8


def _masks(c: Column) -> Column:
    """The text with each character in turn replaced by a line feed, which no window holds."""
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.lit("\n"), F.substring(c, i + 1, F.length(c))))


def one_off(terms: DataFrame, term: str, corpus: DataFrame, text: str, alphabet: str = HAN, least: int = MIN_LENGTH, most: int = MAX_VARIANTS) -> DataFrame:
    """term, variant, n: windows of the term's length, all of ``alphabet``, at Hamming distance 1.

    Two different texts of one length share a masked form only if they differ at the masked place,
    so an equality join finds every pair once. Windows are counted before they are masked. Terms
    with more than ``most`` variants go, as do terms shorter than ``least`` or with a character
    outside the alphabet. Null terms and texts give no rows.
    """
    names = terms.select(F.col(term).alias("term")).where(F.col("term").rlike(rf"^[{alphabet}]{{{least},}}\z")).distinct()
    sizes = names.select(F.length("term").alias("len")).distinct()  # as many rows as the longest term has characters, at most
    runs = corpus.select(F.explode(F.regexp_extract_all(text, F.lit(rf"[{alphabet}]{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.groupBy("run").agg(F.count("*").alias("times"))
    fits = runs.join(F.broadcast(sizes), F.length("run") >= F.col("len"))
    cut = F.transform(F.sequence(F.lit(1), F.length("run") - F.col("len") + 1), lambda i: F.substring(F.col("run"), i, F.col("len")))
    windows = fits.select(F.explode(cut).alias("variant"), "times").groupBy("variant").agg(F.sum("times").alias("n"))
    a = names.select("term", F.explode(_masks(F.col("term"))).alias("mask"))
    b = windows.select("variant", "n", F.explode(_masks(F.col("variant"))).alias("mask"))
    pairs = a.join(b, "mask").where(F.col("term") != F.col("variant")).select("term", "variant", "n")
    return pairs.withColumn("_of", F.count("*").over(Window.partitionBy("term"))).where(F.col("_of") <= most).drop("_of")
