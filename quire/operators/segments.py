"""Segments of texts: lines, chapters, packs, islands, neighbours, digests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Non-blank lines of each text, numbered from 0 among themselves."""
    parts = F.filter(F.split(text, "\n"), lambda x: ~is_blank(x))
    return df.select(key, F.posexplode(parts).alias("seg", "source"))


def chapters(segments: DataFrame, key: str, heading: Column) -> DataFrame:
    """``chapter``: number of headings so far in the text."""
    w = Window.partitionBy(key).orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("chapter", F.sum(heading.cast("int")).over(w))


def pack_ids(sizes: Column, budget: int, more: int = 0) -> Column:
    """Greedy packs: array of pack numbers; a pack closes when the next item would exceed the budget.

    ``more`` is added to the size of a pack for each of its items. A running fold with resets: it goes
    over each array once, in Python over Arrow batches of sizes.
    """
    @F.arrow_udf("array<int>")
    def packed(batch: pa.Array) -> pa.Array:
        out = []
        for row in batch.to_pylist():
            numbers, pack, size = [], 0, 0
            for n in row or []:
                if size and size + n > budget:
                    pack, size = pack + 1, 0
                size += n + more
                numbers.append(pack)
            out.append(None if row is None else numbers)
        return pa.array(out, pa.list_(pa.int32()))

    return packed(sizes)


def pack_rows(df: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """``df`` with ``pack`` (greedy, in order) and ``nth`` place in its pack, for groups given as rows.

    Groups stream sorted through one running fold, so none is held in memory.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("pack", T.IntegerType()), T.StructField("nth", T.IntegerType())])
    at = df.columns.index(key)

    def run(batches):
        last, pack, used, nth = object(), 0, 0, 0
        for b in batches:
            packs, places = [], []
            for k, n in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if k != last:
                    last, pack, used, nth = k, 0, 0, 0
                elif nth and used + n > budget:
                    pack, used, nth = pack + 1, 0, 0
                packs.append(pack)
                places.append(nth)
                used, nth = used + n, nth + 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(packs, pa.int32()), pa.array(places, pa.int32())], names=schema.names)

    return df.select("*", F.coalesce(size, F.lit(0)).cast("bigint").alias("size_")).repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def packs(df: DataFrame, key: str, text: str = "text", budget: int = 1800) -> DataFrame:
    """Lines of each text packed in order: per pack its number, segments and characters."""
    parts = F.filter(F.split(text, "\n"), lambda x: ~is_blank(x))
    got = df.select(key, parts.alias("p")).select(key, "p", pack_ids(F.transform("p", F.length), budget).alias("k"))
    rows = got.select(key, F.explode(F.arrays_zip("k", "p")).alias("x")).select(key, F.col("x.k").alias("pack"), F.length("x.p").alias("n"))
    return rows.groupBy(key, "pack").agg(F.count("*").alias("n_segments"), F.sum("n").alias("n_chars"))


def islands(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """Runs of equal flags: number, flag, first and last position."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.select(key, order, flag.alias("flag"))
    d = d.withColumn("new", F.coalesce((F.lag("flag").over(w) != F.col("flag")).cast("int"), F.lit(0)))
    d = d.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "island").agg(F.first("flag").alias("flag"), F.min(order).alias("first_pos"), F.max(order).alias("last_pos"))


def rolling_context(df: DataFrame, key: str, order: str, text: str, n: int = 6) -> DataFrame:
    """The last ``n`` non-blank texts before each row, joined by line feeds."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    d = df.where(~is_blank(F.col(text)))
    return d.select(key, order, F.concat_ws("\n", F.collect_list(text).over(w)).alias("context"))


def neighbours(df: DataFrame, key: str, order: str, text: str, n: int = 2) -> DataFrame:
    """Texts of the rows around each row."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select(key, order, F.concat_ws("|", F.collect_list(text).over(w.rowsBetween(-n, -1))).alias("before"), F.concat_ws("|", F.collect_list(text).over(w.rowsBetween(1, n))).alias("after"))


def head_tail(df: DataFrame, key: str, order: str, text: str, head: int = 3, tail: int = 2, cut: int = 600) -> DataFrame:
    """First and last texts of a group (the last only where there are more than ``head``), cut.

    The few rows of each group are picked before they are gathered.
    """
    w = Window.partitionBy(key)
    d = df.select(key, order, text, F.row_number().over(w.orderBy(order)).alias("_a"), F.row_number().over(w.orderBy(F.desc(order))).alias("_z"))
    few = d.where((F.col("_a") <= head) | (F.col("_z") <= tail)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_a", F.col(text).alias("t")))).alias("a"))
    return few.select(key, F.substring(F.array_join(F.transform("a", lambda x: x.t), "……"), 1, cut).alias("digest"))


def keep(df: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """One row a key: the first or last by ``order``; partial aggregation, no window."""
    rest = F.struct(*[c for c in df.columns if c != key])
    pick = F.max_by(rest, order) if last else F.min_by(rest, order)
    return df.groupBy(key).agg(pick.alias("r")).select(key, "r.*")


def running_quota(df: DataFrame, key: str, order: str, accepted: Column, limit: int) -> DataFrame:
    """Accepted rows until the quota of their key is used up."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(accepted.cast("int")).over(w)).where(accepted & (F.col("used") <= limit))


def forward_filled(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``value`` carried on over the rows after it that have none."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def prefix_sums(df: DataFrame, key: str, order: str, size: Column) -> DataFrame:
    """``before`` and ``upto``: sizes of the group's rows before each row, and with it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("upto", F.sum(size).over(w)).withColumn("before", F.col("upto") - size)


def rewrite_candidates(segments: DataFrame, key: str, order: str, share: float = 0.2, alphabet: str = "\u4e00-\u9fff") -> DataFrame:
    """Text segments fit for a rewrite on their own: no continuation, not continued, mostly of ``alphabet``."""
    from ..functions.text import share_of

    w = Window.partitionBy(key).orderBy(order)
    d = segments.withColumn("_next", F.coalesce(F.lead("cont").over(w), F.lit(False)))
    fit = (F.col("kind") == "text") & ~F.col("cont") & ~F.col("_next") & ~is_blank(F.col("target")) & (share_of(F.col("target"), f"[{alphabet}]") > share)
    return d.where(fit).drop("_next")


def samples(chapters: DataFrame, key: str, order: str, text: str, least: int = 200, cut: int = 2800) -> DataFrame:
    """(key, place, sample): the start of a book's first and middle long chapter and the end of its last.

    Chapters longer than ``least`` characters count; a chapter is taken once. Books without any are left out.
    """
    w = Window.partitionBy(key)
    d = chapters.where(F.length(text) > least).withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    first, middle, last = F.col("_i") == 0, F.col("_i") == F.floor(F.col("_n") / 2), F.col("_i") == F.col("_n") - 1
    place = F.when(first, "first").when(middle, "middle").when(last, "last")
    sample = F.when(place == "last", F.substring(F.col(text), F.greatest(F.lit(1), F.length(text) - cut + 1), F.lit(cut))).otherwise(F.substring(text, 1, cut))
    return d.where(place.isNotNull()).select(key, order, place.alias("place"), sample.alias("sample"))


def hash_sample(df: DataFrame, columns: list[str], share: float, seed: int = 0) -> DataFrame:
    """Each row with chance ``share``, decided by a hash of its columns, so reruns agree."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) < int(share * (1 << 40)))


def seeded_split(df: DataFrame, group: list[str], key: str, first: int, seed: int = 0) -> DataFrame:
    """``part``: 'mutated' for the ``first`` keys of each group in a seeded order, 'clean' for the rest."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), key), key))
    return df.withColumn("part", F.when(nth <= first, "mutated").otherwise("clean"))


def until(df: DataFrame, key: str, order: Column, size: Column, enough: int) -> DataFrame:
    """Rows of each group in the given order until their sizes reach ``enough``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_had", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("_had") < enough).drop("_had")
