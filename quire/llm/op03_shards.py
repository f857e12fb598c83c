"""Sharding by sampled splitters: near-equal bytes, equal texts next to each other.

Law ``bytes``. Records are ordered by the key (64-bit hash of the text, CRC-32 of the text, doc_id),
so copies of one text are neighbours while a group of any size can still be divided by its ids. A
size-weighted sample of keys is drawn (each record stands in it with a chance in proportion to its
size, decided by a hash of the row, so reruns agree), its quantiles split the keys into ranges, and
the exact bytes of each range are counted. Ranges that are overfull are subdivided by a second,
denser sample of just their records. Within a range one window gives each record its exact offset,
and the sums of the ranges before give its place among all bytes: shard = place * shards / total.
No window spans more than a range; only hashes, ids and sizes are shuffled, never texts.

Size: UTF-8 bytes of the text (null: none) plus 8. A null text sorts by its hash like any other and
has CRC 0; a null doc_id sorts first. Identical rows are interchangeable. An empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, work_dir, written

SHARDS = 24
#: Sampled keys a range; the number of ranges follows the number of shuffle partitions.
SAMPLE_PER_RANGE = 24
#: A range over this many times the mean is subdivided.
OVERFULL = 2.0


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )


_ORDER = ("h", "text_crc32", "doc_id")


def _key() -> Column:
    return F.struct("h", "text_crc32", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"))


def _sample(rows: DataFrame, step: float, seed: int) -> list[tuple]:
    """Keys drawn with chance size / step each, larger records as often as their size counts."""
    u = F.xxhash64(F.lit(seed), "h", "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    times = F.floor(F.col("size") / step + u)
    got = rows.where(times > 0).select(_key().alias("k"), times.alias("n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    return sorted((tuple(r.k), int(r.n)) for r in got)


def _quantiles(sample: list[tuple], ranges: int) -> list[tuple]:
    total = sum(n for _, n in sample)
    out, seen = [], 0
    for k, n in sample:
        seen += n
        if len(out) < ranges - 1 and seen * ranges >= (len(out) + 1) * total:
            out.append(k)
            while len(out) < ranges - 1 and seen * ranges >= (len(out) + 1) * total:
                out.append(k)
    return sorted(set(out))


def _range_of(spark: SparkSession, splitters: list[tuple]) -> Column:
    """Number of splitters below a record's key: a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        h, c, d = splitters[mid]
        d0 = f"coalesce(doc_id, {_long(-(1 << 63))})"
        below = f"(h > {_long(h)} OR (h = {_long(h)} AND (text_crc32 > {_long(c)} OR (text_crc32 = {_long(c)} AND {d0} > {_long(d)}))))"
        return f"IF({below}, {tree(mid + 1, hi)}, {tree(lo, mid)})"

    return F.expr(f"int({tree(0, len(splitters))})")


def _long(x: int) -> str:
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"({x}L)"


def split_ranges(rows: DataFrame, ranges: int) -> tuple[list[tuple], dict[int, int]]:
    """Splitters, and the exact bytes of each range; overfull ranges are subdivided once more."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return [], {}
    splitters = _quantiles(_sample(rows, total / (ranges * SAMPLE_PER_RANGE), 1), ranges)
    count = lambda s: {r[0]: r[1] for r in rows.groupBy(_range_of(spark, s).alias("r")).agg(F.sum("size")).collect()}
    sums = count(splitters)
    over = {r for r, n in sums.items() if n > OVERFULL * total / ranges}
    if over:
        part = rows.where(_range_of(spark, splitters).isin(sorted(over)))
        step = total / (ranges * SAMPLE_PER_RANGE * 8)
        sample = _sample(part, step, 2)
        keys = [k for k, _ in sample]
        added = []
        for r in over:
            lo = bisect_left(keys, splitters[r - 1]) if r else 0
            hi = bisect_left(keys, splitters[r]) + 1 if r < len(splitters) else len(keys)
            added += _quantiles(sample[lo:hi], -(-int(sums[r] * ranges * 2) // total))
        splitters = sorted({*splitters, *added})
        sums = count(splitters)
    return splitters, sums


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null)."""
    spark = docs.sparkSession
    rows = written(keyed(docs), f"{work_dir(spark)}/keys")  # texts are read once
    ranges = ranges or max(shards, 2 * shuffle_partitions(spark))
    splitters, sums = split_ranges(rows, ranges)
    total = max(1, sum(sums.values()))
    before, seen = {}, 0
    for r in range(len(splitters) + 1):
        before[r] = seen
        seen += sums.get(r, 0)
    start = F.element_at(F.array(*[F.lit(before[r]).cast("bigint") for r in range(len(splitters) + 1)]), F.col("r") + 1)
    in_range = Window.partitionBy("r").orderBy(*_ORDER)
    placed = (
        rows.withColumn("r", _range_of(spark, splitters))
        .withColumn("place", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("place", start + F.coalesce("place", F.lit(0)))
        .withColumn("shard", F.least(F.floor((F.col("place") + F.col("size") / 2) * shards / total), F.lit(shards - 1)).cast("int"))
        .withColumn("nr", F.row_number().over(Window.partitionBy("r", "shard").orderBy(*_ORDER)) - 1)
    )
    counts = placed.groupBy("shard", "r").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("shard", "r", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return placed.join(ahead, ["shard", "r"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nr") + F.col("ahead")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
