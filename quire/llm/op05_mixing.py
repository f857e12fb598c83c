"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are laid end to end in a seeded order and cut into blocks of ``block``
words. All seats of the mix are given out by highest quotients target / (2 k + 1), one block a seat;
a source holds at most ``cap`` seats a block. The seats of a shard are the difference of two such
apportionments (the method is house-monotone), so every shard has integer quotas. Within a shard a
source's quota is met by whole passes over its blocks of the shard and, for the rest, by a
systematic choice with a seeded start. The number of chosen words below any position has a closed
form, so a document's taken words are a difference of two values, whatever its length.

Places come from a two-level prefix sum: documents fall into buckets by their seeded hash, with a
number of buckets per source in proportion to its rows, so no window holds a whole source.

Size: words of the text (null: 0). A null source is a source, last in order. Documents of the same
id and text are interchangeable; a null doc_id hashes like any value. One row a source is held on
the driver. No documents: no rows.

Whole copies (``whole``): the shares taken / size of a bucket's documents are summed in the order of
their sizes, from a seeded start below 1; a document has as many copies as whole numbers lie in its
step. So copies are taken / size on average, and as neighbours in the sum are of like size, a
bucket's copied words differ from its taken ones by a document or two.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, work_dir, written

WEIGHTS = (5, 2, 1)
#: The mix's share of all words, as a fraction.
SHARE = (3, 2)
CAP = 2
BLOCK = 16
MIX_SHARDS = 8
SEED = 17
ROWS_PER_BUCKET = 2_000
#: Sources, of a kilobyte each, that are broadcast; more are joined with equal results.
BROADCAST_SOURCES = 10_000
#: Parts of a copy that shares are counted in.
UNIT = 1 << 32
#: Buckets, at some dozens of bytes each, whose sums are sent to all tasks for whole copies.
BROADCAST_BUCKETS = 200_000


def targets(sizes: list[int], weights: list[int], total: Fraction, cap: int = CAP) -> list[Fraction]:
    """``total`` shared by weight; what exceeds ``cap`` times a size is reshared until none does."""
    out = [Fraction(0)] * len(sizes)
    open_, left = set(range(len(sizes))), Fraction(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / weight > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def sainte_lague(shares: list[Fraction], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients share / (2 k + 1), at most ``most`` each; ties to the first.

    The quotient of the last seat is found by bisection over exact fractions' floats, and the few
    seats next to it are given out one by one, so the cost does not depend on ``seats``.
    """
    import heapq

    seats = min(seats, sum(m for m, s in zip(most, shares) if s > 0))
    held = lambda q: [min(m, max(0, int((float(s) / q + 1) / 2))) if s > 0 else 0 for s, m in zip(shares, most)]
    lo, hi = 0.0, max([1.0, *map(float, shares)]) * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if sum(held(mid)) > seats:
            lo = mid
        else:
            hi = mid
    got = held(hi)
    got = [max(0, g - 1) for g in got]
    heap = [(-s / (2 * g + 1), i) for i, (s, g, m) in enumerate(zip(shares, got, most)) if s > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


def plan(sizes: list[int], block: int = BLOCK, shards: int = MIX_SHARDS, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> list[dict]:
    """Per source: its target and, per shard, first block, blocks and quota."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    goal = targets(sizes, weight, Fraction(sum(sizes) * share[0], share[1]), cap)
    blocks = [-(-n // block) for n in sizes]
    edge = [[b * h // shards for h in range(shards + 1)] for b in blocks]
    seats = int(round(sum(goal) / block))
    below = [0] * len(sizes)
    out = [{"target": float(g), "shards": []} for g in goal]
    for h in range(shards):
        now = sainte_lague(goal, seats * (h + 1) // shards, [cap * e[h + 1] for e in edge])
        now = [max(a, b) for a, b in zip(now, below)]
        for i, e in enumerate(edge):
            quota = min(now[i] - below[i], cap * (e[h + 1] - e[h]))
            out[i]["shards"].append((e[h], e[h + 1] - e[h], quota))
            now[i] = below[i] + quota
        below = now
    return out


def mix(docs: DataFrame, block: int = BLOCK, shards: int = MIX_SHARDS, seed: int = SEED, extra: tuple = (), whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken (``whole``: and copies) of every document, then the ``extra`` columns."""
    spark = docs.sparkSession
    narrow = ["doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("h")]
    sized = written(docs.select(*narrow), f"{work_dir(spark)}/sizes")  # texts are read once for all sums
    rows = docs.select(F.struct(*extra).alias("extra_"), *narrow) if extra else sized
    totals = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sources = []
    for r, p in zip(totals, plan([r["size"] for r in totals], block, shards)):
        parts, cum = [], 0
        for k, (first, n, quota) in enumerate(p["shards"]):
            passes, rest = divmod(quota, n) if n else (0, 0)
            start = hash((seed, k, 7919)) % n if n else 0
            parts.append((first, n, passes, rest, start, cum))
            cum += quota * block
        sources.append((r.source, r["size"], p["target"], max(1, r.rows // ROWS_PER_BUCKET), parts))
    part = "array<struct<first:bigint,n:bigint,whole:bigint,rest:bigint,start:bigint,cum:bigint>>"
    info = spark.createDataFrame(sources, f"source string, source_size bigint, target double, buckets bigint, parts {part}")
    if len(sources) <= BROADCAST_SOURCES:
        info = F.broadcast(info)
    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumnRenamed("source", "s").join(info, F.col("s").eqNullSafe(F.col("source")))
        return df.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets")))

    rows = dealt(rows)
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    rows = rows.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = dealt(sized).groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("bs"), F.col("bucket").alias("bb"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    if whole and sum(s[3] for s in sources) <= BROADCAST_BUCKETS:  # the rows stay where their buckets are
        sums = F.broadcast(sums)
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bucket") == F.col("bb")))
    rows = rows.withColumn("b", F.col("ahead") + F.col("end")).withColumn("a", F.col("b") - F.col("size"))

    def below(x: str) -> str:
        """Words taken of the source's first x words."""
        j = f"({x} div {block})"
        at = f"filter(parts, p -> p.n > 0 AND p.first <= {j})"
        p = f"element_at({at}, size({at}))"
        extra = f"least({j} - p.first, p.n)"
        full = f"({extra} * p.whole + (p.start + {extra} * p.rest) div p.n) * {block}L"
        chosen = f"IF({j} - p.first < p.n, p.whole + (p.start + ({j} - p.first + 1) * p.rest) div p.n - (p.start + ({j} - p.first) * p.rest) div p.n, 0L)"
        return f"coalesce(transform(array({p}), p -> p.cum + {full} + ({x} - {j} * {block}L) * {chosen})[0], 0L)"

    taken = F.when(F.col("size") > 0, F.expr(f"{below('b')} - {below('a')}")).otherwise(F.lit(0))
    found = ("doc_id", "size", "source_size", "target")
    if whole:
        rows = rows.withColumn("taken", taken.cast("bigint"))
        rows = rows.withColumn("share", F.when(F.col("size") > 0, F.expr(f"cast(round(cast(taken AS decimal(20, 0)) * {UNIT} / size) AS bigint)")).otherwise(F.lit(0)))
        start = F.pmod(F.xxhash64(F.lit(seed), "source", "bucket"), F.lit(UNIT))
        upto = start + F.sum("share").over(Window.partitionBy("source", "bucket").orderBy("size", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("upto", upto).withColumn("copies", F.expr(f"upto div {UNIT} - (upto - share) div {UNIT}"))
        taken, found = F.col("taken"), (*found, "copies")
    return rows.select(*found, taken.cast("bigint").alias("taken"), *[F.col(f"extra_.{c}") for c in extra if c not in found])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
