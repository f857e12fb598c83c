"""Usage roll-ups, snapshots, reports and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouping(df: DataFrame, tier: str, stage: str, value: str) -> DataFrame:
    """Calls and totals by tier, by stage and over all."""
    sets = df.groupingSets([[F.col(tier)], [F.col(stage)], []], F.col(tier), F.col(stage))
    return sets.agg(F.count("*").alias("calls"), F.sum(value).cast("bigint").alias("total")).select(F.col(tier).alias("tier"), F.col(stage).alias("stage"), "calls", "total")


#: Counters of a slot of usage; those of operations come on top.
FIELDS = ("prompt_tokens", "completion_tokens", "total_tokens", "cache_hit_tokens", "cache_miss_tokens")


def summary(calls: DataFrame) -> DataFrame:
    """(by, name, calls, FIELDS, cache_hit_rate, accepted, rejected) by tier, stage, operation and in total.

    ``calls`` has a row a call: tier, stage, operation, FIELDS, outcome ('accepted', 'rejected' or null).
    Totals are the sums of the tiers; missing numbers are 0.
    """
    from ..functions.text import hit_rate

    by = ["tier", "stage", "operation"]
    sets = calls.groupingSets([[F.col(c)] for c in by] + [[]], *[F.col(c) for c in by])
    sums = [F.coalesce(F.sum(f), F.lit(0)).cast("bigint").alias(f) for f in FIELDS]
    d = sets.agg(F.grouping_id(*by).alias("g_"), F.count("*").alias("calls"), *sums, F.count_if(F.col("outcome") == "accepted").alias("accepted"), F.count_if(F.col("outcome") == "rejected").alias("rejected"))
    kind = F.when(F.col("g_") == 3, "tier").when(F.col("g_") == 5, "stage").when(F.col("g_") == 6, "operation").otherwise("total")
    rate = hit_rate(F.col("cache_hit_tokens"), F.col("cache_miss_tokens"))
    return d.select(kind.alias("by"), F.coalesce(*by).alias("name"), "calls", *FIELDS, rate.alias("cache_hit_rate"), "accepted", "rejected")


def flushed(before: DataFrame, now: DataFrame, saved: DataFrame, key: str, value: str) -> DataFrame:
    """The saved summary with what has grown since ``before``; as it was where nothing has."""
    return merged(saved, delta(now, before, key, value).withColumnRenamed("grown", value), key, value)


def delta(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """Growth of a snapshot, never below 0, without the keys that did not grow."""
    j = now.select(key, F.col(value).alias("n")).join(before.select(key, F.col(value).alias("b")), key, "full")
    return j.select(key, F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("grown")).where("grown > 0")


def merged(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    return a.select(key, value).unionByName(b.select(key, value)).groupBy(key).agg(F.sum(value).alias(value))


def verdict(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Counts, recall and precision of a 0/1 finding against a 0/1 truth."""
    t, f = F.col(truth) == 1, F.col(found) == 1
    a = df.agg(F.count_if(t & f).alias("hits"), F.count_if(~t & f).alias("false_positives"), F.count_if(t).alias("positives"))
    return a.withColumn("recall", F.round(F.try_divide(F.col("hits").cast("double"), F.col("positives").cast("double")), 6))


def found_of(injected: DataFrame, reported: DataFrame, key: list[str]) -> DataFrame:
    """One row: injected errors that were reported and not, and reports at places without one."""
    there = injected.select(*key).distinct().withColumn("truth", F.lit(1))
    told = reported.select(*key).distinct().withColumn("found", F.lit(1))
    both = there.join(told, key, "full")
    return both.agg(F.count_if(F.expr("truth = 1 AND found = 1")).alias("hits"), F.count_if(F.expr("truth = 1 AND found IS NULL")).alias("missed"), F.count_if(F.col("truth").isNull()).alias("false_positives"))


#: What a change may cost: share of more losses than wins, and percentage points of recall.
MORE_LOSSES, LESS_RECALL = 0.10, 5.0


def ab_margin(verdicts: DataFrame) -> DataFrame:
    """One row of a comparison judged pair by pair ('a', 'b' or 'tie'): counts, b's net margin, and whether it may pass."""
    v = F.col("verdict")
    d = verdicts.agg(F.count("*").alias("pairs"), F.count_if(v == "a").alias("a_wins"), F.count_if(v == "b").alias("b_wins"), F.count_if(v == "tie").alias("ties"))
    margin = F.try_divide((F.col("b_wins") - F.col("a_wins")).cast("double"), F.col("pairs").cast("double"))
    return d.withColumn("margin", F.round(margin, 6)).withColumn("passes", F.coalesce(F.col("margin") >= -MORE_LOSSES, F.lit(False)))
