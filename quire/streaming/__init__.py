"""Streams of translated segments: rolling contexts, append once, what is still to do."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Targets that a book's state keeps, and those that a context shows.
KEPT, SHOWN = 40, 6
SEGMENTS = "book string, chapter int, seg int, source string, target string"


def events(spark: SparkSession, path: str, schema: str = SEGMENTS) -> DataFrame:
    """A stream of the JSON lines appended below ``path``; lines that are no JSON give null columns."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(path)


def rolling_contexts(segments: DataFrame, shown: int = SHOWN, kept: int = KEPT) -> DataFrame:
    """(book, chapter, seg, context): the last ``shown`` non-blank targets of the book before each segment.

    The state of a book is its last ``kept`` targets, over chapters and micro-batches. Within a batch a
    book's segments go in order; across batches in order of arrival.
    """

    def run(key, parts: Iterator, state: GroupState):
        import pandas as pd

        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["chapter", "seg"], kind="stable")
        out = []
        for chapter, seg, target in zip(rows.chapter, rows.seg, rows.target):
            out.append((key[0], chapter, seg, "\n".join(past[-shown:])))
            if isinstance(target, str) and target.strip():
                past = [*past, target][-kept:]
        state.update((past,))
        yield pd.DataFrame(out, columns=["book", "chapter", "seg", "context"])

    return segments.groupBy("book").applyInPandasWithState(run, "book string, chapter int, seg int, context string", "past array<string>", "append", GroupStateTimeout.NoTimeout)


def append_once(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """A query that appends rows to the table at ``path``, each key once, whatever is sent or run again.

    Rows whose key stands in the table already are left out, so a batch that is repeated after a failure
    adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        if exists(spark, path):
            rows = rows.join(spark.read.schema(batch.schema).parquet(path).select(*keys), keys, "left_anti")
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def pending(chapters: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters without a row in ``done``: what a restart still has to do."""
    return chapters.join(done.select(*keys).distinct(), keys, "left_anti")


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last event of each key: a log replayed."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
