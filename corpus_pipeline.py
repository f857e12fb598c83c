"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import op02_pieces, op05_mixing, op06_jaccard, op08_secrets, op09_langid
from quire.llm.common import give_back, table, work_dir, written
from quire.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")




def ready(spark: SparkSession) -> None:
    """Before a stage that needs memory beside the executors' heaps: they are made small, and workers have the code."""
    ship(spark)
    give_back(spark)


#: A text of so many bytes that no language tells from noise (8 bits a byte say nothing) is rejected.
MIN_BYTES, MAX_BITS = 32, 7.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with ``lang`` set to it.

    Rejected: texts that are null or without a letter, and texts of ``MIN_BYTES`` or more that even the
    best language codes at ``MAX_BITS`` bits a byte or worse. Where no row has a label, so that nothing
    could be learned, texts with a letter stay as they are. Repeated rows and null ids are rows like any
    other; columns beyond those of documents are left out. No rows: none.
    """
    ship(spark)
    model = op09_langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    told = docs.select(*COLUMNS, op09_langid.told(model, spark).alias("told_"))
    noise = (F.octet_length("text") >= MIN_BYTES) & (F.col("told_.bits") >= MAX_BITS)
    told = told.where((F.col("told_.lang_pred") != op09_langid.UND) & ~F.coalesce(noise, F.lit(False)))
    return told.withColumn("lang", F.col("told_.lang_pred")).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, null last, and of equal ids any one row.

    Groups are of rows, not ids: rows are numbered and written first, so the numbers hold in every
    later read, and repeated or null ids are rows like any other. Texts without a shingle all stay.
    """
    ship(spark)
    rows = written(docs.select(*COLUMNS).withColumn("row_", F.monotonically_increasing_id()), f"{work_dir(spark)}/rows")
    groups = op06_jaccard.link_components(rows.select(F.col("row_").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_"))
    stay = groups.join(rows.select("row_", "doc_id"), "row_").groupBy("component_id").agg(least.alias("m")).select("m.row_")
    return rows.join(stay.hint("shuffle_hash"), "row_", "left_semi").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows. Null texts stay null, empty ones empty."""
    ship(spark)
    return op08_secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents, none too, so that each source has the words the mix takes of it.

    Null and wordless texts have no words to take, so they have no copies; a null source is a source.
    """
    ready(spark)
    taken = op05_mixing.mix(docs, extra=COLUMNS, whole=True).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens of every document, and digests of ids and decoded text; null texts count as empty."""
    ready(spark)
    return op02_pieces.round_trip(docs, op02_pieces.tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", distinct_texts),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: No SQL: learned models, similarity components and merges are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{work_dir(spark)}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
