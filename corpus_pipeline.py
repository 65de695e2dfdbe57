"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the folder that the
cluster shares and hands the rows read back to the next stage. All stages but the last return the columns of documents.
A later stage sees only what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import language, packing, toxicity
from storyloom.llm._common import held_out, read, stage
from storyloom.llm._encode import vocabulary
from storyloom.llm.decontamination import drop_leaks
from storyloom.llm.simhash import drop_near_copies

#: SQL cannot express the learned stages; tests hold run() against brute-force versions instead.
ORACLE_SQL = None
#: Share of a document's text that its main language needs.
MIN_SHARE = 0.5
#: Bytes of encoded words that a worker remembers while packing: few, for its executor has run all stages before.
WORKER_BYTES = 16 << 20
#: Bounds of the batches of rows that executors and workers hold at once: what one takes lies in both, and twice in the executor
#: while it grows. Memory only: no result depends on them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Set for the session, as a stage's rows are made when its result is written."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def _carried(docs: DataFrame) -> DataFrame:
    """(row, text): all other columns in one struct, so that no name can clash with those that an operator adds."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")


def _restored(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: those without a letter, or without a language of at least half, go."""
    small_batches(spark)
    model = language.train(docs, ~held_out("doc_id"))
    found = language.identify(_carried(docs), model, key="row", keep=("text",))
    return _restored(found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_SHARE)), docs)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out("doc_id"))
    found = toxicity.score_documents(_carried(docs), model, key="row", keep=("text",))
    return _restored(found.where(F.col("score") < toxicity.THRESHOLD), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word-shingle similarity 0.8 or more: the one with the smallest doc_id."""
    small_batches(spark)
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=2, remembered=WORKER_BYTES)


STAGES = [
    ("language", identify_language),
    ("toxicity", reject_toxic),
    ("simhash", drop_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
