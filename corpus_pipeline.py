"""The corpus pipeline: toxicity, exact dedup, MinHash near-dedup, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.  All
but the last return the columns of ``documents``.  Rows of one identifier and equal text count as one row from the second stage on.
A row without an identifier is told apart by its text; it goes where a document with an identifier has an equal text or equal shingles.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import bpe, common, decontaminate, exact_dedup, near_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.  It is fitted on the labelled documents of ``docs``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.chain_of_labels())
    return toxicity.keep_clean(docs, model)


def _mark():
    """A row's text as a number; together with the identifier it names a row."""
    return F.xxhash64("text", F.octet_length("text"))


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose identifier and mark are among the kept ones: _key, and all columns, whatever their names, in _row."""
    key = lambda mark: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), mark.cast("string")).alias("_key")
    chosen = decided.where("kept").select(key(F.col("mark"))).distinct()
    return docs.select(key(_mark()), F.struct("*").alias("_row")).join(chosen, "_key", "left_semi")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier stays."""
    kept = _keep(docs, exact_dedup.exact_dedup(docs, mark=_mark()))
    once = Window.partitionBy("_key").orderBy("_row.text", F.xxhash64("_row"))
    return kept.withColumn("_k", F.row_number().over(once)).where("_k = 1").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8 or more."""
    return _keep(docs, near_dedup.near_dedup(docs, shingle=5, percent=80, mark=_mark())).select("_row.*")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; the other documents stay as they are."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, n_tokens, ids."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("bpe", encode),
]

#: The first stage is a fitted model and the third works on sampled hash functions: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with common.temporary(spark) as kept:
            docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs)
        if before is not None:
            common.release(before)
        before = docs
    return docs
