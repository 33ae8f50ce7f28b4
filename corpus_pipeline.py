"""From raw documents to packed sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from providerfx.llm import blocks, decontamination, near_duplicates, packing, substrings, toxicity
from providerfx.llm.queries import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document of this score or more goes.
TOXIC = 0.7
#: Words of a passage that may stand in one place only.
PASSAGE = 50


def documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.toxicity(docs, labels, held_out).filter(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(docs, shingle=5, percent=80).filter("kept").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one that consists of such passages alone goes."""
    cut = substrings.dedup_substrings(docs, window=PASSAGE)
    return documents(cut.filter("n_removed = 0 or n_removed < n_words"))


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return documents(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_coverage=0.5))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0)


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("substrings", cut_repeated_passages), ("decontamination", cut_benchmark_passages), ("packing", pack)]

#: No SQL: a learned classifier, a tokenizer and a packing have none. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage read and its own tables are dropped as soon as its documents are written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        made = blocks.made()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            schema, before, path = docs.schema, path, blocks.new_path(spark, name)
            blocks.write_plain(docs, path)
            blocks.drop_made(spark, made)
            if before:
                blocks.drop_path(spark, before)
            docs = spark.read.schema(schema).parquet(path)
    return docs
