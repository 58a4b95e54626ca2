"""The corpus pipeline: toxicity, near duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm import decontamination, jaccard, packing, secrets, toxicity
from lakesift.llm.common import materialise, text_of

#: Toxicity scoring, similarity search and tokenizers can't be written in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a lexicon that is learned from the tables documents and labels.

    Null or empty text: the score of no finding, so the row stays. Equal texts stay or go together. Null doc_ids are scored
    as others are. Empty table: empty result. All columns stay as they are, whatever their names.
    """
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = "toxicity"
    while own in docs.columns:
        own = f"_{own}"
    return toxicity.score(docs, model, keep=tuple(docs.columns), into=own).where(F.col(own) < 0.5).drop(own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked or equal texts: the one with the smallest id.

    Null text: as empty; all rows without words of one text are one class. Null doc_id: comes after all others, and is kept
    where its class has no other. Rows that repeat a doc_id with unlike texts are apart. Empty table: empty result.
    """
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window close to a benchmark item.

    Rows are told apart by a 64-bit hash of their texts: a row with a null doc_id goes if its text has a
    match, and of rows that share a doc_id only those go whose own texts have one. Null or empty text: stays. Repeated rows
    stay or go together. Empty tables: empty result, or all documents. Other columns stay as they are.
    """
    key = F.xxhash64(text_of())
    found = decontamination.contaminated(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("__found"))
    return docs.join(materialise(found, "contaminated"), key == F.col("__found"), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts masked and n_chars as it is then.

    Null text: stays null, and so does its n_chars. Repeated rows: masked alike. Empty table: empty result. Other columns
    stay as they are, whatever their names.
    """
    return secrets.mask_rows(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences, as ``packing.pack`` gives them.

    Null or empty text: one piece that holds the end id. Repeated rows: each is packed. Empty table: empty result. Only
    doc_id and text are read.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
