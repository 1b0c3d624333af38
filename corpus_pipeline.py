"""A training-data pipeline over `documents`: each stage reads what the one before has kept.

1. quality_rules drops the documents that fail a rule.
2. near_duplicates keeps the first document of each class of near duplicates.
3. decontamination drops documents that hold a benchmark passage.
4. secret_scan replaces secrets by a mark; the documents stay.
5. best_fit_packing packs the documents into sequences and returns a row for each piece.

Each stage but the last returns all columns of its input, whatever their names, in their order. What becomes of
odd rows:

- Null or empty texts have no words and fail the first stage. Given to a later stage alone, they are classes of
  their own, hold no passage and no secret, and are packed as one closing id.
- Rows with a null doc_id are judged by their text in the first and fourth stage; the second and third, which
  compare documents by id, keep them; the last gives them pieces with a null doc_id.
- Rows that repeat a doc_id are one document in the second stage, which keeps one of them. Equal texts are near
  duplicates: the smallest doc_id stays. Nulls in other columns stay as they are, but n_chars follows a new text.
- Texts of any length are read whole. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontam, jaccard_join, packing, quality_rules, secrets
from riskloom.llm.common import table
from riskloom.session import shared_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark and n_chars follows; a table without samples has a model of its base patterns alone."""
    names = docs.columns
    out = secrets.redact(docs, secrets.model_for(docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op10(docs)


STAGES = [
    ("quality_rules", good),
    ("near_duplicates", distinct),
    ("decontamination", unseen),
    ("secret_scan", redacted),
    ("best_fit_packing", packed),
]

#: Near-duplicate classes, the Markov models and the tokenizer are beyond SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again, in the session's shared folder.

    A stage's files go once the next ones are written, so only the last result stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
        if i:
            delete(spark, f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
    return docs


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
