"""A training corpus from `documents`: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared folder and reads
it again as the next stage's docs, so that a lost executor or a failed stage costs that stage alone. All stages but the
last return the columns of documents.

Mixing gives whole documents: one row for each pass that the mix takes of a document, and one more where it takes at
least half of it once again.

Defined cases are those of the operators: null or empty texts go at the quality rules; equal rows are one document; an
empty table gives an empty corpus.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from markloom.llm import bpe, mixing, pii, quality, simhash
from markloom.llm.common import shared_folder, table
from markloom.llm.queries import vocabulary_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.passes(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary_file("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixed_sources),
    ("tokens", tokens),
]

#: The last stages have no form in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:  # the stage before isn't read again
            remove(spark, f"{folder}/{k - 1}")
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
