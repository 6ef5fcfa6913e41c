"""The corpus pipeline: quality rules, near duplicates, personal data, packing.

Each stage takes the table that the one before it wrote.  All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import minhash, packing, pii, quality
from dossier.llm.shipping import ship
from dossier.sinks.stage import new_folder

# No stage is one that SQL can express; tests hold each against a brute-force version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.good_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.one_per_class(docs)


def without_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    swapped = pii.pseudonymised(docs).drop("_n_entities")
    return swapped.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", one_of_each),
    ("surrogates", without_private),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = new_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
