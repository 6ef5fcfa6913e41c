"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import bpe, embeddings, main_text, minhash, packing, pii, quality, spelling, stream_dedup, token_files, url_templates, warc, whitening
from dossier.llm.oracles import ORACLES, RULES
from dossier.llm.shipping import ship
from dossier.sinks.stage import new_folder

QUERIES: dict = {}


def query(function):
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = shipped
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_main_text(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


@query
def op3_url_templates(spark, sf_dir):
    """The number in a page's path is that of the document it shows, which labels judge."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("url_key"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good")
    )
    judged = url_templates.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, labels)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op4_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, count_col="n_entities")


@query
def op5_warc(spark, sf_dir):
    out = new_folder(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), out)
    return warc.captures(warc.read_archive(spark, out))


@query
def op7_minhash(spark, sf_dir):
    """A class id and whether the row is the one of its class to keep."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


@query
def op8_embeddings(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op10_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_token_files(spark, sf_dir):
    out = new_folder(spark, "token-files")
    token_files.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out, end_id=2
    )
    return token_files.read_token_files(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_whitening(spark, sf_dir):
    """``deviation`` as a long; null where it does not fit."""
    found = whitening.whitened(table(spark, sf_dir, "embeddings"), keep=8)
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@query
def op12_stream_dedup(spark, sf_dir):
    return stream_dedup.deduplicated(spark, f"{sf_dir}/documents.parquet", new_folder(spark, "stream-dedup"))


@query
def op13_spelling(spark, sf_dir):
    words = spelling.counted_words(table(spark, sf_dir, "documents"), least_length=6, least_count=5, slips=199)
    return spelling.variants(words, ratio=5)
