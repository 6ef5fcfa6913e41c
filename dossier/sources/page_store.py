"""The text of a crawl, stored for lookups: one row per URL, bucketed and sorted by it.

A join on the URL moves the rows that ask to the buckets that hold them; the texts stay where they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCHEMA = "page_id bigint, url string, text string"


def _table(path: str) -> str:
    return "page_texts_" + hashlib.sha256(path.encode()).hexdigest()[:16]


def store_page_texts(texts: DataFrame, path: str, buckets: int) -> DataFrame:
    """Store (page_id, url, text) under ``path``, a shared folder that does not exist yet, and return it as
    :func:`read_page_texts` does.

    Of several pages of one URL the highest page_id stays; pages without a URL are never looked up and not stored.  Texts are
    moved once, here.  Some hundred MB a bucket are a good size."""
    spark = texts.sparkSession
    newest = W.partitionBy("url").orderBy(F.desc("page_id"))
    dealt = texts.where(F.col("url").isNotNull()).select("page_id", "url", "text").repartition(buckets, "url")
    latest = dealt.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")
    writer = latest.write.format("parquet").bucketBy(buckets, "url").sortBy("url").option("path", f"{path}/texts")
    writer.saveAsTable(_table(path))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")
    return spark.table(_table(path))


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """The stored texts, by their buckets; a session that did not write them learns the layout from the folder."""
    table = _table(path)
    if not spark.catalog.tableExists(table):
        buckets = spark.read.schema("buckets int").parquet(f"{path}/layout").head()["buckets"]
        place = f"{path}/texts".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {table} ({SCHEMA}) USING parquet CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(table)
