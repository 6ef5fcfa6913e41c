"""Page text, links, and the lookup of hit URLs in the crawled table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed_values as fixed
from dossier.functions.html import anchors, body_text
from dossier.functions.text import chunks, fill
from dossier.functions.urls import resolve_url
from dossier.settings import DEFAULTS
from dossier.sinks.stage import stage

PAGE_MISSING = "page not found"


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", body_text(F.col("html")).alias("text"))


# Explodes below are outer ones with the empty rows dropped after: for an inner explode
# the optimizer adds a filter that computes the whole array a second time.


def _each_anchor(pages: DataFrame, links: Column) -> DataFrame:
    exploded = pages.select(
        "page_id", F.col("url").alias("_base"), F.posexplode_outer(links).alias("pos", "_a")
    )
    return exploded.where(F.col("pos").isNotNull())


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link: page_id, pos, text, href, url (absolute)."""
    return _each_anchor(pages, anchors(F.col("html"))).select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("_a.text").alias("text"),
        F.col("_a.href").alias("href"),
        resolve_url(F.col("_base"), F.col("_a.href")).alias("url"),
    )


def page_top_links(pages: DataFrame, n: int = DEFAULTS.links_per_page) -> DataFrame:
    """The first ``n`` links of each page as ``text (url)`` labels.

    The list is cut before it is exploded, so only the kept links are resolved."""
    kept = F.slice(anchors(F.col("html")), 1, n)
    return _each_anchor(pages, kept).select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        fill(
            fixed.LINK_LABEL,
            text=F.col("_a.text"),
            url=resolve_url(F.col("_base"), F.col("_a.href")),
        ).alias("label"),
    )


def latest_pages(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Pages whose URL is in ``urls``, one per URL: the highest page_id.

    The ids are found on the two narrow columns, with a maximum combined before the
    shuffle, and written; the wide columns are then read only where they are kept.  ``urls``
    should be a written stage too: the sizes of both decide how the joins are done.  Beyond the
    broadcast limit the wide columns of ``pages`` are shuffled, so give texts rather than markup.
    """
    ids = stage(
        pages.select("url", "page_id")
        .join(urls.select("url"), "url", "left_semi")
        .groupBy("url")
        .agg(F.max("page_id").alias("page_id")),
        "page-ids",
    )
    return pages.join(ids, ["url", "page_id"], "left_semi")


def page_lookup(visits: DataFrame, texts: DataFrame) -> DataFrame:
    """Each visit with its page text; a miss stays as a row with a status.

    status: no_url, no_page, empty_text or ok."""
    looked_up = visits.join(
        texts.select("url", "page_id", "text"), "url", "left"
    )
    status = (
        F.when(F.coalesce("url", F.lit("")) == "", "no_url")
        .when(F.col("page_id").isNull(), "no_page")
        .when(F.col("text") == "", "empty_text")
        .otherwise("ok")
    )
    return looked_up.withColumn("status", status)


def text_chunks(texts: DataFrame, keys: list[str], limit: int = DEFAULTS.chunk_chars) -> DataFrame:
    """(keys, part, chunk): paragraphs packed greedily up to ``limit``."""
    exploded = texts.select(
        *keys, F.posexplode_outer(chunks(F.col("text"), limit)).alias("part", "chunk")
    )
    return exploded.where(F.col("part").isNotNull()).select(
        *keys, F.col("part").cast("bigint").alias("part"), "chunk"
    )
