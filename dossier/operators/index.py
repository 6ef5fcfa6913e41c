"""A search index that grows with the crawl: new pages are a new segment, old postings stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators.search import _part, postings, term_stats
from dossier.operators.search import lengths as lengths_of
from dossier.sinks.segments import Segments

POSTINGS = "doc_key bigint, dl bigint, term string, tf bigint, segment string, part int"
LENGTHS = "doc_key bigint, dl bigint, segment string"
TERMS = "term string, df bigint, occurrences bigint, segment string"
SIZES = "n_docs bigint, sum_dl bigint, segment string"


class SearchIndex(Segments):
    """Per segment: postings by part of a term's hash, document lengths, and what term statistics and the corpus size
    are made of, which add up over segments.  Several writers may append; each leaves out the documents that it finds there, so
    the same new document must not be given to two of them at once."""

    def append(self, corpus: DataFrame) -> bool:
        """Index the documents (doc_key, text) that are not in the index yet; False if there are none.

        A document is known by its key: a changed text under an old key is not taken in.  Rows of one key within
        ``corpus`` must be one."""
        segment = self.new_segment()
        fresh = corpus.select("doc_key", "text").join(self.lengths().select("doc_key"), "doc_key", "left_anti")
        lengths_of(fresh).write.parquet(self.folder("lengths", segment))
        added = self.stored("lengths", [segment], LENGTHS)
        if not added.head(1):
            return False
        rows = postings(fresh).withColumn("part", _part()).hint("rebalance", F.col("part"))
        rows.sortWithinPartitions("part", "term").write.partitionBy("part").parquet(self.folder("postings", segment))
        self._count([segment], segment)
        self._name(segment, [])
        return True

    def _count(self, of: list[str], segment: str) -> None:
        """Statistics of the postings and lengths of ``of``, as those of ``segment``."""
        term_stats(self.stored("postings", of, POSTINGS)).write.parquet(self.folder("terms", segment))
        sums = self.stored("lengths", of, LENGTHS).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("sum_dl"))
        sums.write.parquet(self.folder("sizes", segment))

    def postings(self) -> DataFrame:
        """(doc_key, dl, term, tf, part) as ``search.search_topk`` takes an index's first table."""
        return self.stored("postings", self.segments(), POSTINGS).drop("segment")

    def lengths(self) -> DataFrame:
        return self.stored("lengths", self.segments(), LENGTHS).select("doc_key", "dl")

    def term_stats(self) -> DataFrame:
        """(term, df, occurrences), from the segments' own counts: no posting is read."""
        stored = self.stored("terms", self.segments(), TERMS)
        return stored.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))

    def size(self) -> DataFrame:
        """One row: n_docs and avg_dl."""
        sums = self.stored("sizes", self.segments(), SIZES).agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl"))
        return sums.select(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), (F.col("sum_dl") / F.col("n_docs")).alias("avg_dl"))

    def compact(self) -> None:
        """One segment in place of those there are; statistics are added up, texts are not read.  Only one compaction may
        run at a time, beside any number of appends."""
        old = self.segments()
        if len(old) < 2:
            return
        segment = self.new_segment()
        rows = self.stored("postings", old, POSTINGS).drop("segment").hint("rebalance", F.col("part"))
        rows.sortWithinPartitions("part", "term").write.partitionBy("part").parquet(self.folder("postings", segment))
        self.stored("lengths", old, LENGTHS).drop("segment").write.parquet(self.folder("lengths", segment))
        terms = self.stored("terms", old, TERMS).groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))
        terms.write.parquet(self.folder("terms", segment))
        self.stored("sizes", old, SIZES).drop("segment").coalesce(1).write.parquet(self.folder("sizes", segment))
        self._name(segment, old)

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """The index as ``search.search_topk`` takes it."""
        return self.postings(), self.lengths()
