"""Report deltas to paragraph messages and to the full text, as batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dossier.functions.ordered import ordered_concat

BLOCK = 4096


def report_messages(deltas: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, msg_no, output): deltas gathered until one brings a line break.

    The buffer is sent whole, not cut at the break; a tail without a break is not sent.
    ``seq`` is a whole number.  Breaks are counted within blocks of ``seq`` and the
    block counts are summed ahead, so a run with a large share of all deltas is
    spread over many tasks.
    """
    kept = deltas.where(F.col("delta").isNotNull()).select(
        "run_id",
        "seq",
        "delta",
        F.floor(F.col("seq") / block).cast("bigint").alias("block"),
        F.contains("delta", F.lit("\n")).cast("bigint").alias("has_break"),
    )
    earlier = W.partitionBy("run_id", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    earlier_blocks = W.partitionBy("run_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = kept.groupBy("run_id", "block").agg(F.sum("has_break").alias("_breaks"))
    offsets = totals.select(
        "run_id", "block", F.coalesce(F.sum("_breaks").over(earlier_blocks), F.lit(0)).alias("_offset")
    )
    numbered = (
        kept.withColumn("_within", F.coalesce(F.sum("has_break").over(earlier), F.lit(0)))
        .join(offsets, ["run_id", "block"])
        .withColumn("msg_no", F.col("_offset") + F.col("_within"))
    )
    sent = ordered_concat(numbered, ["run_id", "msg_no"], "seq", "delta", "", "output", block=block)
    return sent.where(F.contains("output", F.lit("\n")))


def report_text(deltas: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, report): all deltas that are not null, in order, tail included."""
    return ordered_concat(deltas, ["run_id"], "seq", "delta", "", "report", block=block)
