"""Ordered string aggregation that splits large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _listagg(value: str, separator: str, order: str):
    literal = separator.replace("\\", "\\\\").replace("\n", "\\n").replace("'", "\\'")
    return F.expr(f"listagg(`{value}`, '{literal}') WITHIN GROUP (ORDER BY `{order}`)")


def ordered_concat(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    separator: str,
    out: str,
    block: int | None = None,
    dense: bool = False,
    errors: str | None = None,
) -> DataFrame:
    """``value`` of each group joined by ``separator`` in the order of ``order``.

    With ``block``, pieces are first joined within runs of ``block`` order values,
    spread over the cluster, and the joined blocks are joined in turn; a group
    holding a large share of all rows is then never sorted piece by piece in one
    task.  ``order`` must be a whole number for that.  Null values are skipped.
    With ``dense`` too, the order values of a group are 0, 1 and so on without a gap: a
    group that ends within its first block is then moved once, not twice.

    ``errors`` names a column whose first value in the order comes out as ``_failed``.
    """

    def first(column: str, place: str) -> list[F.Column]:
        return [F.min_by(column, F.when(F.col(column).isNotNull(), F.col(place))).alias("_failed")] if errors else []

    if block is None:
        return df.groupBy(*keys).agg(_listagg(value, separator, order).alias(out), *first(errors, order))
    joined = (
        df.withColumn("_block", F.floor(F.col(order) / block).cast("bigint"))
        .groupBy(*keys, "_block")
        .agg(_listagg(value, separator, order).alias(out), F.max(order).alias("_last"), *first(errors, order))
    )

    def whole(blocks: DataFrame) -> DataFrame:
        return blocks.groupBy(*keys).agg(_listagg(out, separator, "_block").alias(out), *first("_failed", "_block"))

    if not dense:
        return whole(joined)
    # A block that is not full is the last, and the last of one block is the whole.
    ends = F.col("_last") < block - 1
    return joined.where(ends).drop("_block", "_last").unionByName(whole(joined.where(~ends)))
