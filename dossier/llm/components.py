"""Connected components of an edge table, by alternating large and small stars.

Every step writes its result to the shared folder, so lineage stays short; hubs are
plain join keys between two stored tables, which adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.stages import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v.  Large: each node joins its larger neighbours to the least
    of its neighbourhood; small: the same for its smaller neighbours and itself."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star-least")
        # Only the rows (node, larger neighbour) are passed on.
        joined = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "star-least")
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return staged(moved.where(F.col("u") > F.col("v")).distinct(), "star")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).head()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; ``edges`` has columns a and b of one long
    type.  The component is its least node.  Loops and repeated edges do no harm; an
    edge with a null end counts for nothing."""
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = staged(pairs.distinct(), "edges")
    state = _state(current)
    while state[0]:
        current = _star(_star(current, large=True), large=False)
        new = _state(current)
        if new == state:
            break
        state = new
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def least_labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least row reachable from each of ``n`` rows over the pairs (x, y), inside one task."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
