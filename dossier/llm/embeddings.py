"""Near duplicates among vectors by int8 tile products with error bounds.

A unit vector x is stored as s*q with int8 q; e = |x - s*q| is known exactly.  For two
vectors, |x.y - s*s'*q.q'| <= e*|s'q'| + |sq|*e' + e*e'.  A pair whose product plus bound stays
below the threshold cannot link, one whose product less bound reaches it must; only the
pairs between are computed in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.components import components, least_labels
from dossier.llm.stages import staged


def _quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the coded vector and of what it misses."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    slack = 1e-12  # far above the rounding of double sums
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(unit - coded, axis=1) + slack


def linked_pairs(one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean table of pairs of rows with cosine >= threshold; rows are not zero."""
    norms = np.linalg.norm(one, axis=1), np.linalg.norm(two, axis=1)
    a = _quantised(one / norms[0][:, None])
    b = _quantised(two / norms[1][:, None])
    # Products of int8 codes are whole numbers that single precision holds exactly up to 2**24.
    exact = np.float32 if one.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (a[0].astype(exact) @ b[0].astype(exact).T) * a[1][:, None] * b[1][None, :]
    bound = a[3][:, None] * (b[2] + b[3])[None, :] + a[2][:, None] * b[3][None, :]
    linked = product - bound >= threshold
    x, y = np.nonzero((product + bound >= threshold) & ~linked)
    for start in range(0, len(x), 100_000):
        i, j = x[start : start + 100_000], y[start : start + 100_000]
        dots = np.einsum("ij,ij->i", one[i], two[j])
        linked[i, j] = dots / (norms[0][i] * norms[1][j]) >= threshold
    return linked


def tile_links(nodes: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """(node, links, root) per tile: vectors linked there, and a tree over linked nodes.

    ``nodes`` has node, label, size, embedding, copies.  Vectors of a label and length are cut into
    blocks by node hash; every pair of blocks is a group of its own, at most two blocks large."""
    kinds = staged(nodes.groupBy("label", "size").agg(F.count("*").alias("n")), "vector-kinds")
    blocks = F.ceil(F.col("n") / block).cast("long")
    placed = nodes.join(kinds, ["label", "size"]).withColumn("blocks", blocks)
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "label", "size", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "copies", "embedding"
    )

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        mine, node, copies = (table.column(c).to_numpy() for c in ("mine", "node", "copies"))
        flat = table.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64)
        vectors = flat.reshape(len(node), -1)
        one, two = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        linked = linked_pairs(vectors[one], vectors[two], threshold)
        if i == j:
            linked = np.triu(linked, 1)
        x, y = np.nonzero(linked)
        x, y = one[x], two[y]
        links = np.bincount(x, copies[y], len(node)) + np.bincount(y, copies[x], len(node))
        root = least_labels(len(node), x, y)
        has = np.flatnonzero(links)
        return pa.table({"node": node[has], "links": links[has].astype(np.int64), "root": node[root[has]]})

    return spread.groupBy("label", "size", "i", "j").applyInArrow(run, "node long, links long, root long")


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors are compared only under equal labels and lengths.  A null label, and a vector that is
    null, empty, zero, or holds a null or non-finite number, links with nothing: no
    links, its own component.  Equal vectors are handled once and counted as often as they
    occur.  Null ids never become a component's id unless all its ids are null; ``kept`` of a null id is false.  A
    vector whose norm leaves the range of doubles counts as zero.
    """
    v = F.col("_v")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_v")
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = F.col("_label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & (square > 0) & (square < float("inf"))
    rows = rows.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    nodes = staged(
        rows.where("_ok")
        .groupBy("_label", "_v")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), F.col("_label").alias("label"), F.size("_v").alias("size"), F.col("_v").alias("embedding"), "least", "copies"),
        "vectors",
    )
    tiles = staged(tile_links(nodes, threshold), "tile-links")
    links = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    found = staged(components(tiles.select(F.col("node").alias("a"), F.col("root").alias("b"))), "vector-components")
    narrow = nodes.select("node", "least", "copies").join(found, "node", "left")
    placed = staged(narrow.withColumn("component", F.coalesce("component", "node")), "vectors-placed")
    least = staged(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    solved = placed.join(least, "component").join(links, "node", "left").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    keyed = staged(
        nodes.select("node", F.col("label").alias("_label"), F.col("embedding").alias("_v")).join(solved, "node").drop("node"),
        "vectors-solved",
    )
    linked = rows.where("_ok").join(keyed, ["_label", "_v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)
