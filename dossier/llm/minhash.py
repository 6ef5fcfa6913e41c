"""Near duplicates by consistent weighted samples of TF-IDF shingles.

1. Equal texts become one node each.
2. The share of nodes that hold a shingle gives its weight, tf * ln(1 + 1 / (share + 1/8)).
   Shares are counted over all nodes in a table of fixed size, by shingle hash: with a floor
   of one in eight under the share, a table error of a few thousandths does not matter,
   whatever the size of the corpus.
3. Each node gets samples by improved consistent weighted sampling: two nodes draw the same
   sample with a probability of their weighted Jaccard similarity.  Runs of samples
   form bands; nodes that share a band may be alike.
4. In every bucket each node is compared with the least one; links hold if the exact weighted
   Jaccard similarity reaches the threshold.  Then all pairs left between different components of a
   bucket are compared, as exact matrix products over blocks of the bucket, so that no link is
   missed behind a poor centre.  A pair of blocks gives a tree over the linked nodes, not its links.
5. Classes are connected components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.components import components, least_labels
from dossier.llm.stages import staged
from dossier.llm.words import KEEP, Interner, numbered_words, slices

WINDOW = 5
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
TABLE_BITS = 18  # shingle shares
BLOCK_BITS = 14
DRAW_BITS = 16  # random draws, by shingle hash
SHARE_FLOOR = 1 / 8
ODD = np.uint64(0x9E3779B97F4A7C15)
NOT_WORD = re.compile(r"[\W_]+")


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


class Shingler:
    """Hashes of five-word shingles of whole texts.  Words are compared in lower case and
    without punctuation; a text of fewer words is one shingle."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.words, self.hashes = Interner(), np.zeros(0, np.uint64)

    def shingles(self, part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of each text in ascending order, their number in the text, and
        where each text starts, with the end at last."""
        if len(self.words) > KEEP // 2:
            self._forget()
        numbers, starts = numbered_words(part, self.words)
        new = [xxhash.xxh64_intdigest(NOT_WORD.sub("", w.lower()) or w) for w in self.words.take_new()]
        self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64)])
        words = self.hashes[numbers]
        rolled = np.zeros(max(len(words) - WINDOW + 1, 0), np.uint64)
        for step in range(WINDOW):
            rolled = rolled * ODD + words[step : len(words) - WINDOW + 1 + step]
        rolled = mixed(rolled)
        out, counts = [], []
        for start, end in zip(starts.tolist(), starts[1:].tolist()):
            if end - start >= WINDOW:
                own = np.sort(rolled[start : end - WINDOW + 1])
            elif end > start:
                value = np.zeros(1, np.uint64)
                for word in words[start:end]:
                    value = value * ODD + word
                own = mixed(value)
            else:
                own = np.zeros(0, np.uint64)
            out.append(own)
            counts.append(len(own))
        flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
        ends = np.cumsum([0, *counts])
        first = np.ones(len(flat), bool)
        first[1:] = flat[1:] != flat[:-1]
        first[ends[:-1][np.array(counts, bool)]] = True
        at = np.flatnonzero(first)
        times = np.diff(np.append(at, len(flat)))
        return flat[at], times, np.searchsorted(at, ends)


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text_key, doc_id, text): one row per distinct text that has a word."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    worded = narrow.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    grouped = worded.groupBy(text_key(F.col("text")).alias("text_key")).agg(
        F.min("doc_id").alias("doc_id"), F.first("text").alias("text")
    )
    return staged(grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "near-texts")


def text_key(text):
    return F.unhex(F.md5(text))


def _summed(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of equal-sized count arrays by block, streamed through each task."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(raw, np.int64)
                totals[block] = totals[block] + counts if block in totals else counts
        yield pa.record_batch(
            [pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())],
            names=["block", "counts"],
        )

    spread = blocks.repartition(1 << (TABLE_BITS - BLOCK_BITS), *keys)
    return spread.select("block", "counts").mapInArrow(run, "block int, counts binary")


def shingle_weights(texts: DataFrame) -> np.ndarray:
    """Weight of each slot of the shingle table, from all texts.  The driver holds the
    table, 2**TABLE_BITS numbers whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, total, n = Shingler(), np.zeros(1 << TABLE_BITS, np.int64), 0
        for batch in batches:
            for part in slices(batch.column(0).to_pylist()):
                found, _, _ = tool.shingles(part)
                total += np.bincount((found >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(total))
                n += len(part)
        blocks = total.reshape(-1, 1 << BLOCK_BITS)
        counts = [*(b.tobytes() for b in blocks), np.full(1 << BLOCK_BITS, n).tobytes()]
        yield pa.record_batch(
            [pa.array(range(len(counts)), pa.int32()), pa.array(counts, pa.binary())], names=["block", "counts"]
        )

    blocks = texts.select("text").mapInArrow(run, "block int, counts binary").withColumn("task", F.spark_partition_id() % 256)
    rows = sorted(_summed(_summed(blocks, ["block", "task"]), ["block"]).collect(), key=lambda row: row["block"])
    if not rows:
        return np.ones(1 << TABLE_BITS)
    table = np.concatenate([np.frombuffer(row["counts"], np.int64) for row in rows[:-1]])
    nodes = max(1, int(np.frombuffer(rows[-1]["counts"], np.int64)[0]))
    # What a slot holds beyond the average load is taken as its shingle's own count.
    share = np.maximum(table - table.mean(), 0) / nodes
    return np.log1p(1 / (share + SHARE_FLOOR))


class Sampler:
    """Improved consistent weighted sampling: r and c are Gamma(2, 1), beta is uniform,
    each a function of sample number and shingle hash."""

    def __init__(self) -> None:
        draw = np.random.default_rng(20240607)
        size = (SAMPLES, 1 << DRAW_BITS)
        self.r = draw.gamma(2, 1, size).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.beta = draw.random(size, np.float32)
        # ln c - r, as both enter the rank only together
        self.base = (np.log(draw.gamma(2, 1, size)) - self.r).astype(np.float32)
        self.odd = draw.integers(1 << 62, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of SAMPLES hashes for each text; every text has a shingle."""
        lengths = np.diff(starts)
        log_weight = np.log(weights).astype(np.float32)
        out = np.empty((len(lengths), SAMPLES), np.uint64)
        for k in range(SAMPLES):
            slot = ((shingles * self.odd[k]) >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
            beta, r = self.beta[k][slot], self.r[k][slot]
            level = np.floor(log_weight * self.inverse[k][slot] + beta)
            rank = self.base[k][slot] - r * (level - beta)
            least = np.minimum.reduceat(rank, starts[:-1])
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            # Of equal ranks the least shingle hash counts; shingles are in that order.
            chosen = at[np.searchsorted(at, starts[:-1])]
            out[:, k] = mixed(shingles[chosen] + ODD * level[chosen].astype(np.int64).view(np.uint64)) + np.uint64(k)
        return out


def signatures(texts: DataFrame, weights) -> DataFrame:
    """(node, chars, sketch, bands) of every text; ``weights`` is a broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, sampler, table = Shingler(), Sampler(), weights.value
        for batch in batches:
            at = 0
            for part in slices(batch.column(1).to_pylist(), 2_000_000):
                found, times, starts = tool.shingles(part)
                weight = times * table[(found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                samples = sampler.sample(found, weight, starts)
                banded = np.full((len(part), BANDS), ODD, np.uint64)
                for row in range(ROWS):
                    banded = mixed(banded * ODD + samples[:, row::ROWS])
                banded += np.arange(BANDS, dtype=np.uint64)
                sketch = (samples >> np.uint64(32)).astype(np.uint32)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, len(part)),
                        pa.array([len(text) for text in part], pa.int64()),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                        pa.FixedSizeListArray.from_arrays(pa.array(banded.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())),
                    ],
                    names=["node", "chars", "sketch", "bands"],
                )
                at += len(part)

    schema = "node long, chars long, sketch binary, bands array<long>"
    return texts.select("node", "text").mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Pairs (a, b) whose exact weighted Jaccard similarity reaches the threshold."""
    own = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, table = Shingler(), weights.value
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found, times, starts = tool.shingles([one, two])
                weight = times * table[(found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                cut = starts[1]
                _, here, there = np.intersect1d(found[:cut], found[cut:], assume_unique=True, return_indices=True)
                x, y = weight[:cut][here], weight[cut:][there]
                shared = np.minimum(x, y).sum()
                keep.append(shared >= threshold * (weight.sum() - shared) * (1 - 1e-12))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    # Always by a shuffle of both sides, as it has to be in a large corpus.
    both = pairs.hint("merge").join(own, "a").hint("merge").join(other, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def similar_pairs(found: np.ndarray, times: np.ndarray, starts: np.ndarray, table: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean table of the texts of a block whose weighted Jaccard similarity reaches the threshold.

    A shared shingle adds its weight times the smaller count, that is, its weight once for every
    level that both counts reach: a product of 0/1 matrices per level."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    weight = table[(found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    total = np.bincount(owner, weight * times, n)
    shared = np.zeros((n, n))
    reached = 0
    while len(found):
        # Shingles of one text add nothing to a pair.
        _, column, count = np.unique(found, return_inverse=True, return_counts=True)
        kept = count[column] > 1
        found, times, owner, weight = found[kept], times[kept], owner[kept], weight[kept]
        if not len(found):
            break
        level = int(times.min())
        _, column = np.unique(found, return_inverse=True)
        for first in range(0, int(column.max()) + 1, 2048):
            part = (column >= first) & (column < first + 2048)
            matrix = np.zeros((n, min(2048, int(column.max()) + 1 - first)))
            matrix[owner[part], column[part] - first] = np.sqrt(weight[part] * (level - reached))
            shared += matrix @ matrix.T
        reached = level
        above = times > level
        found, times, owner, weight = found[above], times[above], owner[above], weight[above]
    return shared >= threshold * (total[:, None] + total[None, :] - shared) * (1 - 1e-12)


def block_links(members: DataFrame, weights, threshold: float, block: int = 512, chars: int = 16_000_000) -> DataFrame:
    """(a, b): trees over the linked nodes of different components in each bucket.

    ``members`` has bucket, node, component, text, size and chars (of the whole bucket).  A bucket is
    cut by node hash into blocks of about ``block`` nodes and ``chars`` characters, and each pair of
    blocks is a group of its own."""
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("chars") / chars)).cast("int")
    placed = members.withColumn("n_blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n_blocks").cast("long")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "component", "text"
    )

    def run(rows: pa.Table) -> pa.Table:
        mine, node, component = (rows.column(c).to_numpy() for c in ("mine", "node", "component"))
        found, times, starts = Shingler().shingles(rows.column("text").to_pylist())
        linked = np.triu(similar_pairs(found, times, starts, weights.value, threshold), 1)
        linked &= component[:, None] != component[None, :]
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        if i != j:
            linked &= mine[:, None] != mine[None, :]
        x, y = np.nonzero(linked)
        root = least_labels(len(node), x, y)
        own = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": pa.array(node[own], pa.int64()), "b": pa.array(node[root[own]], pa.int64())})

    return spread.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def node_classes(texts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(node, component) of all nodes that have a near duplicate."""
    spark = texts.sparkSession
    weights = spark.sparkContext.broadcast(shingle_weights(texts))
    signed = staged(signatures(texts, weights), "near-signatures")
    members = signed.select("node", "chars", F.explode("bands").alias("bucket"))
    measures = (F.min("node").alias("centre"), F.count("*").alias("size"), F.sum("chars").alias("chars"))
    centres = staged(members.groupBy("bucket").agg(*measures).where("size > 1"), "near-buckets")
    shared = staged(members.drop("chars").join(centres, "bucket"), "near-members")
    # Texts that share a bucket with another are set apart once; only those are compared.
    meeting = shared.select("node").distinct().hint("merge")
    met = staged(texts.select("node", "text").join(meeting, "node", "left_semi"), "near-met")
    # A pair of a similarity at the threshold agrees in fewer samples once in some thousand times.
    least = int(SAMPLES * threshold - 4 * (SAMPLES * threshold * (1 - threshold)) ** 0.5)
    star = shared.where(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda c: signed.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"))

    def agree(batches):
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            keep = [bool((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum() >= least) for x, y in rows]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    sketched = star.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b")
    likely = staged(sketched.mapInArrow(agree, "a long, b long"), "near-likely")
    links = staged(verified(likely, met, weights, threshold), "near-links")
    first = staged(components(links), "near-components")

    # Pairs across components that the stars did not settle.
    placed = shared.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = staged(placed.select("bucket", "node", "component", "size", "chars"), "near-placed")
    mixed_buckets = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_members = staged(placed.join(staged(mixed_buckets.select("bucket"), "near-open"), "bucket"), "near-open-members")
    rest = block_links(open_members.join(met, "node"), weights, threshold)
    more = staged(rest, "near-more")
    if more.isEmpty():
        return first
    return components(links.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``doc_id`` and ``class_id`` of every row: the least doc_id among all rows linked to it.

    Equal texts are always of one class.  A null text, and one without words, is a class of
    its own row.  Null ids are allowed: a class takes the least id that is not null, if it
    has any.  Repeated rows come out as often as they went in.
    """
    texts = distinct_texts(docs, id_col, text_col)
    classes = staged(text_classes(texts, node_classes(texts, threshold)), "near-classes")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col).cast("string")).alias("text_key"))
    joined = keyed.join(classes, "text_key", "left")
    return joined.select("doc_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def text_classes(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(text_key, component, class_id) of every distinct text."""
    narrow = texts.select("node", "text_key", "doc_id")
    placed = staged(
        narrow.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-texts-placed"
    )
    least = staged(placed.groupBy("component").agg(F.min("doc_id").alias("class_id")), "near-class-ids")
    return placed.join(least, "component").select("text_key", "component", "class_id")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` less all but one of each class: the one of the least doc_id, then of
    the least text key.  Rows without words all stay."""
    columns = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    id_, text = columns[docs.columns.index(id_col)], columns[docs.columns.index(text_col)]
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    row = F.struct(*columns)
    firsts = (
        plain.where(worded)
        .groupBy(text_key(F.col(text)).alias("text_key"))
        .agg(F.min_by(row, F.coalesce(F.col(id_), F.lit((1 << 63) - 1))).alias("row"))
        .select(F.monotonically_increasing_id().alias("node"), "text_key", "row")
    )
    firsts = staged(firsts, "near-rows")
    texts = firsts.select("node", "text_key", F.col(f"row.{id_}").cast("long").alias("doc_id"), F.col(f"row.{text}").alias("text"))
    found = node_classes(texts, threshold)
    narrow = found.join(texts.select("node", "text_key", "doc_id"), "node")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    kept = narrow.groupBy("component").agg(F.min_by("node", order).alias("node"))
    gone = staged(found.select("node").join(kept.select("node"), "node", "left_anti"), "near-gone")
    left = firsts.join(gone, "node", "left_anti").select("row.*")
    return left.unionByName(plain.where(~worded)).toDF(*docs.columns)
