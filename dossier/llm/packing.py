"""Best-fit packing of token sequences into bins of several permitted lengths.

Pieces go, longest first, into the open bin that they fill best.  If none fits, a bin is opened of the length that
costs least per token that it can expect to hold: what the pieces still to come, by their lengths, would fill of each
permitted length.  At the end each bin shrinks to the least permitted length that holds its contents.  A shard is also
packed with each length alone (and longer ones only for pieces that need them), and the cheapest packing counts: bins
cost their lengths and a fixed part each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.stages import staged
from dossier.llm.tokens import byte_codec

SIZES = (512, 1024, 2048, 4096, 8192)
BIN_COST = 32  # of any bin, in tokens, beside its length


class Packer:
    """Bins of one shard.  ``lengths`` are those of all pieces still to come; with ``single`` only that length is
    opened, or the least that holds a longer piece."""

    def __init__(self, sizes: tuple[int, ...], bin_cost: int, lengths: Iterable[int] = (), single: int | None = None) -> None:
        self.sizes = sorted(sizes)
        self.bin_cost = bin_cost
        self.single = single
        self.coming = Counter(lengths)
        self.lengths = sum(1 << n for n in self.coming)  # bit n is set if a piece of length n is to come
        self.bins: list[list] = []  # [used, contents]
        self.open: list[list[int]] = [[] for _ in range(self.sizes[-1] + 1)]  # bins by free space
        self.mask = 0  # bit n is set if a bin has n free

    def fill(self, space: int) -> int:
        """How much of ``space`` the pieces to come fill, the longest that fit first."""
        filled, lengths = 0, self.lengths
        while lengths := lengths & ((1 << (space - filled + 1)) - 1):
            n = lengths.bit_length() - 1
            filled += n * min(self.coming[n], (space - filled) // n)
            lengths ^= 1 << n
        return filled

    def cost(self, used: int) -> int:
        """Of a bin that has shrunk to its contents."""
        return next(s for s in self.sizes if s >= used) + self.bin_cost

    def least_cost(self, size: int) -> int:
        """The permitted length, at least ``size``, that costs least per token it can expect to hold."""
        fitting = [s for s in self.sizes if s >= max(size, self.single or 0)]
        if self.single:
            return fitting[0]
        held = {s: size + self.fill(s - size) for s in fitting}
        return min(fitting, key=lambda s: (self.cost(held[s]) / held[s], s))

    def total(self) -> int:
        return sum(self.cost(used) for used, _ in self.bins)

    def add(self, size: int, item: tuple) -> None:
        if size in self.coming:
            self.coming[size] -= 1
            if not self.coming[size]:
                del self.coming[size]
                self.lengths ^= 1 << size
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self.open[free].pop()
            if not self.open[free]:
                self.mask ^= 1 << free
        else:
            free = self.least_cost(size)
            number = len(self.bins)
            self.bins.append([0, []])
        target = self.bins[number]
        target[1].append((target[0], size, item))
        target[0] += size
        left = free - size
        if left:
            if not self.open[left]:
                self.mask |= 1 << left
            self.open[left].append(number)

    def packed(self) -> Iterator[tuple[int, int, int, list]]:
        """(number, length, used, contents) of each bin, shrunk to its contents."""
        for number, (used, contents) in enumerate(self.bins):
            yield number, next(s for s in self.sizes if s >= used), used, contents


def packed_shard(items: list[tuple], sizes: tuple[int, ...], bin_cost: int) -> Packer:
    """The cheapest packing of (length, doc_id, start) pieces, in falling length: jointly chosen lengths, or one alone."""
    best = None
    for single in (None, *sizes):
        packer = Packer(sizes, bin_cost, (item[0] for item in items) if single is None else (), single)
        for size, doc, start in items:
            packer.add(size, (doc, start))
        if best is None or packer.total() < best.total():
            best = packer
    return best


def token_lengths(docs: DataFrame, path: str, id_col: str, text_col: str, end_tokens: int) -> DataFrame:
    """(doc_id, n_tokens) of every row, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(path)
        for batch in batches:
            counts = codec.counts([text or "" for text in batch.column(1).to_pylist()])
            yield pa.record_batch(
                [batch.column(0), pa.array([n + end_tokens for n in counts], pa.int64())], names=["doc_id", "n_tokens"]
            )
        codec.trim()
        pa.default_memory_pool().release_unused()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long")


def best_fit(
    docs: DataFrame,
    tokenizer_path: str,
    sizes: tuple[int, ...] = SIZES,
    bin_cost: int = BIN_COST,
    shard_rows: int = 50_000,
    end_tokens: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``bin_id, capacity, used, position, doc_id, start, n_tokens``.

    A piece is ``n_tokens`` ids of a document from ``start`` on; a document longer than the largest
    size is cut, all others are whole.  Every token of every row is in just one bin.
    A null text counts as empty and takes its end token only; null and repeated ids are packed like any others.
    Rows are dealt to shards of about ``shard_rows`` each, whatever their keys, and each shard is packed
    by itself in descending length.  An empty table gives no rows; extra columns are not read.
    """
    lengths = staged(token_lengths(docs, tokenizer_path, id_col, text_col, end_tokens), "token-lengths")
    shards = max(1, -(-lengths.count() // shard_rows))
    dealt = lengths.where("n_tokens > 0").repartition(shards).sortWithinPartitions(F.desc("n_tokens"), "doc_id")
    largest = max(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, full = [], []
        for batch in batches:
            for doc, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = n // largest * largest
                full += [(doc, start) for start in range(0, whole, largest)]
                if n > whole:
                    items.append((n - whole, doc, whole))
        items.sort(key=lambda item: -item[0])
        packer = packed_shard(items, sizes, bin_cost)
        base = TaskContext.get().partitionId() << 33

        def rows() -> Iterator[tuple]:
            for number, capacity, used, contents in packer.packed():
                for position, size, (doc, start) in contents:
                    yield base + number, capacity, used, position, doc, start, size
            for extra, (doc, start) in enumerate(full, len(packer.bins)):
                yield base + extra, largest, largest, 0, doc, start, largest

        names = ["bin_id", "capacity", "used", "position", "doc_id", "start", "n_tokens"]
        part: list[tuple] = []
        for row in rows():
            part.append(row)
            if len(part) == 20_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*part)], names=names)
                part = []
        if part:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*part)], names=names)

    schema = "bin_id long, capacity long, used long, position long, doc_id long, start long, n_tokens long"
    return dealt.mapInArrow(run, schema)
