"""Token ids in files, by canonical length-limited Huffman codes.

A file is a sequence of frames, one per document, each independent of the others:

    TOK1 | bucket u32 | known u8 | doc_id i64 | start i64 | ids u64 | checkpoints u32 |
    payload bytes u32 | gaps u16 each | payload | line feed

``start`` counts ids from the start of the bucket, ``gaps`` are the bits between checkpoints
every 128 ids.  Frames are in ascending doc_id order within a bucket, buckets in ascending
order of their number.  The code lengths are a Parquet table beside the files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.huffman import STRIDE, Coder, code_lengths
from dossier.llm.stages import staged
from dossier.llm.tokens import byte_codec

HEAD = "<4sIBqqQII"
MAGIC = b"TOK1"


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_tokens, ids as little-endian 32-bit numbers, or 16-bit where they fit, and null; behind
    them each task adds one row of nulls with ``counts``, how often it saw each id from 0 on, as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(path)
        size = max(codec.vocab_size, end_id + 1)
        width = np.uint16 if size <= 1 << 16 else np.uint32
        names = ["doc_id", "n_tokens", "ids", "counts"]
        total = np.zeros(size, np.int64)
        for batch in batches:
            lengths, rows, held = [], [], 0
            waiting: list = []
            for ids in codec.encode([text or "" for text in batch.column(1).to_pylist()]):
                lengths.append(len(ids) + 1)
                waiting.append(ids)
                held += len(ids)
                rows.append(np.append(ids, end_id).astype(width).tobytes())
                if held > 1_000_000:
                    total += np.bincount(np.concatenate(waiting), minlength=size)
                    waiting, held = [], 0
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=size)
            total[end_id] += len(rows)
            none = pa.nulls(len(rows), pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(lengths, pa.int64()), pa.array(rows, pa.binary()), none], names=names)
        codec.trim()
        last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())]
        yield pa.record_batch(last, names=names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts binary")


def unpacked(raw: bytes, n_tokens: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n_tokens else "<u4").astype(np.int64)


def token_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over the whole corpus, from the counts that the tokenising tasks left."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                seen = np.frombuffer(raw, np.int64)
                total = seen + total if len(total) else seen
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    left = tokens.where(F.col("counts").isNotNull()).select("counts")
    return left.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    out: str,
    end_id: int = 2,
    max_bits: int = 18,
    ids_per_file: int = 16_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write ``out``/ids and ``out``/codes.

    Null text counts as empty: its only id is the end id.  Null ids come first; repeated
    ids keep all their rows, in an order given by their contents.  A doc_id that fills several
    buckets is spread over them.  The driver holds one count per vocabulary entry and one
    boundary per bucket.  A very long text is one frame; an empty table gives no frames and no codes; extra columns are not read.
    """
    spark = docs.sparkSession
    tokens = staged(tokenized(docs, tokenizer_path, end_id, id_col, text_col), "token-ids")
    counted = token_counts(tokens).collect()  # at most one row per vocabulary entry
    ids = tokens.where(F.col("n_tokens").isNotNull()).select("doc_id", "n_tokens", "ids")
    size = max([end_id, *(row["id"] for row in counted)]) + 1
    counts = np.zeros(size, np.int64)
    for row in counted:
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, max_bits)
    codes = spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int")
    codes.coalesce(1).write.mode("overwrite").parquet(f"{out}/codes")

    buckets = max(1, -(-int(counts.sum()) // ids_per_file))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * buckets))).head()[0] if shares else []
    cuts = np.array(cuts or [], np.int64)
    coder = Coder(lengths)

    def encode(batches):
        for batch in batches:
            known, rows = batch.column(0), batch.column(2).to_pylist()
            doc = known.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            tie = np.array([zlib.crc32(raw) for raw in rows], np.int64)
            low, high = np.searchsorted(cuts, doc, "left"), np.searchsorted(cuts, doc, "right")
            bucket = low + tie % (high - low + 1)
            frames = []
            for raw, n in zip(rows, batch.column(1).to_pylist()):
                checkpoints, payload = coder.encode(unpacked(raw, n))
                frames.append(np.diff(checkpoints).astype("<u2").tobytes() + payload)
            yield pa.record_batch(
                [known, pa.array(bucket, pa.int32()), pa.array(tie, pa.int64()), batch.column(1), pa.array(frames, pa.binary())],
                names=["doc_id", "bucket", "tie", "n_tokens", "body"],
            )

    def frame(batches):
        bucket, start = None, 0
        for batch in batches:
            out = []
            for doc, here, n, body in zip(*(column.to_pylist() for column in batch.columns)):
                if here != bucket:
                    bucket, start = here, 0
                points = -(-n // STRIDE)
                head = struct.pack(HEAD, MAGIC, here, doc is not None, doc or 0, start, n, points, len(body) - 2 * max(points - 1, 0))
                out.append(head + body)
                start += n
            yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    encoded = ids.mapInArrow(encode, "doc_id long, bucket int, tie long, n_tokens long, body binary")
    ordered = encoded.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "doc_id", "n_tokens", "tie")
    framed = ordered.select("doc_id", "bucket", "n_tokens", "body").mapInArrow(frame, "value binary")
    # The text writer puts out the bytes as they are, and a line feed after each frame.
    framed.select(F.col("value").cast("string")).write.mode("overwrite").option("maxRecordsPerFile", 200_000).text(f"{out}/ids")


def read_token_files(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` of every document.

    ``start`` counts the ids of all documents before it in doc_id order."""
    codes = spark.read.parquet(f"{out}/codes").collect()  # at most one row per vocabulary entry
    lengths = np.zeros(max([0, *(row["id"] for row in codes)]) + 1, np.int64)
    for row in codes:
        lengths[row["id"]] = row["bits"]
    coder = Coder(lengths)

    def frames(data: bytes) -> Iterator[tuple]:
        at = 0
        while at < len(data):
            magic, bucket, known, doc, start, n, points, size = struct.unpack_from(HEAD, data, at)
            if magic != MAGIC:
                raise ValueError("not a frame of token ids")
            at += struct.calcsize(HEAD)
            gaps = np.frombuffer(data, "<u2", max(points - 1, 0), at).astype(np.int64)
            at += 2 * len(gaps)
            yield bucket, doc if known else None, start, n, np.concatenate([[0], np.cumsum(gaps)]), data[at : at + size]
            at += size
            if data[at : at + 1] != b"\n":
                raise ValueError("frame without its end")
            at += 1

    def groups(data: bytes, ids: int = 2_000_000) -> Iterator[list]:
        part, held = [], 0
        for row in frames(data):
            part.append(row)
            held += row[3]
            if held >= ids:
                yield part
                part, held = [], 0
        if part:
            yield part

    def decode(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for part in groups(data):
                    base = np.cumsum([0, *(8 * len(row[5]) for row in part)])
                    starts = np.concatenate([row[4] + b for row, b in zip(part, base)])
                    counts = np.concatenate(
                        [np.minimum(STRIDE, row[3] - STRIDE * np.arange(len(row[4]))) for row in part]
                    )
                    ids = coder.decode(starts, counts, b"".join(row[5] for row in part)).astype("<u4")
                    cuts = np.cumsum([row[3] for row in part])[:-1]
                    each = np.split(ids, cuts)
                    columns = [
                        pa.array([row[0] for row in part], pa.int32()),
                        pa.array([row[1] for row in part], pa.int64()),
                        pa.array([row[2] for row in part], pa.int64()),
                        pa.array([row[3] for row in part], pa.int64()),
                        pa.array([zlib.crc32(i.tobytes()) for i in each], pa.int64()),
                    ]
                    names = ["bucket", "doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([i.astype(np.int32) for i in each], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.record_batch(columns, names=names)

    schema = "bucket int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = spark.read.format("binaryFile").load(f"{out}/ids").select("content")
    found = staged(files.mapInArrow(decode, schema), "token-frames")
    totals = found.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()  # one row per bucket
    ends = np.cumsum([row["n"] for row in sorted(totals, key=lambda row: row["bucket"])]).tolist()
    before = dict(zip(sorted(row["bucket"] for row in totals), [0, *ends]))
    bases = spark.createDataFrame(sorted(before.items()), "bucket int, base long")
    return found.join(bases, "bucket").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), *found.columns[3:]
    )
