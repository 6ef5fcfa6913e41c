"""WARC archives: pages written as segmented, chunked records, and read back whole.

Bytes of a record longer than a segment go on in continuation records that name the first one's
identifier; reading groups them by it, orders them by segment number and checks their
total length.  Bodies are framed by HTTP chunked transfer coding.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.stages import staged

SEGMENT = 64 * 1024
CHUNK = 16 * 1024
RECORDS_PER_FILE = 4096
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # the table has no capture times


def chunked(payload: bytes) -> bytes:
    parts = [payload[at : at + CHUNK] for at in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";", 1)[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it should")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records_of(identifier: str, fields: dict[str, str], block: bytes, segment: int = SEGMENT) -> Iterator[bytes]:
    """One record, or a first segment and its continuations."""
    own = {"WARC-Record-ID": f"<{identifier}>", "WARC-Date": DATE, **fields}
    if len(block) <= segment:
        yield _record(own, block)
        return
    count = -(-len(block) // segment)
    yield _record({**own, "WARC-Segment-Number": "1"}, block[:segment])
    for number in range(2, count + 1):
        more = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{identifier}/{number}')}>",
            "WARC-Date": DATE,
            "WARC-Segment-Origin-ID": f"<{identifier}>",
            "WARC-Segment-Number": str(number),
        }
        if number == count:
            more["WARC-Segment-Total-Length"] = str(len(block))
        yield _record(more, block[segment * (number - 1) : segment * number])


def write_archive(
    pages: DataFrame, out: str, least_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> None:
    """One response or revisit per row under ``out``.

    Of equal payloads of at least ``least_payload`` bytes the one of the largest page_id is the response,
    and the others revisit it; a row that repeats that page_id is a response too.  Where all ids of a group are null, all
    are responses.  Null html is an empty payload; null URLs and ids are left out of the record's fields.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    owners = staged(
        base.where(F.octet_length("payload") >= least_payload)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha1", "owner"),
        "warc-owners",
    )
    rows = base.join(owners, "sha1", "left").select("page_id", "url", "payload", "sha1", "owner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, part, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page, url, payload, sha1, owner in zip(*(c.to_pylist() for c in batch.columns)):
                row += 1
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                revisit = owner is not None and page != owner
                fields = {"WARC-Type": "revisit" if revisit else "response"}
                if url is not None and url.isprintable():
                    fields["WARC-Target-URI"] = url
                if page is not None:
                    fields["X-Page-ID"] = str(page)
                fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
                if revisit:
                    fields |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": str(owner)}
                identifier = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{sha1}/{task}/{row}')}"
                block = REVISIT_HEAD if revisit else HTTP_HEAD + chunked(payload)
                for record in records_of(identifier, fields, block):
                    part.append(record[:-1])  # the writer adds the last line feed
                    held += len(record)
                if held > 4_000_000:
                    yield pa.record_batch([pa.array(part, pa.binary())], names=["value"])
                    part, held = [], 0
        if part:
            yield pa.record_batch([pa.array(part, pa.binary())], names=["value"])

    written = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    # The text writer puts out the bytes as they are, and compresses each file.
    files = written.write.mode("overwrite").option("maxRecordsPerFile", RECORDS_PER_FILE)
    files.option("compression", "gzip").text(out)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of one file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        at += 4


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``record_type, page_id, url, refers_to, digest, block`` of every record, segments put together.
    Files may be compressed as a whole or not.

    A group of segments with a gap, without its first or last one, or of another length than it states
    raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                part, held = [], 0
                for fields, block in parsed(gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data):
                    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    part.append(
                        {
                            "record_type": fields["warc-type"],
                            "origin": fields.get("warc-segment-origin-id", fields["warc-record-id"]),
                            "number": int(number) if number else None,
                            "total": int(total) if total else None,
                            "page_id": int(page) if page else None,
                            "url": fields.get("warc-target-uri"),
                            "refers_to": int(refers) if refers else None,
                            "digest": fields.get("warc-payload-digest"),
                            "block": block,
                        }
                    )
                    held += len(block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(part, schema=layout)
                        part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_pylist(part, schema=layout)

    kinds = {"number": pa.int64(), "total": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "block": pa.binary()}
    names = ["record_type", "origin", "number", "total", "page_id", "url", "refers_to", "digest", "block"]
    layout = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    schema = ", ".join(f"{n} {'binary' if n == 'block' else 'long' if n in kinds else 'string'}" for n in names)
    files = spark.read.format("binaryFile").load(path).select("content")
    records = staged(files.mapInArrow(run, schema), "warc-records")
    whole = records.where(F.col("number").isNull())
    ordered = F.array_sort(F.collect_list(F.struct("number", "block", "total")))
    first = lambda c: F.min_by(c, "number").alias(c)
    grouped = records.where(F.col("number").isNotNull()).groupBy("origin").agg(
        *(first(c) for c in ("record_type", "page_id", "url", "refers_to", "digest")), ordered.alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda out, part: F.concat(out, part["block"]))
    numbers = F.transform("parts", lambda part: part["number"])
    right = (
        (numbers == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long")))
        & (F.element_at("parts", -1)["total"] == F.octet_length("block"))
    )
    kept = ["record_type", "page_id", "url", "refers_to", "digest", "block"]
    rebuilt = grouped.withColumn("block", joined).withColumn(
        "block", F.when(F.coalesce(right, F.lit(False)), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" do not fit"))))
    )
    return whole.select(*kept).unionByName(rebuilt.select(*kept))


def payloads(records: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, digest, payload``: bodies decoded and checked
    against their digest; a revisit has no payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, digest, block in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5))):
                if kind == "revisit":
                    out.append(None)
                    continue
                head, _, body = block.partition(b"\r\n\r\n")
                payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if digest != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
                    raise ValueError("a payload does not match its digest")
                out.append(payload)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=names)

    names = ["page_id", "url", "record_type", "refers_to", "digest", "payload"]
    schema = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"
    return records.select(*names[:5], "block").mapInArrow(run, schema)


def captures(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record; a
    revisit takes its length from the response that it refers to."""
    found = payloads(records).select(
        "page_id",
        "record_type",
        "refers_to",
        F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    found = staged(found, "warc-captures")
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes")
    used = staged(revisits.select(F.col("refers_to").alias("owner"), "payload_digest").distinct(), "warc-referred")
    responses = found.where("record_type = 'response'")
    sizes = staged(
        responses.select(F.col("page_id").alias("owner"), "payload_digest", "payload_bytes")
        .join(used, ["owner", "payload_digest"], "left_semi")
        .distinct(),
        "warc-sizes",
    )
    solved = revisits.withColumnRenamed("refers_to", "owner").join(sizes, ["owner", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(solved.withColumnRenamed("owner", "refers_to").select(*columns))
