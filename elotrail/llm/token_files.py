"""Operator 8: token-id files in patched frame-of-reference blocks (see ``pfor``).

The files are written and committed by Spark (Parquet, one row per segment, the
coded payload as one binary column), so a lost executor leaves no torn file and
any store Spark can write will do.  A row holds a run of whole documents:

    part, segment        place in the order; parts are ascending ranges of doc_id
    start                ids before the segment inside its part
    doc_ids, lengths     documents of the segment, ids of each with the end id
    payload              the coded ids, with the index of block starts
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import pfor
from .common import text_of
from .encoding import Encoder

SEGMENT_IDS = 1 << 18  # a segment is closed at the document that reaches so many ids
SCHEMA = ("part int, segment int, start long, doc_ids array<long>, lengths array<long>, "
          "payload binary")
_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                    ("payload", pa.binary())])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                      doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts (null: empty), append ``end_id`` to each, write them in
    ascending doc_id order (null first; equal ids by text) to segment files at ``path``.

    One shuffle: the texts by ranges of doc_id (and a hash of the text, so that an id
    that many rows share does not fill one range).  A task holds one segment; a
    document is never split, so memory follows the largest text.  Repeated rows are
    written as often as they come, an empty table writes no segment; other columns
    are not read."""
    last = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        made, start, size = 0, 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def close() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in ids]
            data = pfor.encode(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in
                 zip((part, made, start, names, lengths, data), _ARROW)], schema=_ARROW)

        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                names.append(name)
                ids.append(x + last)
                size += len(x) // 4 + 1
                if size >= SEGMENT_IDS:
                    yield close()
                    made, start, size, ids, names = made + 1, start + size, 0, [], []
        if names:
            yield close()

    (docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
     .withColumn("h", F.xxhash64("text"))
     .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
     .select("doc_id", "text").mapInArrow(segments, SCHEMA)
     .write.option("compression", "none").parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments at ``path`` with ``offset``: the ids of all segments before."""
    seg = spark.read.schema(SCHEMA).parquet(path)
    sums = seg.groupBy("part").agg(F.sum(F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offs = sums.select(F.col("part").alias("p"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    # one row per file of the writer, hence small enough to send to every task
    return (seg.join(F.broadcast(offs), F.col("part") == F.col("p"))
            .withColumn("offset", F.col("off") + F.col("start")).drop("p", "off"))


def document_digests(segments: DataFrame) -> DataFrame:
    """Decode each segment and return doc_id, start, n_tokens and ids_crc32 per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                raw = memoryview(pfor.decode(row["payload"]).astype("<u4").tobytes())
                n = np.array(row["lengths"], np.int64)
                ends = np.cumsum(n)
                if len(raw) != 4 * ends[-1]:
                    raise ValueError("a segment's ids and lengths differ")
                crc = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["offset"] + ends - n),
                     pa.array(n), pa.array(crc, pa.int64())], schema=schema)

    return segments.select("doc_ids", "lengths", "payload", "offset").mapInArrow(
        digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
