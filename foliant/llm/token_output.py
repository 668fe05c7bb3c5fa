"""Operator 3: token-id files with random access.

Documents are range-partitioned by ``doc_id`` and sorted, so that a file holds
a contiguous run of documents and the files follow each other in order; rows of
one ``doc_id`` are told apart by a hash of their text and their place in the
input, so that many of them spread over files too.  The text is what moves; it is encoded after the shuffle, and each task writes
segments of directly addressable codes (``codes``) as rows of a Parquet table,
which brings Spark's commit protocol and any Hadoop file system with it.
Positions in the whole corpus are a prefix sum over one number per file.

Edge cases: null text is empty text (the end id alone); rows of one doc_id
stay, in the order of a hash of their text; a null ``doc_id`` sorts first; an empty table
gives an empty set of segments; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import codes
from foliant.llm.tokens import bpe_table, loaded

SEGMENTS = "part int, segment int, start long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, codes binary"
#: Ids in a segment, unless one document has more.
SEGMENT_TOKENS = 1_000_000


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets after ``end_id`` is put behind every text."""
    bounds = offsets + np.arange(len(offsets))
    out = np.empty(bounds[-1], np.uint32)
    ends = bounds[1:] - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[ends] = end_id
    out[keep] = ids
    return out, bounds


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``path``, in ascending doc_id order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(bpe_table, tokenizer)
        part = TaskContext.get().partitionId()
        segment = start = 0
        for batch in batches:
            ids, bounds = with_end(*table.texts(batch.column("text")), end_id)
            doc_ids = batch.column("doc_id").to_pylist()
            first = 0
            while first < len(doc_ids):
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + segment_tokens, "right")) - 1)
                n = int(bounds[last] - bounds[first])
                row = [part], [segment], [start], [n], [doc_ids[first:last]], [np.diff(bounds[first : last + 1]).tolist()], [codes.encode(ids[bounds[first] : bounds[last]])]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)
                segment, start, first = segment + 1, start + n, last

    order = ("doc_id", "of_text", "place")
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("of_text"), F.monotonically_increasing_id().alias("place")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(pack, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


_NAMES = ["part", "segment", "start", "n_tokens", "doc_ids", "lengths", "codes"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def open_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``base``, the ids of all files before; one number per file passes through the driver."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = sorted(segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part int, base long")
    return segments.join(F.broadcast(bases), "part")  # as many rows as files


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = codes.Codes(row["codes"]).slice(0, row["n_tokens"]).astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                values = row["doc_ids"], bounds[:-1] + (row["base"] + row["start"]), row["lengths"], crc
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return open_token_files(spark, path).mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, path: str, start: int, stop: int) -> list[int]:
    """The ids at corpus positions ``start`` to ``stop``: only segments that overlap are fetched."""
    at = F.col("base") + F.col("start")
    rows = open_token_files(spark, path).where((at < stop) & (at + F.col("n_tokens") > start)).select(at.alias("at"), "codes").orderBy("at").toLocalIterator()
    return [int(i) for row in rows for i in codes.Codes(bytes(row["codes"])).slice(start - row["at"], stop - row["at"])]
