"""Operator 2: exact deduplication through content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so, so equal
stretches give equal chunks.  A chunk is named by a 128-bit BLAKE2 digest and
checked by an independent 128-bit hash and its length; one row per distinct
chunk verifies that a name stands for one content.  Texts are then compared by
their recipes, the ordered lists of chunk names; only digests are shuffled and
no text moves.  Recipes holding a name that stands for several contents (none
is expected) are compared with the checks included.  Finally the SHA-256 of the
texts of a group must agree, else the job fails.

Edge cases: null and empty texts are equal; repeated rows, also of one doc_id,
belong to one group and every row of the doc_id that stays is kept; null ids
never stay unless a group has no other; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.store import written
from foliant.llm.tokens import sliced

WINDOW = 32
MIN_CHUNK, MAX_CHUNK, MEAN_BITS = 1024, 16384, 12


def _gear() -> np.ndarray:
    """256 fixed 32-bit values, from a generator with a fixed seed."""
    return np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def boundaries(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the rolling hash of the last WINDOW bytes has MEAN_BITS leading zeros."""
    h = gear[data]
    span = 1
    while span < WINDOW:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint32(span)
        h = h + shifted
        span *= 2
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def _cuts(size: int, allowed: list[int]) -> list[int]:
    """Ends of the chunks of a text of ``size`` bytes."""
    ends, last, k = [], 0, 0
    while size - last > MIN_CHUNK:
        while k < len(allowed) and allowed[k] < last + MIN_CHUNK:
            k += 1
        last = min(allowed[k] if k < len(allowed) else size, last + MAX_CHUNK, size)
        ends.append(last)
    if last < size or not ends:
        ends.append(size)
    return ends


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, names (digests of the chunks in order) and checks of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = _gear()
        for batch in batches:
            sha, names, checks = [], [], []
            for piece in sliced(batch.column("text").cast(pa.large_string()).fill_null("")):
                offsets = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
                data = np.frombuffer(piece.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                bounds = offsets - offsets[0]
                allowed = boundaries(data, gear) if len(data) else np.zeros(0, np.int64)
                spans = np.searchsorted(allowed, bounds, "right")
                view = memoryview(data)
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    text, last, own, seen = view[a:b], 0, [], []
                    for end in _cuts(b - a, (allowed[spans[k] : spans[k + 1]] - a).tolist()):
                        chunk = text[last:end]
                        own.append(hashlib.blake2b(chunk, digest_size=16).digest())
                        seen.append(xxhash.xxh3_128_digest(chunk) + (end - last).to_bytes(4, "big"))
                        last = end
                    sha.append(hashlib.sha256(text).hexdigest())
                    names.append(own)
                    checks.append(seen)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sha), pa.array(names, pa.list_(pa.binary())), pa.array(checks, pa.list_(pa.binary()))], names=["doc_id", "text_sha256", "names", "checks"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_sha256 string, names array<binary>, checks array<binary>")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id, text)."""
    joined = lambda c: F.array_join(F.transform(c, F.hex), ",")
    table = written(recipes(docs).select("doc_id", "text_sha256", "names", "checks", F.sha2(F.concat(joined("names"), F.lit("|"), joined("checks")), 256).alias("recipe_checked")), "recipes")
    chunks = table.select("recipe_checked", F.explode(F.arrays_zip("names", "checks")).alias("c")).select("recipe_checked", F.hex("c.names").alias("name"), F.hex("c.checks").alias("check"))
    distinct = chunks.select("name", "check").distinct()
    unverified = written(distinct.groupBy("name").agg(F.count("*").alias("contents")).where("contents > 1").select("name"), "unverified")
    short = F.sha2(joined("names"), 256)
    if unverified.isEmpty():  # all names are verified: no chunk needs to meet them again
        named = table.select("doc_id", "text_sha256", short.alias("recipe"))
    else:
        unsure = chunks.join(unverified, "name", "left_semi").select("recipe_checked").distinct().withColumn("unsure", F.lit(True))
        named = table.join(unsure, "recipe_checked", "left").select("doc_id", "text_sha256", F.when(F.col("unsure"), F.col("recipe_checked")).otherwise(short).alias("recipe"))
    mark = F.xxhash64("text_sha256")
    groups = named.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min(mark).alias("low"), F.max(mark).alias("high")).where("group_size > 1")
    agreed = F.when(F.col("low") == F.col("high"), F.col("group_size")).otherwise(F.raise_error(F.lit("texts of one recipe differ")).cast("long"))
    # As a table of its own, so that a hot recipe's rows can be split over tasks in the join.
    several = written(groups.select("recipe", "keep_id", agreed.alias("group_size")), "groups")
    rows = named.join(several, "recipe", "left").select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
