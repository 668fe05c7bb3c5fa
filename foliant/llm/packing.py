"""Operator 10: packing documents into sequences by exact complements.

Documents are encoded and cut into pieces where they are read.  Which pieces
share a sequence depends on lengths alone, so only the histogram of lengths
(at most ``capacity`` counts) reaches the driver.  The plan is made on counts:
for each largest length the gap it leaves is looked up among single lengths,
sums of pairs and sums of triples, and combinations that fill it exactly are
consumed as often as the counts allow; what is left is packed by best fit.  A
piece finds its place from its rank among pieces of its length: ranks are local
to the task that made the piece plus the counts of the tasks before, so no
length, however common, meets in one task.

Edge cases: null text is empty text (the end id alone, one piece); repeated
rows and null ids are packed like others; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.store import written
from foliant.llm.token_output import with_end
from foliant.llm.tokens import bpe_table, loaded, sliced

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"
_TYPES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "task": pa.int32(), "local": pa.int64()}

#: (sequences, [(length, items of that length in each sequence)])
Pattern = tuple[int, list[tuple[int, int]]]


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text); the first piece of a long document takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task = loaded(bpe_table, tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            names, at_row = batch.column("doc_id"), 0
            for texts in sliced(batch.column("text").cast(pa.large_string()).fill_null("")):
                own = names.slice(at_row, len(texts))
                at_row += len(texts)
                ids, bounds = with_end(*table.texts(texts), end_id)
                ids = ids.astype("<u4", copy=False)
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = sizes - (pieces - 1) * capacity
                start = np.where(number == 0, 0, first[owner] + (number - 1) * capacity)
                length = np.where(number == 0, first[owner], capacity)
                at = bounds[owner] + start
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=capacity + 1)
                local = np.empty(len(length), np.int64)
                local[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
                seen += counts
                values = [own.take(pa.array(owner)), number, start, length, crc, np.full(len(owner), task), local]
                yield pa.RecordBatch.from_arrays([v.cast(t) if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, _TYPES.values(), strict=True)], names=list(_TYPES))

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use every piece counted in ``histogram`` exactly once."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    patterns: list[Pattern] = []

    def use(items: list[int]) -> None:
        lengths, times = np.unique(items, return_counts=True)
        n = int((count[lengths] // times).min())
        if n:
            count[lengths] -= n * times
            patterns.append((n, [(int(x), int(k)) for x, k in zip(lengths[::-1], times[::-1], strict=True)]))

    def pairs(total: int) -> np.ndarray:
        """Larger halves, largest first, of the available pairs with this sum."""
        high = np.arange(total - 1, (total - 1) // 2, -1)
        return high[np.minimum(count[high], count[total - high]) > 0] if total > 1 else high[:0]

    if count[capacity]:
        use([capacity])
    for longest in range(capacity - 1, 0, -1):
        gap = capacity - longest
        if count[longest] and count[gap]:
            use([longest, gap])
        if count[longest]:
            for high in pairs(gap):
                use([longest, int(high), int(gap - high)])
                if not count[longest]:
                    break
        if count[longest] and gap > 2:
            present = (count[1:gap] > 0).astype(np.float64)
            sums = np.convolve(present, present) if len(present) else present  # sums[s - 2] > 0: some pair sums to s
            for third in range(gap - 2, 0, -1):
                if not count[longest]:
                    break
                if count[third] and sums[gap - third - 2] > 0.5:
                    for high in pairs(gap - third):
                        use([longest, third, int(high), int(gap - third - high)])
                        if not count[longest] or not count[third]:
                            break
    # Best fit of what is left: into each open sequence the longest piece that still fits.
    while len(left := np.flatnonzero(count)):
        items, gap, spare = [], capacity, count.copy()
        while True:
            fitting = left[: np.searchsorted(left, gap, "right")]
            fitting = fitting[spare[fitting] > 0]
            if not len(fitting):
                break
            length = int(fitting[-1])
            n = int(min(spare[length], gap // length))
            items += [length] * n
            spare[length] -= n
            gap -= n * length
        use(items)
    return patterns


def place(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Rank intervals by length: pieces of ``length`` with ranks from ``low`` go, ``each`` to a sequence, to sequences from ``sequence`` at ``offset``."""
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for n, items in patterns:
        offset = 0
        for length, each in items:
            rows.append((length, int(used[length]), sequence, offset, each))
            used[length] += n * each
            offset += length * each
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "sequence", "offset", "each"), table.T.copy(), strict=True))


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs`` (doc_id, text)."""
    pieces = written(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    counted = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = place(plan(histogram, capacity), capacity)
    key = where["length"] * (1 << 48) + where["low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            nth = rank - where["low"][row]
            each = where["each"][row]
            sequence, offset = where["sequence"][row] + nth // each, where["offset"][row] + nth % each * length
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("local"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, schema)
