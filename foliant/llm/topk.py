"""Operator 4: exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments, and each segment keeps its mean and
its deviation (root of the summed squared distances from the mean).  For a
segment of width w, <q, x> is at most w * mean(q) * mean(x) + dev(q) * dev(x),
so the sums of these are upper bounds of the score, that is lower bounds of the
distance, and finer ones are tighter.  A block of queries meets a block of
candidates; pairs whose bound is below the query's k-th best exact score so far
are dropped coarse to fine, and only survivors are scored.

That k-th best score comes first from a fixed sample of at most ``SAMPLE``
candidates, which all query blocks are compared with before they move, and then
rises with every block of candidates that a task has seen.  The bounds of the
extremes of a block come before those of its rows.

Blocks of at most ``BLOCK`` vectors are single rows, in the narrowest integers that
hold them.  They meet in a grid of twice as many cells as there are shuffle
partitions: query blocks are sent to the columns and candidate blocks to the rows
of the grid, which has the shape that moves least.  A task returns k rows for a query
(more where it has more than ``STATES`` query blocks); these are merged to one row for
each id, then cut by two windows, first within groups of ids.

Edge cases: vectors that are null, empty, or hold a null or non-finite component, and rows
without an id, take no part; only vectors of equal dimension meet; a query
doesn't meet rows of its own id; ties go to the smaller id, and repeated rows of one id
count once (the greatest score); scores are exact integers, and a job whose scores leave 64 bits fails; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK, SAMPLE, STATES = 2048, 1024, 2048, 512
LEVELS = (1, 4, 16)
#: Integers up to here, and sums of their products below it, are exact as doubles.
EXACT = float(1 << 53)
BLOCKS = "block long, dim int, kind int, ids array<bigint>, data binary"
KINDS = (np.int8, np.int16, np.int32, np.float64)


def _good(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding, as doubles, of the rows that take part."""
    x: Column = F.col("embedding")
    double = F.transform(x, lambda v: v.cast("double"))
    whole = F.forall(double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & whole)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), double.alias("embedding"))


def packed(x: np.ndarray) -> tuple[int, bytes]:
    """Kind and bytes of whole numbers, as narrow as they allow."""
    reach = np.abs(x).max(initial=0)
    kind = next((k for k, t in enumerate(KINDS[:-1]) if reach <= np.iinfo(t).max), len(KINDS) - 1)
    return kind, x.astype(KINDS[kind]).tobytes()


def unpacked(kind: int, data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, KINDS[kind]).reshape(-1, dim).astype(np.float64)


def blocks(vectors: DataFrame, scale: int, size: int) -> DataFrame:
    """Rows of at most ``size`` vectors of one dimension: block, dim, ids in ascending order and the components floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            starts, ids = np.cumsum(sizes) - sizes, batch.column("vec_id").to_numpy()
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for k in range(0, len(own), size):
                    part = own[k : k + size]
                    part = part[np.argsort(ids[part], kind="stable")]
                    kind, data = packed(flat[starts[part][:, None] + np.arange(dim)])
                    values = [[number], [dim], [kind], [ids[part].tolist()], [data]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["block", "dim", "kind", "ids", "data"])
                    number += 1

    return _good(vectors).mapInArrow(run, BLOCKS)


def statistics(x: np.ndarray) -> list[np.ndarray]:
    """For each level, rows whose inner products are upper bounds: scaled means, then deviations, of the segments."""
    out = []
    for level in LEVELS:
        edges = np.unique(np.linspace(0, x.shape[1], min(level, x.shape[1]) + 1).astype(int))
        width = np.diff(edges)
        mean = np.add.reduceat(x, edges[:-1], axis=1) / width
        spread = x - np.repeat(mean, width, axis=1)
        deviation = np.sqrt(np.add.reduceat(spread * spread, edges[:-1], axis=1))
        out.append(np.hstack([mean * np.sqrt(width), deviation]))
    return out


@dataclass
class Block:
    """Vectors of one dimension in ascending order of their ids, and their statistics."""

    ids: np.ndarray
    x: np.ndarray
    of: list[np.ndarray]

    @classmethod
    def made(cls, ids: list[int], x: np.ndarray) -> Block:
        return cls(np.array(ids, np.int64), x, statistics(x))


def _pairs(q: Block, c: Block, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries and candidates, and exact scores, of all pairs that reach ``least`` of the query; some others may be among them."""
    # Rounding errors of the bounds stay below this.
    slack = 1e-9 * (np.abs(q.of[0]).sum(axis=1) * np.abs(c.of[0]).max(initial=0) + 1)
    needed = least - slack
    low, high = c.of[0].min(axis=0), c.of[0].max(axis=0)
    rows = np.flatnonzero(np.maximum(q.of[0] * low, q.of[0] * high).sum(axis=1) >= needed)
    mask = np.ones((len(rows), len(c.ids)), bool)
    pairs = None
    for of_q, of_c in zip(q.of, c.of, strict=True):
        if pairs is None:  # while many are left, whole blocks are faster than pairs
            mask &= of_q[rows] @ of_c.T >= needed[rows, None]
            live = mask.any(axis=1)
            rows, mask = rows[live], mask[live]
            if mask.sum() * 16 < mask.size:
                i, j = np.nonzero(mask)
                pairs = rows[i], j
        else:
            left = np.einsum("pd,pd->p", of_q[pairs[0]], of_c[pairs[1]]) >= needed[pairs[0]]
            pairs = pairs[0][left], pairs[1][left]
    if float(np.abs(c.x).max(initial=0)) * float(np.abs(q.x).sum(axis=1).max(initial=0)) < EXACT:
        if pairs is None:
            scores = q.x[rows] @ c.x.T
            i, j = np.nonzero(mask & (scores >= least[rows, None]))
            return rows[i], j, scores[i, j].astype(np.int64)
        return *pairs, np.einsum("pd,pd->p", q.x[pairs[0]], c.x[pairs[1]]).astype(np.int64)
    if pairs is None:
        i, j = np.nonzero(mask)
        pairs = rows[i], j
    exact = [sum(int(a) * int(b) for a, b in zip(q.x[i], c.x[j], strict=True)) for i, j in zip(*pairs, strict=True)]
    return *pairs, np.array(exact, np.int64)  # fails where a score leaves 64 bits


class Best:
    """The k best rows, by id, of each query of a block so far; ``least`` is the k-th score where there are k."""

    def __init__(self, q: Block, k: int, least: np.ndarray | None = None) -> None:
        self.q, self.k = q, k
        self.least = np.full(len(q.ids), -np.inf) if least is None else least.copy()
        self.rows, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, c: Block) -> None:
        i, j, scores = _pairs(self.q, c, self.least)
        other = c.ids[j] != self.q.ids[i]
        if not other.any():
            return
        rows, ids, scores = (np.concatenate(x) for x in ((self.rows, i[other]), (self.ids, c.ids[j][other]), (self.scores, scores[other])))
        order = np.lexsort((-scores, ids, rows))  # the first row of an id has its greatest score
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.append(True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1]))
        rows, ids, scores = rows[first], ids[first], scores[first]
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        rank = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
        last = rank == self.k - 1
        self.least[rows[last]] = np.maximum(self.least[rows[last]], scores[last].astype(np.float64))
        keep = rank < self.k
        self.rows, self.ids, self.scores = rows[keep], ids[keep], scores[keep]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.q.ids[self.rows]), pa.array(self.ids), pa.array(self.scores)], names=["query_id", "vec_id", "score"])


def _grid(vectors: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """Rows and columns of the grid: candidate blocks are copied to each row, query blocks to each column."""
    cells = 2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = queries.select("vec_id").count() / max(1, vectors.select("vec_id").count())
    rows = min(cells, max(1, round(math.sqrt(cells * share))))
    return rows, -(-cells // rows)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` rows of ``vectors`` (vec_id, embedding) that score highest for each row of ``queries``."""
    by: dict[int, list[tuple[int, list[float]]]] = {}
    for row in _good(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():  # SAMPLE rows at most
        by.setdefault(len(row["embedding"]), []).append((row["vec_id"], row["embedding"]))
    sample = {dim: Block.made([i for i, _ in rows], np.floor(np.array([x for _, x in rows]) * scale)) for dim, rows in by.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(sample)

    def with_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                best = Best(Block.made(row["ids"], unpacked(row["kind"], row["data"], row["dim"])), k)
                if row["dim"] in shared.value:
                    best.meet(shared.value[row["dim"]])
                out.append(best.least.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Best] = {}
        candidates: tuple[int | None, Block | None] = (None, None)
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in ("q_block", "block")}
                dim, q_block, block = batch.column("dim")[n].as_py(), row["q_block"].as_py(), row["block"].as_py()
                value = lambda c, n=n, batch=batch: batch.column(c)[n].as_py()
                if block != candidates[0]:
                    candidates = block, Block.made(value("ids"), unpacked(value("kind"), value("data"), dim))
                if q_block not in states:
                    while len(states) >= STATES:
                        yield states.pop(next(iter(states))).batch()
                    states[q_block] = Best(Block.made(value("q_ids"), unpacked(value("q_kind"), value("q_data"), dim)), k, np.frombuffer(value("least")))
                states[q_block].meet(candidates[1])
        for best in states.values():
            yield best.batch()

    spread = Window.partitionBy("query_id", "dealt").orderBy(F.desc("score"), "vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows, columns = _grid(vectors, queries)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(n)).cast("int")
    # Explicit numbers of partitions: the blocks are small, their products are not.
    right = blocks(vectors, scale, BLOCK).withColumn("column", own(columns)).withColumn("at", every(rows)).repartition(rows * columns, "dim", "at", "column")
    left = blocks(queries, scale, QUERY_BLOCK).mapInArrow(with_least, BLOCKS + ", least binary").withColumn("at", own(rows)).withColumn("column", every(columns))
    left = left.select(F.col("block").alias("q_block"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "least", "dim", "at", "column").repartition(rows * columns, "dim", "at", "column")
    units = right.join(left.hint("merge"), ["dim", "at", "column"])
    found = units.mapInArrow(run, "query_id long, vec_id long, score long")
    # Repeated rows of an id are one row before any are counted; then an id is in one group only.
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    few = merged.withColumn("dealt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(spread)).where(F.col("r") <= k)
    return few.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
