"""Operator 5: near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct 5-word shingles.  Two collections of ``m``
half-keys, each over ``ROWS`` minhashes, are combined pairwise into ``m * m``
table keys of ``2 * ROWS`` rows: 2 m ROWS minhashes do the work of
2 m² ROWS.  Documents with equal sets are one class from the start, so copies
cost nothing further, and only ids and keys are shuffled.

A class is named by a number of one of its rows, so that rows of one doc_id with
different texts stay apart.  Buckets are worked in two passes, neither of which
expands a bucket into pairs of documents already known to belong together:

1. every member is compared with the bucket's pivot, the one of the smallest
   doc_id (linear); verified links give first components;
2. members outside the pivot's component are compared with all members of other
   components, in cells of two blocks of about ``BLOCK`` members: once to offer each
   component the likeliest pair only, then, with the components that these links
   joined, for all pairs that are left.

Buckets are never gathered: their pivots, sizes and blocks come from
aggregates that are combined before they move, and a block is a hash of its
members, so a hot bucket is spread over many tasks of bounded size.  A bucket of S
members of which R are outside sends R * S / BLOCK rows.

A comparison first uses odd sketches: a bit for every residue says whether an
odd number of shingles fall on it, and the number of bits in which two sketches
differ never exceeds the size of the symmetric difference.  What that bound
does not rule out is verified on the full sets.

Edge cases: null and empty texts, or texts without words, have no shingles and
are linked with nothing; with fewer than five words the whole sequence is one
shingle; a component is named by its smallest doc_id, also where rows of one
doc_id have different texts; a null doc_id is linked with nothing and kept;
``keep_one`` leaves one row of a group, whichever it is of equal ones; an empty
table gives no rows; other columns are not read by ``near_dedup`` and pass
through ``keep_one``.  Thresholds up to 50 percent are refused, as sketches of
sets of very different sizes aren't compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import components
from foliant.llm.store import written
from foliant.llm.tokens import forget, trim

WORDS, ROWS, BLOCK = 5, 3, 1024
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M = (1 << 64) - 1
_STEPS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle names of a text; A-Z become lower case, words end at ASCII white space."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    return np.unique(_mixed(sum((w[k : k + n] ^ (w[k : k + n] >> np.uint64(32))) * _STEPS[k] for k in range(WORDS))))


def half_count(percent: int) -> int:
    """Half-keys in a collection so that a pair at the threshold is missed with a probability of about 1 in 500."""
    return math.ceil(math.log(0.001) / math.log(1 - (percent / 100) ** ROWS))


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd factors and addends of the minhashes of 2 * count half-keys."""
    a, b = np.random.default_rng(5).integers(0, 1 << 63, (2, 2 * count * ROWS), dtype=np.uint64)
    return (a << np.uint64(1)) | np.uint64(1), b


def half_keys(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Half-keys (signed 64-bit) of a nonempty set under ``permutations``."""
    least = np.full(len(a), _M, np.uint64)
    for start in range(0, len(h), 4096):
        np.minimum(least, (h[start : start + 4096, None] * a + b).min(axis=0), out=least)
    rows = _mixed(least).reshape(-1, ROWS)
    keys = np.zeros(len(rows), np.uint64)
    for r in range(ROWS):
        keys = _mixed(keys * _STEPS[1] + rows[:, r])
    return keys.view(np.int64).tolist()


def odd_sketch(h: np.ndarray) -> bytes:
    """Parity bits by residue; as many bits as the next power of two of the size, 64 at least."""
    bits = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words reduced to the sketch of a smaller width."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _name(h: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(h.tobytes())


def _halves_of(names: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def text_name(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return F.xxhash64(body), F.xxhash64(F.lit(7), body)


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """A row number, doc_id, the name of the text (t0, t1), n_shingles, the name of the set (k0, k1), half-keys and odd sketch of ``docs`` (doc_id, text)."""
    count = half_count(percent)
    passed = ["doc_id", "t0", "t1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        a, b = permutations(count)
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            size, names, halves, sketches = [], [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py())
                size.append(len(h))
                names.append(_name(h))
                halves.append(half_keys(h, a, b) if len(h) else None)
                sketches.append(odd_sketch(h) if len(h) else None)
            rows = pa.array(np.arange(number, number + len(size)))
            number += len(size)
            yield pa.RecordBatch.from_arrays(
                [rows, *map(batch.column, passed), pa.array(size, pa.int64()), *_halves_of(names), pa.array(halves, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["row", *passed, "n_shingles", "k0", "k1", "halves", "sketch"],
            )
            trim()

    t0, t1 = text_name(F.col("text"))
    schema = "row long, doc_id long, t0 long, t1 long, n_shingles long, k0 long, k1 long, halves array<bigint>, sketch binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", t0.alias("t0"), t1.alias("t1")).mapInArrow(run, schema)


def buckets(representatives: DataFrame, percent: int) -> DataFrame:
    """key, id and pivot of the members of all buckets with two members or more; the pivot is the member with the smallest document."""
    count = half_count(percent)
    # Many more rows come out than go in, so they start from as many partitions as a shuffle has.
    spread = representatives.select("id", "doc", "halves").repartition(int(representatives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = spread.select("id", "doc", "halves", F.posexplode(F.slice("halves", 1, count)).alias("i", "one"))
    both = left.select("id", "doc", "i", "one", F.posexplode(F.slice("halves", count + 1, count)).alias("j", "two"))
    rows = both.select("id", "doc", F.xxhash64("i", "j", "one", "two").alias("key"))
    # A written table, so that a hot key's rows can be split over tasks in the join.
    pivots = written(rows.groupBy("key").agg(F.min_by("id", "doc").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot"), "pivots")
    return rows.select("id", "key").join(pivots, "key").select("key", "id", "pivot")


def _possible(n1: np.ndarray, n2: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in ``apart`` shingles at least can reach the threshold."""
    return (100 + percent) * np.maximum(apart, np.abs(n1 - n2)) <= (100 - percent) * (n1 + n2)


def _words(sketches: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, width)


def possible_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that the sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = batch.column("n1").to_numpy(), batch.column("n2").to_numpy()
            s1, s2 = batch.column("s1").to_pylist(), batch.column("s2").to_pylist()
            apart = np.zeros(len(n1), np.int64)
            w1, w2 = (np.fromiter(map(len, s), np.int64, len(s)) // 8 for s in (s1, s2))
            for x, y in set(zip(w1.tolist(), w2.tolist(), strict=True)):
                own = np.flatnonzero((w1 == x) & (w2 == y))
                least = min(x, y)
                differ = fold(_words([s1[i] for i in own], x), least) ^ fold(_words([s2[i] for i in own], y), least)
                apart[own] = np.bitwise_count(differ).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(_possible(n1, n2, apart, percent)))

    first = sketches.select(F.col("id").alias("a"), F.col("n_shingles").alias("n1"), F.col("sketch").alias("s1"))
    second = sketches.select(F.col("id").alias("b"), F.col("n_shingles").alias("n2"), F.col("sketch").alias("s2"))
    return pairs.join(first, "a").join(second, "b").mapInArrow(run, "a long, b long")


def _nearest(found: np.ndarray, comp: np.ndarray, difference: np.ndarray) -> np.ndarray:
    """Of ``found``, for each component the row with the smallest difference."""
    order = np.lexsort((difference, comp[found]))
    first = np.unique(comp[found][order], return_index=True)[1]
    return found[order][first]


def _cell_pairs(ids: np.ndarray, n: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, sketches: list[bytes], percent: int, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a ``left`` and a ``right`` row of other components that the sketches do not rule out; with ``nearest`` a left row's likeliest of each component (and width) only."""
    width, same = np.array([len(s) // 8 for s in sketches]), np.array_equal(left, right)
    for w in np.unique(width[left]):
        own = np.flatnonzero(left & (width == w))
        for x in (w // 2, w, 2 * w):  # sets whose sizes are further apart can't reach a threshold above 50 %
            other = np.flatnonzero(right & (width == x))
            if not len(other):
                continue
            least = min(w, x)
            own_words, other_words = (fold(_words([sketches[i] for i in at], v), least) for at, v in ((own, w), (other, x)))
            for k, i in enumerate(own):
                ok = comp[other] != comp[i]
                if same:
                    ok &= ids[other] > ids[i]
                take = np.flatnonzero(ok)
                apart = np.bitwise_count(other_words[take] ^ own_words[k]).sum(axis=1)
                ok = _possible(n[other[take]], n[i], apart, percent)
                found = other[take[ok]]
                if nearest and len(found) > 1:
                    found = _nearest(found, comp, apart[ok] / (n[found] + n[i]))
                if len(found):
                    yield np.minimum(ids[found], ids[i]), np.maximum(ids[found], ids[i])


def cross_pairs(members: DataFrame, sketches: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of members of one bucket, but of two components, that the sketches do not rule out.

    ``members`` has key, id, component, and ``inside``: whether that is the component of the bucket's pivot.  A
    cell is a block of outside members (``low``) with another or the same one, or with a block of inside ones
    (``high`` from -1 downwards).  With ``nearest`` a member offers each component its likeliest pair only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def emitted() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            ids, n, comp, block = (np.array([r[c] for r in rows], np.int64) for c in ("id", "n_shingles", "component", "block"))
            low, high = rows[0]["low"], rows[0]["high"]
            found = list(_cell_pairs(ids, n, comp, block == low, block == high, [r["sketch"] for r in rows], percent, nearest))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                at = row["key"], row["low"], row["high"]
                if at != cell:
                    yield from emitted()
                    cell, rows = at, []
                rows.append(row)
        yield from emitted()

    outside = ~F.col("inside")
    sizes = members.groupBy("key").agg(F.count_if(outside).alias("out"), F.count_if("inside").alias("in")).where("out > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    # A written table, so that a hot key's rows can be split over tasks in the join.
    mixed = members.join(written(sizes.select("key", blocks("out").alias("out"), blocks("in").alias("in")), "mixed"), "key")
    block = F.pmod(F.xxhash64("id"), F.when(outside, F.col("out")).otherwise(F.col("in"))).cast("int")
    placed = mixed.withColumn("block", F.when(outside, block).otherwise(-1 - block))
    all_out, all_in = F.sequence(F.lit(0), F.col("out") - 1), F.when(F.col("in") > 0, F.sequence(F.lit(-1), -F.col("in"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    pair = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    own = F.col("block")
    cells = F.when(outside, F.concat(F.transform(all_out, lambda x: pair(F.least(own, x), F.greatest(own, x))), F.transform(all_in, lambda x: pair(own, x)))).otherwise(F.transform(all_out, lambda x: pair(x, own)))
    spread = placed.select("key", "id", "component", "block", F.explode(cells).alias("cell")).select("key", "id", "component", "block", "cell.low", "cell.high")
    joined = spread.join(sketches.select("id", "n_shingles", "sketch"), "id").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return joined.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v): the ``pairs`` whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([one, two])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    first = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(first, "a").join(second, "b").mapInArrow(run, "u long, v long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and elements (sorted 64-bit names) of the sets in ``wanted`` (id, k0, k1, doc: a document that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sets = [shingles(t.as_py()) for t in batch.column("text").slice(start, 256)]
                yield pa.RecordBatch.from_arrays([*_halves_of([_name(h) for h in sets]), pa.array([h.tobytes() for h in sets], pa.binary())], names=["k0", "k1", "elements"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted.select("doc").distinct(), "doc", "left_semi")
    sets = texts.select("text").mapInArrow(run, "k0 long, k1 long, elements binary").dropDuplicates(["k0", "k1"])
    return sets.join(wanted.select("k0", "k1", "id"), ["k0", "k1"]).select("id", "elements")


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with their component, and whether it is that of their pivot."""
    of_pivot = found.select(F.col("id").alias("pivot"), F.col("component").alias("pivots"))
    known = members.join(found, "id", "left").join(of_pivot, "pivot", "left").select("key", "id", F.coalesce("component", "id").alias("component"), F.coalesce("pivots", "pivot").alias("pivots"))
    return written(known.select("key", "id", "component", (F.col("component") == F.col("pivots")).alias("inside")), "known")


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; links inside the old ones say nothing new, so stars stand for them."""
    return components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(links))


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, t0, t1, n_shingles, ``group`` (a name of the row's component; null: linked with nothing) and component_id of every row of ``docs`` (doc_id, text)."""
    if not 50 < percent <= 100:
        raise ValueError("the threshold must be above 50 percent, and 100 at most")
    table = written(signatures(docs, percent), "signatures")
    classes = written(table.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k0", "k1").agg(F.min("row").alias("id"), F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "classes")
    sketches = written(table.select(F.col("row").alias("id"), "n_shingles", "sketch", "halves").join(classes.select("id", "doc"), "id"), "sketches")
    members = written(buckets(sketches, percent), "buckets")
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi")
    sets = written(full_sets(docs, wanted), "sets")

    pairs = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = written(verified(possible_pairs(pairs, sketches, percent), sets, percent), "links")
    first = components(links)
    # First each outside member's likeliest links, as one link joins whole components; then all that is still open.
    second = _merged(first, verified(cross_pairs(_placed(members, first), sketches, percent, nearest=True), sets, percent))
    final = _merged(second, verified(cross_pairs(_placed(members, second), sketches, percent), sets, percent))

    labelled = written(classes.join(final, "id", "left").select("k0", "k1", "doc", F.coalesce("component", "id").alias("group"), ((F.col("copies") > 1) | F.col("component").isNotNull()).alias("several")), "labelled")
    # A component's own smallest class has no row in ``final``.
    ends = written(final.select(F.col("component").alias("group")).distinct(), "ends")
    least = labelled.join(ends, "group", "left_semi").groupBy("group").agg(F.min("doc").alias("component_id"))
    # A table of the classes that say anything; so written, a hot class's rows can be split over tasks in the join.
    named = labelled.join(least, "group", "left").where("several OR component_id IS NOT NULL").select("k0", "k1", "group", F.coalesce("component_id", "doc").alias("component_id"))
    rows = table.select("row", "doc_id", "t0", "t1", "n_shingles", "k0", "k1").join(written(named, "named"), ["k0", "k1"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return rows.select("doc_id", "t0", "t1", "n_shingles", F.when(linked, F.coalesce("group", "row")).alias("group"), F.when(linked, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text); links are Jaccard similarities of ``percent`` or more."""
    return grouped(docs, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: one with the smallest doc_id, of several texts that with the smallest name."""
    rows = written(grouped(docs, percent), "grouped")
    text = F.struct("doc_id", "t0", "t1")
    several = rows.where("group IS NOT NULL").groupBy("group").agg(F.min(text).alias("best"), F.max(text).alias("last"), F.count("*").alias("n")).where("n > 1")
    several = written(several.select("group", "best", (F.col("best") < F.col("last")).alias("differ")), "several")
    dropped = rows.join(several.where("differ"), "group").where(text != F.col("best")).select("doc_id", "t0", "t1").distinct()
    empty = rows.where("group IS NULL AND doc_id IS NOT NULL").groupBy("doc_id", "t0", "t1").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "t0", "t1")
    repeated = rows.join(several, (rows["group"] == several["group"]) & (text == F.col("best"))).groupBy("doc_id", "t0", "t1").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "t0", "t1").unionByName(empty)
    # A row travels as one value, so that no name of its columns can clash with those made here.
    t0, t1 = text_name(F.col("text"))
    whole = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), t0.alias("t0"), t1.alias("t1")).join(written(dropped, "dropped"), ["doc_id", "t0", "t1"], "left_anti")
    repeated = written(repeated, "repeated")
    if not repeated.isEmpty():
        once = whole.join(repeated, ["doc_id", "t0", "t1"], "left_anti")
        whole = once.unionByName(whole.join(repeated, ["doc_id", "t0", "t1"], "left_semi").dropDuplicates(["doc_id", "t0", "t1"]))
    return whole.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
