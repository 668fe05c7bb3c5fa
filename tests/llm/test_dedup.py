"""Operators 1, 2 and 5: lines, exact copies and near copies."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import components, exact_dedup, line_dedup, near_dedup


def naive_lines(rows, ratio, least):
    totals, pages = collections.Counter(), collections.Counter()
    bare = lambda line: line.strip(" \t\r")
    for _, text, host in rows:
        totals[host] += 1
        pages.update({(host, bare(x)) for x in (text or "").split("\n") if text is not None and bare(x)})
    gone = {k for k, n in pages.items() if n >= least and n / totals[k[0]] > ratio}
    out = []
    for doc, text, host in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if (host, bare(x)) not in gone]
        out.append((doc, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("which", "ratio", "least"), [("docs", 0.08, 2), ("docs", 0.1, 5), ("docs", 0.01, 2), ("hard", 0.3, 2), ("nothing", 0.1, 5)])
def test_lines(request, which, ratio, least):
    df = request.getfixturevalue(which)
    expected = naive_lines([(r.doc_id, r.text, r.source) for r in df.collect()], ratio, least)
    got = line_dedup.drop_boilerplate(df, ratio, least)
    assert got.columns == [*(c for c in df.columns if not c.startswith("lines_")), "lines_total", "lines_dropped"]
    same = line_dedup.drop_boilerplate(df, ratio, least, counts=None)
    assert same.schema == df.schema and sorted(map(repr, same.drop("text").collect())) == sorted(map(repr, df.drop("text").collect()))
    assert sorted(map(tuple, got.select("doc_id", "text", "lines_total", "lines_dropped").collect()), key=repr) == expected


def test_a_page_may_lose_all_lines(spark):
    df = spark.createDataFrame([(k, "menu\nmenu" if k < 6 else f"own {k}\nmenu ", "h") for k in range(8)], "doc_id LONG, text STRING, source STRING")
    got = {r.doc_id: (r.text, r.lines_dropped) for r in line_dedup.drop_boilerplate(df, 0.5, 2).collect()}
    assert got[0] == ("", 2) and got[7] == ("own 7", 1)


@pytest.mark.parametrize("which", ["docs", "hard", "nothing"])
def test_exact(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    expected = []
    for d, t in rows:
        keep = max((x for x in groups[t] if x is not None), default=None)
        expected.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=repr) == sorted(expected, key=repr)


def test_chunks_follow_the_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 256, 200_000, dtype=np.uint8)
    gear = exact_dedup._gear()

    def chunks(data):
        ends = exact_dedup._cuts(len(data), exact_dedup.boundaries(data, gear).tolist())
        return [data[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    one, two = chunks(shared), chunks(np.concatenate([rng.integers(0, 256, 777, dtype=np.uint8), shared]))
    assert b"".join(one) == shared.tobytes() and len(set(one) & set(two)) >= len(one) - 3
    assert all(len(c) <= exact_dedup.MAX_CHUNK for c in one) and all(len(c) >= exact_dedup.MIN_CHUNK for c in one[:-1])
    assert exact_dedup._cuts(0, []) == [0]


def test_names_that_stand_for_two_contents(spark, monkeypatch):
    """With a digest that says nothing, the checks still tell texts apart."""
    monkeypatch.setattr(exact_dedup.hashlib, "blake2b", lambda *a, **k: hashlib.md5(b""))
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id LONG, text STRING")
    local = [(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(frame).collect()]
    assert sorted(local) == [(1, 3), (2, 2), (3, 3)]


WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def naive_components(rows, percent):
    sets = {d: shingle_set(t) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        for e in {e for x in s for e in holders[x] if e > d}:
            both = len(s & sets[e])
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return sorted(((d, len(shingle_set(t)), None if d is None else root(d), d is None or root(d) == d) for d, t in rows), key=repr)


def near(df, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(df, percent).collect()), key=repr)


@pytest.mark.parametrize(("which", "percent"), [("docs", 85), ("hard", 80), ("nothing", 80)])
def test_near(request, which, percent):
    df = request.getfixturevalue(which)
    assert near(df, percent) == naive_components([(r.doc_id, r.text) for r in df.collect()], percent)


def test_near_families(spark, monkeypatch):
    """Chains and families of edited copies, in blocks of three."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, number = [], 100
    for _ in range(6):
        base = [word() for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = word()
            rows.append((number, " ".join(text)))
            number -= rng.choice([1, -3])
            base = text if rng.random() < 0.3 else base
    rows = list({d: (d, t) for d, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    for percent in (80, 85):
        got, expected = near(df, percent), naive_components(rows, percent)
        assert sum(a != b for a, b in zip(got, expected, strict=True)) <= len(rows) // 100


def test_keep_one(spark, hard):
    kept = near_dedup.keep_one(hard)
    assert kept.columns == hard.columns
    ids = sorted(r.doc_id or -1 for r in kept.collect())
    assert ids == [-1, -1, 1, 2, 3, 4, 5, 9, 10, 11, 12]
    assert kept.schema == hard.schema


TALE = " ".join(f"word{k}" for k in range(60))


def test_texts_of_one_id_stay_apart(spark):
    """Rows of one doc_id with different texts are no copies of each other, and each is judged by its own text."""
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(7, other), (7, TALE), (3, TALE + " end"), (9, TALE), (2, "alone " + other[:20]), (2, "start " + TALE), (2, TALE + " more"), (2, TALE + " more"), (None, TALE), (None, TALE), (8, ""), (8, "")]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id LONG, text STRING, t0 INT").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(df).collect() if r.doc_id)
    assert got == sorted([(7, 7, True), (7, 2, False), (3, 2, False), (9, 2, False), (2, 2, True), (2, 2, True), (2, 2, True), (2, 2, True), (8, 8, True), (8, 8, True)])
    kept = near_dedup.keep_one(df)
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert kept.columns == df.columns and len(left) == 6 and left.count((None, TALE)) == 2 and left.count((8, "")) == 1
    assert {(7, other), (2, "alone " + other[:20])} < set(left) and sum(d == 2 for d, _ in left) == 2


def test_thresholds_that_sketches_cannot_serve(docs):
    for percent in (50, 40, 101):
        with pytest.raises(ValueError):
            near_dedup.near_dedup(docs, percent)


def bucket_of(spark, rows):
    """members and sketches of buckets from (key, id, component, inside, elements)."""
    members = spark.createDataFrame([r[:4] for r in rows], "key LONG, id LONG, component LONG, inside BOOLEAN")
    sets = {r[1]: np.array(sorted(r[4]), np.uint64) for r in rows}
    sketches = spark.createDataFrame([(i, len(s), near_dedup.odd_sketch(s)) for i, s in sets.items()], "id LONG, n_shingles LONG, sketch BINARY")
    return members, sketches, sets


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_cells_hold_every_pair_of_two_components(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng, rows = np.random.default_rng(3), []
    for key in range(6):
        base = rng.integers(0, 1 << 63, int(rng.integers(20, 140)))
        for k in range(int(rng.integers(2, 30))):
            own = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.3])]
            component = int(rng.integers(0, 5)) if key else 0
            rows.append((key, 100 * key + k, 1000 * key + component, component == 0, own.tolist()))
    members, sketches, sets = bucket_of(spark, rows)
    got = {(r.a, r.b) for r in near_dedup.cross_pairs(members, sketches, 80).collect()}
    for key, a, c, _, _ in rows:
        for key2, b, c2, _, _ in rows:
            if key == key2 and a < b:
                both = len(np.intersect1d(sets[a], sets[b]))
                if c == c2:
                    assert (a, b) not in got
                elif 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    assert (a, b) in got


def test_a_hot_bucket_is_dealt_out(spark):
    """A bucket of 100,000 members: no cell has more than its two blocks, and rows are few."""
    n, seen = 100_000, []
    members = spark.range(n, numPartitions=8).selectExpr("7L AS key", "id", "if(id % 2000 = 0, id, 1L) AS component", "id % 2000 <> 0 AS inside")
    sketch = bytearray(near_dedup.odd_sketch(np.arange(40, dtype=np.uint64) * np.uint64(977)))
    sketches = spark.range(n, numPartitions=8).select("id", F.lit(40).cast("long").alias("n_shingles"), F.lit(bytes(sketch)).alias("sketch"))
    whole = type(members).mapInArrow

    def counted(self, run, schema):
        rows = self.groupBy("key", "low", "high").count()
        seen.extend(r["count"] for r in rows.collect())
        return whole(self, run, schema)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(members), "mapInArrow", counted)
        pairs = near_dedup.cross_pairs(members, sketches, 80)
    assert max(seen) < 2.5 * near_dedup.BLOCK and sum(seen) < n + 50 * 120
    assert pairs.count() == 50 * (n - 50) + 50 * 49 // 2


@settings(max_examples=80, deadline=None)
@given(st.text("abc AB\t\n\x0b\x1f é", max_size=60))
def test_shingles(text):
    assert len(near_dedup.shingles(text)) == len(shingle_set(text))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.floats(0, 1))
def test_sketches_never_exceed_the_difference(one, two, share):
    two = two | set(list(one)[: int(len(one) * share)])
    a, b = (np.frombuffer(near_dedup.odd_sketch(np.array(sorted(x), np.uint64)), np.uint64).reshape(1, -1) for x in (one, two))
    least = min(a.shape[1], b.shape[1])
    assert np.bitwise_count(near_dedup.fold(a, least) ^ near_dedup.fold(b, least)).sum() <= len(one ^ two)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 200)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.id: r.component for r in components.components(spark.createDataFrame([*edges, *[(b, a) for a, b in edges[:9]], (None, 1), (2, None)], "u LONG, v LONG")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components.components(spark.createDataFrame([], "u LONG, v LONG")).count() == 0
