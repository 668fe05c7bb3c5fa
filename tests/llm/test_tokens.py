"""Operators 3, 8, 9 and 10: encoding, files, counts and packing."""

from __future__ import annotations

import hashlib
import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, models, pre_tokenizers

from foliant.llm import codes, counts, packing, pieces, queries, store, token_output, tokens

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TRICKY = [
    "a  b", "a   b", "a\t b \n\nc d's 'll  ", "", " ", "\n", "x'.y ,. foo.,bar", "it's, don't. ", "Ünï .çà", "a b c", "é́́x", "ΑΣ ς ΟΔΟΣ.", "<|endoftext|> a <|startoftext|>", "a\x1cb \x85c",
    "​ x", "1.2, 33", "日本語 テスト。 ", "İstanbul ſ", "a ̈b", "foo 're x", "</s> <s> <unk> x", "▁a ▁ b", None, "x\n y", "x \ny", "x\ny\nz", "a\x00 b", "a\x01 b.", "Ab. cD,\nEf",
]
#: Library objects of their own, as a user would make them.
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
ADDED = ["<|endoftext|>", "a <|endoftext|> b, c.", "<|startoftext|><|endoftext|>", "x\n<|startoftext|>y", "<|ENDOFTEXT|> <|endoftext", "a.<|endoftext|>\nb"]
TABLES = {WORD: tokens.bpe_table(WORD), BYTE: tokens.bpe_table(BYTE), PIECE: tokens.piece_table(PIECE)}


def split(table, texts):
    ids, bounds = table.texts(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def library_ids(path, text):
    if path == PIECE:
        return SentencePieceProcessor(model_file=PIECE).encode(text or "")
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", TABLES)
def test_chunks_give_the_library_s_ids(path):
    assert split(TABLES[path], TRICKY + ADDED) == [library_ids(path, t) for t in TRICKY + ADDED]


def test_added_tokens_keep_their_ids():
    assert [split(TABLES[p], ["<|endoftext|>"]) for p in (WORD, BYTE)] == [[[49407]], [[50256]]]


def test_vocabularies_that_cross_cuts_stay_whole(tmp_path):
    vocabulary = {c: k for k, c in enumerate(["a", "b", "Ġ", "aĠ", "bĠ", "Ġa"])}
    torn = Tokenizer(models.BPE(vocab=vocabulary, merges=[("a", "Ġ"), ("b", "Ġ"), ("Ġ", "a")]))
    torn.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    path = str(tmp_path / "torn.json")
    torn.save(path)
    assert tokens.uncut_texts(path) == tokens._EVERY and tokens.uncut_texts(BYTE) != tokens._EVERY != tokens.uncut_texts(WORD)
    texts = ["a b a", "ab ab", "", "b a b b"]
    assert split(tokens.bpe_table(path), texts) == [torn.encode(t).ids for t in texts]
    torn.pre_tokenizer = pre_tokenizers.Whitespace()
    torn.save(path)
    assert tokens.uncut_texts(path) == tokens._EVERY


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab, .'\nAéß\t 日1▁́"), max_size=30), max_size=4), st.sampled_from(list(TABLES)))
def test_any_text(texts, path):
    assert split(TABLES[path], texts) == [library_ids(path, t) for t in texts]


def test_a_full_table_stays_right(monkeypatch):
    table = tokens.bpe_table(BYTE)
    table._limit = 5
    monkeypatch.setattr(tokens, "SLICE_BYTES", 20)
    texts = [f"word{k} other{k % 3}, and word{k - 1}." for k in range(40)]
    assert split(table, texts) == [table._each([t])[0].tolist() for t in texts]
    assert len(table._place) == len(table._start) < 30 and table._length.sum() == len(table._ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70_000), max_size=1500), st.data())
def test_codes(values, data):
    ids = np.array(values, np.uint32)
    read = codes.Codes(codes.encode(ids))
    assert len(read) == len(ids) and read.slice(0, len(ids)).tolist() == values
    a, b = sorted((data.draw(st.integers(0, len(ids))), data.draw(st.integers(0, len(ids)))))
    assert read.slice(a, b).tolist() == values[a:b]
    if values:
        k = data.draw(st.integers(0, len(ids) - 1))
        assert read[k] == values[k]


def test_codes_refuse_other_bytes():
    with pytest.raises(ValueError):
        codes.Codes(b"nope" + bytes(20))
    with pytest.raises(IndexError):
        codes.Codes(codes.encode(np.zeros(3, np.uint32)))[3]


def expected_ids(path, text, end):
    return [*LIBRARY[path].encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    ids = [expected_ids(WORD, t, 2) for _, t in rows]
    starts = [0, *accumulate(map(len, ids))]
    got = [tuple(r) for r in queries.op3_token_output(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()]
    assert got == [(d, s, len(i), crc(i)) for (d, _), s, i in zip(rows, starts, ids, strict=False)]


def test_token_files_of_hard_rows(spark, hard, nothing):
    hard = hard.unionByName(hard.where("doc_id = 9").withColumn("text", F.lit("<|endoftext|> and <|startoftext|>")))
    path = store.new_path(spark, "t")
    token_output.write_token_files(hard, path, WORD, 2, segment_tokens=10)
    rows = [(r.doc_id, r.text) for r in hard.orderBy("doc_id", F.xxhash64("text")).collect()]
    ids = [expected_ids(WORD, t, 2) for _, t in rows]
    flat = [i for x in ids for i in x]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.read_documents(spark, path).collect())
    assert got == [(s, d, len(i), crc(i)) for (d, _), s, i in zip(rows, [0, *accumulate(map(len, ids))], ids, strict=False)]
    for a, b in ((0, len(flat)), (3, 4), (17, 300), (len(flat) - 5, len(flat))):
        assert token_output.read_tokens(spark, path, a, b) == flat[a:b]
    empty = store.new_path(spark, "t")
    token_output.write_token_files(nothing, empty, WORD, 2)
    assert token_output.read_documents(spark, empty).count() == 0


@pytest.mark.parametrize("which", ["docs", "hard", "nothing"])
def test_sentencepiece(request, which):
    df = request.getfixturevalue(which)
    library = tokens.piece_model(PIECE)
    expected = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_eos=True)
        text = library.decode(ids)
        expected.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    got = [tuple(r) for r in pieces.encode_pieces(df, PIECE).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def greedy(word, vocabulary, longest):
    count = start = 0
    while start < len(word):
        stop = min(len(word), start + longest)
        while stop > start and word[start:stop] not in vocabulary:
            stop -= 1
        if stop == start:
            return 1
        start, count = stop, count + 1
    return count


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=12), st.text("abcd", max_size=25))
def test_automaton_counts_greedy_pieces(vocabulary, word):
    known = {v.encode() for v in vocabulary}
    assert counts.LongestMatch(sorted(known)).count(word.encode()) == greedy(word.encode(), known, 4)


@pytest.mark.parametrize("which", ["docs", "hard", "nothing"])
def test_counts(request, which):
    import regex

    df = request.getfixturevalue(which)
    vocabulary = set(counts.vocabulary(BYTE))
    longest, known = max(map(len, vocabulary)), {}

    def count(text):
        total = 0
        for part in regex.findall(public_tokenizers.PATTERN, text or ""):
            if part not in known:
                known[part] = greedy(part.encode(), vocabulary, longest)
            total += known[part]
        return total

    assert sorted(((r.doc_id, r.n_tokens) for r in counts.count_tokens(df, BYTE).collect()), key=repr) == sorted(((r.doc_id, count(r.text)) for r in df.collect()), key=repr)


def check_packing(df, rows, capacity):
    got = [r.asDict() for r in rows.collect()]
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    expected = {}
    for r in df.collect():
        ids = expected_ids(BYTE, r.text, 0)
        first = len(ids) % capacity or capacity
        bounds = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
        expected.setdefault(r.doc_id, []).extend((k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)))
    assert {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs) for d, rs in by_doc.items()} == {d: sorted(x) for d, x in expected.items()}
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r["offset"])
        ends = [0, *accumulate(r["length"] for r in rs)]
        assert [r["offset"] for r in rs] == ends[:-1] and ends[-1] <= capacity
    return len(by_sequence), sum(r["length"] for r in got)


def test_packing(docs, hard, nothing):
    sequences, total = check_packing(docs, packing.pack(docs, BYTE, 0, 2048), 2048)
    assert sequences <= -(-total // 2048) + 2
    added = hard.unionByName(hard.where("doc_id = 11").withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit("x <|endoftext|> y")}))
    check_packing(added, packing.pack(added, BYTE, 0, 64), 64)
    assert packing.pack(nothing, BYTE, 0).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 9), max_size=12))))
def test_plan_uses_everything_once(case):
    capacity, histogram = case
    patterns = packing.plan(histogram, capacity)
    used = {}
    for n, items in patterns:
        assert n > 0 and sum(length * k for length, k in items) <= capacity
        for length, k in items:
            used[length] = used.get(length, 0) + n * k
    assert used == histogram
    where = packing.place(patterns, capacity)
    assert sum(len(items) for _, items in patterns) == len(where["length"])


def test_plan_fills_gaps_exactly():
    for histogram in ({10: 3, 6: 3}, {10: 2, 4: 2, 2: 2}, {10: 1, 3: 1, 2: 1, 1: 1}, {16: 4}):
        assert sum(n for n, _ in packing.plan(histogram, 16)) == sum(k * v for k, v in histogram.items()) // 16
    many = {length: 10_000_000_000 for length in (1500, 548, 300, 248, 1000)}
    assert sum(n for n, _ in packing.plan(many, 2048)) <= 1.1 * sum(k * v for k, v in many.items()) / 2048
