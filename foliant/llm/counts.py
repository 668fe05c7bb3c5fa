"""Operator 9: token counts by a linear longest-match automaton.

Counts the pieces that greedy longest-match segmentation would make of each
pre-token, without building the pieces.  The vocabulary is a trie over bytes;
a state without a way on falls back along its failure link, and each link
carries the precomputed number of pieces that are complete once it is taken
(the pieces popped).  Every byte is read once and every link shortens the
pending string, so the time is linear in the text.

Edge cases: null and empty texts count 0; repeated rows and null ids stay; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foliant.llm.tokens import ChunkTable, Encoded, byte_alphabet, loaded, spaced_cut, uncut_texts


def vocabulary(path: str) -> list[bytes]:
    """The pieces, as bytes, of a byte-level vocabulary file, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        loaded_json = json.load(f)
    special = {t["content"] for t in loaded_json.get("added_tokens", ())}
    back = byte_alphabet()
    return [bytes(back[c] for c in piece) for piece in loaded_json["model"]["vocab"] if piece not in special]


class LongestMatch:
    """Trie with failure links over ``pieces``; all single bytes that may occur should be among them."""

    def __init__(self, pieces: list[bytes]) -> None:
        self._next: dict[int, int] = {}
        symbols, parents, final = [0], [-1], [False]
        for piece in pieces:
            node = 0
            for b in piece:
                child = self._next.get(node << 8 | b)
                if child is None:
                    child = self._next[node << 8 | b] = len(symbols)
                    symbols.append(b)
                    parents.append(node)
                    final.append(False)
                node = child
            if node:
                final[node] = True
        self._fail, self._pops = [-1] * len(symbols), [0] * len(symbols)
        depth = [0] * len(symbols)
        for v in range(1, len(symbols)):  # a parent is made before its children
            depth[v] = depth[parents[v]] + 1
        for v in sorted(range(1, len(symbols)), key=depth.__getitem__):
            if final[v]:
                self._fail[v], self._pops[v] = 0, 1
                continue
            state, popped = self._fail[parents[v]], self._pops[parents[v]]
            while state >= 0 and state << 8 | symbols[v] not in self._next:
                popped += self._pops[state]
                state = self._fail[state]
            if state >= 0:
                self._fail[v], self._pops[v] = self._next[state << 8 | symbols[v]], popped

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1 for the whole word where some part has none, as word-piece does with unknown words."""
        step, fail, pops = self._next.get, self._fail, self._pops
        node = total = 0
        for b in word:
            child = step(node << 8 | b)
            while child is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                child = step(node << 8 | b)
            node = child
        while node:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def count_table(path: str) -> ChunkTable:
    """A table whose value for a chunk is its number of pieces."""
    import regex
    from public_tokenizers import PATTERN

    split, automaton = regex.compile(PATTERN).findall, LongestMatch(vocabulary(path))

    def encode(chunks: list[str]) -> Encoded:
        counts = [sum(automaton.count(t.encode()) for t in split(c)) for c in chunks]
        return np.array(counts, np.uint32), np.ones(len(chunks), np.int64)

    return ChunkTable(encode, encode, spaced_cut, True, uncut=uncut_texts(path))


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and n_tokens of ``docs`` (doc_id, text), counted inside each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(count_table, vocabulary_path)
        for batch in batches:
            counts, bounds = table.texts(batch.column("text"))
            totals = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(np.diff(totals[bounds]), pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
