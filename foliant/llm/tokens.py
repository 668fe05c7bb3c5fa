"""Distinct-chunk tables: a tokenizer library sees every distinct chunk once.

The vocabularies used here never join a visible character with the space after
it, so a text whose words stand between single spaces can be cut before each
space and every chunk has the same ids wherever it stands.  A batch of texts
is split and dictionary-encoded by Arrow, unseen chunks go to the library, and
the ids are joined back by position with NumPy.  Texts with runs of white
space, white space at an end, or one of the few characters on which notions of
white space differ go to the library whole, and so do texts that hold the string of
an added token.  Whether a vocabulary allows such cuts is checked when it is
loaded; with one that doesn't, every text goes to the library whole.

Edge cases: null text is empty text, which has no ids; repeated texts and chunks are
looked up once; a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters on which notions of white space differ, and marks of this module.
_ODD = r"[\x00\x01\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}▁]"
#: A text matching this is not cut.
_UNCUT = r"\s\s|^\s|\s$|" + _ODD
#: Bytes of text handled at a time.
SLICE_BYTES = 4_000_000

Encoded = tuple[np.ndarray, np.ndarray]


def trim() -> None:
    """Give freed memory back to the system where the C library can; else it stays with this worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


class ChunkTable:
    """Ids of texts through a table of about ``limit`` chunks, and those of one slice.

    ``encode`` maps a list of chunks to (all ids, lengths), ``each`` one of
    whole texts.  ``prepare`` may cut texts further, by spaces: with ``spaced``
    a word after U+0001 is a chunk as it stands and any other one has a space
    before it; without, the library treats both alike.  Texts that match
    ``uncut`` (RE2) are not cut.
    """

    def __init__(self, encode: Callable[[list[str]], Encoded], each: Callable[[list[str]], Encoded], prepare: Callable[[pa.Array], pa.Array], spaced: bool, limit: int = 450_000, uncut: str = _UNCUT) -> None:
        self._encode, self._each, self._prepare, self._spaced, self._limit, self._uncut = encode, each, prepare, spaced, limit, uncut
        self._place: dict[str, int] = {}
        self._ids = np.zeros(0, np.uint32)
        self._start = np.zeros(0, np.int64)
        self._length = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        chunks = [w[1:] if w[:1] == "\x01" else f" {w}" for w in words] if self._spaced else words
        ids, lengths = self._encode(chunks)
        base = len(self._start)
        self._place.update(zip(words, range(base, base + len(words)), strict=True))
        ends = np.cumsum(lengths) + len(self._ids)
        self._start = np.concatenate([self._start, ends - lengths])
        self._length = np.concatenate([self._length, lengths])
        self._ids = np.concatenate([self._ids, ids])

    def _places(self, words: list[str]) -> np.ndarray:
        places = list(map(self._place.get, words))
        fresh = [k for k, p in enumerate(places) if p is None]
        if fresh:
            base = len(self._start)
            self._learn([words[k] for k in fresh])
            for n, k in enumerate(fresh, base):
                places[k] = n
        return np.array(places, np.int64)

    def texts(self, texts: pa.Array) -> Encoded:
        """(ids of all texts in order, offsets of each text's ids); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts, lengths = [], []
        for piece in sliced(texts):
            ids, counts = self._slice(piece)
            parts.append(ids)
            lengths.append(counts)
        offsets = np.zeros(len(texts) + 1, np.int64)
        if parts:
            np.cumsum(np.concatenate(lengths), out=offsets[1:])
        trim()
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), offsets

    def _slice(self, texts: pa.Array) -> Encoded:
        known = len(self._start)
        out = self._looked_up(texts)
        if known >= self._limit:  # full: what this slice added goes again, what came early is mostly what is frequent
            for chunk in list(islice(reversed(self._place), len(self._start) - known)):
                del self._place[chunk]
            self._ids = self._ids[: self._start[known] if known < len(self._start) else None]
            self._start, self._length = self._start[:known], self._length[:known]
        return out

    def _looked_up(self, texts: pa.Array) -> Encoded:
        uncut = pc.match_substring_regex(texts, self._uncut)
        if pc.any(uncut).as_py():
            mask = uncut.to_numpy(zero_copy_only=False)
            whole_ids, whole_counts = self._each(texts.filter(uncut).to_pylist())
            cut_ids, cut_counts = self._cut(texts.filter(pc.invert(uncut)))
            counts = np.zeros(len(texts), np.int64)
            counts[mask], counts[~mask] = whole_counts, cut_counts
            owner = np.repeat(mask, counts)
            ids = np.empty(len(owner), np.uint32)
            ids[owner], ids[~owner] = whole_ids, cut_ids
            return ids, counts
        return self._cut(texts)

    def _cut(self, texts: pa.Array) -> Encoded:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.split_pattern(self._prepare(texts), " ")
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        places = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        bounds = bounds - bounds[0]
        lengths = self._length[places]
        ends = np.cumsum(lengths)
        ids = self._ids[np.repeat(self._start[places] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate([[0], ends])[bounds]
        return ids, np.diff(total)


def sliced(texts: pa.Array, size: int | None = None) -> Iterator[pa.Array]:
    """Slices of about ``size`` bytes (SLICE_BYTES if it isn't given), one text at least."""
    if not len(texts):
        return
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + (size or SLICE_BYTES), "right")))
        yield texts.slice(start, stop - start)
        start = stop


def _flat(encodings: list) -> Encoded:
    lists = [e.ids for e in encodings]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return (np.concatenate([np.array(x, np.uint32) for x in lists]) if lists else np.zeros(0, np.uint32)), lengths


# A comma or full stop after an ASCII letter, and a lone line feed, are always pre-tokens of their own.
def spaced_cut(texts: pa.Array) -> pa.Array:
    """For vocabularies that keep the space before a word."""
    texts = pc.replace_substring_regex(texts, r"([a-z])([.,])", "\\1 \x01\\2")
    texts = pc.replace_substring(texts, "\n", " \x01\n \x01")
    return pc.binary_join_element_wise(pa.scalar("\x01", pa.large_string()), texts, pa.scalar("", pa.large_string()))


def plain_cut(texts: pa.Array) -> pa.Array:
    """For vocabularies that drop white space and turn letters to lower case."""
    texts = pc.replace_substring_regex(texts, r"([a-z])([.,])", r"\1 \2")
    return pc.ascii_lower(pc.replace_substring(texts, "\n", " "))


#: Matches every text.
_EVERY = "(?s)^"
# Pieces that a cut would tear: something before a space, something around a line feed, a letter before a comma or full stop.
_TORN = re.compile("[^ ] |[^\n ]\n|\n[^\n ]|[a-z][.,]")


def byte_alphabet() -> dict[str, int]:
    """The byte behind each printable stand-in in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


def _crossing(pieces: Iterable[str]) -> bool:
    """Whether one of these pieces, in the byte alphabet, can stand across a cut."""
    back = byte_alphabet()
    texts = [bytes(back[c] for c in p if c in back).decode(errors="replace") for p in pieces]
    torn = [t for t in texts if _TORN.search(t)]
    return bool(torn) and not pc.all(pc.match_substring_regex(pa.array(torn), _ODD)).as_py()


def uncut_texts(path: str) -> str:
    """The pattern of texts that may not be cut for the ``tokenizers`` file ``path``: all of them unless its pieces stay within cuts."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    added = [t["content"] for t in file.get("added_tokens", ())]
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in file.get("added_tokens", ())):
        return _EVERY
    steps = file.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers") or [steps]
    byte_level = file["model"]["type"] == "BPE" and steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space")
    end = file["model"].get("end_of_word_suffix") or ""
    if not byte_level or _crossing(piece.removesuffix(end) for piece in file["model"]["vocab"] if piece not in added):
        return _EVERY
    # In any case, as chunks may be made lower case.
    return "|".join([_UNCUT, *(f"(?i:\\Q{content}\\E)" for content in added)])


def bpe_table(path: str) -> ChunkTable:
    """A table over a ``tokenizers`` vocabulary; strings of special tokens in a text get their ids, as the library has it.

    The library works in this thread alone unless TOKENIZERS_PARALLELISM is set: a task has one core.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    # Chunks that start with a space are encoded many at a time, with a mark between them that no chunk holds.
    mark = tokenizer.encode(" \x00", add_special_tokens=False).ids
    spaced = tokenizer.encode(" a", add_special_tokens=False).ids != tokenizer.encode("a", add_special_tokens=False).ids

    def each(texts: list[str]) -> Encoded:
        return _flat(tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def joined(chunks: list[str]) -> Encoded:
        parts = []
        for i in range(0, len(chunks), 4000):  # one encoding at a time: they are far larger than their ids
            parts.append(np.array(tokenizer.encode_batch_fast([" \x00".join(chunks[i : i + 4000]) + " \x00"], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == mark[-1])
        keep = np.ones(len(ids), bool)
        for back in range(len(mark)):
            keep[ends - back] = False
        return ids[keep], np.diff(ends, prepend=-1) - len(mark)

    def encode(chunks: list[str]) -> Encoded:
        if not spaced:
            return joined([f" {c}" for c in chunks])
        mask = np.fromiter((c[:1] == " " for c in chunks), bool, len(chunks))
        lengths = np.zeros(len(chunks), np.int64)
        parts = []
        for own, kind in ((mask, joined), (~mask, each)):
            if own.any():
                ids, lengths[own] = kind([chunks[i] for i in np.flatnonzero(own)])
                parts.append((own, ids))
        owner = np.repeat(mask, lengths)
        out = np.empty(len(owner), np.uint32)
        for own, ids in parts:
            out[owner if own is mask else ~owner] = ids
        return out, lengths

    return ChunkTable(encode, each, spaced_cut if spaced else plain_cut, spaced, uncut=uncut_texts(path))


def piece_table(path: str) -> ChunkTable:
    """A table over a SentencePiece model; where some piece crosses a white-space mark, texts stay whole."""
    model = piece_model(path)
    crossing = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))

    def encode(chunks: list[str]) -> Encoded:
        lists = model.encode(chunks, num_threads=1)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint32, int(lengths.sum())), lengths

    return ChunkTable(encode, encode, lambda texts: texts, False, uncut=_EVERY if crossing else _UNCUT)


_LOADED: dict[tuple[str, str], object] = {}


def loaded(kind: Callable, source: str):
    """One table or model for each worker process; those of other sources go, as a worker serves one operator after another."""
    key = (kind.__name__, source)
    if key not in _LOADED:
        for other in [k for k in _LOADED if k[1] != source]:
            del _LOADED[other]
        trim()
        _LOADED[key] = kind(source)
    return _LOADED[key]


def forget() -> None:
    """Drop the tables that earlier operators left in this worker process; for operators that load none."""
    if _LOADED:
        _LOADED.clear()
        trim()


def piece_model(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)
