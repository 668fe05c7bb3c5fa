"""Directly addressable codes: any id of a sequence without decoding a block.

An id is cut into 8-bit chunks, lowest first; chunk ``k`` of every id that has
one lies in level ``k``, in order.  A bitmap beside each level says whether an
id goes on, and a rank directory (ones before every 512 bits) turns a position
in one level into the position in the next with one lookup and one popcount.

Layout, little-endian: ``DAC1``, u32 levels, u64 ids; then for each level u64
entries, the chunk bytes, the bitmap (lowest bit first), the u32 rank directory.

Edge cases: no ids are one level without entries; there are no nulls among ids; an id outside
the sequence is an IndexError, a slice is cut to it; other bytes are refused.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512


def encode(ids: np.ndarray) -> bytes:
    """Codes of an unsigned 32-bit array (which may be empty)."""
    rest = np.ascontiguousarray(ids, np.uint32)
    parts, levels = [], 0
    while levels == 0 or len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        directory = np.concatenate([[0], np.cumsum(per_block)]).astype("<u4")
        parts += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), directory.tobytes()]
        rest = rest[more] >> 8
        levels += 1
    return b"".join([MAGIC, struct.pack("<IQ", levels, len(ids)), *parts])


class Codes:
    """Reader over the bytes that ``encode`` made; nothing is decoded up front."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        levels, self._n = struct.unpack_from("<IQ", data, 4)
        self._levels, at = [], 16
        for _ in range(levels):
            (count,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, count, at)
            at += count
            bits = np.frombuffer(data, np.uint8, -(-count // 8), at)
            at += len(bits)
            directory = np.frombuffer(data, "<u4", -(-count // BLOCK) + 1, at)
            at += directory.nbytes
            self._levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return self._n

    def _rank(self, level: int, position: int) -> int:
        _, bits, directory = self._levels[level]
        block = position // BLOCK
        ones = int(directory[block])
        first, last = block * BLOCK // 8, position // 8
        ones += int.from_bytes(bits[first:last].tobytes(), "little").bit_count()
        if position % 8:
            ones += (int(bits[last]) & ((1 << position % 8) - 1)).bit_count()
        return ones

    def __getitem__(self, position: int) -> int:
        if not 0 <= position < self._n:
            raise IndexError(position)
        value = 0
        for level, (chunks, bits, _) in enumerate(self._levels):
            value |= int(chunks[position]) << 8 * level
            if not bits[position // 8] >> position % 8 & 1:
                break
            position = self._rank(level, position)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids of positions ``start`` to ``stop`` (exclusive), found by rank at both ends."""
        start, stop = max(0, start), min(self._n, stop)
        out = np.zeros(max(0, stop - start), np.uint32)
        live = np.arange(len(out))
        for level, (chunks, bits, _) in enumerate(self._levels):
            if stop <= start:
                break
            out[live] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            first = start // 8 * 8
            more = np.unpackbits(bits[first // 8 : -(-stop // 8)], bitorder="little")[start - first : stop - first].astype(bool)
            live = live[more]
            start = self._rank(level, start)
            stop = start + len(live)
        return out
