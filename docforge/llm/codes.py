"""Directly addressable codes: ids cut into chunk levels, with continuation bitmaps and rank directories.

A number's lowest chunk stands in level 0 at its own position. If more is left, its bit in the level's bitmap
is set and the next chunk stands in the next level, at the position that counts the set bits before
it. The rank directory holds that count for each block of bits, so any number is found by one
lookup per level, without decoding its neighbours.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DACODES1"
WIDTHS = (8, 8, 16)
BLOCK = 512  # bits between two counts of a rank directory
_COUNT = "<Q"


def _pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def encode(ids: np.ndarray) -> bytes:
    """Levels until no number has a rest; each is its size, chunks, bitmap and directory, padded to eight bytes."""
    rest = np.ascontiguousarray(ids, np.uint32)
    parts = [MAGIC, struct.pack(_COUNT, len(rest))]
    for number, width in enumerate(WIDTHS):
        last = number == len(WIDTHS) - 1
        chunk = rest if last else rest & np.uint32((1 << width) - 1)
        above = np.zeros(len(rest), np.uint32) if last else rest >> np.uint32(width)
        more = above > 0
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        directory = np.concatenate([[np.uint64(0)], np.cumsum(counts, dtype=np.uint64)])
        parts += [struct.pack(_COUNT, len(rest)), _pad(chunk.astype(f"<u{width // 8}").tobytes()), _pad(bits.tobytes()), directory.astype("<u8").tobytes()]
        rest = above[more]
        if not len(rest):
            break
    return b"".join(parts)


class Codes:
    """Numbers in an encoded buffer, read in place."""

    def __init__(self, buffer):
        view = memoryview(buffer)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.size = struct.unpack_from(_COUNT, view, 8)[0]
        self.levels, at, count = [], 16, self.size
        for width in WIDTHS:
            count = struct.unpack_from(_COUNT, view, at)[0]
            at += 8
            chunks = np.frombuffer(view, f"<u{width // 8}", count, at)
            at += (chunks.nbytes + 7) // 8 * 8
            bits = np.frombuffer(view, np.uint8, (count + 7) // 8, at)
            at += (bits.nbytes + 7) // 8 * 8
            directory = np.frombuffer(view, "<u8", (count + BLOCK - 1) // BLOCK + 1, at)
            at += directory.nbytes
            self.levels.append((width, chunks, bits, directory))
            if not directory[-1]:
                break
        self.end = at

    def _rank(self, level: int, position: int) -> int:
        """Set bits before ``position``: the directory's count, and at most one block of bits."""
        _, _, bits, directory = self.levels[level]
        block = position // BLOCK
        head = bits[block * BLOCK // 8 : position // 8]
        total = int(directory[block]) + int(np.bitwise_count(head).sum())
        if position % 8:
            total += (int(bits[position // 8]) & ((1 << position % 8) - 1)).bit_count()
        return total

    def __getitem__(self, position: int) -> int:
        if not 0 <= position < self.size:
            raise IndexError(position)
        value = shift = 0
        for level, (width, chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[position]) << shift
            if not bits[position // 8] >> position % 8 & 1:
                break
            shift += width
            position = self._rank(level, position)
        return value

    def read(self, start: int, stop: int) -> np.ndarray:
        """The numbers of a range; each level gives one range of its own."""
        return self._read(0, start, stop).astype(np.uint32)

    def _read(self, level: int, start: int, stop: int) -> np.ndarray:
        width, chunks, bits, _ = self.levels[level]
        values = chunks[start:stop].astype(np.uint32)
        if stop > start and level + 1 < len(self.levels):
            lowest = start // 8
            more = np.unpackbits(bits[lowest : (stop + 7) // 8], bitorder="little")[start - lowest * 8 : stop - lowest * 8].view(bool)
            first = self._rank(level, start)
            above = self._read(level + 1, first, first + int(more.sum()))
            values[more] |= above << np.uint32(width)
        return values
