"""A wavelet matrix over token ids in one compressed file.

Plane by plane from the highest bit, the file holds that bit of every token; after each plane the tokens with a 0
come before those with a 1, each part in its former order.  Planes are cut into blocks of ``BLOCK_BITS``, each
compressed by itself and listed with its place and with the ones before it, so that a rank reads one block of each
plane and a token, a count or an occurrence needs no more than that.

Layout (little endian): magic ``LSWM``, version, bits of an id, number of tokens, number of documents, length of
the directory; the compressed directory (document ids, whether an id is null, tokens of each document, zeros of each
plane, place and ones-before of each block); the blocks.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC, VERSION, BLOCK_BITS = b"LSWM", 1, 1 << 18
_HEAD = struct.Struct("<4sHHqqq")


def build(ids: np.ndarray, doc_ids: np.ndarray, doc_null: np.ndarray, doc_sizes: np.ndarray) -> bytes:
    """The file of the tokens ``ids`` (unsigned), which belong to the documents in turn."""
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    a = ids.astype(np.uint16 if bits <= 16 else np.uint32, copy=True)
    pack = zstandard.ZstdCompressor(level=1)
    zeros, places, before, blocks, at = [], [0], [], [], 0
    for b in range(bits - 1, -1, -1):
        bit = (a & a.dtype.type(1 << b)) != 0
        flat = np.packbits(bit, bitorder="little")
        ones = 0
        for i in range(0, len(flat), BLOCK_BITS // 8):
            part = flat[i : i + BLOCK_BITS // 8]
            data = pack.compress(part.tobytes())
            blocks.append(data)
            at += len(data)
            places.append(at)
            before.append(ones)
            ones += int(np.bitwise_count(part).sum())
        zeros.append(n - ones)
        a = np.concatenate((np.compress(~bit, a), np.compress(bit, a)))
    directory = pack.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in (doc_ids.astype("<i8"), doc_sizes.astype("<i8"), np.array(zeros, "<i8"), np.array(places, "<i8"), np.array(before, "<i8"), doc_null.astype(np.uint8))))
    return b"".join([_HEAD.pack(MAGIC, VERSION, bits, n, len(doc_ids), len(directory)), directory, *blocks])


class WaveletFile:
    """Access, counting and occurrence lookup in a file's bytes (or a memory map of them)."""

    def __init__(self, data: bytes | memoryview) -> None:
        magic, version, self.bits, self.n, docs, size = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        self.per_plane = -(-self.n // BLOCK_BITS)
        blocks = self.bits * self.per_plane
        raw = zstandard.ZstdDecompressor().decompress(bytes(data[_HEAD.size : _HEAD.size + size]))
        longs = np.frombuffer(raw, "<i8", 2 * docs + self.bits + 2 * blocks + 1)
        self.doc_ids, self.doc_sizes, self.zeros, self.places, self.before = np.split(longs, np.cumsum([docs, docs, self.bits, blocks + 1]))
        self.doc_null = np.frombuffer(raw, np.uint8, docs, 8 * len(longs)).astype(bool)
        self.body, self.data = _HEAD.size + size, data
        self._block = lru_cache(maxsize=4 * self.bits)(self._load)

    def _bytes(self, block: int) -> np.ndarray:
        a, z = self.body + self.places[block], self.body + self.places[block + 1]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(self.data[a:z])), np.uint8)

    def _load(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bytes and, for each, the ones before it in its plane."""
        part = self._bytes(block)
        return part, np.concatenate(([0], np.cumsum(np.bitwise_count(part), dtype=np.int64))) + self.before[block]

    def _bit(self, plane: int, i: int) -> int:
        part, _ = self._block(plane * self.per_plane + i // BLOCK_BITS)
        k = i % BLOCK_BITS
        return int(part[k >> 3]) >> (k & 7) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        part, ranks = self._block(plane * self.per_plane + i // BLOCK_BITS)
        k = i % BLOCK_BITS
        return int(ranks[k >> 3]) + (int(part[k >> 3]) & ((1 << (k & 7)) - 1)).bit_count()

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) 1 or 0 of a plane."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The i-th token."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            bit = self._bit(p, i)
            ones = self._ones(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, a: int, z: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            x, y = self._ones(p, a), self._ones(p, z)
            if token >> (self.bits - 1 - p) & 1:
                a, z = int(self.zeros[p]) + x, int(self.zeros[p]) + y
            else:
                a, z = a - x, z - y
        return a, z

    def count(self, token: int, a: int = 0, z: int | None = None) -> int:
        """How often a token stands in places a to z (past the last)."""
        x, y = self._range(token, a, self.n if z is None else z)
        return y - x

    def occurrences(self, token: int, a: int = 0, z: int | None = None) -> list[int]:
        """The places of a token, ascending."""
        x, y = self._range(token, a, self.n if z is None else z)
        out = []
        for i in range(x, y):
            for p in range(self.bits - 1, -1, -1):
                one = token >> (self.bits - 1 - p) & 1
                i = self._select(p, one, i - int(self.zeros[p]) if one else i)
            out.append(i)
        return out

    def decode(self) -> np.ndarray:
        """All tokens: from the last plane up, each plane's order is undone."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            flat = b"".join(self._bytes(p * self.per_plane + k).tobytes() for k in range(self.per_plane))
            bit = np.unpackbits(np.frombuffer(flat, np.uint8), count=self.n, bitorder="little").view(bool)
            z = int(self.zeros[p])
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~bit)] = a[:z]
            out[np.flatnonzero(bit)] = a[z:] | kind(1 << (self.bits - 1 - p))
            a = out
        return a
