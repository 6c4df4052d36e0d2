"""Wavelet matrix over token ids: one bit plane per id bit, with rank and select.

Plane ``l`` holds bit ``bits - 1 - l`` of the ids in the order left by the planes before it; a
plane's zeros go stably before its ones.  So any id is read, counted in a range, or located by
one rank or select per plane, and the whole sequence by undoing the partitions.

``to_bytes`` is the file: magic, id bits, length, zeros per plane, then each plane's
bits compressed.  Rank counts per 64-bit word are rebuilt on opening.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

MAGIC = b"WVM1"


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.zeros, self.planes = n, zeros, planes
        self.bits = len(planes)
        self._ranks: list | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        seq = np.ascontiguousarray(ids, dtype=np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = [], []
        for level in range(bits):
            one = (seq & seq.dtype.type(1 << (bits - 1 - level))) != 0
            planes.append(np.packbits(one, bitorder="little"))
            high = np.compress(one, seq)
            low = np.compress(np.logical_not(one, out=one), seq)
            zeros.append(len(low))
            seq = np.concatenate([low, high])
        return cls(len(ids), zeros, planes)

    def to_bytes(self) -> bytes:
        packed = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in self.planes]
        head = struct.pack(f"<4sBQ{self.bits}Q{self.bits}Q", MAGIC, self.bits, self.n, *self.zeros, *map(len, packed))
        return head + b"".join(packed)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        magic, bits, n = struct.unpack_from("<4sBQ", blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = struct.calcsize("<4sBQ")
        zeros = list(struct.unpack_from(f"<{bits}Q", blob, at))
        sizes = struct.unpack_from(f"<{bits}Q", blob, at + 8 * bits)
        at += 16 * bits
        planes = []
        for s in sizes:
            raw = pa.decompress(blob[at: at + s], decompressed_size=(n + 7) // 8, codec="zstd", asbytes=True) if n else b""
            planes.append(np.frombuffer(raw, np.uint8))
            at += s
        return cls(n, zeros, planes)

    def decode(self) -> np.ndarray:
        """All ids."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            up = np.empty(self.n, kind)
            up[~one] = cur[:z]
            up[one] = cur[z:] | kind(1 << (self.bits - 1 - level))
            cur = up
        return cur

    def _rank_table(self):
        if self._ranks is None:
            self._ranks = []
            for p in self.planes:
                words = np.zeros((len(p) + 7) // 8 + 1, np.uint64)
                words.view(np.uint8)[: len(p)] = p
                before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
                self._ranks.append((words, before))
        return self._ranks

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        words, before = self._rank_table()[level]
        return int(before[i >> 6]) + (int(words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            word = int(self._rank_table()[level][0][i >> 6])
            bit = word >> (i & 63) & 1
            ones = self._ones(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if token >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences in [a, b)."""
        if token >> self.bits:
            return 0
        x, y = self._range(token, a, self.n if b is None else b)
        return y - x

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        a, b = self._range(token, 0, self.n) if not token >> self.bits else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._find(level, i - self.zeros[level] if bit else i, bit)
        return i

    def _find(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th bit of this value in a plane."""
        words, before = self._rank_table()[level]
        counts = before if bit else np.arange(len(before)) * 64 - before
        w = int(np.searchsorted(counts, k, side="right")) - 1
        word = int(words[w]) if bit else ~int(words[w]) & (1 << 64) - 1
        for _ in range(k - int(counts[w])):
            word &= word - 1
        return w * 64 + (word & -word).bit_length() - 1

    def occurrences(self, token: int, limit: int | None = None) -> list[int]:
        n = self.count(token)
        return [self.select(token, k) for k in range(n if limit is None else min(n, limit))]
