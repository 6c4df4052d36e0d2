"""Repeated strings of at least a given length in a small collection, from its Burrows-Wheeler transform.

Common-prefix lengths are found breadth-first by increasing value: boundaries between suffixes
that differ at depth d give, by one backward extension with every symbol, the boundaries at
depth d + 1.  The search stops at the minimum length; neighbours without a boundary by then share
that many bytes.  Memory follows the collection, which the caller bounds.
"""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the first ``depth`` symbols (or more) of their suffixes, by doubling."""
    n = len(codes)
    bits = int(codes.max()).bit_length()
    k = max(1, 62 // bits)
    k = 1 << (k.bit_length() - 1)
    key = np.zeros(n, np.uint64)
    for j in range(k):
        part = np.zeros(n, np.uint64)
        if j < n:
            part[: n - j] = codes[j:]
        key = (key << np.uint64(bits)) | part
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.uint64)
        step = np.empty(n, np.uint64)
        step[0] = 1
        step[1:] = s[1:] != s[:-1]
        np.cumsum(step, out=step)
        if k >= depth or step[-1] == n:
            return order
        rank[order] = step
        key = rank * np.uint64(n + 1)
        key[: n - k] += rank[k:]
        k *= 2


class Occurrences:
    """rank(symbol, position) over a sequence, as one bit vector per symbol with block counts."""

    def __init__(self, seq: np.ndarray, symbols: int):
        blocks = (len(seq) >> 6) + 1
        self.words = np.zeros((symbols, blocks), np.uint64)
        pos = np.arange(len(seq))
        for c in range(symbols):
            p = pos[seq == c]
            np.bitwise_or.at(self.words[c], p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.zeros((symbols, blocks), np.int32)
        np.cumsum(counts[:, :-1], axis=1, out=self.before[:, 1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """(symbols, len(at)) occurrences before each position."""
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[:, block] + np.bitwise_count(self.words[:, block] & mask)


def repeated_starts(strings: list[bytes], min_len: int) -> list[np.ndarray]:
    """For each string the offsets at which ``min_len`` bytes begin that also begin elsewhere in
    the collection.  A string never runs into the next one; an empty collection gives []."""
    m = len(strings)
    if m == 0:
        return []
    lens = np.array([len(x) for x in strings], np.int64)
    ends = np.cumsum(lens + 1) - 1
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    n = len(text)
    stop = np.zeros(n, bool)
    stop[ends] = True
    present = np.unique(text[~stop]) if n > m else np.zeros(0, np.uint8)
    dense = np.zeros(256, np.int64)
    dense[present] = np.arange(len(present))
    sym = dense[text]
    sigma = len(present)
    # separators are distinct and come first
    codes = sym + m
    codes[ends] = np.arange(m)
    order = suffix_order(codes, min_len)
    prev = order - 1
    bwt = np.where((prev >= 0) & ~stop[prev], sym[prev], sigma)
    occ = Occurrences(bwt, sigma)
    total = np.bincount(sym[~stop], minlength=sigma)
    block = m + np.cumsum(total) - total
    known = np.zeros(n + 1, bool)
    known[: m + 1] = True
    known[block] = True
    known[n] = True
    new = np.unique(np.concatenate([np.arange(m + 1), block]))
    new = new[new < n]
    for _ in range(1, min_len):
        if len(new) == 0:
            break
        found = []
        for a in range(0, len(new), 1 << 13):
            image = (block[:, None] + occ.rank(new[a: a + (1 << 13)])).ravel()
            image = image[~known[image]]
            known[image] = True
            found.append(image)
        new = np.unique(np.concatenate(found))
    same = np.flatnonzero(~known[1:n]) + 1
    hit = np.zeros(n, bool)
    hit[order[same]] = True
    hit[order[same - 1]] = True
    at = np.flatnonzero(hit)
    cut = np.searchsorted(at, np.concatenate([[0], ends + 1]))
    begin = ends - lens
    return [at[cut[i]: cut[i + 1]] - begin[i] for i in range(m)]
