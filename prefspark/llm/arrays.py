"""Helpers shared by the operators: UTF-8 buffers of Arrow text columns as numpy arrays,
word boundaries and word hashes over whole buffers, packed arrays in binary columns.

Everything here works on one batch inside a Spark task; memory is bounded by the chunk
(``CHUNK_BYTES`` of text, or one document when it is longer).
"""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1


def worker_cache(name: str, make):
    """A value kept for the life of the Python worker (package code is pickled by value, so
    module globals would be rebuilt for every task)."""
    home = sys.modules.setdefault("_prefspark_llm_worker", types.ModuleType("_prefspark_llm_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset: col.offset + len(col) + 1] if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and what their allocators
    keep would add up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another libc
        pass


def releasing(run):
    """``run`` (batches -> batches) that releases memory when its task ends."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return whole


def text_chunks(batches, column: str = "text", chunk_bytes: int = CHUNK_BYTES):
    """Slices of record batches of at most ``chunk_bytes`` of text (one row at least), as
    (slice, bytes, offsets).  Memory is released after the last one."""
    try:
        yield from _text_chunks(batches, column, chunk_bytes)
    finally:
        release()


def _text_chunks(batches, column: str, chunk_bytes: int):
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        data, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(off, off[a] + chunk_bytes, side="right")) - 1)
            b = min(b, n)
            yield batch.slice(a, b - a), data[off[a]: off[b]], off[a: b + 1] - off[a]
            a = b


def _tables():
    rng = np.random.default_rng(20240611)
    return rng.integers(0, 1 << 63, size=256, dtype=np.uint64) * U64(2) + U64(1)


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value per byte."""
    return worker_cache("byte_values", _tables)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier and of its inverse modulo 2**64."""
    home = worker_cache("powers", lambda: {})
    if len(home.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + CHUNK_BYTES // 8)
        for key, base in (("p", _MULT), ("q", pow(_MULT, -1, 1 << 64))):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            home[key] = np.multiply.accumulate(t)
    return home["p"][:n], home["q"][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h + U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; see ``span_hash``."""
    p, _ = powers(len(data))
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(byte_values()[data] * p, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    _, q = powers(max(1, len(sums)))
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    def make():
        t = np.arange(256, dtype=np.uint8)
        t[65:91] += 32
        return t
    return worker_cache("lower_table", make)[data]


def _not_blank() -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def _alphanumeric() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


def word_spans(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as (starts, ends, document index); documents never share a word.
    ``plain``: words of ASCII letters, digits and bytes beyond ASCII only, without punctuation."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = (worker_cache("plain_bytes", _alphanumeric) if plain else worker_cache("word_bytes", _not_blank))[data]
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cuts = offsets[1:-1]
    first[cuts[cuts < n]] = True
    first &= inside
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cuts[cuts > 0] - 1] = True
    last &= inside
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def doc_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets into a sorted document index: rows of document i are [b[i], b[i + 1])."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + l)``."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


def table(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)


def packed(x: np.ndarray) -> bytes:
    """A length-prefixed compressed array of unsigned integers."""
    raw = x.astype("<u8").tobytes() if x.dtype.itemsize == 8 else x.astype(f"<u{x.dtype.itemsize}").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    if size == 0:
        return np.zeros(0, dtype)
    return np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype)


def range_cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted 64-bit keys change from one of ``parts`` equal ranges to the next."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def byte_planes(x: np.ndarray) -> np.ndarray:
    """The bytes of unsigned integers, all lowest ones first; compresses small values well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).ravel()


def from_planes(planes: np.ndarray, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()
