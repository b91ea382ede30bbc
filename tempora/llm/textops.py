"""Vectorised text primitives shared by the operators of this subpackage.

Texts reach a task as Arrow string arrays.  They are viewed as one UTF-8 byte buffer
with document offsets, so that words, lines, rolling hashes and anchors come from a few
numpy passes and no Python loop runs per word.  Nothing here touches Spark.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
CHUNK_BYTES = 1 << 20  # small temporaries: a task holds a few dozen arrays of this many elements

_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C17)
_BASE_INV = U(pow(int(_BASE), -1, 2**64))
_WBASE = U(0xD6E8FEB86659FD97)
_WBASE_INV = U(pow(int(_WBASE), -1, 2**64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow_cache: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown and kept per process."""
    key = int(base)
    got = _pow_cache.get(key)
    if got is None or len(got) < n:
        size = max(n, CHUNK_BYTES + (1 << 18))
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.cumprod(got, out=got)
        if size <= 2 * CHUNK_BYTES:  # those of a very long text are not kept
            _pow_cache[key] = got
    return got[:n]


def give_back() -> None:
    """Memory that a reused worker no longer holds goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except AttributeError:  # other C libraries
    _TRIM = None


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on 64-bit words (a bijection)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def as_strings(col) -> pa.Array:
    """A plain string array (int32 offsets) without nulls: null texts count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return col.fill_null("") if col.null_count else col


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut (without copying) into runs of rows of about ``limit`` bytes in one column."""
    for b in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size.astype(np.int64))
        i, n = 0, b.num_rows
        while i < n:
            before = end[i - 1] if i else 0
            j = min(n, max(i + 1, int(np.searchsorted(end, before + limit, "right"))))
            yield b.slice(i, j - i)
            i = j
        give_back()


def chunks(col, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole documents of about ``limit`` bytes."""
    col = as_strings(col)
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    give_back()


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the documents of a chunk: byte ranges and per-document bounds."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        n = len(buf)
        ns = ~SPACE[buf]
        st, en = ns.copy(), ns.copy()
        if n:
            st[1:] &= ~ns[:-1]
            en[:-1] &= ~ns[1:]
            first = offs[:-1][np.diff(offs) > 0]
            st[first] = ns[first]
            last = offs[1:][np.diff(offs) > 0] - 1
            en[last] = ns[last]
        self.buf, self.offs = buf, offs
        self.start, self.end = np.flatnonzero(st), np.flatnonzero(en) + 1
        self.bounds = np.searchsorted(self.start, offs)  # words of document d: bounds[d]:bounds[d+1]
        self.count = np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return range_hash(prefix_hash(LOWER[self.buf] if lower else self.buf), self.start, self.end)

    def code_points(self) -> np.ndarray:
        c = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=c[1:])
        return c[self.end] - c[self.start]


def word_counts(col) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(Words(buf, offs).count for _, _, buf, offs in chunks(col))])


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=h[1:])
    return h


def gram_order(h: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit value for each run of n bytes (from its prefix hashes) by which minima are taken."""
    m = max(0, len(h) - n)
    x = (h[n:] - h[:m]) * powers(_BASE_INV, len(h))[:m]
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return (x >> U(32)).astype(np.uint32)


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range [start, end), independent of where it lies."""
    inv = powers(_BASE_INV, len(h))
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64) * U(0xA0761D6478BD642F))


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (runs over document borders included)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_WBASE, len(words)), out=h[1:])
    m = len(words) - n + 1
    return mix((h[n:] - h[:m]) * powers(_WBASE_INV, m) + U(n))


def windows_inside(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for each window start whose n units lie in one document."""
    m = max(0, total - n + 1)
    bad = np.zeros(m + 1, np.int32)
    ends = bounds[1:]
    lo = np.maximum(ends - n + 1, bounds[:-1])
    keep = lo < ends
    np.add.at(bad, np.minimum(lo[keep], m), 1)
    np.add.at(bad, np.minimum(ends[keep], m), -1)
    return np.cumsum(bad)[:m] == 0


def salted(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h + (doc.astype(np.uint64) + U(1)) * U(0x9FB21C651E98DF25))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        s = keys[order]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(keys), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[order] = hit
    return out


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for each unit inside a window of n units that begins at one of ``starts``."""
    d = np.zeros(total + 1, np.int32)
    d[starts] += 1  # starts are distinct
    d2 = np.bincount(np.minimum(starts + n, total), minlength=total + 1)[: total + 1]
    return np.cumsum(d - d2)[:total] > 0


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum of v[i:i+w] for each i with a whole window; v: 32-bit values."""
    m = len(v) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    # value above index: the least word has the least value, and the leftmost place among equals
    best, have = (v.astype(np.uint64) << U(32)) | np.arange(len(v), dtype=np.uint64), 1
    while have < w:
        step = min(have, w - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return (best & U(0xFFFFFFFF)).astype(np.int64)[:m]
