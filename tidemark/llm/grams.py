"""Vectorised text helpers used inside tasks.

A slice of an Arrow string column is seen as one byte array with document
offsets.  Words, word hashes, word n-gram hashes and byte n-gram hashes of the
whole slice are computed with a handful of numpy passes, so no Python code
runs per word.  Hashes are 64-bit polynomial hashes over randomised byte
values, finished with a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 0xD6E8FEB86659FD93
#: bytes of text handled at once; a longer document is handled alone
SLICE_BYTES = 2 << 20

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("p", BASE), ("i", INVERSE)):
            t = np.full(size, base, dtype=U64)
            t[0] = 1
            _powers[key] = np.cumprod(t, dtype=U64)
    return _powers["p"], _powers["i"]


def lower_ascii_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_ascii_table()
#: words of ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _byte_values(fold: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U64) * U64(STEP))
    return v[LOWER] if fold else v


VALUES = {True: _byte_values(True), False: _byte_values(False)}


def as_text(column) -> pa.Array:
    """One string array without nulls (null texts become empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; document d is bytes[offsets[d]:offsets[d+1]]."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, dtype=np.int64 if large else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of a batch with at most SLICE_BYTES of text (one row at least)."""
    col = as_text(batch.column(text))
    _, offs = text_bytes(col)
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, len(batch))
        data, o = text_bytes(col.slice(lo, hi - lo))
        yield batch.slice(lo, hi - lo), data, o
        lo = hi


def prefix_sums(data: np.ndarray, fold: bool) -> np.ndarray:
    """sums[j] - sums[i], times BASE**-i, hashes bytes i to j."""
    p, _ = _power_table(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(VALUES[fold][data] * p[:len(data)], dtype=U64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = _power_table(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts])


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray,
               fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and for each document the
    number of its first word (one more entry at the end)."""
    cls = is_word[LOWER[data]] if fold else is_word[data]
    n = len(cls)
    before = np.zeros(n, dtype=bool)
    after = np.zeros(n, dtype=bool)
    before[1:] = cls[:-1]
    after[:-1] = cls[1:]
    cut = offs[:-1][offs[:-1] < offs[1:]]
    before[cut] = False
    after[offs[1:][offs[:-1] < offs[1:]] - 1] = False
    starts = np.flatnonzero(cls & ~before)
    ends = np.flatnonzero(cls & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i+k-1 for every i that has k words after it."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = words[:m].copy()
    for j in range(1, k):
        h *= U64(STEP)
        h += words[j:j + m]
    return mix(h)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's k-word shingles; a document of
    fewer words has its whole word sequence as the only one, one without words none."""
    starts, ends, first = word_spans(data, offs, NOT_SPACE)
    words = span_hashes(prefix_sums(data, True), starts, ends)
    grams = ngram_hashes(words, k)
    out = []
    for d in range(len(offs) - 1):
        lo, hi = first[d], first[d + 1]
        if hi - lo >= k:
            g = np.sort(grams[lo:hi - k + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif hi > lo:
            out.append(ngram_hashes(words[lo:hi], int(hi - lo)) ^ U64(hi - lo))
        else:
            out.append(np.zeros(0, U64))
    return out


def byte_gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of bytes i to i+q-1 for every i with q bytes after it in the slice."""
    if len(data) < q:
        return np.zeros(0, U64)
    sums = prefix_sums(data, False)
    _, inv = _power_table(len(sums))
    m = len(data) - q + 1
    return mix((sums[q:] - sums[:m]) * inv[:m])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for every i, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[:n], m[w - span:w - span + n])
