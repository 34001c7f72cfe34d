"""Vectorised text primitives over Arrow string buffers (numpy, no per-word
Python objects). Words are maximal runs of bytes other than space and
0x09-0x0D; those separators are ASCII, so bytes of UTF-8 can be scanned
directly. Hashes are 64-bit: equal words always hash alike, different ones
differ but for a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
SHINGLE = 5
_COEF = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
#: Text bytes handled at a time; bounds the eight-byte temporaries.
PIECE = 4 << 20
BLOCK = 1 << 19

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            step = np.full(n, base, dtype=np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes; a longer text is alone."""
    _, offsets = buffers(texts)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string or binary array without nulls."""
    n = len(texts)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    _, off, data = texts.buffers()
    if n == 0 or off is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=kind, count=n + 1, offset=texts.offset * width).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def no_nulls(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.fill_null("") if texts.null_count else texts


def lowered(raw: np.ndarray) -> np.ndarray:
    return LOWER[raw]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n+1 word offsets by text."""
    if not len(buf):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    solid = ~SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    first[at] = solid[at]
    at = offsets[1:][full] - 1
    last[at] = solid[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, *ends: np.ndarray):
    """64-bit hashes of byte spans given in ascending order of start; with
    several arrays of ends, a tuple of hash arrays that share the starts."""
    out = [np.empty(len(starts), dtype=np.uint64) for _ in ends]
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + BLOCK)))
        stop = max(int(e[i:j].max()) for e in ends)
        power, inverse = _tables(stop - base + 1)
        total = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf[base:stop]] * power[: stop - base], out=total[1:])
        s = starts[i:j] - base
        for o, end in zip(out, ends):
            e = end[i:j] - base
            o[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out[0] if len(out) == 1 else tuple(out)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in text order, and n+1 offsets. A
    text with fewer words has its whole sequence as one; without words, none."""
    coef = _COEF if size <= len(_COEF) else mix(np.arange(1, size + 1, dtype=np.uint64)) | U64(1)
    counts = np.diff(offsets)
    n_out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_off = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(n_out, out=out_off[1:])
    out = np.empty(int(out_off[-1]), dtype=np.uint64)
    if len(words) >= size:
        runs = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for k in range(size):
            runs += words[k : k + len(runs)] * coef[k]
        at = np.repeat(offsets[:-1] - out_off[:-1], n_out) + np.arange(len(out))
        whole = np.repeat(counts >= size, n_out)
        out[whole] = runs[at[whole]]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        part = words[offsets[d] : offsets[d + 1]]
        tag = U64(len(part) * 0x2545F4914F6CDD1D % 2**64)
        out[out_off[d]] = np.append(part * coef[: len(part)], tag).sum(dtype=np.uint64)
    return mix(out), out_off


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each slice, and their n+1 offsets."""
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    keep[heads] = True
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(keep, out=total[1:])
    return values[keep], total[offsets]


def words_of(texts: pa.Array, lower: bool = True):
    """(bytes, word starts, word ends, word offsets, word hashes) of a string
    array without nulls."""
    raw, offsets = buffers(texts)
    buf = lowered(raw) if lower else raw
    starts, ends, at = word_spans(buf, offsets)
    return buf, starts, ends, at, span_hashes(buf, starts, ends)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each slice (0 for an empty one); pairwise within the slice."""
    out = np.zeros(len(offsets) - 1, dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out
