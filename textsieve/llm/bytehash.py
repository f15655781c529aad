"""Vectorised hashing of UTF-8 bytes inside Arrow batches: substrings and words, without a Python object for each.

A substring's hash is a polynomial over 64-bit values drawn per byte, modulo 2^64, from prefix sums; equal bytes have
equal hashes, whatever block they lie in. Two different words of a corpus collide with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
VALUES = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
BASES = [0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: for [^\x20\x09-\x0D]+, and for [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (which has no upper case).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i below n."""
    if which not in _powers or len(_powers[which][0]) < n:
        m = max(n, BLOCK + 1)
        base, inverse = BASES[which], pow(BASES[which], -1, 2**64)
        out = []
        for b in (base, inverse):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[which] = (out[0], out[1])
    return _powers[which]


def prefix(b: np.ndarray, which: int = 0) -> np.ndarray:
    """s such that (s[j] - s[i]) * inverse power i is the hash of b[i:j]."""
    s = np.empty(len(b) + 1, np.uint64)
    s[0] = 0
    np.cumsum(VALUES[which][b] * powers(which, len(b) + 1)[0][: len(b)], out=s[1:])
    return s


def substring(s: np.ndarray, i: np.ndarray, j: np.ndarray, which: int = 0) -> np.ndarray:
    return (s[j] - s[i]) * powers(which, len(s))[1][i]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and its offsets (n + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column if column.null_count == 0 else pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str | int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `most` bytes of a text column (a longer text is a part of its own)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True, spans: bool = False, prefixes: tuple[int, ...] = ()):
    """(hash, document) of every word in order; with spans also each word's bytes from and to, in data.

    With prefixes the hash is a row per length more: of the word's first so many bytes, or of all if it has no more.
    """
    hashes, owners, froms, tos = [], [], [], []
    for lo, hi in _cuts(data, offsets, is_word):
        b = data[lo:hi]
        b = LOWER[b] if lower else b
        w = is_word[b]
        first = w.copy()
        first[1:] &= ~w[:-1]
        last = w.copy()
        last[:-1] &= ~w[1:]
        k = np.searchsorted(offsets, lo, "left"), np.searchsorted(offsets, hi, "left")
        edge = offsets[k[0] : k[1]] - lo
        edge = edge[(edge > 0) & (edge < len(b))]
        first[edge] |= w[edge]
        last[edge - 1] |= w[edge - 1]
        i, j = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = prefix(b)
        h = mix(substring(sums, i, j))
        hashes.append(np.stack([h, *(np.where(j - i > n, mix(substring(sums, i, np.minimum(i + n, j)) + np.uint64(n)), h) for n in prefixes)]) if prefixes else h)
        owners.append(np.searchsorted(offsets, i + lo, "right") - 1)
        if spans:
            froms.append(i + lo)
            tos.append(j + lo)
    join = lambda xs, t: np.concatenate(xs, -1) if xs else np.empty(0, t)
    out = join(hashes, np.uint64) if hashes or not prefixes else np.empty((1 + len(prefixes), 0), np.uint64), join(owners, np.int64)
    return (*out, join(froms, np.int64), join(tos, np.int64)) if spans else out


def _cuts(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of about BLOCK bytes that end between words (a longer word makes a longer block)."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + BLOCK, n)
        if hi < n:
            k = int(np.searchsorted(offsets, hi, "right")) - 1  # the last document that begins at or before hi
            if offsets[k] > lo + BLOCK // 2:
                hi = int(offsets[k])
            else:
                while hi < n and is_word[LOWER[data[hi - 1]]]:
                    hi += 1
        yield lo, hi
        lo = hi
