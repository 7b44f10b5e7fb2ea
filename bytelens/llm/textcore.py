"""Words and hashes of whole Arrow text columns in numpy, a bounded chunk at a time.

Texts are taken as UTF-8 bytes. Every word definition in use classes all bytes from 0x80 up alike, so
classing bytes equals classing characters. Hashes are 64-bit polynomials over a random byte table; where
a result must be exact, callers compare the bytes or count on 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
MUL_A, MUL_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODE = BYTE_CODE[LOWER]

#: Word bytes: digits, a-z (after lower-casing) and everything from 0x80.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Word bytes: all but the ASCII blanks.
NONBLANK = np.ones(256, bool)
NONBLANK[[0x20, *range(0x09, 0x0E)]] = False

_pow = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _pow:
        out = []
        for b in (BASE, BASE_INV):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        if size > 4 * CHUNK:  # one very long text; not worth keeping
            return out[0], out[1]
        _pow[size] = tuple(out)
    return _pow[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MUL_A
    h = (h ^ (h >> np.uint64(27))) * MUL_B
    return h ^ (h >> np.uint64(31))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column in one byte array, and each row's bounds. Null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of the rows [lo, hi) of (data, offs): bounds within data, 64-bit hashes, rows' word bounds."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int, table: np.ndarray, lower: bool = True):
        self.base = int(offs[lo])
        self.buf = buf = data[self.base : offs[hi]]
        cuts = offs[lo : hi + 1] - self.base
        n = len(buf)
        inside = table[buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = cuts[:-1][cuts[:-1] < n]
        first[heads] = inside[heads]
        last = inside
        last = last.copy()
        last[:-1] &= ~inside[1:]
        tails = cuts[1:][cuts[1:] > 0] - 1
        last[tails] = inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, cuts)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((LOWER_CODE if lower else BYTE_CODE)[buf] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; row borders are the caller's."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= BASE
        out += hashes[j : j + n]
    return mix(out)


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a word sequence shorter than a shingle; its length takes part."""
    out = np.uint64(len(hashes) * 0x632BE59BD9B4E019 % (1 << 64))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = out * BASE + h
    return mix(np.array([out]))[0]
