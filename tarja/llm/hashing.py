"""Vectorised hashing of byte strings: any range of a buffer in constant time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BATCH_BYTES = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(16, int(n).bit_length()))[:n]


def run_keys(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit key for each range of k bytes. Equal bytes give equal keys; unlike ones may share a key (the
    polynomial is modulo 2^64), so a key only says what is worth comparing."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(INVERSE, n + 1)[: n + 1 - k])


PRIME = (1 << 31) - 1
#: Two bases modulo PRIME. Unlike strings of n bytes agree under both for at most (n / PRIME) ** 2 of all pairs of bases.
BASES = (0x3C6EF35F, 0x2545F491)
#: From here on sums of products could pass 64 bits and are reduced first.
LONG = 1 << 24


@cache
def _prime_powers(base: int, bits: int) -> np.ndarray:
    out = np.ones(1, dtype=U)
    while len(out) < 1 << bits:
        out = np.concatenate([out, out * U(pow(base, len(out), PRIME)) % U(PRIME)])
    return out


def prime_powers(base: int, n: int) -> np.ndarray:
    return _prime_powers(base, max(16, int(n).bit_length()))[:n]


class RangeDigest:
    """Digest of data[a:b] for arrays a, b, from two polynomials modulo a prime and the length; equal
    bytes give equal digests wherever they stand, and no pattern of bytes makes unlike ones meet."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        own = data.astype(U) + U(1)
        self.sums, self.back = [], []
        for base in BASES:
            terms = own * prime_powers(base, n)
            sums = np.zeros(n + 1, dtype=U)
            np.cumsum(terms % U(PRIME) if n > LONG else terms, out=sums[1:])
            self.sums.append(sums)
            self.back.append(prime_powers(pow(base, -1, PRIME), n + 1))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        one, two = ((s[b] - s[a]) % U(PRIME) * back[a] % U(PRIME) for s, back in zip(self.sums, self.back, strict=True))
        return mix(mix((one << U(31)) | two) + (b - a).astype(U))


def text_slices(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows of about ``most`` bytes, for strings or binaries; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, whole[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
