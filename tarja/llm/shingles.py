"""Sets of five-word shingles of many texts at a time."""

from __future__ import annotations

import numpy as np

from .hashing import RangeDigest, U, mix

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the sorted distinct shingles of row i are hashes[starts[i]:starts[i + 1]].

    A text of one to four words has one shingle, all of them; one without words has none."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, dtype=U), np.zeros(rows + 1, dtype=np.int64)
    low = _LOWER[data]
    inside = np.concatenate([[False], _IN_WORD[low], [False]])
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    here, before = inside[1:], inside[:-1]
    begins = np.flatnonzero(here[:-1] & (~before[:-1] | first[:-1]))
    ends = np.flatnonzero(before & (~here | first))
    words = RangeDigest(low)(begins, ends)
    row = np.searchsorted(offsets, begins, side="right") - 1
    count = np.bincount(row, minlength=rows)
    n = len(words)
    if n >= WORDS:
        h = np.zeros(n - WORDS + 1, dtype=U)
        for k in range(WORDS):
            h = mix(h + words[k : n - WORDS + 1 + k])
        whole = row[: n - WORDS + 1] == row[WORDS - 1 :]
        h, of = h[whole], row[: n - WORDS + 1][whole]
    else:
        h, of = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    few = np.flatnonzero((count > 0) & (count < WORDS))
    if len(few):
        at = np.concatenate([[0], np.cumsum(count)])
        short = np.array([_sequence(words[at[i] : at[i + 1]]) for i in few], dtype=U)
        h, of = np.concatenate([h, short]), np.concatenate([of, few])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))])


def _sequence(words: np.ndarray) -> int:
    h = np.full(1, len(words), dtype=U)
    for w in words:
        h = mix(h * U(3) + w)
    return int(h[0])


def set_digests(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set."""
    zero = np.zeros(1, dtype=U)
    a = np.concatenate([zero, np.cumsum(mix(h), dtype=U)])
    b = np.concatenate([zero, np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=U)])
    n = np.diff(starts).astype(U)
    return mix(a[starts[1:]] - a[starts[:-1]] + n), mix(b[starts[1:]] - b[starts[:-1]] + n * U(7))
