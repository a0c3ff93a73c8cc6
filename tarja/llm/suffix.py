"""Suffix arrays by two-stage sorting, with array operations.

Stage one sorts only the suffixes that are smaller than their successors. Stage two scans the
buckets of first bytes in ascending order and places every other suffix behind those already
placed in its bucket, in the order in which their successors come up.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_LOW, _HIGH = U(0x0101010101010101), U(0x8080808080808080)


def words(text: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes at every position as one number, so that numbers sort as bytes do."""
    padded = np.concatenate([text, np.zeros(room + 8, dtype=np.uint8)])
    return np.ndarray(len(text) + room, dtype=">u8", buffer=padded, strides=(1,)).astype(U)


def _has_end(w: np.ndarray) -> np.ndarray:
    return ((w - _LOW) & ~w & _HIGH) != 0


def _sort_directly(at: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` bytes, eight at a time; only ties go on."""
    key = w[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    for d in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        open_ = np.flatnonzero(tied & ~_has_end(key))
        if not len(open_):
            break
        group = np.cumsum(new)[open_]
        k = w[at[open_] + d]
        order = np.lexsort((k, group))
        at[open_] = at[open_][order]
        k = k[order]
        key = np.zeros(len(at), dtype=U)
        key[open_] = k
        fresh = np.ones(len(open_), dtype=bool)
        fresh[1:] = (k[1:] != k[:-1]) | (group[1:] != group[:-1])
        new[open_] |= fresh
    return at


def suffix_array(text: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """All positions of ``text`` (bytes from 1; 0 ends each string and the whole) in the order of
    their first ``depth`` bytes up to a 0."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    change = np.append(change, n - 1)
    rises = np.zeros(len(change), dtype=bool)
    rises[:-1] = text[change[:-1] + 1] > text[change[:-1]]
    smaller = np.repeat(rises, np.diff(np.append(-1, change)))
    ends = text == 0
    direct = _sort_directly(np.flatnonzero(smaller & ~ends), w, depth)
    cut = np.searchsorted(text[direct], np.arange(257))
    arriving: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        if c == 0:
            bucket = np.flatnonzero(ends)
        else:
            parts = list(arriving[c])
            now = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            parts = [now]
            while len(now):  # a run of equal bytes: each round places the bytes one further left
                now = now[now > 0] - 1
                now = now[text[now] == c]
                parts.append(now)
            bucket = np.concatenate([*parts, direct[cut[c] : cut[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = text[before]
        larger = byte > c
        before, byte = before[larger], byte[larger]
        if len(before):
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            for a, z in zip(first, np.append(first[1:], len(byte)), strict=True):
                arriving[byte[a]].append(before[a:z])
    return np.concatenate(out)


def repeated(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, where in it a piece of ``length`` bytes starts that also starts elsewhere in
    the strings: positions whose common prefix with a neighbour in the suffix array is that long."""
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), dtype=np.uint8) + np.uint8(1)
    w = words(text, length + 8)
    order = suffix_array(text, w, length)
    left, right = order[:-1], order[1:]
    same = np.arange(len(left))
    for d in range(0, length, 8):
        a = w[left[same] + d]
        rest = length - d
        mask = U(0xFFFFFFFFFFFFFFFF) if rest >= 8 else U((1 << 64) - (1 << (64 - 8 * rest)))
        equal = (a & mask) == (w[right[same] + d] & mask)
        if rest >= 8:
            equal &= ~_has_end(a)
        else:
            equal &= ~_has_end(a | ~mask)
        same = same[equal]
    found = np.zeros(len(text), dtype=bool)
    found[left[same]] = True
    found[right[same]] = True
    ends = np.cumsum([len(s) + 1 for s in strings])
    return [np.flatnonzero(found[z - len(s) - 1 : z]) for s, z in zip(strings, ends, strict=True)]
