"""Two-stage suffix sorting of chosen suffixes of a text, and their common prefixes."""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray, reach: int) -> np.ndarray:
    """The 8 bytes at every place as a big-endian number; zeros follow the end, ``reach`` more places long."""
    padded = np.concatenate([text, np.zeros(reach + 8, np.uint8)]).astype(np.uint64)
    out = padded[: len(text) + reach].copy()
    for k in range(1, 8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor. The empty suffix is the least."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    change = np.flatnonzero(text[:-1] != text[1:])
    if len(change):
        nxt = np.searchsorted(change, np.arange(change[-1] + 1))
        at = change[nxt]
        out[: change[-1] + 1] = text[at] < text[at + 1]
    return out


def sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes' first ``depth`` bytes: words one after another, ties alone go on."""
    key = words[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    for d in range(8, depth, 8):
        tied = same | np.concatenate([same[1:], [False]])
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(~same)[where]
        sub = at[where]
        key = words[sub + d]
        order = np.lexsort((key, group))
        at[where] = sub[order]
        key = key[order]
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (group[1:] == group[:-1])])
        same[where] = again
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """The ``wanted`` places, in an order that puts suffixes with ``depth`` bytes in common side by side.

    Only suffixes smaller than their successors are sorted directly. Every other one is placed
    when the scan over the buckets of first bytes comes to its successor. So the wanted suffixes
    and, up to the next one that is sorted directly, their successors are enough.
    """
    if words is None:
        words = words_at(text, depth + 8)
    n = len(text)
    up = rising(text)
    member = np.zeros(n + 1, bool)
    member[wanted] = True
    at = wanted[~up[wanted]] + 1
    while len(at):
        at = at[at < n]
        at = at[~member[at]]
        member[at] = True
        at = at[~up[at]] + 1
    member[n] = False
    places = np.flatnonzero(member)
    direct = sort_directly(words, places[up[places]], depth)
    induced = np.bincount(text[places[~up[places]]], minlength=256)
    sizes = induced + np.bincount(text[direct], minlength=256)
    start = np.concatenate([[0], np.cumsum(sizes)])
    head = start[:-1].copy()
    out = np.zeros(len(places), np.int64)
    first = text[direct]
    offset = start[:-1] + induced - np.concatenate([[0], np.cumsum(np.bincount(first, minlength=256))[:-1]])
    out[offset[first] + np.arange(len(direct))] = direct

    def induce(block: np.ndarray) -> None:
        before = block - 1
        before = before[before >= 0]
        before = before[member[before] & ~up[before]]
        if not len(before):
            return
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        counts = np.bincount(byte, minlength=256)
        rank = np.arange(len(byte)) - (np.cumsum(counts) - counts)[byte]
        out[head[byte] + rank] = before
        head[:] += counts

    if n:
        induce(np.array([n]))
    for c in np.flatnonzero(sizes):
        done = start[c]
        while done < head[c]:
            block = out[done : head[c]].copy()
            done = head[c]
            induce(block)
        induce(out[start[c] + induced[c] : start[c + 1]])
    keep = np.zeros(n, bool)
    keep[wanted] = True
    return out[keep[out]]


def common_prefix(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, counted up to ``depth``."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for d in range(0, depth, 8):
        if not len(live):
            break
        differ = words[order[live] + d] ^ words[order[live - 1] + d]
        zero = differ == 0
        out[live[zero]] += 8
        rest = differ[~zero]
        # Equal leading bytes: those above the highest set bit.
        high = np.zeros(len(rest), np.int64)
        for s in (32, 16, 8):
            big = rest >> np.uint64(s) != 0
            rest = np.where(big, rest >> np.uint64(s), rest)
            high += big * (s // 8)
        out[live[~zero]] += 7 - high
        live = live[zero]
    return np.minimum(out, depth)
