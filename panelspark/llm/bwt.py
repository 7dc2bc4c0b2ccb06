"""Column-wise construction of the Burrows-Wheeler transform of many strings.

Each round inserts one symbol of every string, from its end to its start, into the
transform and into the array of longest common prefixes of all suffixes so far.  Both
live in files that a round reads and writes once, in order.
"""

from __future__ import annotations

import tempfile
from typing import BinaryIO

import numpy as np


class _Column:
    """An array kept in an open file: read as a whole in order, replaced as a whole.

    It only grows, so it is written over in place.  A file that is emptied and written
    again is sent to the disk each time it is closed, which a round would wait for.
    """

    def __init__(self, file: BinaryIO, values: np.ndarray) -> None:
        self.file, self.kind = file, values.dtype
        self.write(values)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.fromfile(self.file, dtype=self.kind)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        values.tofile(self.file)


def _range_min(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """min(values[start:stop]) of each non-empty range."""
    order = np.argsort(-starts)  # falling starts: the gaps between ranges cost nothing
    at = np.empty(2 * len(starts), np.int64)
    at[::2], at[1::2] = starts[order], stops[order]
    padded = np.append(values, values.dtype.type(0))
    out = np.empty(len(starts), values.dtype)
    out[order] = np.minimum.reduceat(padded, at)[::2]
    return out


def _merge(old: np.ndarray, stays: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``old`` in its order at the places ``stays`` of the result, ``new`` at the places ``at``."""
    out = np.empty(len(stays), old.dtype)
    out[stays], out[at] = old, new
    return out


def build(symbols: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of the strings ``symbols[end - length:end]``.

    Symbols are bytes; in the transform they are shifted by one and 0 is the end mark, so
    the first ``n`` entries belong to the empty suffixes.  Strings have 1 to 254 bytes.
    """
    n = len(ends)
    kind = np.uint8 if int(symbols.max()) < 255 else np.uint16
    with tempfile.TemporaryFile(prefix="bwt-", buffering=0) as first, tempfile.TemporaryFile(prefix="lcp-", buffering=0) as second:
        bwt = _Column(first, symbols[ends - 1].astype(kind) + kind(1))
        lcp = _Column(second, np.zeros(n, np.uint8))
        place = np.arange(n)
        for j in range(1, int(lengths.max()) + 1):
            active = np.flatnonzero(lengths >= j)
            b, common = bwt.read(), lcp.read()
            order = np.argsort(b, kind="stable")
            rank = np.empty(len(b), np.int32)
            rank[order] = np.arange(len(b), dtype=np.int32)
            done = int(np.count_nonzero(b == 0))
            p = place[active]
            r, c = rank[p].astype(np.int64), b[p]
            before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(b) - 1)]
            has_before, has_after = (r > 0) & (b[before] == c), (r + 1 < len(b)) & (b[after] == c)
            near = np.zeros(2 * len(p), np.uint8)  # the common prefixes with what is before, and what is after
            has = np.concatenate((has_before, has_after))
            if has.any():
                starts, stops = np.concatenate((before, p))[has] + 1, np.concatenate((p, after))[has] + 1
                near[has] = 1 + _range_min(common, starts, stops)
            own, nxt = near[: len(p)], near[len(p) :]
            at = r - done + n
            more = lengths[active] > j
            symbol = np.zeros(len(p), kind)
            symbol[more] = symbols[ends[active[more]] - j - 1].astype(kind) + kind(1)
            stays = np.ones(len(b) + len(at), dtype=bool)
            stays[at] = False
            merged = _merge(b, stays, at, symbol)
            prefixes = _merge(common, stays, at, own)
            follows = at + 1 < len(prefixes)
            prefixes[at[follows] + 1] = nxt[follows]
            prefixes[at] = own
            bwt.write(merged)
            lcp.write(prefixes)
            place[active] = at
        return bwt.read(), lcp.read()


def shared_windows(
    symbols: np.ndarray, ends: np.ndarray, lengths: np.ndarray, owners: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the ``width``-byte windows that a string with a smaller owner also has."""
    b, common = build(symbols, ends, lengths)
    n = len(ends)
    order = np.argsort(b, kind="stable")
    rank = np.empty(len(b), np.int64)
    rank[order] = np.arange(len(b))
    step = rank - np.count_nonzero(b == 0) + n
    group = np.cumsum(common < width) - 1
    least = np.full(len(b), np.iinfo(np.int64).max)
    for mark in (True, False):
        place, active, found = np.arange(n), np.arange(n), []
        for j in range(1, int(lengths.max()) + 1):
            active = active[lengths[active] >= j]
            place[active] = step[place[active]]
            if j < width:
                continue
            if mark:
                least[place[active]] = owners[active]
            else:
                hit = active[smallest[group[place[active]]] < owners[active]]
                found.append((hit, lengths[hit] - j))
        if mark:
            smallest = np.minimum.reduceat(least, np.flatnonzero(common < width))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
