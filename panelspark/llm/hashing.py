"""Words and word shingles as 64-bit hashes, computed on the bytes of whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text that is hashed at once.
PIECE = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (public splitmix constants)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A random number for every byte; A-Z as a-z, white space 0."""
    values = mix(np.arange(256))
    values[65:91] = values[97:123]
    values[[32, *range(9, 14)]] = 0
    return values


def _place_factors(n: int) -> np.ndarray:
    """An odd random number for every place in a word."""
    return mix(np.arange(1 << 10, (1 << 10) + n)) | np.uint64(1)


_VALUES, _FACTORS = _byte_values(), _place_factors(256)
def word_hashes(raw: np.ndarray, cuts: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words per text) of texts that lie in ``raw`` between ``cuts``.

    A hash is the sum over the word's bytes of byte number times place number, mixed.
    Words are taken ``step`` bytes at a time, so a very long text costs no wide arrays.
    """
    full = np.ones(256, bool)
    full[[32, *range(9, 14)]] = False
    full = full[raw]
    starts = full.copy()
    starts[1:] &= ~full[:-1]
    heads = cuts[:-1][cuts[:-1] < cuts[1:]]
    starts[heads] = full[heads]
    at = np.flatnonzero(starts)
    per_text = np.diff(np.searchsorted(at, cuts))
    found = np.empty(len(at), np.uint64)
    begin = 0
    while begin < len(at):
        stop = max(begin + 1, int(np.searchsorted(at, at[begin] + step)))
        low, high = at[begin], at[stop] if stop < len(at) else len(raw)
        part = at[begin:stop] - low
        place = np.arange(high - low) - np.repeat(part, np.diff(np.append(part, high - low)))
        used = int(place[full[low:high]].max()) + 1
        factors = _FACTORS if used <= len(_FACTORS) else _place_factors(used)
        products = _VALUES[raw[low:high]] * factors[np.minimum(place, len(factors) - 1)]
        lengths = np.add.reduceat(full[low:high], part, dtype=np.uint64)
        found[begin:stop] = mix(np.add.reduceat(products, part) + lengths)
        begin = stop
    return found, per_text


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, cuts between them), some MB at a time; null is empty."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary()).fill_null(b"")
        lengths = pa.compute.binary_length(text).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            part = text.slice(start, stop - start)
            raw = np.frombuffer(b"".join(part.to_pylist()), np.uint8)
            yield batch.slice(start, stop - start), raw, np.append(0, np.cumsum(lengths[start:stop])).astype(np.int64)
            start = stop


def shingles(words: np.ndarray, per_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of ``size`` words, repeats included, shingles per text).

    A text of fewer words has its whole sequence as the only one, one without words none.
    """
    factors = _place_factors(size)
    sums = np.zeros(len(words), np.uint64)
    for i in range(min(size, len(words))):
        sums[: len(words) - i] += words[i:] * factors[i]
    ends = np.cumsum(per_text)
    begins = ends - per_text
    left = np.repeat(ends, per_text) - np.arange(len(words))
    first = left >= size
    for t in np.flatnonzero((per_text > 0) & (per_text < size)).tolist():
        part = words[begins[t] : ends[t]]
        sums[begins[t]] = (part * factors[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
        first[begins[t]] = True
    return mix(sums[first]), np.where(per_text >= size, per_text - size + 1, np.minimum(per_text, 1))
