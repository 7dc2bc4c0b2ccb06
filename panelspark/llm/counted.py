"""Numbers of occurrences of hashes, counted in Spark, kept as sorted hash arrays.

Tasks count what they meet and send it on packed, a shard of the hash range at a time;
every shard is merged by one task and written as arrays that workers map.  A shard's size
is set by the caller's number of shards, so neither tasks nor driver grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from panelspark.llm.arrays import mapped, write_arrays
from panelspark.llm.common import sorted_groups
from panelspark.session import materialize, new_path

#: Hashes a task gathers before it counts and sends them on.
GATHERED = 2_000_000


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def share(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the upper half of a hash, evenly and in its order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(planes(steps) + planes(counts.astype("<u8")))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(16, -1)
    steps, counts = (np.ascontiguousarray(raw[a : a + 8].T).view("<u8").ravel() for a in (0, 8))
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.concatenate([h for h, _ in held])
    if not len(hashes):
        return hashes, np.empty(0, np.int64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], np.concatenate([n for _, n in held])[order]
    heads = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[heads], np.add.reduceat(counts, heads)


class Counted:
    """Counted hashes by shards of the hash range; workers map them as they look up."""

    def __init__(self, paths: list[str], sizes: list[int], total: int, bits: int):
        self.paths, self.total, self.bits = paths, total, bits
        self.bases = np.append(0, np.cumsum(sizes)).astype(np.int64)

    @property
    def size(self) -> int:
        return int(self.bases[-1])

    def maps(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of a shard; without a path it is empty."""
        if not self.paths[s]:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return mapped(self.paths[s], ("hash", "<u8"), ("count", "<u8"))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): a hash's place among all, or their number and 0 if it is unknown."""
        wanted, inverse = np.unique(_cut(hashes, self.bits), return_inverse=True)
        ids = np.full(len(wanted), self.size, np.int64)
        counts = np.zeros(len(wanted), np.int64)
        cuts = np.searchsorted(share(wanted, len(self.paths)), np.arange(len(self.paths) + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            known, number = self.maps(s)
            if not len(known):
                continue
            part = wanted[cuts[s] : cuts[s + 1]]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            met = np.flatnonzero(known[at] == part)
            ids[cuts[s] + met] = self.bases[s] + at[met]
            counts[cuts[s] + met] = number[at[met]]
        return ids[inverse], counts[inverse]


def _cut(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The hashes with only their upper ``bits`` kept."""
    return hashes if bits >= 64 else hashes & ~np.uint64((1 << (64 - bits)) - 1)


def count_values(
    df: DataFrame,
    found: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]],
    shards: int,
    bits: int = 64,
    least: int = 1,
    name: str = "counts",
) -> Counted:
    """Counts the hashes that ``found`` draws from the rows; kept are those met ``least`` times.

    With fewer ``bits`` hashes that agree in their upper bits are counted together, so a
    count is never too small.
    """
    folder = new_path(df.sparkSession, name)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            hashes, counts = _summed(held)
            cuts = np.searchsorted(share(hashes, shards), np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                blob = _pack(hashes[cuts[s] : cuts[s + 1]], counts[cuts[s] : cuts[s + 1]])
                yield pa.record_batch([pa.array([s], pa.int32()), pa.array([blob], pa.binary())], ["shard", "data"])

        for hashes in found(batches):
            held.append(np.unique(_cut(hashes, bits), return_counts=True))
            if sum(len(h) for h, _ in held) > GATHERED:
                held = [_summed(held)]
                if len(held[0][0]) > GATHERED // 2:
                    yield from out()
                    held = []
        if held:
            yield from out()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), table in sorted_groups(batches, ["shard"]):
            hashes, counts = _summed([_unpack(b.as_py()) for b in table.column("data")])
            total = int(counts.sum())
            kept = counts >= least
            path = write_arrays(folder, f"{shard:06d}", {"hash": hashes[kept].astype("<u8"), "count": counts[kept].astype("<u8")})
            yield pa.record_batch([pa.array([shard], pa.int32()), *[pa.array([x]) for x in (path, int(kept.sum()), total)]], ["shard", "path", "size", "total"])

    blobs = df.mapInArrow(count, "shard int, data binary").repartition(shards, "shard").sortWithinPartitions("shard")
    stored = materialize(blobs.mapInArrow(store, "shard int, path string, size long, total long"), name)
    rows = {r.shard: r for r in stored.collect()}  # a row per shard
    paths = [rows[s].path if s in rows else "" for s in range(shards)]
    sizes = [rows[s]["size"] if s in rows else 0 for s in range(shards)]
    return Counted(paths, sizes, sum(r.total for r in rows.values()), bits)
