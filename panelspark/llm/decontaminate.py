"""Benchmark decontamination by spaced-seed hashing.

A fixed mask looks at some positions of a window of tokens and ignores the others, so a
substitution at an ignored position leaves the hash as it was.  Hashes of all windows of
the benchmark and of the documents are joined; around each hit the tokens are compared
along the diagonal, and an overlap that is long and alike enough is a leak.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_schema, record, text_batches
from panelspark.session import materialize

#: 1 is looked at, 0 ignored.  Any overlap of 13 tokens or more of which 80 % are equal
#: holds a window of one of them that is equal where it is looked at: enumerated in a test
#: for 13 to 25 tokens, and a longer one has a half that is as much alike.
MASKS = ("1111011", "1101000111", "1110001101", "1011111")
#: Tokens that an overlap must have, or the whole item if that is shorter.
MIN_OVERLAP = 13
#: Items below this many tokens must be there as they are.
MIN_ITEM = 8
#: Equal tokens of an overlap, in percent.
MIN_EQUAL_PERCENT = 80
#: Tokens on each side of a hit that are compared.
REACH = 64
#: Bits of the table that keeps most windows of clean documents out of the join.
FILTER_BITS = 26

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _marks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it is in a CJK character, and whether it is in a punctuation
    mark or space outside ASCII."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lengths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    single = (points >= 0x2E80) & (points < 0xA000) | (points >= 0xF900) & (points < 0xFB00)
    single |= (points >= 0xFF66) & (points < 0xFFA0) | (points >= 0x20000) & (points < 0x32400)
    apart = (points >= 0x2000) & (points < 0x2070) | (points >= 0x3000) & (points < 0x3005) | (points >= 0x3008) & (points < 0x3021)
    apart |= (points == 0x3030) | (points == 0x303D) | (points == 0x30FB) | (points >= 0xFE30) & (points < 0xFE70)
    apart |= (points >= 0xFF00) & (points < 0xFF66) & ~(
        (points >= 0xFF10) & (points < 0xFF1A) | (points >= 0xFF21) & (points < 0xFF3B) | (points >= 0xFF41) & (points < 0xFF5B)
    )
    return np.repeat(single, lengths), np.repeat(apart, lengths)


def token_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each token: runs of ASCII letters and digits or other non-ASCII
    characters, lower-cased from A-Z; punctuation and white space part tokens.  A Chinese or
    Japanese character is a token of its own."""
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    inside = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    first, last = inside.copy(), inside.copy()
    single = None
    if len(raw) and raw.max() >= 0xE2:
        single, apart = _marks(text)
        inside &= ~apart
        first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if single is not None and single.any():
        single &= inside
        lead = single & ((raw & 0xC0) != 0x80)
        # a CJK character begins a token, as does what comes behind one
        first |= lead
        first[1:] |= inside[1:] & ~single[1:] & single[:-1]
        last[:-1] |= inside[:-1] & first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.empty(0, np.uint64)
    # Horner sums of each token: bytes times the power of their distance to the token's end
    token = np.cumsum(first) - 1
    weight = _powers(int((ends - starts).max()))[(ends[token] - np.arange(len(raw)) - 1) * inside]
    value = (raw.astype(np.uint64) + np.uint64(1)) * weight * inside
    return _scramble(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def whole_masks(n: int, percent: int = MIN_EQUAL_PERCENT) -> list[str]:
    """Masks of ``n`` tokens for items of ``n``: an overlap begins and ends with equal tokens,
    and wherever those between differ that may, some mask ignores them all."""
    wrong = n * (100 - percent) // 100 if n >= MIN_ITEM else 0
    if not wrong:
        return ["1" * n]
    left, out = set(combinations(range(1, n - 1), wrong)), []
    while left:
        hidden = max(combinations(range(1, n - 1), n - 6), key=lambda h: len(left & set(combinations(h, wrong))))
        left -= set(combinations(hidden, wrong))
        out.append("".join("0" if i in hidden else "1" for i in range(n)))
    return out


def all_masks(masks: tuple[str, ...]) -> list[tuple[int, str]]:
    """(item length, mask): those of short items, and with length zero those of all others."""
    return [(0, m) for m in masks] + [(n, m) for n in range(1, MIN_OVERLAP) for m in whole_masks(n)]


def window_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the looked-at tokens of every window, by its first position."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(len(mask)))
    for i, bit in enumerate(mask):
        if bit == "1":
            out = out * _BASE + tokens[i : i + n]
    return _scramble(out)


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    """Two places in the filter table for each hash."""
    return [(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64), (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]


def benchmark_windows(items: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(item_id, pos, mask, hash) of the benchmark; texts without a token have none."""
    known = all_masks(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            for item, text in zip(batch.column("item_id").to_pylist(), texts, strict=True):
                tokens = token_hashes(text)
                for m, (length, mask) in enumerate(known):
                    if length != (len(tokens) if len(tokens) < MIN_OVERLAP else 0):
                        continue
                    h = window_hashes(tokens, mask).view(np.int64)
                    n = len(h)
                    yield pa.record_batch(
                        [pa.array([item] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array([m] * n, pa.int32()), pa.array(h)],
                        ["item_id", "pos", "mask", "hash"],
                    )

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, pos int, mask int, hash long")


def filter_table(windows: DataFrame) -> np.ndarray:
    """A table of ``2 ** FILTER_BITS`` bits with two bits set per hash.

    Its size is fixed (8 MB) whatever the benchmark's; a larger benchmark makes it less
    selective and never wrong, as the join decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _slots(batch.column("hash").to_numpy().view(np.uint64)):
                yield pa.record_batch([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["word", "bit"])

    words = windows.select("hash").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    found = words.toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


def _hits(docs: DataFrame, table: np.ndarray, masks: tuple[str, ...], used: list[int]) -> DataFrame:
    """Stretches of the documents around windows that the filter lets through.

    (doc_id, cluster, first, tokens, at, masks, hashes): windows whose surroundings touch
    share a stretch.  ``used`` are the masks the benchmark has windows of; ``cluster`` tells rows of one doc_id apart.
    """
    ddl = "doc_id long, cluster string, first int, tokens binary, at array<int>, mask array<int>, hash array<long>"
    schema = arrow_schema(ddl)
    known = all_masks(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch, texts in text_batches(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                tokens = token_hashes(text)
                at, which, hashes = [], [], []
                for m in used:
                    length, mask = known[m]
                    h = window_hashes(tokens, mask)
                    if not len(h):
                        continue
                    ok = np.ones(len(h), dtype=bool)
                    for slot in _slots(h):
                        ok &= (table[slot >> 6] >> (slot & 63) & 1).astype(bool)
                    found = np.flatnonzero(ok)
                    if 0 < length < MIN_ITEM:
                        # of equal stretches the first stands for all
                        found = found[np.sort(np.unique(h[found], return_index=True)[1])]
                    at.append(found)
                    which.append(np.full(len(found), m))
                    hashes.append(h[found].view(np.int64))
                if not at or not sum(map(len, at)):
                    continue
                at_, which_, hash_ = map(np.concatenate, (at, which, hashes))
                order = np.argsort(at_, kind="stable")
                at_, which_, hash_ = at_[order], which_[order], hash_[order]
                cuts = np.flatnonzero(np.diff(at_) > 2 * REACH) + 1
                for a, w, h in zip(np.split(at_, cuts), np.split(which_, cuts), np.split(hash_, cuts), strict=True):
                    lo, hi = max(0, int(a[0]) - REACH), min(len(tokens), int(a[-1]) + REACH + 16)
                    rows.append((doc, uuid.uuid4().hex, lo, tokens[lo:hi].tobytes(), a.astype(np.int32), w.astype(np.int32), h))
            if rows:
                yield record(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, least: int, percent: int) -> tuple[int, int, int]:
    """(start in doc, tokens, equal tokens) of the longest alike stretch on a diagonal.

    It begins and ends with equal tokens and ``percent`` of it or more is equal; zeros if
    none has ``least`` tokens.
    """
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    if hi - lo < least:
        return 0, 0, 0
    same = doc[lo:hi] == item[lo - diagonal : hi - diagonal]
    # with gain 100 - percent for equal and -percent for other tokens, a stretch is alike
    # if its sum is not negative: the longest one from prefix sums
    score = np.concatenate(([0], np.cumsum(np.where(same, 100 - percent, -percent))))
    lowest = np.minimum.accumulate(score)
    best = (0, 0, 0)
    ends = np.flatnonzero(same) + 1
    for end in ends[::-1].tolist():
        if end <= best[1]:
            break
        start = int(np.searchsorted(-lowest, -score[end], "left"))
        while start < end and not same[start]:
            start += 1
        if end - start > best[1]:
            best = (lo + start, end - start, int(same[start:end].sum()))
    return best if best[1] >= least else (0, 0, 0)


def _questions(met: DataFrame, items: DataFrame) -> DataFrame:
    """(cluster, asked): a row per stretch, with the items to compare it with.

    ``met`` has (cluster, item_id, at, pos) of equal windows.  All diagonals of a stretch and an
    item are one entry, so neither a stretch nor an item is copied for each of them, however
    repetitive both are.
    """
    diagonals = F.collect_set((F.col("at") - F.col("pos")).cast("long")).alias("diagonals")
    grouped = met.groupBy("cluster", "item_id").agg(diagonals)
    named = grouped.join(items.select("item_id", F.col("text").alias("item")), "item_id")
    return named.groupBy("cluster").agg(F.collect_list(F.struct("item_id", "item", "diagonals")).alias("asked"))


def find_leaks(
    docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, min_overlap: int = MIN_OVERLAP, min_equal_percent: int = MIN_EQUAL_PERCENT
) -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_equal): benchmark passages in documents.

    A row per document and benchmark item, with its longest overlap; ``start`` counts the
    document's tokens.  Items with the same tokens are one: the smallest id stands for all.
    Rows without an id, null and empty texts give nothing, repeated rows of a document one
    row; an empty table on either side gives none.
    """
    items = items.filter("item_id IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id"))
    windows = materialize(benchmark_windows(items, masks), "benchmark-windows")
    table = filter_table(windows)
    used = sorted(r["mask"] for r in windows.select("mask").distinct().collect())
    clusters = materialize(_hits(docs.filter("doc_id IS NOT NULL"), table, masks, used), "spaced-seed-hits")
    hits = clusters.select("cluster", F.explode(F.arrays_zip("at", "mask", "hash")).alias("w"))
    hits = hits.select("cluster", F.col("w.at").alias("at"), F.col("w.mask").alias("mask"), F.col("w.hash").alias("hash"))
    compared = _questions(hits.join(windows, ["mask", "hash"]), items).join(
        clusters.select("cluster", "doc_id", "first", "tokens"), "cluster"
    )
    names = ["doc_id", "item_id", "start", "n_tokens", "n_equal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = []
            columns = (batch.column(c) for c in ("doc_id", "first", "tokens", "asked"))
            for doc, first, tokens, asked in zip(*columns, strict=True):
                stretch, low = np.frombuffer(tokens.as_buffer(), np.uint64), first.as_py()
                for question in asked:
                    name = question["item_id"].as_py()
                    if name not in known:
                        if len(known) > 4096:
                            known.clear()
                        known[name] = token_hashes(question["item"].as_py())
                    item, least = known[name], min(min_overlap, len(known[name]))
                    found = [best_overlap(stretch, item, d - low, least, min_equal_percent) for d in question["diagonals"].values.to_numpy().tolist()]
                    start, size, equal = max(found, key=lambda x: (x[1], x[2], -x[0]))
                    if size:
                        rows.append((doc.as_py(), name, low + start, size, equal))
            if rows:
                yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names)

    leaks = compared.mapInArrow(run, "doc_id long, item_id long, start long, n_tokens long, n_equal long")
    longest = F.max(F.struct("n_tokens", "n_equal", (-F.col("start")).alias("back"))).alias("b")
    best = leaks.groupBy("doc_id", "item_id").agg(longest)
    return best.select(
        "doc_id", "item_id", (-F.col("b.back")).alias("start"), F.col("b.n_tokens").alias("n_tokens"), F.col("b.n_equal").alias("n_equal")
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage is found, with all columns."""
    bad = find_leaks(docs, items).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__leak"], "left_anti")
