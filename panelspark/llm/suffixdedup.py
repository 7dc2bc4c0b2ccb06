"""Substring deduplication over the collection's Burrows-Wheeler transform.

Texts are cut where their windows' minimizers change: all windows of ``WIDTH`` bytes that
have the same leftmost smallest seed go into one short string, so equal windows of any two
documents land in the same bucket, whatever surrounds them.  A bucket holds each distinct
string once, with its smallest document; the strings that may share a window with another
one form a collection whose transform and common prefixes are built column by column
(``bwt.py``), and intervals of common prefixes of ``WIDTH`` or more give the smallest
document of each window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.bwt import shared_windows
from panelspark.llm.common import arrow_schema, record, sorted_groups
from panelspark.session import materialize

WIDTH = 50
SEED = 8
#: Bytes of text that are cut, or whose strings are hashed, at once.
CUT_BYTES = 250_000
#: Bytes of text whose strings go to the buckets together.
PORTION_BYTES = 16_000_000
#: Bytes of text for which there is a bucket, at least.
BUCKET_BYTES = 2_000_000
#: Strings of one collection, unless a single seed has more.
COLLECTION = 4_000
#: Bytes of packed strings in a record batch.
BATCH_BYTES = 4_000_000
_SHORT = 24  # low bits of a window's key: its place
_LENGTH = 26  # low bits of a span: its length
_REST = WIDTH - SEED
_HALF = (_REST + 1) // 2
_STEP = 7  # by so many bytes the two sides of a seed are shifted to tell partners

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPREAD = np.uint64(0x94D049BB133111EB)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def _words(data: np.ndarray) -> np.ndarray:
    """The ``SEED`` bytes from each place on, as one number."""
    return np.ndarray(max(0, len(data) - SEED + 1), "<u8", data, strides=(1,)).astype(np.uint64)


def _stretch_keys(words: np.ndarray, start: np.ndarray, length: np.ndarray | int, salt: np.ndarray | int = 0) -> np.ndarray:
    """64-bit hashes of stretches of ``SEED`` bytes or more; the last word of one ends with it.

    Each word is mixed before it joins the hash.  Else two words that differ in their last
    bytes only could make up for each other, as in a text that repeats a few letters.
    """
    key = np.zeros(len(start), np.uint64) + np.asarray(length).astype(np.uint64)
    key = _scramble(key + (np.asarray(salt).astype(np.uint64) << np.uint64(8)) + _ODD)
    for at in range(0, int(np.max(length, initial=0)), SEED):
        word = words[start + np.minimum(at, length - SEED)]
        word += _ODD
        key ^= _scramble(word)
        key *= _SPREAD
        key ^= key >> np.uint64(32)
    return _scramble(key)


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches one after the other."""
    stops = np.cumsum(lengths)
    at = np.arange(int(stops[-1]) if len(stops) else 0, dtype=np.int64)
    return data[at + np.repeat(starts - (stops - lengths), lengths)]


def cut(data: np.ndarray, unit_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, anchor, seed hash) of the strings of a buffer of texts laid end to end; and its words.

    Every window inside a text lies in exactly one string; ``anchor`` is the place of its
    seed in the string.  Windows with equal bytes have equal seeds at equal places.
    """
    words = _words(data)
    n = len(data) - WIDTH + 1
    low = _scramble(words)
    low &= ~np.uint64((1 << _SHORT) - 1)
    low |= np.arange(len(low), dtype=np.uint64)
    span, covered = WIDTH - SEED + 1, 1
    while 2 * covered <= span:
        low = np.minimum(low[:-covered], low[covered:])
        covered *= 2
    low = np.minimum(low[:n], low[span - covered : span - covered + n])
    place = (low & np.uint64((1 << _SHORT) - 1)).astype(np.int32)
    del low
    starts = np.concatenate(([0], unit_ends[:-1]))
    last = np.repeat(unit_ends - WIDTH, unit_ends - starts)[:n]
    valid = np.arange(n) <= last
    first = valid.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    end = valid.copy()
    end[:-1] &= first[1:] | ~valid[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(end)
    return a, b - a + WIDTH, place[a] - a, _scramble(words[place[a]]) >> np.uint64(_SHORT), words


def _smallest_owner(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each row, a row of each class, smallest owner of each class)."""
    order = np.argsort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    heads = np.flatnonzero(new)
    classes = np.empty(len(keys), np.int64)
    classes[order] = np.cumsum(new) - 1
    return classes, order[heads], np.minimum.reduceat(owners[order], heads)


def _planes(values: np.ndarray) -> bytes:
    """Differences of 64-bit integers, their first bytes first: what is zero packs to nothing."""
    gaps = np.diff(values, prepend=0).astype("<i8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes, n: int, at: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def _spans(docs: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(docs, pa.int64()), pa.array((start << _LENGTH) + length, pa.int64())], ["doc_id", "span"])


def _runs(docs: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the stretches that meet or overlap in rows one after the other."""
    stop = start + length
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (start[1:] < start[:-1]) | (start[1:] > stop[:-1])
    heads = np.flatnonzero(new)
    return docs[heads], start[heads], np.maximum.reduceat(stop, heads) - start[heads]


_PIECES = "bucket int, doc_id long, span long, packed binary"
_PIECE_SCHEMA = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("span", pa.int64()), ("packed", pa.binary())])


def _pieces(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed strings by bucket, and spans that are already known to fall.

    Of equal strings in one portion of text only those of the smallest document go on; the
    others fall in any case.  So a passage of a third of all documents travels once a portion.
    """

    def strings(units: list[tuple[int, int, bytes]]) -> tuple:
        """(text, start, length, anchor, seed hash, key, document, place in it) of the strings of texts."""
        raw = b"".join(u[2] for u in units)
        sizes = np.array([len(u[2]) for u in units])
        ends = np.cumsum(sizes)
        start, length, anchor, seed, words = cut(np.frombuffer(raw, np.uint8), ends)
        key = _stretch_keys(words, start, length, anchor)
        unit = np.searchsorted(ends, start, "right")
        at = start - (ends - sizes)[unit] + np.array([u[1] for u in units])[unit]
        return raw, start, length.astype(np.uint8), anchor.astype(np.uint8), seed, key, np.array([u[0] for u in units])[unit], at

    def portion(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        raw = b"".join(h[0] for h in held)
        base = np.cumsum([0, *(len(h[0]) for h in held)])
        start = np.concatenate([h[1] + b for h, b in zip(held, base[:-1], strict=True)])
        length, anchor, seed, key, owner, at = (np.concatenate([h[i] for h in held]) for i in range(2, 8))
        held.clear()
        classes, _, least = _smallest_owner(key, owner)
        falls = owner > least[classes]
        bucket = (_scramble(seed) % np.uint64(buckets)).astype(np.int32)
        del seed, key, classes
        if falls.any():
            docs, *known = _spans(*_runs(owner[falls], at[falls], length[falls].astype(np.int64)))
            # these need no bucket of their own; by document they spread evenly
            spread = (_scramble(docs.to_numpy().astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(spread), docs, *known, pa.nulls(len(docs), pa.binary())], schema=_PIECE_SCHEMA)
        stays = np.flatnonzero(~falls)
        stays = stays[np.argsort(bucket[stays], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[stays])) + 1
        press = zstandard.ZstdCompressor(level=3)
        named, packed, size = [], [], 0

        def batch() -> pa.RecordBatch:
            m = len(named)
            return pa.RecordBatch.from_arrays(
                [pa.array(named, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(packed, pa.binary())], schema=_PIECE_SCHEMA
            )

        for rows in np.split(stays, cuts):
            if not len(rows):
                continue
            head = np.array([len(rows)], "<i8").tobytes()
            meta = (_planes(owner[rows]), _planes(at[rows]), length[rows].tobytes(), anchor[rows].tobytes())
            texts = map(raw.__getitem__, map(slice, start[rows].tolist(), (start[rows] + length[rows]).tolist()))
            named.append(int(bucket[rows[0]]))
            packed.append(press.compress(b"".join((head, *meta, *texts))))
            size += len(packed[-1])
            if size >= BATCH_BYTES:
                yield batch()
                named, packed, size = [], [], 0
        yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, held, size, total = [], [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer()
                whole = len(raw) if raw is not None and doc is not None else 0
                for a in range(0, whole - WIDTH + 1, CUT_BYTES):
                    part = bytes(raw[a : a + CUT_BYTES + WIDTH - 1])
                    units.append((doc, a, part))
                    size += len(part)
                    if size >= CUT_BYTES:
                        held.append(strings(units))
                        total += size
                        units, size = [], 0
                    if total >= PORTION_BYTES:
                        yield from portion(held)
                        held, total = [], 0
        if units:
            held.append(strings(units))
        if held:
            yield from portion(held)

    # rows without an id or a text are passed over in the task: a filter here would keep
    # Spark from using the shuffle of the texts again
    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def _unpack(packed: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """(owner, place, length, anchor, bytes) of all strings of a bucket."""
    parts: list[tuple] = []
    opener = zstandard.ZstdDecompressor()
    for blob in packed.drop_null():
        raw = opener.decompress(blob.as_buffer())
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        parts.append(
            (
                _from_planes(raw, n, 8),
                _from_planes(raw, n, 8 + 8 * n),
                np.frombuffer(raw, np.uint8, n, 8 + 16 * n).astype(np.int64),
                np.frombuffer(raw, np.uint8, n, 8 + 17 * n).astype(np.int64),
                np.frombuffer(raw, np.uint8, offset=8 + 18 * n),
            )
        )
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(5))


def _keys(data: np.ndarray, start: np.ndarray, length: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, key of the seed and half the rest to its left, to its right, seed), a part of the strings at a time.

    The halves of strings that have none are of no use.
    """
    heads = np.searchsorted(start, np.arange(0, len(data) + CUT_BYTES, CUT_BYTES))
    for a, b in zip(heads[:-1], heads[1:], strict=True):
        if a == b:
            continue
        base = start[a]
        words = _words(data[base : start[b - 1] + length[b - 1]])
        at, size, seed = start[a:b] - base, length[a:b], anchor[a:b]
        left, right = np.maximum(seed - _HALF, 0), np.minimum(seed, size - SEED - _HALF)
        yield (
            _stretch_keys(words, at, size, seed),
            _stretch_keys(words, at + left, SEED + _HALF),
            _stretch_keys(words, at + right, SEED + _HALF),
            words[at + seed],
        )


def _with_others(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Which rows have the key of a row of another owner."""
    order = np.argsort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    heads = np.flatnonzero(new)
    mixed = np.minimum.reduceat(owners[order], heads) < np.maximum.reduceat(owners[order], heads)
    found = np.empty(len(keys), dtype=bool)
    found[order] = np.repeat(mixed, np.diff(np.append(heads, len(keys))))
    return found


def _partners(length: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which strings may share a window with one of another document.

    A shared window holds the seed and, on one side of it, at least half of the rest, so
    two such strings agree on the seed with that half to the left or to the right.
    """
    found = np.zeros(len(length), dtype=bool)
    for has, keys in ((anchor >= _HALF, left), (length - anchor >= SEED + _HALF, right)):
        rows = np.flatnonzero(has)
        if len(rows):
            found[rows[_with_others(keys[rows], owner[rows])]] = True
    return found


def _close_partners(data: np.ndarray, length: np.ndarray, anchor: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The same more closely, with what is missing from a window on one side of the seed on the other.

    The bytes of a shared window to the left of its seed, at most ``_REST``, are taken in
    steps; two such strings agree on a step to the left and on what a window with less than
    one step more has at least to the right.
    """
    words, start = _words(data), np.cumsum(length) - length
    found = np.zeros(len(length), dtype=bool)
    for left in range(0, _REST + 1, _STEP):
        right = max(0, _REST - left - _STEP + 1)
        rows = np.flatnonzero((anchor >= left) & (length - anchor >= SEED + right))
        if len(rows):
            keys = _stretch_keys(words, start[rows] + anchor[rows] - left, left + SEED + right)
            found[rows[_with_others(keys, owner[rows])]] = True
    return found


def _judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The spans that fall of one bucket."""
    known = table.filter(pa.compute.is_valid(table.column("span")))
    if known.num_rows:
        yield from known.select(["doc_id", "span"]).to_batches()
    if known.num_rows == table.num_rows:
        return
    owner, at, length, anchor, data = _unpack(table.column("packed"))
    start = np.cumsum(length) - length
    key, left, right, seeds = (np.concatenate(k) for k in zip(*_keys(data, start, length, anchor), strict=True))
    classes, first, least = _smallest_owner(key, owner)
    falls = owner > least[classes]
    if falls.any():
        yield _spans(owner[falls], at[falls], length[falls])
    chosen = np.flatnonzero(_partners(length[first], anchor[first], left[first], right[first], least))
    if not len(chosen):
        return
    chosen = chosen[np.argsort(seeds[first[chosen]], kind="stable")]
    rows = first[chosen]
    seeds = seeds[rows]
    # collections of whole seeds
    heads = np.concatenate(([0], np.flatnonzero(seeds[1:] != seeds[:-1]) + 1, [len(rows)]))
    a, string, offset = 0, [], []
    while a < len(rows):
        b = max(int(heads[np.searchsorted(heads, a + COLLECTION, "right") - 1]), int(heads[np.searchsorted(heads, a, "right")]))
        part, owners = rows[a:b], least[chosen[a:b]]
        close = np.flatnonzero(_close_partners(_gather(data, start[part], length[part]), length[part], anchor[part], owners))
        if len(close):
            part = part[close]
            text = _gather(data, start[part], length[part])
            s, o = shared_windows(text, np.cumsum(length[part]), length[part], owners[close], WIDTH)
            string.append(chosen[a:b][close[s]])
            offset.append(o)
        a = b
    if not sum(map(len, string)):
        return
    string, offset = np.concatenate(string), np.concatenate(offset)
    # runs of neighbouring windows of a string, then all its places in its smallest document
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    new = np.ones(len(string), dtype=bool)
    new[1:] = (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(string)) - 1
    run_of, run_at, run_len = string[heads], offset[heads], offset[tails] - offset[heads] + WIDTH
    own = np.flatnonzero(~falls)
    own = own[np.argsort(classes[own], kind="stable")]
    lo, hi = np.searchsorted(classes[own], run_of, "left"), np.searchsorted(classes[own], run_of, "right")
    which = np.repeat(np.arange(len(run_of)), hi - lo)
    rows = own[_gather(np.arange(len(own)), lo, hi - lo)]
    yield _spans(owner[rows], at[rows] + run_at[which], run_len[which])


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, copy): true for documents whose whole text a smaller document has too, by MD5."""
    marked = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), F.unhex(F.md5("text")).alias("h"))
    firsts = marked.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = marked.join(firsts, "h").filter("doc_id > first").select("doc_id", F.lit(True).alias("copy"))
    return materialize(copies.distinct(), "copies")


def bucket_count(total_bytes: int) -> int:
    """Buckets for so much text, 256 from 128 MB on.

    A portion sends a piece to each bucket, so their size grows with the root of the text:
    with a size that stays, the pieces would grow with its square and each become tiny.
    """
    size = max(BUCKET_BYTES, (2_000 * total_bytes) ** 0.5)
    return max(8, min(256, total_bytes // 500_000), int(total_bytes // size))


def repeated_spans(docs: DataFrame, total_bytes: int) -> DataFrame:
    """(doc_id, span): stretches, start * 2**26 + length, covered by windows of smaller documents.

    They overlap and come in no order; together they cover exactly the bytes that lie in a
    ``WIDTH``-byte window which also starts in a document with a smaller doc_id.
    """
    buckets = bucket_count(total_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in sorted_groups(batches, ["bucket"]):
            yield from _judge(table)

    pieces = _pieces(docs, buckets).repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return pieces.mapInArrow(run, "doc_id long, span long")


def covered(spans: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the maximal runs that the spans cover."""
    start, length = spans >> _LENGTH, spans & ((1 << _LENGTH) - 1)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate((start + length)[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > stop[:-1]
    heads = np.flatnonzero(new)
    return start[heads], stop[np.append(heads[1:], len(start)) - 1]


def remove_repeats(docs: DataFrame, derive, schema: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, ...) a row of ``docs``; ``derive(kept bytes)`` gives the rest.

    Null text is empty.  A doc_id names one text: repeated rows with it are the same
    document and lose the same bytes.  Rows without a doc_id lose nothing.  Exact copies of
    a smaller document fall as a whole and are not cut.
    """
    full = f"doc_id long, n_bytes long, n_removed long, n_spans long, {schema}"
    target = arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), batch.column("copy").to_pylist())
            for doc, text, spans, copy in zip(*columns, strict=True):
                raw = (text.as_buffer() or b"") if text.is_valid else b""
                size, kept, removed, n = len(raw), bytes(raw), 0, 0
                if copy and size >= WIDTH:
                    kept, removed, n = b"", size, 1
                elif spans.is_valid:
                    starts, stops = covered(spans.values.to_numpy(), size)
                    removed, n = int((stops - starts).sum()), len(starts)
                    cuts = zip([0, *stops.tolist()], [*starts.tolist(), size], strict=True)
                    kept = b"".join(kept[a:b] for a, b in cuts)
                out.append((doc, size, removed, n, *derive(kept)))
            if out:
                yield record(out, target)

    # both branches shuffle the texts by doc_id in the same way, so that happens once
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(exact_copies(docs), "doc_id", "left")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spans = repeated_spans(texts.filter("copy IS NULL"), total).groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    rows = texts.join(spans, "doc_id", "left")
    return rows.select("doc_id", "text", "spans", "copy").mapInArrow(run, full)
