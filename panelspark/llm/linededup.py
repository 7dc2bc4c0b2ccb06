"""Exact line deduplication that returns keep bitmaps instead of text.

The keys of long lines are hashed and range-partitioned by (hash, document), sorted
within a partition by document and position, and streamed.  A hot line may span many
partitions: each partition then reports a summary of its part, the summaries are added
up by hash, and only lines that fall are named again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import SPACE_CHARS, arrow_schema, record, text_batches
from panelspark.session import materialize

_LOWER = {c: c + 32 for c in range(65, 91)}
#: Occurrences of one line that go into one row of a partition's report at most.
PIECE = 16384


def line_key(line: str) -> str:
    return line.strip(SPACE_CHARS).translate(_LOWER)


def line_hashes(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(h1, h2, doc_id, pos) of every line whose key has at least ``min_chars`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            hashes, docs_, at = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                for pos, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        hashes.append(xxhash.xxh3_128_digest(key.encode()))
                        docs_.append(doc)
                        at.append(pos)
            pairs = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(docs_, pa.int64()), pa.array(at, pa.int32())],
                ["h1", "h2", "doc_id", "pos"],
            )

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, pos int")


def _reports(lines: DataFrame, min_docs: int) -> DataFrame:
    """Streams the sorted lines: a row for each run of equal hashes, or for each ``PIECE`` of one.

    A run inside a partition with too few documents can't fall and is left out; a run at
    either end may go on in a neighbour, so it is always reported.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("h1", pa.int64()), ("h2", pa.int64()), ("n_docs", pa.int64()), ("last_doc", pa.int64()), ("docs", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32()))]
        )
        rest: pa.RecordBatch | None = None
        first = True

        def report(part: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """Rows of all runs of ``part``; it starts and ends with whole runs."""
            nonlocal first
            h1, h2, doc = (part.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
            pos = part.column("pos").to_numpy()
            n = len(h1)
            new_hash = np.ones(n, dtype=bool)
            new_hash[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_hash.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            starts = np.flatnonzero(new_hash)
            stops = np.append(starts[1:], n)
            seen = np.add.reduceat(new_doc.astype(np.int64), starts)
            keep = seen >= min_docs
            keep[0] |= first
            keep[-1] |= last
            first = False
            rows = []
            for k in np.flatnonzero(keep):
                a, b = int(starts[k]), int(stops[k])
                for i in range(a, b, PIECE):
                    j = min(i + PIECE, b)
                    rows.append((h1[a], h2[a], int(new_doc[i:j].sum()), doc[j - 1], doc[i:j], pos[i:j]))
                if len(rows) >= 512:
                    yield record(rows, schema)
                    rows = []
            if rows:
                yield record(rows, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([rest, batch] if rest is not None else [batch]).combine_chunks()
            h1, h2 = part.column("h1").to_numpy(), part.column("h2").to_numpy()
            open_run = int(np.argmax((h1 == h1[-1]) & (h2 == h2[-1])))
            if open_run:
                yield from report(part.slice(0, open_run), last=False)
            rest = part.slice(open_run).combine_chunks().to_batches()[0]
        if rest is not None:
            yield from report(pa.Table.from_batches([rest]), last=True)

    ordered = lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    return ordered.mapInArrow(run, "h1 long, h2 long, n_docs long, last_doc long, docs array<long>, pos array<int>")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, keep): deflated bitmaps, a bit per line, of the documents that lose lines.

    A key in at least ``min_docs`` documents keeps its lines in the largest doc_id only.
    Rows with one doc_id are one document; rows without a doc_id lose and take nothing.
    """
    reports = materialize(_reports(line_hashes(docs, min_chars), min_docs), "line-reports")
    totals = reports.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"), F.max("last_doc").alias("stays"))
    falls = totals.filter(F.col("n") >= min_docs).select("h1", "h2", "stays")
    lost = (
        reports.select("h1", "h2", F.arrays_zip("docs", "pos").alias("at"))
        .join(falls, ["h1", "h2"])
        .select("stays", F.explode("at").alias("at"))
        .filter("at.docs != stays")
        .select(F.col("at.docs").alias("doc_id"), F.col("at.pos").alias("pos"))
    )
    grouped = lost.groupBy("doc_id").agg(F.collect_set("pos").alias("pos"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for pos in batch.column("pos"):
                dropped = np.asarray(pos.values.to_numpy())
                bits = np.ones((int(dropped.max()) // 8 + 1) * 8, dtype=bool)
                bits[dropped] = False
                keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
            yield pa.record_batch([batch.column("doc_id"), pa.array(keep, pa.binary())], ["doc_id", "keep"])

    return grouped.mapInArrow(pack, "doc_id long, keep binary")


def unpack(keep: bytes | None, n_lines: int) -> np.ndarray:
    """The bitmap as booleans; lines beyond its end stay."""
    bits = np.ones(n_lines, dtype=bool)
    if keep:
        found = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:n_lines]
        bits[: len(found)] = found.astype(bool)
    return bits


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, derive, schema: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, ...) a row of ``docs``; ``derive(kept text)`` gives the rest.

    Null or empty text is one empty line.  If all lines fall, the kept text is empty.
    The bitmaps grow with the documents, so both sides are always sorted and merged.
    """
    full = f"doc_id long, n_lines long, n_dropped long, {schema}"
    target = arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            out = []
            for doc, text, keep in zip(batch.column("doc_id").to_pylist(), texts, batch.column("keep").to_pylist(), strict=True):
                n = text.count("\n") + 1
                if keep:
                    bits = unpack(keep, n)
                    text = "\n".join(x for x, k in zip(text.split("\n"), bits.tolist(), strict=True) if k)
                out.append((doc, n, n - int(bits.sum()) if keep else 0, *derive(text)))
            yield record(out, target)

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(bitmaps.hint("merge"), "doc_id", "left")
    return rows.select("doc_id", "text", "keep").mapInArrow(run, full)
