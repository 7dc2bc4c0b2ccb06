"""Ranked lexical search by presence masks.

Documents are reduced once to the query terms they hold.  A task then takes its documents
in blocks: every term has a bitmap of the block's documents, and the bitmaps of an item's
terms, laid side by side, give each document the mask of the terms it holds.  Documents of
one mask share one upper bound, the sum of its terms' largest scores in the block.  Masks
are evaluated by descending bound until the next bound is below the item's last rank.

Queries are a stated set.  They are taken in blocks of ``BLOCK_BYTES`` of text, so what is
sent to the tasks is bounded whatever their number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_schema, record
from panelspark.session import materialize

#: Text of the items that are searched for at once; a single item is never cut.
BLOCK_BYTES = 4_000_000
#: Documents and postings of a block, at most (a single document may hold more postings).
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 2_000_000
#: Candidates that are scored at least before bounds are looked at again.
STEP = 128

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Term bytes stay (A-Z lower-cased), all other ASCII becomes a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c in _LETTERS or c > 127 else 32 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in their order."""
    return text.translate(_FOLD).split()


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """The items (id, terms with their numbers) in blocks; rows of one id are one item."""
    rows = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found: dict[int | None, Counter] = {}
        for item, text in part.collect():
            found.setdefault(item, Counter()).update(terms(text.encode()))
        yield sorted(found.items(), key=lambda x: (x[0] is None, x[0]))


def postings(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """(doc_id, n, ids, tfs): a row's number of terms, and which known terms it holds how often."""
    numbers = {t: i for i, t in enumerate(known)}
    ddl = "doc_id long, n long, ids array<int>, tfs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.get
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            sizes, ids, tfs, ends = [], [], [], [0]
            for value in text:
                found = terms(value.as_py() or b"")
                held = np.array([i for i in map(get, found) if i is not None], np.int32)
                held, times = np.unique(held, return_counts=True)
                sizes.append(len(found))
                ids.append(held)
                tfs.append(times.astype(np.int32))
                ends.append(ends[-1] + len(held))
            if not sizes:
                continue
            cuts = pa.array(np.array(ends, np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x))) for x in (ids, tfs)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


class Block:
    """Documents with the scores of the query terms they hold."""

    def __init__(self, docs: list[int | None], m: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.docs, row, tf = docs, row[order], tf[order].astype(np.int64)
        term = term[order]
        self.score = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        names, starts = np.unique(term, return_index=True)
        ends = np.append(starts[1:], len(term))
        self.row = row
        self.span = {t: (a, b) for t, a, b in zip(names.tolist(), starts.tolist(), ends.tolist(), strict=True)}
        self.most = dict(zip(names.tolist(), np.maximum.reduceat(self.score, starts).tolist() if len(term) else [], strict=True))
        self.bitmap: dict[int, np.ndarray] = {}

    def bits(self, term: int) -> np.ndarray:
        """The term's bitmap over the documents of the block."""
        if term not in self.bitmap:
            held = np.zeros(len(self.docs), bool)
            held[self.row[slice(*self.span[term])]] = True
            self.bitmap[term] = np.packbits(held)
        return self.bitmap[term]

    def masks(self, wanted: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(group of each document, bytes of each group's mask): equal masks are one group."""
        n = len(self.docs)
        planes = [
            np.packbits(np.unpackbits(np.stack([self.bits(t) for t in wanted[i : i + 8]]), axis=1, count=n), axis=0, bitorder="little")[0]
            for i in range(0, len(wanted), 8)
        ]
        group = np.zeros(n, np.uint64)
        for i in range(0, len(planes), 4):  # groups so far and four more planes fit 64 bits
            for plane in planes[i : i + 4]:
                group = group << np.uint64(8) | plane
            first, group = np.unique(group, return_index=True, return_inverse=True)[1:]
            group = group.astype(np.uint64)
        return group.astype(np.int64), [plane[first] for plane in planes]

    def exact(self, rows: np.ndarray, wanted: list[int], times: list[int]) -> np.ndarray:
        """Scores of the documents ``rows`` (ascending)."""
        total = np.zeros(len(rows), np.int64)
        for t, q in zip(wanted, times, strict=True):
            a, b = self.span[t]
            held = self.row[a:b]
            at = np.minimum(np.searchsorted(held, rows), b - a - 1)
            total += np.where(held[at] == rows, q * self.score[a + at], 0)
        return total

    def best(self, item: list[tuple[int, int]], top: int, floor: int) -> list[tuple[int, int | None]]:
        """The documents that may be among the item's ``top``: (score, doc), at least ``floor`` each."""
        item = sorted(((t, q) for t, q in item if t in self.span), key=lambda x: -x[1] * self.most[x[0]])
        if not item:
            return []
        wanted, times = [t for t, _ in item], [q for _, q in item]
        group, planes = self.masks(wanted)
        bound = np.zeros(len(planes[0]), np.int64)
        for i, plane in enumerate(planes):
            at = [q * self.most[t] for t, q in item[8 * i : 8 * i + 8]]
            table = sum((np.arange(256) >> j & 1) * x for j, x in enumerate(at))
            bound += table[plane]
        order = np.argsort(-bound, kind="stable")
        members = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(bound)))
        found: list[tuple[int, int | None]] = []
        at = 0
        while at < len(order) and bound[order[at]] >= max(floor, 1):
            rows: list[np.ndarray] = []
            while at < len(order) and sum(map(len, rows)) < STEP and bound[order[at]] >= max(floor, 1):
                g = order[at]
                rows.append(members[ends[g - 1] if g else 0 : ends[g]])
                at += 1
            picked = np.sort(np.concatenate(rows))
            scores = self.exact(picked, wanted, times)
            found += [(s, self.docs[r]) for s, r in zip(scores.tolist(), picked.tolist(), strict=True) if s >= max(floor, 1)]
            found = ranked(found, top)
            floor = found[-1][0] if len(found) == top else floor
        return found


def ranked(found: list[tuple[int, int | None]], top: int) -> list[tuple[int, int | None]]:
    """The first ``top`` by score, then doc_id, null ids last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]


def _blocks(batches: Iterator[pa.RecordBatch], weight: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Block]:
    """Stored postings as blocks of bounded size."""
    for batch in batches:
        ends = np.cumsum(pa.compute.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, base + BLOCK_POSTINGS, "right"))
            part = batch.slice(start, min(max(stop, start + 1), start + BLOCK_DOCS) - start)
            start += part.num_rows
            ids, tfs = (part.column(c).flatten().to_numpy() for c in ("ids", "tfs"))
            row = np.repeat(np.arange(part.num_rows), np.diff(np.append(base, ends[start - part.num_rows : start])))
            m = 25 + (75 * part.column("n").to_numpy() * n_docs) // n_terms
            yield Block(part.column("doc_id").to_pylist(), m, row, ids, tfs, weight)


def _search(docs: DataFrame, items: list[tuple[int | None, Counter]], top: int) -> DataFrame | None:
    known = sorted(set().union(*(t for _, t in items))) if items else []
    if not known:
        return None
    held = materialize(postings(docs, known), "postings")
    n_docs, n_terms = held.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    # a count for each term of the block, which is bounded
    holders = {r[0]: r[1] for r in held.select(F.explode("ids").alias("id")).groupBy("id").count().collect()}
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders.get(i, 0) + 1))) for i in range(len(known))], np.int64)
    numbers = {t: i for i, t in enumerate(known)}
    asked = [(item, [(numbers[t], q) for t, q in found.items()]) for item, found in items if found]
    ddl = "item_id long, doc_id long, score long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple[int, int | None]]] = [[] for _ in asked]
        for block in _blocks(batches, weight, n_docs, n_terms):
            for i, (_, item) in enumerate(asked):
                floor = found[i][-1][0] if len(found[i]) == top else 0
                found[i] = ranked(found[i] + block.best(item, top, floor), top)
        rows = [(item, doc, score) for (item, _), best in zip(asked, found, strict=True) for score, doc in best]
        if rows:
            yield record(rows, schema)

    return held.filter("n > 0").mapInArrow(run, ddl)


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    Equal scores rank by ascending doc_id, null ids last; repeated rows are documents of
    their own.  Null texts and texts without a term take no part; an item without a term,
    or no documents, gives no rows.  Rows that share an item_id are one item whose terms
    add up.  Other columns of both tables are left alone.
    """
    found = [x for block in _item_blocks(items) if (x := _search(docs, block, top)) is not None]
    if not found:
        empty = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
        found = [empty]
    best = reduce(DataFrame.union, found)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", place).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
