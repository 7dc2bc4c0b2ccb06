"""Filter interaction audit with wide packed counters.

Whether a document fails each of five filters is a mask of five bits.  What happens to it
in every one of the 120 filter orders, step by step, follows from the mask alone, so each
mask (with the document's labels) is mapped once to one big integer: six fields of 64 bits
for each of the 600 steps.  Adding such integers adds all 3,600 counters at once; a field
holds any count below 2^64, so no sum of rows carries over into the next field.

Partitions add up a wide integer per part, parts add up those, and each part's integer is
unpacked into its 600 rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_schema, worker_cache
from panelspark.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bits of a field; a counter may not reach 2^64.
FIELD = 64
#: Counters of a step, lowest field first.
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Parts a task adds up at once; then its sums go out and it starts anew.
OPEN_PARTS = 256

_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_STEPS = len(ORDERS) * len(FILTERS)


def wide_integer(mask: int, good: bool, toxic: bool) -> int:
    """All 3,600 counters of one document as one integer."""
    fields = np.zeros((len(ORDERS), len(FILTERS), len(COUNTERS)), "<u8")
    for o, order in enumerate(ORDERS):
        alive = True
        for s, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails = bool(mask & bit)
            removed = fails and alive
            alive = alive and not fails
            fields[o, s] = (alive, removed, fails and not removed, mask == bit, removed and good, removed and toxic)
    return int.from_bytes(fields.tobytes(), "little")


def wide_classes() -> list[int]:
    """The integers of all classes: mask + 32 for a good and + 64 for a toxic document."""
    known = worker_cache("wide-classes")
    if not known:
        known[0] = [wide_integer(c & 31, bool(c & 32), bool(c & 64)) for c in range(128)]
    return known[0]


def unpack(total: int) -> np.ndarray:
    """The counters (order, step, counter) that a sum of wide integers holds."""
    size = _STEPS * len(COUNTERS) * FIELD // 8
    return np.frombuffer(total.to_bytes(size, "little"), "<u8").reshape(len(ORDERS), len(FILTERS), -1).astype("i8")


def text_mask(text: bytes) -> int:
    """Bits A to D of a text; E needs the other texts."""
    words = text.split()  # of bytes: at the six ASCII white spaces
    chars = count_chars(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    marked = len(text) != len(text.translate(None, _MARKS))
    return (
        (len(words) < 100)
        | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * upper > 10 * chars) << 2
        | marked << 3
    )


def count_chars(text: bytes) -> int:
    """Code points of UTF-8: the bytes that continue none."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, copies): the filters that each text fails, a row per distinct row.

    Bit E is set where a smaller doc_id has the same text.  First texts are found by a
    partial minimum and met again on (text, doc_id), so a text with millions of copies
    is never one group.  A null text is empty, a null lang is the part ''.  A row without
    doc_id has no smaller one and is none for others; repeated rows count each.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [text_mask(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            kept = [batch.column(c) for c in ("doc_id", "part", "same")]
            yield pa.record_batch([*kept, pa.array(masks, pa.int32())], ["doc_id", "part", "same", "mask"])

    hashed = rows.withColumn("same", F.unhex(F.sha2("text", 256)))
    judged = hashed.mapInArrow(judge, "doc_id long, part string, same binary, mask int")
    judged = materialize(judged, "filter-masks")
    firsts = judged.groupBy("same").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL")
    firsts = firsts.withColumn("first", F.lit(True))
    copies = judged.groupBy("same", "doc_id", "part", "mask").agg(F.count("*").alias("copies"))
    met = copies.join(firsts, ["same", "doc_id"], "left")
    later = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0)
    return met.select("doc_id", "part", F.col("mask").bitwiseOR(later).alias("mask"), "copies")


def packed_sums(classed: DataFrame) -> DataFrame:
    """(part, total): per part the sum of its rows' wide integers, as bytes.

    ``classed`` has part, class (0 to 127) and copies.  A task adds up its rows, so every
    partition sends one integer a part, however many rows it has.
    """
    size = _STEPS * len(COUNTERS) * FIELD // 8

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = wide_classes()
        sums: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(sums)), pa.array([v.to_bytes(size, "little") for v in sums.values()])], ["part", "total"])

        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            names, codes = parts.dictionary.to_pylist(), parts.indices.to_numpy()
            kinds, copies = (batch.column(c).to_numpy() for c in ("class", "copies"))
            counts = np.zeros((len(names), 128), "i8")
            np.add.at(counts, (codes, kinds), copies)
            for i, name in enumerate(names):
                found = np.flatnonzero(counts[i]).tolist()
                sums[name] = sums.get(name, 0) + sum(int(counts[i, c]) * wide[c] for c in found)
                if len(sums) >= OPEN_PARTS:
                    yield out()
                    sums = {}
        if sums:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: str, total: int) -> pa.RecordBatch:
            return pa.record_batch([pa.array([part]), pa.array([total.to_bytes(size, "little")])], ["part", "total"])

        held, total = None, 0
        for batch in batches:
            for part, value in zip(batch.column("part").to_pylist(), batch.column("total"), strict=True):
                if held is not None and part != held:
                    yield out(held, total)
                    total = 0
                held, total = part, total + int.from_bytes(value.as_py(), "little")
        if held is not None:
            yield out(held, total)

    ddl = "part string, total binary"
    sums = classed.select("part", "class", "copies").mapInArrow(add_up, ddl)
    return sums.repartition("part").sortWithinPartitions("part").mapInArrow(merge, ddl)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows a part: (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley), zeros included.

    ``labels`` (doc_id, quality, toxic) may lack documents, which are neither good nor
    toxic; of several rows of one document each label counts if any row has it.  No
    documents give no rows; other columns of both tables are left alone.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    joined = failures(docs).join(marks, "doc_id", "left")
    kind = F.col("mask") + 32 * F.coalesce("good", F.lit(0)) + 64 * F.coalesce("toxic", F.lit(0))
    sums = packed_sums(joined.select("part", kind.cast("int").alias("class"), "copies"))
    ddl = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTERS, "shapley"))
    schema = arrow_schema(ddl)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [o for o in ORDERS for _ in FILTERS]
        steps = list(range(1, len(FILTERS) + 1)) * len(ORDERS)
        at = np.array([FILTERS.index(x) for o in ORDERS for x in o])
        for batch in batches:
            for part, total in zip(batch.column("part").to_pylist(), batch.column("total").to_pylist(), strict=True):
                counters = unpack(int.from_bytes(total, "little")).reshape(_STEPS, len(COUNTERS))
                shapley = np.zeros(len(FILTERS), "i8")
                np.add.at(shapley, at, counters[:, COUNTERS.index("removed")])
                columns = [pa.array([part] * _STEPS), pa.array(orders), pa.array(steps, pa.int32())]
                columns += [pa.array(c) for c in counters.T] + [pa.array(shapley[at])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return sums.mapInArrow(rows, ddl)
