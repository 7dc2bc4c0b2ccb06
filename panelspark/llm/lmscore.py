"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, scored from memory maps.

Vocabulary, n-grams and context statistics are flat arrays sorted by hash, one set of
files a shard, in the shared folder.  Their number grows with the corpus, their size does
not, and workers map them, so no task and no driver holds the model.

- Words are 64-bit hashes; a word's id is its place among the sorted hashes.
- The n-grams of the highest order keep their counts; a shorter one counts the distinct
  words in front of it, or its occurrences if it begins with the start mark (of which
  order - 1 stand before each text).
- An n-gram lies in the shard of its context.  Contexts whose words are all frequent are
  spread over all shards by their last word, so no shard takes a frequent word's n-grams alone.
- Discounts come from the counts of counts of each order; the unigrams are interpolated
  with the uniform distribution over the vocabulary and one unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.arrays import mapped, write_arrays
from panelspark.llm.common import arrow_schema, sorted_groups
from panelspark.llm.counted import Counted, count_values, planes, share
from panelspark.llm.hashing import mix, pieces, word_hashes
from panelspark.session import materialize, new_path

#: Text bytes of the corpus per shard of n-grams and per shard of the vocabulary.
SHARD_BYTES, VOCABULARY_BYTES = 16_000_000, 96_000_000
#: n-grams a task gathers before it counts them and sends them on.
GATHERED = 4_000_000
#: A context is frequent if each of its words makes up over 1 / (SPREAD x shards) of all tokens.
SPREAD = 4
_LOW = np.uint64(0xFFFFFFFF)
_BUCKETS = 12
#: The end of a text as a token.
_END = mix(np.array([0x5EED]))[0]


def tokens(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, where each text's tokens end): its words, then the end."""
    words, per_text = word_hashes(raw, cuts)
    ends = np.cumsum(per_text + 1)
    found = np.empty(ends[-1], np.uint64)
    is_word = np.ones(len(found), bool)
    is_word[ends - 1] = False
    found[is_word], found[~is_word] = words, _END
    return found, ends


def windows(ids: np.ndarray, ends: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """For each token the ``order`` ids up to it, oldest first; ``start`` stands before a text."""
    begins = np.append(0, ends[:-1])
    place = np.arange(len(ids)) - np.repeat(begins, ends - begins)
    columns = []
    for back in range(order - 1, 0, -1):
        column = np.full(len(ids), start, np.uint32)
        column[back:] = ids[:-back] if back < len(ids) else ids[:0]
        column[place < back] = start
        columns.append(column)
    return [*columns, ids]


def combine(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of 32-bit columns in ascending order, with their summed counts."""
    levels, code = [], columns[0].astype(np.uint64)
    for column in columns[1:]:
        level = None
        if len(levels):
            level, code = np.unique(code, return_inverse=True)
            code = code.astype(np.uint64)
        levels.append(level)
        code = code << np.uint64(32) | column
    if counts is None:
        code, counts = np.unique(code, return_counts=True)
    elif len(code):
        order = np.argsort(code)
        code = code[order]
        heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        code, counts = code[heads], np.add.reduceat(counts[order], heads)
    out = []
    for level in reversed(levels):
        out.append((code & _LOW).astype(np.uint32))
        code = code >> np.uint64(32)
        if level is not None:
            code = level[code.astype(np.int64)]
    out.append(code.astype(np.uint32))
    return out[::-1], counts.astype(np.int64)


def pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Ascending rows as byte planes, the first column as differences, compressed."""
    first = np.diff(columns[0], prepend=np.uint32(0)).astype("<u4")
    parts = [planes(c) for c in (first, *[c.astype("<u4") for c in columns[1:]], counts.astype("<u8"))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // (4 * width + 8)

    def column(a: int, size: int) -> np.ndarray:
        planes = raw[a * n : (a + size) * n].reshape(size, n)
        return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel()

    columns = [column(4 * i, 4) for i in range(width)]
    columns[0] = np.cumsum(columns[0], dtype=np.uint32)
    return columns, column(4 * width, 8).astype(np.int64)


def context_hash(context: list[np.ndarray]) -> np.ndarray:
    value = np.full(len(context[0]), len(context), np.uint64)
    for column in context:
        value = mix(value ^ column)
    return value


def _bucket(hashes: np.ndarray) -> np.ndarray:
    """A part of a shard, by bits that decide neither shard nor key."""
    return (hashes >> np.uint64(32) & np.uint64((1 << _BUCKETS) - 1)).astype(np.int64)


class Layout:
    """What every task must know: shards, vocabulary size, start mark, frequent words."""

    def __init__(self, shards: int, size: int, frequent: np.ndarray):
        self.shards, self.size, self.frequent = shards, size, frequent
        self.unknown, self.start = size, size + 1

    def hot(self, context: list[np.ndarray]) -> np.ndarray:
        found = np.ones(len(context[0]), bool)
        for column in context:
            found &= np.isin(column, self.frequent)
        return found

    def shard(self, columns: list[np.ndarray]) -> np.ndarray:
        """Shards of n-grams: by context, by context and word if frequent, by id if single."""
        if len(columns) == 1:
            return (columns[0].astype(np.uint64) * np.uint64(self.shards) // np.uint64(max(self.size, 1))).astype(np.int32)
        value = context_hash(columns[:-1])
        return share(np.where(self.hot(columns[:-1]), mix(value ^ columns[-1]), value), self.shards)

    def blobs(self, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(shard, packed rows) of distinct ascending rows."""
        shard = self.shard(columns)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[s] : cuts[s + 1]]
            yield s, pack([c[rows] for c in columns], counts[rows])


def _ids(vocabulary: Counted, batches: Iterator[pa.RecordBatch], order: int, start: int) -> Iterator[list[np.ndarray]]:
    for _, raw, cuts in pieces(batches):
        hashes, ends = tokens(raw, cuts)
        yield windows(vocabulary.look_up(hashes)[0].astype(np.uint32), ends, order, start)


def _count_words(train: DataFrame, shards: int) -> Counted:
    """The training tokens and their numbers of uses."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, raw, cuts in pieces(batches):
            yield tokens(raw, cuts)[0]

    return count_values(train, found, shards, name="vocabulary")


def _frequent(spark: SparkSession, vocabulary: Counted, least: float) -> np.ndarray:
    """Ids of the words with over ``least`` occurrences: fewer than all tokens / ``least``."""
    shards = spark.range(len(vocabulary.paths)).select(F.col("id").cast("int").alias("shard"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("shard").to_pylist():
                found = np.flatnonzero(vocabulary.maps(s)[1] > least) + vocabulary.bases[s]
                yield pa.record_batch([pa.array(found.astype(np.int64))], ["id"])

    return np.array(sorted(r.id for r in shards.mapInArrow(pick, "id long").collect()), np.uint32)


_ROW = "kind int, shard int, data binary, path string, numbers array<long>"
_FILES, _SHORTER, _HOT = 0, 1, 2


def _row(schema: pa.Schema, kind: int, shard: int, **values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"kind": kind, "shard": shard, **values}], schema)


def _spans(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new row of ascending columns begins."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def _store_order(blobs: DataFrame, order: int, layout: Layout, folder: str) -> DataFrame:
    """Merges the n-grams of each shard and writes its arrays; rows of ``_ROW``.

    Rows are the shard's files with its counts of counts, its n-grams without their first
    word for the next order, and the statistics of frequent contexts.
    """
    schema = arrow_schema(_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), table in sorted_groups(batches, ["shard"]):
            found = [unpack(b.as_py(), order) for b in table.column("data")]
            columns, counts = combine([np.concatenate(c) for c in zip(*(f[0] for f in found), strict=True)], np.concatenate([f[1] for f in found]))
            del found
            numbers = [*_counts_of_counts(counts), int(counts.sum())]
            if order == 1:
                low = -(-shard * layout.size // layout.shards)
                high = -(-(shard + 1) * layout.size // layout.shards)
                dense = np.zeros(high - low, "<u8")
                dense[columns[0].astype(np.int64) - low] = counts
                numbers += [low, int((counts > 2).sum())]
                yield _row(schema, _FILES, shard, path=write_arrays(folder, f"1-{shard:06d}", {"count": dense}), numbers=numbers)
                continue
            context, word = columns[:-1], columns[-1]
            heads = _spans(context)
            hashes = context_hash(context)
            types = np.diff(np.append(heads, len(word)))
            stats = [np.add.reduceat(x.astype(np.int64), heads) for x in (counts, counts == 1, counts == 2, counts > 2)]
            hot = layout.hot([c[heads] for c in context])
            if hot.any():
                table = np.stack([hashes[heads].view(np.int64), *stats])[:, hot].T.tolist()
                yield pa.RecordBatch.from_pylist([{"kind": _HOT, "shard": shard, "numbers": x} for x in table], schema)
            many = np.flatnonzero((types > 1) & ~hot)
            many = many[np.argsort(hashes[heads[many]])]
            bucket = _bucket(hashes)
            key = (hashes & _LOW) << np.uint64(32) | word
            place = np.lexsort((key, bucket))
            large = np.flatnonzero(counts[place] >= 255)
            arrays = {
                "key": key[place].astype("<u8"),
                "bucket": np.searchsorted(bucket[place], np.arange((1 << _BUCKETS) + 1)).astype("<u4"),
                "count": np.minimum(counts[place], 255).astype("<u1"),
                "large": large.astype("<u4"),
                "value": counts[place][large].astype("<u8"),
                "context": hashes[heads[many]].astype("<u8"),
                "total": stats[0][many].astype("<u8"),
            }
            for i in (1, 2, 3):
                arrays[f"types{i}"] = stats[i][many].astype("<u4")
            del place, key, bucket
            yield _row(schema, _FILES, shard, path=write_arrays(folder, f"{order}-{shard:06d}", arrays), numbers=numbers)
            del arrays
            shorter, counts = combine(columns[1:], np.where(columns[1] == layout.start, counts, 1))
            for s, blob in layout.blobs(shorter, counts):
                yield _row(schema, _SHORTER, s, data=blob)

    spread = blobs.select("shard", "data").repartition(layout.shards, "shard").sortWithinPartitions("shard")
    return materialize(spread.mapInArrow(run, _ROW), f"order-{order}")


def discounts(n: list[int]) -> list[float]:
    """What is taken from counts of 0, 1, 2 and 3 or more, by the counts of counts 1 to 4.

    Counts of counts of a small corpus can give no discounts, or none between 0 and the
    count; then they are 1/2, 1 and 3/2.
    """
    plain = [0.0, 0.5, 1.0, 1.5]
    if min(n) < 1:
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    found = [0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return found if all(0 < d < i + 1 for i, d in enumerate(found[1:])) else plain


class Model:
    """Paths and numbers of a stored model; workers map its arrays as they meet them."""

    def __init__(self, order: int, layout: Layout, vocabulary: Counted, tokens_n: int):
        self.order, self.layout, self.vocabulary, self.tokens_n = order, layout, vocabulary, tokens_n
        self.paths: dict[int, dict[int, str]] = {}
        self.lows: dict[int, int] = {}
        self.discounts: dict[int, np.ndarray] = {}
        self.unigrams = (0, 0.0)  # total, weight of the uniform distribution
        self.hot: dict[int, np.ndarray] = {}

    def add_order(self, order: int, files: list, hot: list) -> None:
        self.paths[order] = {r.shard: r.path for r in files}
        sums = np.array([r.numbers[:5] for r in files], dtype=object).reshape(-1, 5).sum(axis=0).tolist() if files else [0] * 5
        d = self.discounts[order] = np.array(discounts([int(x) for x in sums[:4]]))
        if order == 1:
            self.lows = {r.shard: r.numbers[5] for r in files}
            ones, twos, total = int(sums[0]), int(sums[1]), int(sums[4])
            more = int(sum(r.numbers[6] for r in files))
            self.unigrams = (total, (d[1] * ones + d[2] * twos + d[3] * more) / total if total else 1.0)
        self.hot[order] = np.array(sorted(hot), np.int64).reshape(-1, 5)

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities of single tokens."""
        total, weight = self.unigrams
        uniform = weight / (self.layout.size + 1)
        if not total:
            return np.full(len(ids), uniform)
        wanted, inverse = np.unique(ids, return_inverse=True)
        counts = np.zeros(len(wanted), np.int64)
        known = wanted[wanted < self.layout.size]
        cuts = np.searchsorted(self.layout.shard([known]), np.arange(self.layout.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if s in self.paths[1]:
                (dense,) = mapped(self.paths[1][s], ("count", "<u8"))
                counts[cuts[s] : cuts[s + 1]] = dense[known[cuts[s] : cuts[s + 1]].astype(np.int64) - self.lows[s]]
        taken = self.discounts[1][np.minimum(counts, 3)]
        return ((counts - taken) / total + uniform)[inverse]

    def look_up(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(counts of n-grams, statistics of their contexts: total and types with 1, 2, 3 or more)."""
        order, layout = len(columns), self.layout
        counts, stats = np.zeros(len(columns[0]), np.int64), np.zeros((len(columns[0]), 4), np.int64)
        hashes, shard = context_hash(columns[:-1]), layout.shard(columns)
        hot = layout.hot(columns[:-1])
        if len(self.hot[order]) and hot.any():
            rows, table = np.flatnonzero(hot), self.hot[order]
            wanted = hashes[rows].view(np.int64)
            at = np.minimum(np.searchsorted(table[:, 0], wanted), len(table) - 1)
            met = table[at, 0] == wanted
            stats[rows[met]] = table[at[met], 1:]
        bucket = _bucket(hashes)
        key = (hashes & _LOW) << np.uint64(32) | columns[-1]
        place = np.lexsort((key, shard.astype(np.int64) << _BUCKETS | bucket))
        cuts = np.searchsorted(shard[place], np.arange(layout.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if s not in self.paths[order]:
                continue
            rows = place[cuts[s] : cuts[s + 1]]
            known, edges, small, large, value, context, total, *types = mapped(
                self.paths[order][s], ("key", "<u8"), ("bucket", "<u4"), ("count", "<u1"), ("large", "<u4"), ("value", "<u8"),
                ("context", "<u8"), ("total", "<u8"), ("types1", "<u4"), ("types2", "<u4"), ("types3", "<u4"),
            )

            def number(at: np.ndarray, small: np.ndarray = small, large: np.ndarray = large, value: np.ndarray = value) -> np.ndarray:
                found = small[at].astype(np.int64)
                big = np.flatnonzero(found == 255)
                if len(big):
                    found[big] = value[np.searchsorted(large, at[big])]
                return found

            low, high = edges[bucket[rows]].astype(np.int64), edges[bucket[rows] + 1].astype(np.int64)
            at = _lower_bound(known, low, high, key[rows])
            met = (at < high) & (known[np.minimum(at, len(known) - 1)] == key[rows])
            counts[rows[met]] = number(at[met])
            rest = ~hot[rows]
            rows, low, high = rows[rest], low[rest], high[rest]
            if not len(rows):
                continue
            if len(context):
                at = np.minimum(np.searchsorted(context, hashes[rows]), len(context) - 1)
                met = context[at] == hashes[rows]
                for i, column in enumerate((total, *types)):
                    stats[rows[met], i] = column[at[met]]
                rows, low, high = rows[~met], low[~met], high[~met]
            # a context with one following word has no statistics of its own
            head = key[rows] & ~_LOW
            at = _lower_bound(known, low, high, head)
            met = (at < high) & (known[np.minimum(at, len(known) - 1)] & ~_LOW == head)
            single = number(at[met])
            stats[rows[met], 0] = single
            stats[rows[met], np.clip(single, 1, 3)] = 1
        return counts, stats

    def log10(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log10 probability of every token."""
        columns = windows(ids, ends, self.order, self.layout.start)
        p = self.unigram(columns[-1])
        for order in range(2, self.order + 1):
            d = self.discounts[order]
            counts, stats = self.look_up(columns[self.order - order :])
            total = np.maximum(stats[:, 0], 1)
            mixed = (counts - d[np.minimum(counts, 3)] + (stats[:, 1:] @ d[1:]) * p) / total
            p = np.where(stats[:, 0] > 0, mixed, p)
        return np.log10(p)


def _lower_bound(known: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First place in [low, high) with a value not below the wanted one, for each of them."""
    low, high = low.copy(), high.copy()
    todo = np.flatnonzero(low < high)
    while len(todo):
        middle = (low[todo] + high[todo]) >> 1
        less = known[middle] < wanted[todo]
        low[todo[less]] = middle[less] + 1
        high[todo[~less]] = middle[~less]
        todo = todo[low[todo] < high[todo]]
    return low


def train_model(texts: DataFrame, order: int) -> Model:
    """Counts the n-grams of ``texts`` (text) and stores the model in the shared folder."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = texts.sparkSession
    texts = texts.select("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    vocabulary = _count_words(texts, max(1, -(-size // VOCABULARY_BYTES)))
    known, total = vocabulary.size, vocabulary.total
    if known + 2 >= 1 << 32:
        raise ValueError("word ids have 32 bits")
    shards = max(1, -(-size // SHARD_BYTES))
    frequent = _frequent(spark, vocabulary, total / (SPREAD * shards))
    layout = Layout(shards, known, np.append(frequent, np.uint32(known + 1)))  # the start mark, too
    model = Model(order, layout, vocabulary, total)
    folder = new_path(spark, "language-model")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s, blob in layout.blobs(columns, counts):
                yield pa.record_batch([pa.array([s], pa.int32()), pa.array([blob], pa.binary())], ["shard", "data"])

        held: list[list[np.ndarray]] = []
        for columns in _ids(vocabulary, batches, order, layout.start):
            held.append(columns)
            if sum(len(c[0]) for c in held) >= GATHERED:
                yield from out(*combine([np.concatenate(c) for c in zip(*held, strict=True)]))
                held = []
        if held:
            yield from out(*combine([np.concatenate(c) for c in zip(*held, strict=True)]))

    blobs = texts.mapInArrow(gather, "shard int, data binary")
    for k in range(order, 0, -1):
        rows = _store_order(blobs, k, layout, folder)
        files = rows.filter(F.col("kind") == _FILES).select("shard", "path", "numbers").collect()  # a row per shard
        merged = rows.filter(F.col("kind") == _HOT).groupBy(F.col("numbers")[0].alias("h"))
        # frequent contexts: fewer than SPREAD x shards words, and what follows among them
        hot = merged.agg(*[F.sum(F.col("numbers")[i]).alias(f"n{i}") for i in range(1, 5)]).collect()
        model.add_order(k, files, [tuple(r) for r in hot])
        blobs = rows.filter(F.col("kind") == _SHORTER)
    return model


def held_out_of(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is in training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row."""
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = model.tokens_n, model.layout.size
        for batch, raw, cuts in pieces(batches):
            hashes, ends = tokens(raw, cuts)
            ids, counts = model.vocabulary.look_up(hashes)
            begins = np.append(0, ends[:-1])
            size = ends - begins
            known = np.add.reduceat((counts > 0).astype(np.int64), begins)
            base = np.add.reduceat(np.log10((counts + 0.5) / (n + 0.5 * (v + 1))), begins)
            score = np.add.reduceat(model.log10(ids.astype(np.uint32), ends), begins)
            columns = [size, known, np.full(len(size), n, np.int64), base, score, 10.0 ** (-score / size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *[pa.array(c) for c in columns]], schema=schema)

    return docs.mapInArrow(run, ddl)


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """Trains on the rows that are not held out and scores every row of ``docs`` (doc_id, text).

    Null and empty texts are one end token.  A null doc_id counts as training.  Repeated
    rows are counted and scored each.  Without training rows every token has the
    probability 1 of the one unknown word.  No rows give none; other columns are left alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out_of(F.col("doc_id")))
    return score_texts(rows, train_model(rows.filter(~F.col("held_out")), order))
