"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into blocks; two that differ in at most ``bits`` positions agree on
at least ``blocks - bits`` whole blocks, so each choice of that many blocks is a join
key, and every candidate pair under a key is verified by its Hamming distance.

Near copies by their shingle sets need no fingerprint: alike sets share one of their rarest
shingles, which is the join key.  The pipeline's stage links texts by fingerprints and then,
between the groups that these leave, by sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_schema, record, sorted_runs, text_batches
from panelspark.llm.components import component_roots
from panelspark.llm.counted import Counted, count_values
from panelspark.llm.hashing import pieces, shingles, word_hashes
from panelspark.session import materialize

#: A-Z to a-z and every white space to a space.
_FOLD = {c: c + 32 for c in range(65, 91)} | {c: 32 for c in range(9, 14)}
#: Fingerprints of one block value are compared in chunks of about so many.
CHUNK = 2048
#: Text bytes per shard of shingle counts.
SHARD_BYTES = 16_000_000
#: Partners of other groups that a text is compared with in the first round, at most.
FIRST_PARTNERS = 32
#: Rows of keys with the same smallest text that one task compares, about.
PART_ROWS = 20_000
#: Pairs that a task holds to send each of them on once.
HELD_PAIRS = 500_000
PARITIES = [f"b{i}" for i in range(8)]


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of the text's word shingles, repeats included."""
    parts = [w for w in text.translate(_FOLD).split(" ") if w]
    if not parts:
        return np.empty(0, np.uint64)
    line = " ".join(parts).encode()
    ends = np.flatnonzero(np.frombuffer(line + b" ", np.uint8) == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(ends) > size:
        starts, ends = starts[: len(ends) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    return np.array(
        [digest(view[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
        dtype=np.uint64,
    )


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if over half the hashes have it; as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")
    return int(value[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; the texts stay where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            values = [fingerprint(shingle_hashes(t, shingle)) for t in texts]
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(values, pa.int64())], ["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, blocks: int) -> list[int]:
    """One mask for each choice of ``blocks - bits`` of the blocks, as signed longs."""
    edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    found = [sum(c) for c in combinations(parts, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _stars(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``bits``: each value to its set's smallest.

    Sets grow from a seed by one vector comparison each, and whatever a set has taken
    is compared no more, so a dense group costs few comparisons.
    """
    values = np.unique(values)
    rest, us, vs = values, [], []
    while len(rest) > 1:
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count((rest ^ front.pop()).view(np.uint64)) <= bits
            if near.any():
                taken, rest = rest[near], rest[~near]
                us.append(taken)
                vs.append(np.full(len(taken), root))
                front.extend(taken)
    if not us:
        return values[:0], values[:0]
    return np.concatenate(us), np.concatenate(vs)


def _shared(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key another row has too, with the number n of its rows."""
    shared = keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return keyed.join(shared, keys)


def _dealt(
    shared: DataFrame, keys: list[str], columns: list[str], together: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """The rows of ``_shared`` sorted into groups, and the columns that name a group.

    A group of more than ``CHUNK`` rows is dealt into chunks and each pair of chunks is a
    group of its own, so no task gets an unbounded group.  Groups that agree in the keys
    ``together`` (all of them by default) and in their chunks go to one task.
    """
    dealt = (
        shared.withColumn("m", F.ceil(F.col("n") / CHUNK).cast("int"))
        .withColumn("c", F.pmod(F.xxhash64(*columns), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select(*keys, F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b"), *columns)
    )
    names = [*keys, "a", "b"]
    return dealt.repartition(*(together or keys), "a", "b").sortWithinPartitions(*names), names


def _blocks(rows: DataFrame, bits: int, blocks: int) -> tuple[DataFrame, list[str]]:
    """``rows`` (with fp) once for every block key that another row shares, and the group keys."""
    if not 0 <= bits < blocks <= 64:
        raise ValueError("bits must be below blocks")
    keys = [
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(_masks(bits, blocks))
    ]
    keyed = rows.withColumn("k", F.explode(F.array(*keys))).select(*rows.columns, "k.t", "k.key")
    return _dealt(_shared(keyed, ["t", "key"]), ["t", "key"], rows.columns)


def links(fps: DataFrame, bits: int = 3, blocks: int = 6) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all within ``bits``.

    Values that share a block key are compared in one group; what is connected in a group
    is linked to its smallest value, so no list of all pairs is made.
    """
    dealt, names = _blocks(fps.select("fp"), bits, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (values,) in sorted_runs(batches, names, ["fp"]):
            u, v = _stars(values, bits)
            if len(u):
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``bits``
    differing fingerprint bits.  A text without words has fingerprint zero and is linked
    like any other.  A null doc_id takes part and is no candidate for the smallest, so a
    component of such rows alone has a null id.  Repeated rows stay; no rows give none.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = materialize(distinct, "fingerprint-classes")
    roots = component_roots(links(distinct.select("fp"), bits, blocks))
    classes = distinct.join(roots, distinct["fp"] == roots["u"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(raw: np.ndarray, cuts: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each of the texts, ascending."""
    hashes, per_text = shingles(*word_hashes(raw, cuts), size)
    ends = np.cumsum(per_text)
    return [np.unique(hashes[a:b]) for a, b in zip((ends - per_text).tolist(), ends.tolist(), strict=True)]


def shingle_counts(rows: DataFrame, shingle: int) -> Counted:
    """How often each shingle occurs in all texts, for those that occur twice or more.

    Counted on as many bits as keep chance agreements rare; these only make a shingle look
    more frequent, which changes the order of shingles, not a result.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(64, 11 + max(1, size).bit_length())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, raw, cuts in pieces(batches):
            yield shingles(*word_hashes(raw, cuts), shingle)[0]

    return count_values(rows.select("text"), found, max(1, -(-size // SHARD_BYTES)), bits, 2, "shingle-counts")


def prefix(hashes: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first of a set's hashes in an order that is one for all sets, rare ones first.

    Two sets that are ``percent`` alike have at least ``percent`` of each in common, so the
    first of their common hashes is behind at most the rest in either: both prefixes hold it.
    A hash that occurs once in all texts (count 0) is in no other set and is left out.
    """
    n = len(hashes)
    first = np.lexsort((hashes, counts))[: n - (percent * n + 99) // 100 + 1]
    return hashes[first[counts[first] > 0]]


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 512 classes of hashes whether a set has an odd number, as eight longs.

    Two sets differ in at least as many hashes as their parities differ in bits.
    """
    odd = np.bincount((hashes & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _possible(sizes: np.ndarray, bits: list[np.ndarray], i: int, j: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, least difference) of the pairs between rows i to j and all that may be alike.

    Left out are only pairs whose sizes or parities prove that too many shingles differ.
    """
    far = np.abs(sizes[i:j, None] - sizes[None, :])
    odd = np.zeros(far.shape, np.int64)
    for b in bits:
        odd += np.bitwise_count((b[i:j, None] ^ b[None, :]).view(np.uint64))
    far = np.maximum(far, odd)
    row, column = np.nonzero((100 + percent) * far <= (100 - percent) * (sizes[i:j, None] + sizes[None, :]))
    return row + i, column, far[row, column]


def _by_least(keyed: DataFrame) -> DataFrame:
    """The rows (id, key) whose key another row has too, with n, the key's smallest id and a part.

    Texts that share many keys share most of their keys' smallest ids, so the groups in which
    a pair meets come to one task, or to one for each part of about ``PART_ROWS`` rows.
    """
    keys = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1")
    loads = keys.groupBy("least").agg(F.ceil(F.sum("n") / PART_ROWS).alias("parts"))
    parted = keys.join(loads, "least").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).drop("parts")
    return keyed.join(parted, "key")


def _once(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(u, v, more) once for each pair among those held; more if any of its rows has it."""
    held, n = [], 0

    def merged() -> list[np.ndarray]:
        u, v, more = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((more, v, u))
        u, v, more = u[order], v[order], more[order]
        last = np.append((u[1:] != u[:-1]) | (v[1:] != v[:-1]), True)
        return [u[last], v[last], more[last]]

    for part in found:
        held.append(part)
        n += len(part[0])
        if n > HELD_PAIRS:
            held = [merged()]
            n = len(held[0][0])
            if n > HELD_PAIRS // 2:
                yield pa.record_batch([pa.array(x) for x in held[0]], ["u", "v", "more"])
                held, n = [], 0
    if n:
        yield pa.record_batch([pa.array(x) for x in merged()], ["u", "v", "more"])


_MEETING = ["least", "part", "key"]


def _proposals(shared: DataFrame, percent: int) -> DataFrame:
    """(u, v) with u > v: for each id of a group its smallest and its closest smaller partner
    that may be alike and have another label."""
    columns = ["id", "label", "size", *PARITIES]
    dealt, names = _dealt(shared, _MEETING, columns, ["least", "part"])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for values in sorted_runs(batches, names, columns):
            if (values[1] == values[1][0]).all():
                continue
            order = np.argsort(values[0])
            ids, labels, sizes, *bits = (v[order] for v in values)
            step = max(1, 1_000_000 // len(ids))
            for i in range(0, len(ids), step):
                row, column, far = _possible(sizes, bits, i, i + step, percent)
                below = (ids[column] < ids[row]) & (labels[column] != labels[row])
                row, column, far = row[below], column[below], far[below]
                if not len(row):
                    continue
                heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                nearest = np.minimum.reduceat(far * len(ids) + column, heads) % len(ids)
                u = np.repeat(ids[row[heads]], 2)
                v = ids[np.stack((column[heads], nearest), axis=1).ravel()]
                yield u, v, np.zeros(len(u), bool)

    found = dealt.mapInArrow(lambda batches: _once(propose(batches)), "u long, v long, more boolean")
    return found.select("u", "v").distinct()


def _crossing(shared: DataFrame, percent: int, most: int) -> DataFrame:
    """(u, v, more) with u > v: for each id of a group its ``most`` closest smaller partners
    that may be alike and have another label, and whether there are more of them.

    A pair comes once for each smallest id and part of the keys that it shares.
    """
    columns = ["id", "label", "size", *PARITIES]
    dealt, names = _dealt(shared, _MEETING, columns, ["least", "part"])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for ids, labels, sizes, *bits in sorted_runs(batches, names, columns):
            if (labels == labels[0]).all():
                continue
            step = max(1, 1_000_000 // len(ids))
            for i in range(0, len(ids), step):
                row, column, far = _possible(sizes, bits, i, i + step, percent)
                apart = np.flatnonzero((labels[row] != labels[column]) & (ids[row] > ids[column]))
                apart = apart[np.lexsort((ids[column[apart]], far[apart], row[apart]))]
                row, column = row[apart], column[apart]
                begins = np.searchsorted(row, row)
                place, total = np.arange(len(row)) - begins, np.searchsorted(row, row, "right") - begins
                kept = place < most
                if kept.any():
                    yield ids[row[kept]], ids[column[kept]], total[kept] > most

    return dealt.mapInArrow(lambda batches: _once(cross(batches)), "u long, v long, more boolean")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) of ids whose word shingle sets have the similarity ``percent``.

    Sets are compared by 32-bit hashes; two texts without words are alike.
    """

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, cuts in pieces(batches):
            sets = [np.unique((x >> np.uint64(32)).astype("<u4")).tobytes() for x in shingle_sets(raw, cuts, shingle)]
            yield pa.record_batch([batch.column("id"), pa.array(sets, pa.binary())], ["id", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), "<u4") for s in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    needed = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    # repeated rows go after the join, when they are few: before it all texts would move
    sets = texts.join(needed, "id").mapInArrow(shorten, "id long, set binary").dropDuplicates(["id"])
    sets = materialize(sets, "shingle-sets")
    left, right = sets.select(F.col("id").alias("u"), F.col("set").alias("a")), sets.select(F.col("id").alias("v"), F.col("set").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, linked: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id): groups of texts whose shingle sets are ``percent`` alike.

    Candidates share a shingle of their prefixes, which all alike pairs do, and are verified
    on the whole sets.  Prefixes follow the shingles' numbers of uses in all texts, so a
    text that shares too few of its shingles with any other has no key at all.  Equal texts
    are one.  ``linked`` has pairs (u, v) of doc_ids that belong together whatever their sets.
    First each text is compared with its smallest and its closest smaller candidate of
    another group.  Then, round by round, texts are compared with their closest candidates of
    other groups, more of them each time, until a round has left out none: every link counts,
    and pairs within a group that is connected by then are never made.  Rows without a
    doc_id are left out; null text is empty.
    """
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    counts = shingle_counts(rows, shingle)
    ddl = "doc_id long, same binary, keys array<long>, size long, " + ", ".join(f"{b} long" for b in PARITIES)
    schema = arrow_schema(ddl)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, cuts in pieces(batches):
            sets = shingle_sets(raw, cuts, shingle)
            uses = counts.look_up(np.concatenate(sets))[1]
            ends = np.cumsum([len(s) for s in sets])
            out, view = [], memoryview(raw)
            for i, (doc, hashes) in enumerate(zip(batch.column("doc_id").to_pylist(), sets, strict=True)):
                # texts without words meet under a key of their own
                keys = prefix(hashes, uses[ends[i] - len(hashes) : ends[i]], percent) if len(hashes) else np.zeros(1, np.uint64)
                same = xxhash.xxh3_128_digest(view[cuts[i] : cuts[i + 1]])
                out.append((doc, same, keys.view(np.int64), len(hashes), *parities(hashes).tolist()))
            yield record(out, schema)

    marked = rows.mapInArrow(mark, ddl).withColumn("row", F.monotonically_increasing_id())
    marked = materialize(marked, "shingle-prefixes")
    firsts = marked.groupBy("same").agg(F.min(F.struct("doc_id", "row")).alias("f"))
    firsts = materialize(firsts.select("same", F.col("f.doc_id").alias("id"), F.col("f.row").alias("row")), "texts")
    one = marked.join(firsts.select("row", "id"), "row")
    keyed = one.select("id", F.explode("keys").alias("key"))
    sized = one.select("id", "size", *PARITIES)
    shared = materialize(_by_least(keyed).join(sized, "id"), "shared-shingles")
    texts = rows.select(F.col("doc_id").alias("id"), "text")

    def labelled(roots: DataFrame) -> DataFrame:
        return shared.join(roots, shared["id"] == roots["u"], "left").withColumn("label", F.coalesce("root", "id"))

    first = rows.selectExpr("doc_id AS u", "doc_id AS v").limit(0) if linked is None else linked.select("u", "v")
    tried = materialize(_proposals(labelled(component_roots(first)), percent), "candidates")
    found = materialize(first.union(_verified(tried, texts, shingle, percent)), "links")
    most, roots = FIRST_PARTNERS, component_roots(found)
    while True:
        met = _crossing(labelled(roots), percent, most).groupBy("u", "v").agg(F.max("more").alias("more"))
        crossing = materialize(met, "crossing")
        rest = materialize(crossing.select("u", "v").join(tried, ["u", "v"], "left_anti"), "candidates")
        if not rest.isEmpty():
            tried = tried.union(rest)
            more = materialize(_verified(rest, texts, shingle, percent), "links")
            if not more.isEmpty():
                found = found.union(more)
                roots = component_roots(found)
        if crossing.filter("more").isEmpty():
            break
        most *= 32
    named = firsts.join(roots, firsts["id"] == roots["u"], "left").select("same", F.coalesce("root", "id").alias("component_id"))
    return marked.join(named, "same").select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies: all columns of the row with the smallest doc_id.

    Groups are those of ``near_duplicates``, whose fingerprints link, joined and completed by
    the links of ``near_copies``, which finds every pair of alike shingle sets.  Of repeated rows with that doc_id one stays; rows without a doc_id stay as they are.
    """
    named = docs.filter("doc_id IS NOT NULL")
    linked = near_duplicates(named).filter("doc_id != component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    groups = near_copies(docs, shingle, percent, materialize(linked, "fingerprint-links"))
    gone = groups.filter("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = named.join(gone, named["doc_id"] == gone["__gone"], "left_anti")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id IS NULL"))
