"""Token-ID files: flat unsigned integers with 64-bit document offsets, memory-mapped.

A shard is three files of little-endian integers: ``.ids`` (all ids, two bytes each if
the vocabulary fits, else four), ``.off`` (n + 1 unsigned 64-bit offsets into it) and
``.doc`` (n signed 64-bit document ids).  A manifest table has a row per shard; the base
of a shard, the number of ids before it, comes from prefix sums over the manifest.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_schema, record, text_batches, worker_cache
from panelspark.llm.hashing import mix
from panelspark.session import new_path

#: How a null doc_id is stored.
NULL_ID = -(1 << 63)
#: Memory of a worker for the ids of words it has met; then it starts anew.
CACHE_BYTES = 48_000_000
#: Bytes of text that are looked up at once, and characters the library encodes in one call:
#: of words, and of whole texts.
_STEP, _CALL, _TEXTS = 1_000_000, 30_000, 250_000

_MANIFEST = "shard long, path string, width int, n_docs long, n_tokens long"
#: White space beyond ASCII that touches ASCII white space: there a run is no cut.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][ \t-\r]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_IS_LETTER, _IS_DIGIT, _IS_MARK = np.zeros((3, 256), bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_IS_DIGIT[48:58] = True
_IS_MARK[33:127] = ~(_IS_LETTER | _IS_DIGIT)[33:127]
#: The character for which each byte stands in a byte-level vocabulary: itself if it can be seen, else one from 256 on.
_AS_CHARACTER = np.arange(256, dtype="<u4")
_UNSEEN = [*range(33), *range(127, 161), 173]
_AS_CHARACTER[_UNSEEN] = 256 + np.arange(len(_UNSEEN))
_BYTES, _PLACES = mix(np.arange(1 << 13, (1 << 13) + 256)), mix(np.arange(1 << 14, (1 << 14) + 256)) | np.uint64(1)


def _piece_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the pieces of ``raw`` that begin at ``starts``, a bounded number of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    stops = np.append(starts[1:], len(raw))
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + _STEP // 4)))
        low, high = starts[begin], stops[end - 1]
        sizes = stops[begin:end] - starts[begin:end]
        part = starts[begin:end] - low
        place = np.arange(high - low) - np.repeat(part, sizes)
        longest = int(sizes.max())
        factors = _PLACES if longest <= len(_PLACES) else mix(np.arange(1 << 14, (1 << 14) + longest)) | np.uint64(1)
        sums = np.add.reduceat(_BYTES[raw[low:high]] * factors[place], part)
        out[begin:end] = mix(sums + sizes.astype(np.uint64) * np.uint64(2))
        begin = end
    return out


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Columns in the order of the first one, which ascends in both; ``a`` is used up, a column at a time."""
    at = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))
    old = np.ones(len(a[0]) + len(b[0]), bool)
    old[at] = False
    for i, new in enumerate(b):
        column = np.empty(len(old), new.dtype)
        column[old], column[at] = a[i], new
        a[i] = column
    return a


class _Known:
    """Ids of pieces by their hash, as sorted arrays: a large set and the latest additions."""

    def __init__(self, kind: np.dtype) -> None:
        self.ids, self.used = np.empty(1 << 16, kind), 0
        self.sets = [[np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32)] for _ in range(2)]

    @property
    def held(self) -> int:
        return self.ids.nbytes + sum(x.nbytes for s in self.sets for x in s)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the ids, their number) of each hash, -1 where it is new."""
        at, size = np.full(len(wanted), -1, np.int64), np.zeros(len(wanted), np.int64)
        for hashes, places, sizes in self.sets:
            if len(hashes):
                i = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
                met = np.flatnonzero(hashes[i] == wanted)
                at[met], size[met] = places[i[met]], sizes[i[met]]
        return at, size

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds pieces in ascending order of their hashes."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        places = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        large, late = self.sets
        late = _merged(late, [hashes, places.astype(np.uint32), sizes.astype(np.uint32)])
        if len(late[0]) > 20_000 + len(large[0]) // 4:
            large, late = _merged(large, late), [x[:0].copy() for x in late]
        self.sets = [large, late]


class Encoder:
    """Ids of texts as the tokenizers library gives them, with the ids of words kept.

    Byte-level BPE splits a text into pieces first.  One always begins at the first of a run
    of white space, at an ASCII mark after a letter or digit, and at a letter after a lone
    white space other than the space.  So a text is cut there, the library encodes each
    distinct part once, and the ids of a text are those of its parts.  A part of letters, with
    a space before them or without, is one piece: the library's model gets it at once, without
    the splitting.  Parts are told apart by 64 bits of hash.  Texts with an added token
    or with white space beyond ASCII next to other white space are encoded by the library as
    a whole, as are all texts of another tokenizer.
    """

    def __init__(self, path: str):
        # a task has one core; threads of the library would hold memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space", True)
            and pre.get("use_regex", True)
            and spec.get("truncation") is None
            and spec.get("padding") is None
        )
        mark = self._whole(["\n"])[0] if self.by_word else np.empty(0)
        # a line feed before a space is a piece of its own, which parts words in one call
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.letters = self._letters() if self.by_word else np.zeros(1 << 11, bool)
        self.known = _Known(self.kind)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind) for e in found]

    def _letters(self) -> np.ndarray:
        """Which of the characters of two bytes are letters, as the library's splitting takes them."""
        asked = [f"a{chr(c)}a" for c in range(1 << 7, 1 << 11)]
        text, at = "\n".join(asked), np.arange(len(asked)) * 4
        found = {tuple(span) for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        return np.append(np.zeros(1 << 7, bool), [(a, a + 3) in found for a in at.tolist()])

    def _is_letter(self, raw: np.ndarray) -> np.ndarray:
        """The bytes of letters, ASCII ones and those of two bytes."""
        out = _IS_LETTER[raw]
        first = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))
        code = (raw[first] & 31).astype(np.int64) << 6 | raw[first + 1] & 63
        first = first[self.letters[code]]
        out[first] = out[first + 1] = True
        return out

    def _single(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each) of words that are one piece, without line feeds."""
        ids, sizes = [], []

        def found(piece: str) -> list[int]:
            out = [t.id for t in self.model.tokenize(piece)]
            sizes.append(len(out))
            return out

        for i in range(0, len(words), 4096):
            raw = np.frombuffer(b"\n".join(words[i : i + 4096]), np.uint8)
            pieces = _AS_CHARACTER[raw].tobytes().decode("utf-32-le").split(chr(_AS_CHARACTER[10]))
            ids.append(np.fromiter(chain.from_iterable(map(found, pieces)), self.kind))
        return np.concatenate(ids), np.array(sizes)

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each) of words of one space and no other white space."""
        lines, line, size = [], [], 0
        for word in words:
            line.append(word)
            size += len(word)
            if size > _CALL:
                lines.append("\n" + "\n".join(line))
                line, size = [], 0
        if line:
            lines.append("\n" + "\n".join(line))
        ids = np.concatenate([x for line in lines for x in self._whole([line])])
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.diff(np.append(marks, len(ids))) - 1

    def _learn(self, hashes: np.ndarray, words: list[bytes], single: np.ndarray, plain: np.ndarray) -> None:
        """Adds new words; ``single`` ones are one piece, ``plain`` ones have one space, in front."""
        alone, easy, other = np.flatnonzero(single), np.flatnonzero(plain & ~single), np.flatnonzero(~(plain | single))
        if len(alone):
            self.known.add(hashes[alone], *self._single([words[i] for i in alone]))
        if len(easy):
            self.known.add(hashes[easy], *self._spaced([words[i].decode() for i in easy]))
        for i in range(0, len(other), 1024):
            part = other[i : i + 1024]
            found = self._whole([words[j].decode() for j in part])
            self.known.add(hashes[part], np.concatenate(found), np.array([len(f) for f in found]))

    def _by_words(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        cuts = np.cumsum([0, *map(len, texts)])
        space, letter = _IS_SPACE[raw], self._is_letter(raw)
        first = space.copy()
        first[1:] &= ~space[:-1]
        lone = first & (raw != 32)
        first[1:] |= _IS_MARK[raw[1:]] & (letter | _IS_DIGIT[raw])[:-1] | lone[:-1] & letter[1:]
        begins = cuts[:-1][cuts[:-1] < cuts[1:]]
        first[begins] = True
        starts = np.flatnonzero(first)
        hashes, which, inverse = np.unique(_piece_hashes(raw, starts), return_index=True, return_inverse=True)
        at, size = self.known.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.known.held > CACHE_BYTES:
                self.known, new = _Known(self.kind), np.arange(len(hashes))
            rows = which[new]
            begin, end = starts[rows], np.append(starts[1:], len(raw))[rows]

            def count(kind: np.ndarray) -> np.ndarray:
                before = np.append(0, np.cumsum(kind))
                return before[end] - before[begin]

            view = raw.tobytes()
            words = [view[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            spaced = (raw[begin] == 32) & (end - begin > 1)
            plain = spaced & (count(space) == 1) & (self.mark is not None)
            self._learn(hashes[new], words, count(~letter) == spaced, plain)
            at, size = self.known.find(hashes)
        at, size = at[inverse], size[inverse]
        ends = np.cumsum(size)
        ids = self.known.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - size), size)]
        edges = np.append(0, ends)[np.searchsorted(starts, cuts)]
        return [ids[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.empty(0, self.kind)] * len(texts)
        group: list[tuple[int, bytes]] = []
        rest: list[int] = []

        def look_up() -> None:
            for (i, _), ids in zip(group, self._by_words([t for _, t in group]), strict=True):
                out[i] = ids
            group.clear()

        def encode_rest() -> None:
            for i, ids in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
                out[i] = ids
            rest.clear()

        held = whole = 0  # bytes of the group, characters of the rest
        for i, text in enumerate(texts):
            if not self.by_word or any(a in text for a in self.added) or _ODD.search(text):
                if rest and whole + len(text) > _TEXTS:
                    encode_rest()
                    whole = 0
                rest.append(i)
                whole += len(text)
                continue
            raw = text.encode()
            if group and held + len(raw) > _STEP:
                look_up()
                held = 0
            group.append((i, raw))
            held += len(raw)
        if group:
            look_up()
        if rest:
            encode_rest()
        return out


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file, kept between tasks."""
    kept = worker_cache("encoders")
    if path not in kept:
        kept.clear()  # one at a time
        kept[path] = Encoder(path)
    return kept[path]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) in ascending doc_id order; returns the manifest.

    Null text is empty and gives the end id alone; null ids come first; rows with equal
    ids are ordered by their text.  No rows give an empty manifest.  Files carry the name
    of the attempt that wrote them and only those of the attempt whose row reached the
    manifest are read, so retried and speculative tasks do no harm.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        base = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        coder, docs_n, total, width = None, 0, 0, 0
        streams = []
        pool = pa.default_memory_pool()
        for batch, texts in text_batches(batches):
            pool.release_unused()  # what the worker's earlier tasks and batches needed
            if coder is None:
                coder = encoder(tokenizer_path)
                streams = [fs.open_output_stream(f"{root}/{base}.{x}") for x in ("ids", "off", "doc")]
                streams[1].write(np.zeros(1, "<u8").tobytes())
            ids, sizes = [], []
            for found in coder.encode(texts):
                ids += [found, np.array([end_id], found.dtype)]
                sizes.append(len(found) + 1)
            width = ids[0].dtype.itemsize
            streams[0].write(np.concatenate(ids).tobytes())
            streams[1].write((total + np.cumsum(sizes)).astype("<u8").tobytes())
            named = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            streams[2].write(named.astype("<i8").tobytes())
            docs_n, total = docs_n + len(texts), total + sum(sizes)
        for s in streams:
            s.close()
        if docs_n:
            yield pa.record_batch(
                [pa.array([x]) for x in (shard, f"{folder}/{base}")] + [pa.array([width], pa.int32()), pa.array([docs_n]), pa.array([total])],
                ["shard", "path", "width", "n_docs", "n_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("__tie"))
    rows = rows.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie", "text")
    stored = f"{folder}-manifest"
    rows.select("doc_id", "text").mapInArrow(write, _MANIFEST).write.parquet(stored)
    manifest = spark.read.schema(_MANIFEST).parquet(stored)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _map(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def read_token_files(
    manifest: DataFrame, derive: Callable[[np.ndarray], list], schema: str, batch: int = 1024
) -> DataFrame:
    """(doc_id, start, n_tokens, ...) for every document of the files.

    ``derive`` gets the document's ids as a view of the mapped file and returns the
    values of the columns that ``schema`` adds; ``start`` counts all ids before it.
    """
    full = f"doc_id long, start long, n_tokens long, {schema}"
    target = arrow_schema(full)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["path"])
                ids = _map(fs, f"{path}.ids", f"<u{row['width']}")
                off, doc = _map(fs, f"{path}.off", "<u8"), _map(fs, f"{path}.doc", "<i8")
                for i in range(0, len(doc), batch):
                    named, cuts = doc[i : i + batch].tolist(), off[i : i + batch + 1].tolist()
                    out = [
                        (None if d == NULL_ID else d, row["base"] + a, b - a, *derive(ids[a:b]))
                        for d, a, b in zip(named, cuts, cuts[1:], strict=False)
                    ]
                    yield record(out, target)

    return manifest.select("shard", "path", "width", "base").repartition("shard").mapInArrow(read, full)


def default_tokenizer(spark: SparkSession) -> str:
    """The tokenizer file: ``spark.panelspark.tokenizer`` if set, else the installed package's."""
    import public_tokenizers

    return spark.conf.get("spark.panelspark.tokenizer", None) or public_tokenizers.path("byte_bpe_50k.json")
