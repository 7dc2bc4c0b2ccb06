"""Suffix deduplication without Spark: what portions of text send on, and windows at seams."""

from __future__ import annotations

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import bwt, suffixdedup
from panelspark.llm.common import sorted_groups

OPENED: list[str] = []
WATCHED: list[bool] = []


def watch(event: str, args: tuple) -> None:
    if WATCHED and event == "open":
        OPENED.append(args[0])


class Docs:
    """Rows that stand for a DataFrame; what a task makes of them comes at once."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        ids, texts = zip(*rows, strict=True)
        self.batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts)], ["doc_id", "text"])

    def select(self, *names: str) -> Docs:
        return self

    def mapInArrow(self, run, schema: str) -> pa.Table:
        return pa.Table.from_batches(list(run(iter([self.batch]))))


def removed(rows: list[tuple[int, str]], buckets: int) -> dict[int, list[tuple[int, int]]]:
    """(start, stop) of what falls in each document."""
    pieces = suffixdedup._pieces(Docs(rows), buckets).sort_by("bucket")
    found: dict[int, list[int]] = {}
    for _, table in sorted_groups(iter(pieces.to_batches()), ["bucket"]):
        for batch in suffixdedup._judge(table):
            for doc, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(doc, []).append(span)
    sizes = {d: len(t) for d, t in rows}
    covered = {d: suffixdedup.covered(np.array(s), sizes[d]) for d, s in found.items()}
    return {d: list(zip(a.tolist(), b.tolist(), strict=True)) for d, (a, b) in covered.items()}


def brute(rows: list[tuple[int, str]], width: int = suffixdedup.WIDTH) -> dict[int, list[tuple[int, int]]]:
    least: dict[str, int] = {}
    for doc, text in sorted(rows):
        for i in range(len(text) - width + 1):
            least.setdefault(text[i : i + width], doc)
    out: dict[int, list[tuple[int, int]]] = {}
    for doc, text in rows:
        for i in range(len(text) - width + 1):
            if least[text[i : i + width]] < doc:
                runs = out.setdefault(doc, [])
                if runs and i <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], i + width)
                else:
                    runs.append((i, i + width))
    return out


def prose(rng: random.Random, n: int, letters: str = "abcdefgh ") -> str:
    return "".join(rng.choices(letters, k=n))


def test_a_portion_sends_a_piece_to_a_bucket():
    # as often as text is cut, a bucket got a piece: their number grew with the square of the text
    rng, buckets = random.Random(1), 300
    rows = [(i, prose(rng, 100_000)) for i in range(60)]
    pieces = suffixdedup._pieces(Docs(rows), buckets)
    assert pieces.num_rows - pieces.column("packed").null_count == buckets


def test_the_pieces_stay_large():
    # portions x buckets, a GB and a hundred: not ten thousand times as many
    count = getattr(suffixdedup, "bucket_count", lambda total: max(8, total // suffixdedup.BUCKET_BYTES))
    assert 100 * count(10**11) < 3_000 * count(10**9)


def test_a_known_passage_is_one_span():
    rng = random.Random(2)
    passage = prose(rng, 4_000)
    rows = [(1, prose(rng, 500) + passage), (2, prose(rng, 300) + passage + prose(rng, 200))]
    pieces = suffixdedup._pieces(Docs(rows), 16)
    # one or two: the strings at both ends of the passage are those of its surroundings
    assert 1 <= pieces.num_rows - pieces.column("span").null_count <= 2
    assert removed(rows, 16) == brute(rows)


def test_columns_are_opened_once():
    # a file that is emptied and written again goes to the disk each time it is closed
    text = np.frombuffer(prose(random.Random(3), 2_000).encode(), np.uint8)
    lengths = np.full(25, 80)
    sys.addaudithook(watch)
    WATCHED.append(True)
    try:
        bwt.build(text, np.cumsum(lengths), lengths)
    finally:
        WATCHED.clear()
    assert len(OPENED) <= 8


def test_repeated_letters_have_keys_of_their_own():
    # words that are the same but for their last bytes must not make up for each other
    letters = "abhkloty"
    texts = [(x + " " + 40 * (y + z + " "))[:n] for x in letters for y in letters for z in letters for n in range(50, 93)]
    texts = sorted(set(texts))
    length = np.array([len(t) for t in texts])
    start = np.cumsum(length) - length
    words = suffixdedup._words(np.frombuffer("".join(texts).encode(), np.uint8))
    keys = [suffixdedup._stretch_keys(words, start, length, np.full(len(texts), anchor)) for anchor in range(0, 43, 3)]
    assert len(np.unique(np.concatenate(keys))) == len(texts) * len(keys)


@pytest.mark.parametrize("left", range(0, 43))
def test_a_window_is_found_wherever_its_seed_lies(left):
    # two strings that share one window of 50 bytes and no more, the seed at each of its places
    rng = random.Random(left)
    window = prose(rng, 50)
    strings = ["x" * 10 + window + "x" * 10, "y" * 7 + window + "y" * 9, prose(rng, 70)]
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    length, anchor = np.array([len(s) for s in strings]), np.array([10 + left, 7 + left, 20])
    found = suffixdedup._close_partners(data, length, anchor, np.array([4, 5, 6]))
    assert found.tolist() == [True, True, False]
    alone = suffixdedup._close_partners(data, length, anchor, np.array([4, 4, 6]))
    assert not alone.any()


@pytest.mark.parametrize("seed", range(12))
def test_passages_across_seams(monkeypatch, seed):
    """Texts that are cut in many parts, and strings in collections of one seed each."""
    rng = random.Random(seed)
    monkeypatch.setattr(suffixdedup, "CUT_BYTES", rng.choice([60, 150, 700, 5_000]))
    monkeypatch.setattr(suffixdedup, "PORTION_BYTES", rng.choice([100, 1_000, 20_000]))
    monkeypatch.setattr(suffixdedup, "BATCH_BYTES", rng.choice([1, 400]))
    monkeypatch.setattr(suffixdedup, "COLLECTION", rng.choice([1, 5, 4_000]))
    passages = [prose(rng, rng.choice([49, 50, 51, 80, 400, 900])) for _ in range(6)]
    rows = []
    for doc in rng.sample(range(100), 25):
        parts = []
        for _ in range(rng.randint(0, 6)):
            passage = rng.choice(passages)
            if rng.random() < 0.3:
                at = rng.randrange(len(passage))
                passage = passage[:at] + "Z" + passage[at + 1 :]
            parts += [prose(rng, rng.randint(0, 120)), passage]
        rows.append((doc, "".join(parts) + "ab" * rng.choice([0, 0, 60])))
    assert removed(rows, rng.choice([1, 3, 40])) == brute(rows)
