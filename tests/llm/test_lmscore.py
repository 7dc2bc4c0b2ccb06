"""The Kneser-Ney model against dictionaries of tuples, and its parts."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import counted, hashing, lmscore

DDL = "doc_id long, text string, shard string, score string, held_out string, h string"


def scored(spark, rows, order):
    df = spark.createDataFrame([(d, t, *["x"] * 4) for d, t in rows], DDL)
    return sorted((tuple(r) for r in lmscore.score(df, order).collect()), key=repr)


def same(got, rows, order):
    n, want = brute.kneser_ney(rows, order)
    want = sorted(want, key=lambda r: repr(r[:4]))
    got = sorted(got, key=lambda r: repr(r[:4]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(r[4] == n for r in got)
    for column, place in ((4, 5), (5, 6)):
        assert sorted(r[place] for r in got) == pytest.approx(sorted(r[column] for r in want), rel=1e-9)
    assert {(r[0], round(r[6], 6)) for r in got} == {(r[0], round(r[5], 6)) for r in want}


def corpus(n, seed=4):
    rng = random.Random(seed)
    words = [f"W{int(rng.paretovariate(0.7)) % 300}" for _ in range(2000)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_dictionaries(spark, order):
    rows = corpus(150)
    same(scored(spark, rows, order), rows, order)


@pytest.mark.parametrize("order", [2, 3])
def test_many_shards_and_frequent_contexts(spark, monkeypatch, order):
    rows = corpus(120, 5) + [(1000 + i, "the " * 40 + f"w{i}") for i in range(20)] + [(2000 + i, "one") for i in range(300)]
    for name, value in (("SHARD_BYTES", 2000), ("VOCABULARY_BYTES", 5000), ("GATHERED", 300)):
        monkeypatch.setattr(lmscore, name, value)
    monkeypatch.setattr(counted, "GATHERED", 300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = lmscore.train_model(df.filter(~lmscore.held_out_of(df.doc_id)), order)
    assert model.layout.shards > 5 and len(model.vocabulary.paths) > 2
    assert len(model.layout.frequent) > 2 and len(model.hot[2]) > 1
    same(scored(spark, rows, order), rows, order)


def test_probabilities_add_up_to_one(spark):
    rows = corpus(100, 6)
    model = lmscore.train_model(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    size = model.layout.size
    for context in ([size + 1, size + 1], [size + 1, 3], [5, 9], [size, 4], [2, 2]):
        ids = np.array([[*context, w] for w in range(size + 1)], np.uint32)
        p = model.unigram(ids[:, 2])
        for k in (2, 3):
            counts, stats = model.look_up([ids[:, i] for i in range(3 - k, 3)])
            d = model.discounts[k]
            mixed = (counts - d[np.minimum(counts, 3)] + (stats[:, 1:] @ d[1:]) * p) / np.maximum(stats[:, 0], 1)
            p = np.where(stats[:, 0] > 0, mixed, p)
        assert p.sum() == pytest.approx(1.0) and (p > 0).all()


def test_model_beats_single_words_on_held_out_text(spark):
    rng = random.Random(9)
    sentences = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(9)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(sentences, k=6))) for i in range(300)]
    got = [r for r in scored(spark, rows, 2) if r[1]]
    assert got and sum(r[6] for r in got) > 0.6 * sum(r[5] for r in got)


def test_nulls_empties_repeats_and_long_texts(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b a"), (None, None), (7, " \t\x0b"), (8, "A\u00a0b a \u4e2d"), (9, "x" * 70_000 + " " + "ab " * 5000), (9, "other")]
    for order in (1, 2, 3):
        same(scored(spark, rows, order), rows, order)
    assert scored(spark, [], 2) == []
    held = [i for i in range(50) if brute.held_out(i)][:3]
    only = scored(spark, [(i, "a b") for i in held], 2)
    assert [r[1:7] for r in only] == [(True, 3, 0, 0, 0.0, 0.0)] * 3


def test_word_hashes_follow_the_words():
    texts = ["", "Ab ab  aB", "ab", " x\ty\x0bz\n", "", "\u00e9 e", "q" * 5000 + " ab"]
    raw = [t.encode() for t in texts]
    cuts = np.append(0, np.cumsum([len(r) for r in raw]))
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    want = [[brute.fold(w) for w in brute.WORD.findall(t)] for t in texts]
    for step in (1, 7, 10_000):
        hashes, per_text = hashing.word_hashes(buffer, cuts, step)
        assert per_text.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        assert len(hashes) == len(flat)
        assert len({*zip(flat, hashes.tolist(), strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))


def test_packed_rows_come_back():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 4):
        columns = [rng.integers(0, 50 if i else 1 << 32, 1000, dtype=np.uint64).astype(np.uint32) for i in range(width)]
        rows, counts = lmscore.combine(columns)
        assert list(zip(*[c.tolist() for c in rows], strict=True)) == sorted(set(zip(*[c.tolist() for c in columns], strict=True)))
        back, numbers = lmscore.unpack(lmscore.pack(rows, counts), width)
        assert all((a == b).all() for a, b in zip(back, rows, strict=True)) and (numbers == counts).all()
        twice, doubled = lmscore.combine([np.concatenate([c, c]) for c in rows], np.concatenate([counts, counts]))
        assert all((a == b).all() for a, b in zip(twice, rows, strict=True)) and (doubled == 2 * counts).all()


def test_pieces_cut_between_texts():
    batch = pa.record_batch([pa.array(["abc", None, "", "defgh", "i"])], ["text"]).slice(1)
    parts = list(hashing.pieces(iter([batch]), 5))
    assert [(p.num_rows, r.tobytes(), c.tolist()) for p, r, c in parts] == [(3, b"defgh", [0, 0, 0, 5]), (1, b"i", [0, 1])]
