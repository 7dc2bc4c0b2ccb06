"""Ranked lexical search against scoring every document, on edge tables."""

import random

import brute
import numpy as np
import pytest

from panelspark.llm import search

DOCS = "doc_id long, text string, rank string, n string, ids string, score string"
ITEMS = "item_id long, text string, rank string, term string"


def found(spark, docs, items, **kw):
    frames = [spark.createDataFrame([(a, b, *["x"] * k) for a, b in rows], ddl) for rows, ddl, k in ((docs, DOCS, 4), (items, ITEMS, 2))]
    return sorted((tuple(r) for r in search.search(*frames, **kw).collect()), key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 9, 30, 90))))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("top", [1, 10])
def test_against_all_documents(spark, monkeypatch, top):
    docs, items = corpus(500)
    assert found(spark, docs, items, top=top) == sorted(brute.ranked_search(docs, items, top), key=repr)


def test_blocks_of_items_and_documents(spark, monkeypatch):
    docs, items = corpus(300, 2)
    want = sorted(brute.ranked_search(docs, items), key=repr)
    monkeypatch.setattr(search, "BLOCK_BYTES", 400)
    monkeypatch.setattr(search, "BLOCK_DOCS", 7)
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 40)
    monkeypatch.setattr(search, "STEP", 3)
    assert len(list(search._item_blocks(spark.createDataFrame(items, "item_id long, text string")))) > 5
    assert found(spark, docs, items) == want


def test_nulls_ties_and_repeats(spark):
    same = [(i, "alpha beta Alpha") for i in range(20, 0, -1)]
    docs = [*same, (None, "alpha beta alpha"), (3, "alpha beta ALPHA"), (30, None), (31, ""), (32, "  --- "), (33, "\u00e9t\u00e9 gamma"), (34, "x" * 300_000 + " beta")]
    items = [(1, "ALPHA gamma"), (2, None), (3, ""), (4, "nowhere"), (None, "beta"), (5, "beta beta \u00e9t\u00e9")]
    got = found(spark, docs, items)
    assert got == sorted(brute.ranked_search(docs, items), key=repr)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 5][:5] == [33, 34, 1, 2, 3]
    # rows of one item_id are one item
    assert found(spark, docs, [(1, "alpha"), (1, "gamma")]) == found(spark, docs, [(1, "alpha gamma")])


def test_empty_tables(spark):
    docs, items = corpus(5)
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [(1, None)], items) == []


def test_masks_group_documents():
    rng = np.random.default_rng(0)
    held = rng.random((200, 90)) < 0.3
    held[:, 5:] &= rng.random((200, 1)) < 0.2
    row, term = np.nonzero(held)
    block = search.Block(list(range(200)), np.full(200, 100), row, term, np.ones(len(row), np.int32), np.arange(1, 91))
    group, planes = block.masks(list(range(90)))
    known = {}
    for d in range(200):
        assert known.setdefault(held[d].tobytes(), group[d]) == group[d]
    assert len(set(known.values())) == len(known) == len(planes[0])
    bits = np.unpackbits(np.stack(planes), axis=0, bitorder="little")[:90].T.astype(bool)
    assert (bits[group] == held).all()
