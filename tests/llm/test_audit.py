"""The filter audit against sending every document through every order."""

import random

import brute
import pytest

from panelspark.llm import audit

DOCS = "doc_id long, lang string, text string, mask string, part string, good string, copies string"
LABELS = "doc_id long, quality int, toxic int, part string, mask string"


def found(spark, docs, labels):
    frames = [spark.createDataFrame([(*r, *["x"] * k) for r in rows], ddl) for rows, ddl, k in ((docs, DOCS, 4), (labels, LABELS, 2))]
    return sorted(tuple(r) for r in audit.audit_filters(*frames).collect())


def texts(n, seed=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"{rng.choice(('a', 'A'))}{rng.randint(0, rng.choice((20, 2000)))}" for _ in range(rng.choice((20, 99, 100, 130)))]
        out.append(" ".join(words) + rng.choice(("", "", " #", "|")))
    return out


def test_against_every_order(spark):
    rng = random.Random(7)
    pool = texts(60)
    docs = [(i, rng.choice(("en", "fr", None, "")), rng.choice(pool)) for i in range(150)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 150, 2)]
    assert found(spark, docs, labels) == brute.filter_audit(docs, labels)


def test_nulls_repeats_and_copies(spark):
    docs = [(1, "en", None), (2, "en", ""), (2, "en", ""), (None, None, ""), (None, "de", "x" * 200_000), (5, "de", "\u00c9 " * 200), (3, "en", ""), (3, "de", "")]
    labels = [(2, 1, None), (2, 0, 1), (None, 1, 1), (99, 1, 1)]
    assert found(spark, docs, labels) == brute.filter_audit(docs, labels)


def test_empty_tables(spark):
    assert found(spark, [], [(1, 1, 1)]) == []
    docs = [(1, "en", "a")]
    assert found(spark, docs, []) == brute.filter_audit(docs, [])


@pytest.mark.parametrize("copies", [1, 2**40, 2**55])
def test_fields_do_not_run_over(copies):
    wide = audit.wide_classes()
    total = sum(copies * w for w in wide)
    single = sum(audit.unpack(w).astype(object) for w in wide)
    assert (audit.unpack(total).astype(object) == copies * single).all()


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(audit, "OPEN_PARTS", 2)
    docs = [(i, f"l{i % 7}", t) for i, t in enumerate(texts(40, 3))]
    assert found(spark, docs, []) == brute.filter_audit(docs, [])
