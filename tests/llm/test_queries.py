"""Each registered query on the smallest tables, against SQL or a plain version."""

import html
import re

import brute
import duckdb
import pytest
import public_tokenizers
from compare import connect, differences

from panelspark.llm import checks
from panelspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{name}.parquet'").fetchall()


def got(spark, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, FOLDER).select(*columns).collect())


@pytest.mark.parametrize("name", sorted(checks.SQL))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), checks.SQL[name]) == []


def test_suffix_dedup(spark):
    want = brute.suffix_dedup(rows("documents", "doc_id, text"))
    assert got(spark, "op8_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert any(r[2] for r in want)


def test_simhash(spark):
    want = brute.simhash(rows("documents", "doc_id, text"))
    assert got(spark, "op9_simhash", "doc_id", "fingerprint", "component_id") == want


def test_token_ids(spark):
    want = brute.token_files(rows("documents", "doc_id, text"), public_tokenizers.path("byte_bpe_50k.json"))
    assert got(spark, "op10_token_ids", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_extraction(spark):
    found = {r[0]: r for r in got(spark, "op5_html_extract", "page_id", "url", "text", "n_chars")}
    pages = rows("pages", "page_id, url, html")
    assert len(found) == len(pages)
    for page, url, source in pages:
        article = re.search(r"<article>(.*)</article>", source, re.S).group(1).replace("<br>", " ")
        blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1|li|ul|div)[^>]*>", article)]
        blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks]
        text = "\n\n".join(b for b in blocks if b)
        assert found[page] == (page, url, text, len(text))


def test_decontamination(spark):
    def tokens(text):
        return re.findall(r"\w+", (text or "").lower())

    items = [(i, tokens(t)) for i, t in rows("benchmark", "item_id, text")]
    want = set()
    for doc, text in rows("documents", "doc_id, text"):
        line = f" {' '.join(tokens(text))} "
        want |= {(doc, i) for i, t in items if len(t) >= 13 and f" {' '.join(t)} " in line}
    found = {r[:2] for r in got(spark, "op6_decontamination", "doc_id", "item_id", "n_tokens")}
    assert want and found == want


def test_licences(spark):
    found = {r[:2] for r in got(spark, "op4_licence_scan", "doc_id", "paragraph", "family", "confirmed") if r[3]}
    want = set()
    for doc, text in rows("documents", "doc_id, text"):
        want |= {(doc, i) for i, x in enumerate((text or "").split("\n")) if re.search("licensed|MIT License|rights reserved", x, re.I)}
    assert want and found == want
