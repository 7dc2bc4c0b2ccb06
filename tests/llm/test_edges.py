"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import sys

import brute
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import chat, decontaminate, extract, licence, linededup, mixing, quality, simhash, suffixdedup, tokenbin

# functions of this module run in tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(brute)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size string, h string, fp string, copy string, __bad string"
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def prose(seed, n=120):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(3, 9))) for _ in range(n))


LINE = "A line that is long enough to have a key of its own, " * 2
EDGES = [
    (1, prose(1), "en", "a"),
    (2, prose(1), "en", "b"),
    (3, prose(3) + "\n" + LINE, "en", None),
    (3, prose(3) + "\n" + LINE, "en", None),
    (4, None, None, None),
    (5, "", "en", ""),
    (6, " \t\n\x0b ", "en", "a"),
    (7, "\n".join([LINE] * 3) + "\nLicensed under the Apache License, Version 2.0.", "en", "a"),
    (8, prose(8, 9000), "en", "a"),
    (9, prose(9) + " " + ITEM.upper() + ". " + prose(10), "en", "b"),
    (10, LINE.upper() + "\n" + prose(11), "en", "b"),
    (11, "\t" + LINE + "\n" + prose(12), "en", "b"),
    (12, LINE, "en", "c"),
    (None, prose(13), "en", "a"),
    (None, None, None, None),
    (14, prose(1).replace(" ", "  ", 2) + " more", "en", "c"),
]
IDS = [r[0] for r in EDGES]


def table(spark, rows):
    return spark.createDataFrame([(*r, None, *["x"] * 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, EDGES).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (None, ITEM), (4, "short")], "item_id long, text string")


def sha(text):
    return (brute.sha(text),)


def known(rows):
    """A row per doc_id of the edge rows."""
    return sorted({r[0]: (r[0], r[1]) for r in rows if r[0] is not None}.items())


def test_quality(docs, none):
    found = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for doc, text, *_ in EDGES:
        if doc is not None:
            r = found[doc]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_rules(text)
    assert quality.judge(docs).count() == len(EDGES) and quality.judge(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 3, 8, 9, 10, 11, 14]


def test_quality_rejects_depleted_documents(spark):
    shared = "\n".join(prose(100 + i, 30) for i in range(3))
    rows = [(i, shared + f"\nown words of number {i}", "en", "host") for i in range(130)]
    rows += [(1000 + i, prose(2000 + i), "en", "host") for i in range(10)]
    found = {r["doc_id"]: r["kept"] for r in quality.judge(table(spark, rows)).collect()}
    assert found[0] and not any(found[i] for i in range(1, 130)) and all(found[1000 + i] for i in range(10))


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(EDGES) and mixing.mix(none).count() == 0
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()), key=str)
    copies = mixing.mixed_rows(docs)
    assert copies.columns == docs.columns and mixing.mixed_rows(none).count() == 0
    assert copies.filter("doc_id = 8").count() <= 2


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a is capped at 200; 2950 are left for weights 2 and 1, of which b takes its cap of 2000 at most
    assert found["a"] == 200 and found[None] == 0
    assert abs(found["b"] - 2950 * 2 / 3) < 1e-6 and abs(found["c"] - 2950 / 3) < 1e-6


def test_taken_words_come_near_the_targets(spark):
    draw = random.Random(5)
    rows = [(i, prose(i, draw.randint(1, 40) * draw.choice([1, 1, 8])), "en", draw.choice("abcd")) for i in range(300)]
    found = mixing.mix(table(spark, rows)).withColumn("source", F.col("source_size"))
    sums = found.groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 0.01 * r["g"] for r in sums)


def test_licences(docs, none):
    found = {(r["doc_id"], r["paragraph"]): r for r in licence.find_licences(docs).collect()}
    assert found[(7, 3)]["family"] == "apache" and found[(7, 3)]["confirmed"]
    assert [k for k, r in found.items() if r["confirmed"]] == [(7, 3)]
    assert licence.find_licences(none).count() == 0
    repeated = licence.find_licences(docs.union(docs)).filter("confirmed")
    assert repeated.count() == 2 and repeated.columns == licence.find_licences(none).columns


@pytest.fixture(scope="module")
def licences(spark):
    rows = [(i, "\n".join(f"{prose(10 * i + j, 20).capitalize()}." for j in range(6)), "en", "a") for i in range(120)]
    wrapped = [
        "Permission is hereby granted, free of charge, to any person",
        "obtaining a copy of this software and associated documentation",
        'files (the "Software"), to deal in the Software without restriction,',
        "including without limitation the rights to use, copy, modify, merge,",
        "publish, distribute, sublicense, and/or sell copies of the Software.",
    ]
    rows.append((500, prose(500, 30) + ".\n" + "\n".join(wrapped) + "\n" + prose(501, 30) + ".", "en", "a"))
    # licences whose names the training does not have
    others = ["Reciprocal Public License 1.5", "Fair License", "Simple Public License", "NASA Open Source Agreement 1.3", "Entessa Public License", "Frameworx License",
              "Sybase Open Watcom Public License", "RealNetworks Public Source License", "Apple Public Source License 2.0", "Lucent Public License"]
    ways = ["Licensed under the {}.", "This file is released under the terms of the {}.", "Distributed under the {}; see the file COPYING."]
    rows += [(600 + i, f"{prose(600 + i, 30)}.\n{ways[i % 3].format(n)}\n{prose(700 + i, 30)}.", "en", "a") for i, n in enumerate(others)]
    known = [("mit", "Licensed under the MIT License; see the file COPYING."), ("gpl", "Distributed under the GNU General Public License, version 2."), ("cc-by", "Photos are licensed under CC BY 4.0."), ("apache", "This file is licensed under the Apache License, Version 2.0.")]
    rows += [(800 + i, f"{prose(800 + i, 30)}.\n{text}\n{prose(900 + i, 30)}.", "en", "a") for i, (_, text) in enumerate(known)]
    return table(spark, rows), len(others), [f for f, _ in known]


def test_unknown_licences_wrapped_notices_and_prose(licences):
    docs, n_others, known = licences
    found = licence.find_licences(docs).collect()
    others = {r["doc_id"]: r["family"] for r in found if 600 <= r["doc_id"] < 700}
    assert sum(f == "unknown" for f in others.values()) >= 0.9 * n_others
    assert {r["doc_id"] - 800: r["family"] for r in found if r["doc_id"] >= 800} == dict(enumerate(known))
    wrapped = [r for r in found if r["doc_id"] == 500]
    assert [(r["paragraph"], r["lines"], r["family"], r["confirmed"]) for r in wrapped] == [(1, 5, "mit", True)]
    assert not [r for r in found if r["doc_id"] < 500]


def test_licence_scores_are_those_of_the_regression(spark, licences):
    import math

    docs, *_ = licences
    lines = licence.paragraphs(docs)
    model = licence.train(spark, lines, 400)
    assert licence.TEMPERATURES[0] < model.temperature < licence.TEMPERATURES[-1]
    rows = [("Licensed under the MIT License.",), ("Released under the Fair License.",), (prose(1, 20),), ("All rights reserved.",), ("",)]
    texts = spark.createDataFrame(rows, "text string")
    features = {r["text"]: r["__features"] for r in licence._features(texts).collect()}
    weights, bias = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    want = {}
    for text, vector in features.items():
        raw = [(weights[c][vector.indices].sum() + bias[c]) / model.temperature for c in range(len(licence.LABELS))]
        p = [math.exp(x - max(raw)) for x in raw]
        p = [x / sum(p) for x in p]
        label = licence.LABELS[p.index(max(p))]
        if label != "none":
            want[text] = (label if max(p) >= model.threshold else "unknown", round(max(p), 9))
    got = {r["text"]: (r["family"], round(r["probability"], 9)) for r in model.score(texts).collect()}
    assert got == want and want[rows[0][0]][0] == "mit" and prose(1, 20) not in want


def test_runs_of_wrapped_lines(spark):
    text = "One\ntwo\nthree.\n\nfour\n \nfive:\nsix\nseven"
    rows = table(spark, [(1, text, "en", "a"), (2, "\n".join("x" * 20), "en", "a"), (3, "a.\nb\n" * 2, "en", "a")])
    found = sorted(tuple(r) for r in licence.paragraphs(rows).filter("lines > 1").collect())
    assert found == [(1, 0, 3, "One two three."), (1, 7, 2, "six seven"), (3, 1, 2, "b a.")]


def test_decontamination(docs, none, items):
    found = [tuple(r) for r in decontaminate.find_leaks(docs, items).select("doc_id", "item_id", "n_equal").collect()]
    assert found == [(9, 1, 16)]
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(EDGES) - 1
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_line_dedup(docs, none):
    found = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs), sha, "kept_sha256 string")
    got = {r["doc_id"]: tuple(r) for r in found.collect()}
    for want in brute.line_dedup([x for _, x in known(EDGES)]):
        assert got[want[0]] == want
    assert found.count() == len(EDGES) and got[7][2] == 3 and got[12][2] == 0
    assert linededup.apply_bitmaps(none, linededup.keep_bitmaps(none), sha, "kept_sha256 string").count() == 0


def test_suffix_dedup(docs, none):
    found = suffixdedup.remove_repeats(docs, sha, "kept_sha256 string")
    got = {r["doc_id"]: tuple(r) for r in found.collect()}
    for want in brute.suffix_dedup([x for _, x in known(EDGES)]):
        assert got[want[0]] == want
    assert found.count() == len(EDGES)
    assert suffixdedup.remove_repeats(none, sha, "kept_sha256 string").count() == 0


def test_simhash(docs, none):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    for doc, _, root in brute.simhash([x for _, x in known(EDGES)]):
        assert got[doc] == root
    assert simhash.near_duplicates(docs).count() == len(EDGES) and simhash.near_duplicates(none).count() == 0


def test_near_copies(docs, none):
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert groups[2] == 1 and groups[14] == 1 and groups[3] == 3 and groups[8] == 8
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(3) == 1 and not {2, 14} & set(ids)
    assert simhash.keep_first(none).count() == 0


def test_near_copies_against_all_pairs(spark):
    draw = random.Random(7)
    rows = []
    for g in range(12):
        base = prose(500 + g, 200).split()
        for k in range(6):
            words = list(base)
            for _ in range(draw.choice([0, 1, 2, 4, 12, 30])):
                words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
            rows.append((g * 6 + k, " ".join(words), "en", "a"))
    draw.shuffle(rows)
    marks = {d: {tuple(t.split()[i : i + 5]) for i in range(196)} for d, t, *_ in rows}
    alike = [(a, b) for a in marks for b in marks if a > b and 100 * len(marks[a] & marks[b]) >= 80 * len(marks[a] | marks[b])]
    want = brute.components(sorted(marks), alike)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(table(spark, rows)).collect()}
    assert got == want and len(set(want.values())) > 12


def test_token_files(spark, docs, none):
    path = tokenbin.default_tokenizer(spark)
    manifest = tokenbin.write_token_files(docs, path)
    found = tokenbin.read_token_files(manifest, lambda ids: (ids.tolist(),), "ids array<int>").orderBy("start").collect()
    order = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in found] == [r[0] for r in order]
    start = 0
    for r in found:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        start += r["n_tokens"]
    from tokenizers import Tokenizer

    text = Tokenizer.from_file(path).decode([r for r in found if r["doc_id"] == 9][0]["ids"][:-1])
    assert text == [r[1] for r in EDGES if r[0] == 9][0]
    empty = tokenbin.write_token_files(none, path)
    assert tokenbin.read_token_files(empty, lambda ids: (), "x int").count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, None, None, None), (2, 0, None, "<|im_end|>\n")]
    rows += [(3, i, "user" if i % 2 else "assistant", f"turn {i} <|im_start|>") for i in range(300)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(turns)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_sha256"] == brute.sha("bb") and got[1]["loss_chars"] == 2
    assert got[1]["turns_sha256"] == brute.sha("user\n\nassistant\nb\nassistant\nb\n")
    assert got[None]["turns_sha256"] == brute.sha("\n\n") and got[2]["turns_sha256"] == brute.sha("\n<|im_end|>\n\n")
    assert got[3]["n_turns"] == 300
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


def test_extraction(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "<p>" + "word, " * 100_000 + "</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract.main_text(pages).collect()), key=str)
    assert got[0] == (1, "u", "", 0) and got[1] == got[0]
    assert got[2][3] == len("word, " * 100_000) - 1 and got[3] == (None, None, "", 0)
    assert extract.main_text(pages.limit(0)).count() == 0


def test_pipeline(spark, docs, none, items, tmp_path):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    # the ids that each stage leaves, null ones as -1: base rules, copies of 1 and 3, the passage in 9
    want = {
        "quality_rules": [-1, 1, 2, 3, 3, 8, 9, 10, 11, 14],
        "near_duplicates": [-1, 1, 3, 8, 9, 10, 11],
        "decontamination": [-1, 1, 3, 8, 10, 11],
    }
    for name, first in (("docs", docs), ("none", none)):
        rows = first
        for stage, function in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{stage}")
            function(spark, rows, str(tmp_path)).write.parquet(path)
            rows, before = spark.read.parquet(path), rows
            found = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows.collect())
            if stage in want:
                assert found == (want[stage] if name == "docs" else [])
            if stage == "source_mixing":
                sizes = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix(before).collect()}
                assert found == sorted(i for d, n in sizes.items() for i in [-1 if d is None else d] * n)
                mixed = found
            if stage == "token_ids":
                assert found == mixed
            else:
                assert rows.columns == before.columns


def test_near_copies_with_contiguous_edits(spark):
    draw = random.Random(11)
    rows = []
    for g in range(60):
        base, other = prose(9000 + g, 200).split(), prose(7000 + g, 200).split()
        n = draw.choice([8, 16, 30, 40, 46])
        edits = (base + other[:n], base[: 200 - min(n, 38)], base[:90] + other[:n] + base[90:])
        rows += [(4 * g + k, " ".join(words), "en", "a") for k, words in enumerate((base, *edits))]
    marks = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t, *_ in rows}
    alike = [(a, b) for a in marks for b in marks if a > b and 100 * len(marks[a] & marks[b]) >= 80 * len(marks[a] | marks[b])]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(table(spark, rows)).collect()}
    assert len(alike) > 150 and got == brute.components(sorted(marks), alike)


def test_fingerprints_link_in_the_stage(spark):
    """Texts that differ in what they repeat least: fingerprints link them, shingle sets do not."""
    pairs = []
    for g in range(40):
        body = prose(100 + g, 60) + " "
        a, b = body * 9 + prose(1100 + g, 40), body * 9 + prose(2100 + g, 40)
        far = simhash.fingerprint(simhash.shingle_hashes(a, 3)) ^ simhash.fingerprint(simhash.shingle_hashes(b, 3))
        if (far & (1 << 64) - 1).bit_count() <= 3:
            pairs.append((a, b))
    assert len(pairs) > 3
    rows = [(2 * g + k, text, "en", "a") for g, pair in enumerate(pairs) for k, text in enumerate(pair)]
    docs = table(spark, rows)
    assert simhash.near_copies(docs).filter("doc_id != component_id").count() == 0
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [2 * g for g in range(len(pairs))]


def test_links_of_both_kinds_make_one_group(spark):
    """1 and 2 are linked from outside, 2 and 3 by their sets: the smallest of all stays."""
    base = prose(77, 200)
    rows = [(1, prose(78, 200), "en", "a"), (2, base, "en", "a"), (3, base + " more", "en", "a"), (4, prose(79, 200), "en", "a")]
    linked = spark.createDataFrame([(2, 1)], "u long, v long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(table(spark, rows), linked=linked).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_a_pair_with_many_common_shingles_is_met_once(spark):
    """A row for each pair, not one for each of the 500 keys that its texts share."""
    keyed = spark.range(500).selectExpr("explode(array(1L, 2L, 3L)) AS id", "id AS key")
    attributes = {"label": F.col("id"), "size": F.lit(500).cast("long")} | {b: F.lit(0).cast("long") for b in simhash.PARITIES}
    found = simhash._crossing(simhash._by_least(keyed).withColumns(attributes), 80, 1)
    assert sorted(map(tuple, found.collect())) == [(2, 1, False), (3, 1, True)]


def test_quality_takes_frequent_lines_out(spark):
    banner = "All  rights of THIS banner\tare reserved"
    rows = [(i, f"{prose(3000 + i, 60)}\n\n{banner}\n tail {i} ", "en", "host" if i % 2 else None) for i in range(260)]
    rows += [(500, f"{prose(9, 60)}\n{banner}", "en", "other"), (None, f"{prose(8, 60)}\n{banner}", "en", "host")]
    docs = table(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert len(found) == len(rows)
    for doc, text, *_ in rows:
        # the smallest document of each host keeps the line, as do other hosts and rows without an id
        want = text if doc in (0, 1, 500, None) else text.replace(f"\n{banner}", "")
        assert found[doc] == (want, len(want))


def test_short_and_changed_benchmark_items(spark):
    def changed(words, *at):
        return " ".join("other" if i in at else w for i, w in enumerate(words))

    texts = {1: prose(1, 9), 2: prose(2, 10), 3: prose(3, 12), 4: prose(4, 13), 5: prose(5, 15), 6: prose(6, 3), 7: "東京は日本の首都である。人口は多い"}
    w = {i: t.split() for i, t in texts.items()}
    leaks = {1: changed(w[1], 4), 2: changed(w[2], 3, 6), 3: changed(w[3], 4, 8), 4: changed(w[4], 4, 8), 5: changed(w[5], 3, 7, 11), 6: texts[6], 7: "、東京は日本の首都である！人口は少い"}
    rows = [(i, f"{prose(50 + i)} {t} {prose(80 + i)}", "en", "a") for i, t in leaks.items()]
    rows += [(16, f"{prose(56)} {changed(w[6], 1)} {prose(86)}", "en", "a"), (12, f"{prose(57)} {changed(w[2], 2, 5, 7)}", "en", "a")]
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    found = decontaminate.find_leaks(table(spark, rows), items).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found)) == [(i, i) for i in range(1, 8)]


def test_leaks_against_all_diagonals(spark):
    draw = random.Random(21)
    vocabulary = [prose(i, 1) for i in range(60)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice((3, 8, 9, 11, 12, 13, 15, 20, 30))))) for i in range(24)]
    rows = []
    for d in range(40):
        words = draw.choices(vocabulary, k=draw.randint(20, 60))
        item = draw.choice(items)[1].split()
        a = draw.randint(0, max(0, len(item) - 14))
        part = item[a : a + draw.randint(8, 30)]
        for _ in range(draw.choice((0, 1, 2, 3, 4))):
            part[draw.randrange(len(part))] = draw.choice(vocabulary) + "q"
        at = draw.randint(0, len(words))
        rows.append((d, " ".join(words[:at] + part + words[at:]), "en", "a"))
    found = decontaminate.find_leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["n_tokens"] for r in found.collect()}
    want = brute.leaks([(d, t) for d, t, *_ in rows], items, str.split)
    assert got == want and len(want) > 12


def test_repetitive_texts_are_not_copied_for_every_diagonal(spark):
    items = spark.createDataFrame([(1, "spam " * 20), (2, "spam " * 9)], "item_id long, text string")
    docs = table(spark, [(1, "spam " * 4000 + prose(1), "en", "a"), (2, prose(2), "en", "a")])
    found = [tuple(r) for r in decontaminate.find_leaks(docs, items).orderBy("item_id").collect()]
    assert [(r[0], r[1], r[3], r[4]) for r in found] == [(1, 1, 20, 20), (1, 2, 9, 9)]
    met = spark.range(4000).selectExpr("'c' AS cluster", "1L AS item_id", "cast(id AS int) AS at", "cast(id % 15 AS int) AS pos")
    asked = decontaminate._questions(met, items).collect()
    assert len(asked) == 1 and len(asked[0].asked) == 1 and len(asked[0].asked[0].diagonals) > 200


def test_mixing_without_ids_and_with_repeats(spark):
    draw = random.Random(5)
    rows = [(None, " ".join(["w"] * 100 + [str(i)]), "en", "a") for i in range(300)]
    rows += [(None, " ".join(["same"] * 100), "en", "b")] * 300 + [(7, " ".join(["x"] * 50), "en", "c")] * 3
    rows += [(i + 100, " ".join(["y"] * draw.randint(1, 200)), "en", draw.choice("abcd")) for i in range(400)]
    docs = table(spark, rows)
    plan = mixing.mix(docs)
    goals = {r["source"]: r for r in plan.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.first("doc_id")).join(
        docs.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).cast("long").alias("source_size")), "source_size").collect()}
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert goals.keys() == words.keys() == set("abcd")
    for source, row in goals.items():
        assert words[source] == row["taken"] and abs(words[source] - row["target"]) <= 0.02 * row["target"]
    again = mixing.mixed_rows(docs.repartition(7))
    assert again.exceptAll(mixed).count() == 0 and mixed.exceptAll(again).count() == 0


@pytest.mark.parametrize("size, held, frequent", [(30, 4, False), (30, 5, True), (400, 4, False), (400, 5, True), (2000, 20, False), (2000, 21, True)])
def test_line_limit_follows_the_host(spark, size, held, frequent):
    """A share of the host with a floor of five documents, whatever the host's size."""
    line = "a line that many documents of one host have"
    docs = spark.range(size).selectExpr("id AS doc_id", "'host' AS host", f"concat('own line ', id, if(id < {held}, '\\n{line}', '')) AS text")
    lines = quality.document_lines(docs)
    assert [r["first_doc"] for r in quality.frequent_lines(lines).collect()] == ([0] if frequent else [])


def test_line_limit_is_bounded_in_large_hosts(spark):
    """In 20,000 documents 1 % is the limit, and over a thousand is frequent in any host."""
    docs = spark.range(120_000).selectExpr("id AS doc_id", "'host' AS host", "concat('own ', id, if(id < 1001, '\\nbanner here', ''), if(id < 1000, '\\nother banner', '')) AS text")
    assert quality.frequent_lines(quality.document_lines(docs)).count() == 1
    small = quality.document_lines(docs.filter("doc_id < 20000"))
    assert quality.frequent_lines(small).count() == 2
    assert quality.frequent_lines(small, max_percent=6, max_docs=10**9).count() == 0
