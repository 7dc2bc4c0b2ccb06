"""The helpers on hand-made cases and against plain versions."""

import json
import os
import random

import brute
import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import bwt, chat, decontaminate, extract, linededup, suffixdedup, tokenbin
from panelspark.llm.simhash import _masks, _stars, fingerprint, shingle_hashes

TEXT = st.text(alphabet=st.sampled_from("ab<|\\%\n imend_start>é\x0b"), max_size=40)


@given(TEXT)
def test_escapes_round_trip(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text)) == text
    assert "\n" not in chat.escape_role(text)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=100))
@settings(max_examples=30, deadline=None)
def test_windows_render_like_the_whole(turns):
    found = list(chat.format_stream(chat.marked_turns, iter(turns)))
    assert "".join(f[2] for f in found) == chat.marked_turns(turns)
    assert [chat.read_turn(*f[2:]) for f in found] == turns
    assert [chat.unescape(s[a:b]) for _, _, s, a, b in found] == [t for _, t in turns]


def bracketed(turns):
    """Local, with the content in the middle of a line and JSON escapes."""
    return "<s>" + "".join(f"[{role}] {json.dumps(text)[1:-1]} [/{role}]" for role, text in turns)


def numbered(turns):
    return "".join(f"{i}:{t}\n" for i, (_, t) in enumerate(turns))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), TEXT), max_size=70))
@settings(max_examples=30, deadline=None)
def test_foreign_templates_are_black_boxes(turns):
    for template, local, inverse in ((bracketed, True, lambda x: json.loads(f'"{x}"')), (bracketed, False, lambda x: json.loads(f'"{x}"')), (numbered, False, str)):
        found = list(chat.format_stream(template, iter(turns), local))
        assert "".join(f[2] for f in found) == (template(turns) if turns else "")
        assert [inverse(s[a:b]) for _, _, s, a, b in found] == [t for _, t in turns]


@pytest.mark.parametrize("whole", [10**9, 0])
def test_templates_that_are_not_local_are_reported(monkeypatch, whole):
    monkeypatch.setattr(chat, "WHOLE_CHARS", whole)
    turns = [("user", f"text {i}") for i in range(100)]

    def last_forty(turns):
        return chat.marked_turns(turns[-40:])

    with pytest.raises(chat.RewritesHistory):
        list(chat.format_stream(numbered, iter(turns), True))
    if whole:
        with pytest.raises(chat.RewritesHistory):
            list(chat.format_stream(last_forty, iter(turns), True))
    with pytest.raises(chat.RewritesHistory):
        list(chat.format_stream(last_forty, iter(turns), False))


def test_content_that_changes_its_frame_is_reported():
    def sized(turns):
        return "".join(f"{len(t)}:{t}\n" for _, t in turns)

    def dropped(turns):
        return "".join(f"<{t}>" for _, t in turns if t)

    with pytest.raises(ValueError):
        list(chat.format_stream(sized, iter([("user", "some text")]), False))
    found = list(chat.format_stream(dropped, iter([("user", ""), ("user", "a"), ("user", "")]), False))
    assert [(s, a, b) for _, _, s, a, b in found] == [("", 0, 0), ("<a>", 1, 2), ("", 0, 0)]


def test_rewriting_template_is_detected():
    def counts(turns):
        return f"{len(turns)} turns\n" + chat.marked_turns(turns)

    with pytest.raises(chat.RewritesHistory):
        list(chat.format_stream(counts, iter([("user", "a"), ("assistant", "b")])))


def test_template_that_needs_the_start_is_rendered_from_there():
    turns = [("user", str(i)) for i in range(100)]
    found = list(chat.format_stream(numbered, iter(turns)))
    assert "".join(f[2] for f in found) == numbered(turns)


def test_transform_and_shared_windows():
    draw = random.Random(1)
    for _ in range(100):
        width = draw.randint(1, 6)
        strings = [bytes(draw.choices(b"ab\0\xff", k=draw.randint(1, 14))) for _ in range(draw.randint(1, 12))]
        owners = [draw.randint(0, 4) for _ in strings]
        symbols, lengths = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
        ends = np.cumsum(lengths)
        suffixes = sorted(s[i:] for s in strings for i in range(len(s) + 1))
        want = [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        assert bwt.build(symbols, ends, lengths)[1].tolist() == want
        least = {}
        for s, o in zip(strings, owners, strict=True):
            for i in range(len(s) - width + 1):
                least[s[i : i + width]] = min(o, least.get(s[i : i + width], o))
        windows = sorted((x, i) for x, s in enumerate(strings) for i in range(len(s) - width + 1) if least[s[i : i + width]] < owners[x])
        found = bwt.shared_windows(symbols, ends, lengths, np.array(owners), width)
        assert sorted(zip(*(f.tolist() for f in found), strict=True)) == windows


def test_cut_holds_every_window_once():
    texts = [b"x" * 200, b"short", bytes(random.Random(2).choices(b"abc ", k=700)), b"y" * 50]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    start, length, _, _, _ = suffixdedup.cut(data, ends)
    seen = [i for s, n in zip(start, length, strict=True) for i in range(s, s + n - suffixdedup.WIDTH + 1)]
    begin = np.concatenate(([0], ends[:-1]))
    want = [i for a, b in zip(begin, ends, strict=True) for i in range(a, b - suffixdedup.WIDTH + 1)]
    assert sorted(seen) == want


@given(st.text(max_size=60), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_fingerprints(text, size):
    assert fingerprint(shingle_hashes(text, size)) & (1 << 64) - 1 == brute.fingerprint(text, size)


def test_masks_leave_close_pairs_a_key():
    draw = random.Random(3)
    for bits, blocks in ((3, 6), (6, 8)):
        masks = _masks(bits, blocks)
        for _ in range(300):
            a = draw.getrandbits(64)
            b = a
            for i in draw.sample(range(64), bits):
                b ^= 1 << i
            assert any((a & m) == (b & m) for m in (m & (1 << 64) - 1 for m in masks))


def test_stars_connect_chains():
    values = np.array([0, 0b111, 0b111111, 0b1111 << 40], np.int64)
    u, v = _stars(values, 3)
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == [(0b111, 0), (0b111111, 0)]


def test_bitmaps_round_trip():
    import zlib

    bits = np.ones(16, bool)
    bits[[1, 9]] = False
    keep = zlib.compress(np.packbits(bits, bitorder="little").tobytes())
    assert np.flatnonzero(~linededup.unpack(keep, 40)).tolist() == [1, 9]
    assert linededup.unpack(None, 3).all()


SPACED = st.text(alphabet=st.sampled_from("ab'sZ9 \n\t\u00a0\u3000\u00e9\u4e2d.,-<|>\x1c"), max_size=40)


@given(st.lists(st.one_of(st.text(max_size=60), SPACED), max_size=5))
@settings(max_examples=200, deadline=None)
def test_encoding_by_words_equals_the_library(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    if not CACHE:
        CACHE.update(coder=tokenbin.Encoder(path), lib=Tokenizer.from_file(path))
    texts = [*texts, *[t + "  \n " + t for t in texts], *[f"It's {t} <|endoftext|> {t}" for t in texts], " ".join(texts)]
    found = [e.ids for e in CACHE["lib"].encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in CACHE["coder"].encode(texts)] == found


@pytest.mark.parametrize("held", [0, 5000])
def test_encoding_starts_anew_when_its_memory_is_full(monkeypatch, held):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenbin, "CACHE_BYTES", held)
    monkeypatch.setattr(tokenbin, "_STEP", 50)
    monkeypatch.setattr(tokenbin, "_CALL", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"w{i * j % 97}, zebra" for i in range(60)) for j in range(5)] + ["", " ", "one"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokenbin.Encoder(path).encode(texts)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = ["Some words, 12 of them.", "", "\u00e9t\u00e9  x\n"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokenbin.Encoder(path).encode(texts)] == want


def test_encoder_holds_a_step_of_text_at_once(monkeypatch):
    """Also of many short texts; whole texts go to the library a bounded number of characters a call."""
    monkeypatch.setattr(tokenbin, "_STEP", 4000)
    monkeypatch.setattr(tokenbin, "_TEXTS", 900, raising=False)
    texts = [f"short text {i}" if i % 3 else f"odd\u00a0 text {i}" for i in range(900)]
    coder = tokenbin.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    steps, calls, by_words, whole = [], [], coder._by_words, coder._whole

    def looked_up(group):
        steps.append(sum(map(len, group)))
        with monkeypatch.context() as m:
            m.setattr(coder, "_whole", whole)
            return by_words(group)

    def encoded(group):
        calls.append(sum(map(len, group)))
        return whole(group)

    monkeypatch.setattr(coder, "_by_words", looked_up)
    monkeypatch.setattr(coder, "_whole", encoded)
    assert [x.tolist() for x in coder.encode(texts)] == want
    assert max(steps) <= 4000 and max(calls) <= 900


def test_words_are_learnt_once_whatever_marks_follow(monkeypatch):
    """Marks are parts of their own, and the library's model gets letters without the splitting."""
    words = ["zebra", "\u00e9t\u00e9", "Stra\u00dfe", "\u043c\u0438\u0440", "\u03bb\u03cc\u03b3\u03bf\u03c2"]
    texts = [" ".join(f"{w}{m}" for w in words for m in ["", ",", ".", "!!", "***", "'s", "-"]) + "\n" + "\n".join(words)]
    coder = tokenbin.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    split, whole = [], coder._whole
    monkeypatch.setattr(coder, "_whole", lambda group: split.extend(group) or whole(group))
    assert [x.tolist() for x in coder.encode(texts)] == want
    # each word with a space and, after a line feed, without
    assert sum(len(s[0]) for s in coder.known.sets) == 2 * len(words) + len([",", ".", "!!", "***", "'s", "-", "\n"])
    assert not any(w in text for w in words for text in split)


def test_cuts_beside_letters_equal_the_library():
    """Every character of two bytes, and some of more, next to letters, marks, digits and white space."""
    coder = tokenbin.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    kinds = [*map(chr, range(128, 1 << 11)), "\u4e2d", "\u2026", "\u200d", "\U0001f600", "\U00010400", "'", "_", "7"]
    texts = [t.format(c) for c in kinds for t in ("a{0}, {0}.{0}a\n{0}b {0}'sx", "{0}\n\na\t{0} \n{0}!a{0}{0}-1{0}.5", " {0}{0} a{0}a{0}7! ")]
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(texts)] == want


def test_known_pieces_are_found_after_merges():
    known, rng = tokenbin._Known(np.dtype("<u2")), np.random.default_rng(1)
    hashes = rng.permutation(np.arange(1, 120_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for part in np.split(hashes, 8):
        part = np.sort(part)
        known.add(part, (part % np.uint64(60_000)).astype("<u2"), np.ones(len(part), np.int64))
    at, size = known.find(hashes)
    assert (size == 1).all() and (known.ids[at] == hashes % np.uint64(60_000)).all()
    assert (known.find(hashes + np.uint64(1))[0] == -1).all()
    assert sum(x.nbytes for s in known.sets for x in s) <= 16 * len(hashes)


CACHE: dict = {}


def test_overlap_bears_substitutions():
    item = np.arange(1, 41, dtype=np.uint64)
    doc = np.concatenate((np.arange(100, 110, dtype=np.uint64), item, np.arange(200, 210, dtype=np.uint64)))
    doc[[15, 22, 30]] = 0
    assert decontaminate.best_overlap(doc, item, 10, 13, 80) == (10, 40, 37)
    doc[14:46] = 0
    assert decontaminate.best_overlap(doc, item, 10, 13, 80) == (0, 0, 0)


def test_tokens_fold_case_and_part_at_punctuation():
    a, b = decontaminate.token_hashes("The cat, the HAT!"), decontaminate.token_hashes("the\ncat THE hat")
    assert a.tolist() == b.tolist() and len(a) == 4 and a[0] == a[2]
    assert len(decontaminate.token_hashes("")) == len(decontaminate.token_hashes(" .,")) == 0


PAGE = """<html><head><title>T</title></head><body><header><h2>Site</h2></header>
<div class="cookie-notice"><p>We use cookies, please agree, or leave, now.</p></div>
<div id="wrap"><div class="sidebar"><p>Popular, posts, of, the, week, and, more.</p></div>
<div class="content"><h1>Title</h1><p>First paragraph, which has some length, and commas, to be found &amp; kept.</p>
<p>Second   paragraph <b>bold</b>, longer than most, with more commas, so that it counts.</p>
<ul><li>An item, with text, in a list</ul><form><p>Enter, your, mail</p></form><script>var a = "<p>no</p>";</script></div>
<section id="comments"><p>A reader, who writes, and writes, and writes, and writes a lot, of text, here, for ever.</p></section></div>
<footer>Imprint</footer></body></html>"""


def test_extraction_leaves_boilerplate_out():
    assert extract.main_blocks(PAGE) == [
        "Title",
        "First paragraph, which has some length, and commas, to be found & kept.",
        "Second paragraph bold, longer than most, with more commas, so that it counts.",
        "An item, with text, in a list",
    ]
    assert extract.main_blocks("") == [] and extract.main_blocks("<p>") == []
    assert extract.main_blocks("plain, text") == ["plain, text"]
    assert extract.main_blocks("<p>a<p>b &lt; c") == ["a", "b < c"]
    assert extract.main_blocks("<div>" * 5000 + "deep") == ["deep"]


def test_masks_hit_every_overlap_that_passes():
    from itertools import combinations

    def missed(masks, n, wrong, ends):
        places = [sum(1 << p + i for i, c in enumerate(m) if c == "1") for m in masks for p in range(n - len(m) + 1)]
        inner = range(1, n - 1) if ends else range(n)
        return sum(all(sum(1 << i for i in x) & p for p in places) for x in combinations(inner, wrong))

    # an overlap of 26 tokens or more has a half of 13 or more that passes
    assert not any(missed(decontaminate.MASKS, n, n // 5, False) for n in range(13, 26))
    for n in range(1, 13):
        wrong = n // 5 if n >= decontaminate.MIN_ITEM else 0
        assert not missed(decontaminate.whole_masks(n), n, wrong, True)


def test_cjk_text_is_parted_by_character():
    a, b = decontaminate.token_hashes("今日は、良い天気。ABC１２ 東京"), decontaminate.token_hashes("今 日 は 良 い 天 気 abc１２ 東 京")
    assert a.tolist() == b.tolist() and len(a) == 10
    assert len(decontaminate.token_hashes("“naïve” – русский")) == 2


def test_late_rewriting_is_detected():
    def forgets(turns):
        return chat.marked_turns(turns if len(turns) <= 40 else turns[-20:])

    def counts_late(turns):
        return chat.marked_turns(turns) if len(turns) < 50 else f"{len(turns)} turns\n" + chat.marked_turns(turns)

    for template in (forgets, counts_late):
        with pytest.raises(chat.RewritesHistory):
            list(chat.format_stream(template, iter([("user", str(i)) for i in range(100)])))

    # windows that end by their characters with few turns
    turns = [("user", "x" * 150_000 + str(i)) for i in range(6)]
    assert "".join(f[2] for f in chat.format_stream(numbered, iter(turns))) == numbered(turns)


def test_extraction_keeps_split_and_wrapped_articles():
    long = [f"Paragraph {i}, which has some length, and commas, to be found, and kept, as it is text." for i in range(10)]
    body = "".join(f"<p>{t}</p>" for t in long)
    for tag in ("svg", "math", "object", "iframe"):
        assert extract.main_blocks(f'<div><p>{long[0]}</p><{tag} a="b"/><p>{long[1]}</p></div>') == long[:2]
    for name in ("content-sidebar-wrap", "has-sidebar", "with-toc"):
        page = f'<body><div class="{name}"><div>{body}</div><div class="sidebar"><p>Popular, posts.</p></div></div></body>'
        assert extract.main_blocks(page) == long
    short = "One short end."
    assert extract.main_blocks(f"<article><div>{body}</div><div><p>{short}</p></div></article>") == [*long, short]
    assert extract.main_blocks(f"<body><div><section>{body}</section><section><p>{short}</p></section></div></body>") == [*long, short]
    # more comments than text stay out
    page = f'<body><div><h1>Title</h1>{"".join(f"<p>{t}</p>" for t in long[:3])}</div><div id="comments">{body}{body}</div></body>'
    assert extract.main_blocks(page) == ["Title", *long[:3]]


def test_extraction_keeps_what_only_looks_like_boilerplate():
    rows = "".join(f"<p>Paragraph {i}, with commas, and text that is long enough to count, it is.</p>" for i in range(5))
    more = """<section id="social-history"><h2>Social history</h2><p>Some words, and more, in the article.</p></section>
<div class="header-image-caption">A caption of the picture</div>
<ul><li>Ann said nothing, and left</li><li>an item of the text</li></ul>"""
    gone = """<ul class="c-list"><li><b>Ann</b> says: nice one, really</li><li><b>Bob</b> wrote: not at all, friend</li></ul>
<div><div>Cy 3 hours ago I agree, with all of it</div><div>Di 2 days ago So do I</div></div>
<div class="share-buttons"><a>Share</a></div><div class="social-links">Follow</div><div id="related-posts">Other</div>
<section><h3>12 comments</h3><p>First, of all, I was here, before you.</p></section>"""
    want = ["Title", *[f"Paragraph {i}, with commas, and text that is long enough to count, it is." for i in range(5)]]
    want += ["Social history", "Some words, and more, in the article.", "A caption of the picture", "Ann said nothing, and left", "an item of the text"]
    assert extract.main_blocks(f"<html><body><article><h1>Title</h1>{rows}{more}{gone}</article></body></html>") == want


def test_extraction_takes_time_in_proportion_to_depth():
    import time

    took = []
    for n in (2000, 8000):
        began = time.perf_counter()
        assert len(extract.main_blocks("<div>text, here" * n + "</div>" * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] and took[1] < 5
