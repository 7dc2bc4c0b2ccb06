"""Plain single-machine versions of the operators, for small tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    inside = set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            inside |= {i, i + 1, i + 2}
    repeat = len(inside)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        repeat,
        len(words) < 50 or 100 * repeat > 50 * len(words),
    )


def line_dedup(rows, min_chars=40, min_docs=5):
    split = [(d, (t or "").split("\n")) for d, t in rows]
    holders = {}
    for d, lines in split:
        for x in lines:
            key = fold(x.strip(SPACES))
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(d)
    out = []
    for d, lines in split:
        kept = []
        for x in lines:
            who = holders.get(fold(x.strip(SPACES)), set())
            if len(who) < min_docs or d == max(who):
                kept.append(x)
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def suffix_dedup(rows, width=50):
    least = {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1):
            least.setdefault(raw[i : i + width], d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if least[raw[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(raw), sum(gone), runs, sha(kept)))
    return sorted(out)


def fingerprint(text, size=3):
    words = WORD.findall(fold(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def simhash(rows, bits=3):
    marks = {d: fingerprint(t) for d, t in rows}
    ids = sorted(marks)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (marks[a] ^ marks[b]).bit_count() <= bits]
    roots = components(ids, links)
    return sorted((d, f"{marks[d]:016x}", roots[d]) for d in ids)


def token_files(rows, path, end_id=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out, start = [], 0
    for d, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        out.append((d, start, len(ids), crc))
        start += len(ids)
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_search(docs, items, top=10):
    held = [(d, Counter(TERM.findall(fold(t or "")))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(fold(text or "")))
        found = []
        for d, c in held:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            score = 0
            for t, q in asked.items():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += q * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(found[:top], 1)]
    return out


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def kneser_ney(rows, order):
    """(doc_id, held out, tokens, known, base score, score) by dictionaries of tuples."""
    texts = [(d, [*WORD.findall(fold(t or "")), "\n"]) for d, t in rows]
    train = [t for d, t in texts if not held_out(d)]
    uses = Counter(w for t in train for w in t)
    n, v = uses.total(), len(uses)
    counts = {order: Counter(g for t in train for g in grams(t, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter()
        for g, c in counts[k + 1].items():
            counts[k][g[1:]] += c if g[1] == " " else 1
    taken, totals, kinds = {}, {}, {}
    for k, table in counts.items():
        taken[k] = kn_discounts(Counter(table.values()))
        totals[k], kinds[k] = Counter(), {}
        for g, c in table.items():
            totals[k][g[:-1]] += c
            kinds[k].setdefault(g[:-1], Counter())[min(c, 3)] += 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / (v + 1)
        total = totals[k][g[:-1]]
        if not total:
            return p(g[1:])
        c = counts[k][g]
        rest = sum(taken[k][i] * m for i, m in kinds[k][g[:-1]].items()) / total
        return (c - taken[k][min(c, 3)]) / total + rest * p(g[1:])

    out = []
    for d, t in texts:
        base = sum(math.log10((uses[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((d, held_out(d), len(t), sum(uses[w] > 0 for w in t), base, sum(math.log10(p(g)) for g in grams(t, order))))
    return n, out


def grams(tokens, order):
    padded = [" "] * (order - 1) + tokens
    return [tuple(padded[i : i + order]) for i in range(len(tokens))]


def kn_discounts(n):
    if min(n[i] for i in (1, 2, 3, 4)) < 1:
        return [0, 0.5, 1, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    found = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
    return [0, *found] if all(0 < x < i for i, x in enumerate(found, 1)) else [0, 0.5, 1, 1.5]


def filter_audit(docs, labels):
    """Every document sent through every order of the filters."""
    least, quality, toxic = {}, set(), set()
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, q, x in labels:
        quality |= {d} if q == 1 and d is not None else set()
        toxic |= {d} if x == 1 and d is not None else set()
    out = {}
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {lang or "" for _, lang, _ in docs}:
        out |= {(part, o, s): [0] * 6 for o in orders for s in range(1, 6)}
    for d, lang, text in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            x
            for x, failed in zip(
                "ABCDE",
                (
                    len(words) < 100,
                    100 * len(set(words)) < 80 * len(words),
                    100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                    any(c in "#$%&*|" for c in text),
                    d is not None and least[text] < d,
                ),
                strict=True,
            )
            if failed
        }
        for o in orders:
            alive = True
            for s, x in enumerate(o, 1):
                row = out[lang or "", o, s]
                if x in fails:
                    row[2 - alive] += 1
                    row[4] += alive and d in quality
                    row[5] += alive and d in toxic
                    alive = False
                row[0] += alive
                row[3] += fails == {x}
    shapley = Counter()
    for (part, o, s), row in out.items():
        shapley[part, o[s - 1]] += row[1]
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items())


def leaks(docs, items, tokens, least=13, percent=80, short=8):
    """(doc_id, item_id, tokens) of the longest alike stretch of every pair, over all diagonals."""
    out = {}
    for d, text in docs:
        doc = tokens(text)
        for i, item_text in items:
            item = tokens(item_text)
            wanted, share = min(least, len(item)), percent if len(item) >= short else 100
            best = 0
            for shift in range(-len(item), len(doc) + 1) if item else ():
                same = [0 <= shift + j < len(doc) and doc[shift + j] == item[j] for j in range(len(item))]
                for a in range(len(item)):
                    for b in range(len(item), a + max(wanted, best + 1) - 1, -1):
                        if same[a] and same[b - 1] and 0 <= shift + a and shift + b <= len(doc) and 100 * sum(same[a:b]) >= share * (b - a):
                            best = b - a
                            break
            if best:
                out[d, i] = best
    return out
