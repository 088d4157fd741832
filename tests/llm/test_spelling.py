"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfwise.llm import spelling as s

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(words):
    out, forms = {}, {}
    for w, n in words.items():
        close = [o for o in words if near(w, o)]
        best = min(close, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        out[w] = (n, len(close))
    rows = []
    for w, (n, n_near) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, n_near, words[forms[w]] if forms[w] else None))
    return sorted(rows, key=str)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def shop(seed):
    """Few stems in many spellings, of very unequal frequency."""
    rng = random.Random(seed)
    stems = ["lampshade", "keyboard", "télévision", "straßenbahn", "notebooks", "zzzzzzzz", "aaaaaaa", "bicycle"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(40):
            w = stems[min(int(rng.expovariate(0.7)), len(stems) - 1)]
            for _ in range(rng.choice([0] * 12 + [1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abzéÿ") + w[at:], w[:at] + rng.choice("abzéÀ") + w[at + 1:]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w, w + ".", w + "5"]))
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_variants(make_docs, seed):
    rows = shop(seed)
    words = plain_words(rows)
    assert len(words) > 100 and any(r[1] and r[2] != r[1] for r in plain_variants(words)), "no chain of two"
    assert got(s.variants(make_docs(rows).repartition(5))) == plain_variants(words)


def test_rounds_and_small_filters(make_docs, monkeypatch):
    """Filters that go out a few blocks at a time, and blocks so full that most edits pass them, lose nothing."""
    rows = shop(9)
    monkeypatch.setattr(s, "AT_ONCE", 40)
    monkeypatch.setattr(s, "A_BLOCK", 8)
    assert got(s.variants(make_docs(rows))) == plain_variants(plain_words(rows))


def test_edges(make_docs):
    long = "q" * 5000 + "é" + "r" * 5000
    rows = [
        (1, None), (2, ""), (3, "short words only"), (4, f"{long} {long} {long}"), (5, " ".join([long[:-1]] * 30)), (None, "nothing Nothing nothings"),
        (None, "nothing"), (7, "nothing nothing"), (7, "nothing nothing"), (8, "ÀÉÎÕÜÿ× ÀÉÎÕÜÿ× ÀÉÎÕÜÿ÷ ÀÉÎÕÜÿ÷"), (9, "a1bcdefg2hijklmn " * 3), (10, "x" * 64 + " " + "x" * 65),
        (11, ("x" * 64 + " ") * 3 + ("x" * 65 + " ") * 2 + ("x" * 66 + " ") * 2),
    ]
    assert got(s.variants(make_docs(rows))) == plain_variants(plain_words(rows))


def test_empty(make_docs):
    assert got(s.variants(make_docs([]))) == []
    assert got(s.variants(make_docs([(1, "no word twice here")]))) == []


def test_ties(make_docs):
    """Of near words with the same n the smallest in code-point order is the form."""
    words = [("shelving", 40), ("shelvinz", 40), ("shelviné", 40), ("shelvin", 2)]
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words)]
    docs = [(k if zlib.crc32(f"{k}:{t.split()[0]}".encode()) % 31 else k + 1000, t) for k, t in docs]
    out = {r[0]: r for r in got(s.variants(make_docs(docs)))}
    assert out["shelvin"] == ("shelvin", "shelving", "shelving", 2, 3, 40) and out["shelvinz"][1] is None


def test_hashes_of_edits():
    """The hash of an edit, made from its word's, is that of the edited word."""
    filters = s.Filters({n: 500 for n in range(6, 12)})
    words = ["bookshelf", "aabbccdde", "éclairage"]
    letters = np.array([ord(c) for c in "abcé"], np.uint64)
    every = np.full(filters.total, np.uint64(2**64 - 1))
    made = {w[:p] + (chr(c) if c >= 0 else "") + w[p + 1:] for at, row, letter in s.edits(words, 9, letters, filters, every, 0) for p, w, c in zip(at, [words[r] for r in row], letter)}
    want = {w[:k] + w[k + 1:] for w in words for k in range(9)} | {w[:k] + c + w[k + 1:] for w in words for k in range(9) for c in "abcé" if c > w[k]}
    assert made == want
    only = np.zeros(filters.total, np.uint64)
    for length, own in ((8, ["bookshel"]), (9, ["éclairagé", "bookshélf"])):
        block, bits = filters.places((s.codes_of(own, length) * s._factors(length)).sum(axis=1, dtype=np.uint64), length)
        np.bitwise_or.at(only, block, bits)
    made = {words[r][:p] + (chr(c) if c >= 0 else "") + words[r][p + 1:] for at, row, letter in s.edits(words, 9, letters, filters, only, 0) for p, r, c in zip(at, row, letter)}
    assert {"bookshel", "éclairagé", "bookshélf"} <= made and len(made) < 10
