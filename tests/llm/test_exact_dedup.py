"""Exact duplicates, and the directory of their index, against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import exact_dedup
from shelfwise.llm.common import ascii_lower


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


ROWS = [
    (1, "Same Text"), (5, "same text"), (3, "SAME TEXT"), (2, None), (8, ""), (4, "É"), (6, "é"), (7, "Ärger Ä"), (10, "ärger ä"), (11, "ÄRGER Ä"),
    (12, "x" * 200_000), (13, "X" * 200_000), (14, "İI"), (15, "İi"), (16, "alone"), (17, "ΑΣ A"), (18, "ΑΣ a"),
]


@pytest.mark.parametrize("capacity, depth", [(1, 16), (2, 3), (50_000, 16)])
def test_duplicates(make_docs, capacity, depth):
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.duplicates(make_docs(ROWS), capacity, depth).collect()}
    groups = {}
    for i, t in ROWS:
        groups.setdefault(lower(t), []).append(i)
    want = {
        i: (max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in ROWS
    }
    assert got == want


def test_repeated_rows_and_missing_ids(make_docs):
    docs = make_docs([(1, "a"), (1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "B"), (2, "c"), (2, "d"), (3, "c")])
    rows = exact_dedup.duplicates(docs).collect()
    assert len(rows) == 9
    kept = [(r["doc_id"], r["text_sha256"]) for r in rows if r["kept"]]
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in "abcd"}
    assert sorted(kept, key=str) == sorted([(1, sha["a"]), (None, sha["b"]), (3, sha["c"]), (2, sha["d"])], key=str)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], lower(r["text"])) for r in left.collect()), key=str) == sorted([(1, "a"), (None, "b"), (3, "c"), (2, "d")], key=str)


def test_empty(make_docs):
    assert exact_dedup.duplicates(make_docs([])).count() == 0
    assert exact_dedup.drop_duplicates(make_docs([])).count() == 0


def test_directory_doubles_only_where_full(spark):
    hashes = [k << 60 for k in range(8)] * 3 + [(1 << 59) + k for k in range(5)]  # prefixes 0000 … 0111, and a full 00001
    entries = spark.createDataFrame([(h,) for h in hashes], "h bigint")
    slots = {r["slot"]: (r["depth"], r["bucket"]) for r in exact_dedup.directory(entries, capacity=4, max_depth=6).collect()}
    assert len(slots) == 64
    for slot, (depth, bucket) in slots.items():
        assert bucket == slot >> (6 - depth) << (6 - depth)
        inside = sum(h >> (64 - depth) == slot >> (6 - depth) if depth else 1 for h in hashes)
        assert inside <= 4 or depth == 6
        if depth:  # the bucket it was split from was overfull
            assert sum(h >> (65 - depth) == slot >> (7 - depth) if depth > 1 else 1 for h in hashes) > 4


def test_ascii_lower(spark):
    texts = ["ABC", "É A", "é A", "ß", "ΑΣ X", "ς A", "İ I", "", "Ａ A", "𐐀 A"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ascii_lower(F.col("t")).alias("l"))
    assert {r["t"]: r["l"] for r in df.collect()} == {t: lower(t) for t in texts}
