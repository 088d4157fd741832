"""Tokens against the tokenizer itself, packing against rules and a plain best fit."""

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import packing

PATH = packing.tokenizer_path()
TEXTS = [
    None, "", " \n\t ", "Hello, World!", "It's we'll I'D 12345 a1b2", "<|endoftext|> a <|startoftext|>b<|endoftext|>", "É é é a ́b", "İSTANBUL ΑΣ",
    "a\x0bb\x0cc\x1cd\x85e f g", "😀😀 日本語テキスト", "x" * 5000, "don''t--stop...now?!", "the&&& of*** a%%%", "\x00a\x7f b", "ſ K Å", "word " * 9000,
]


def test_ids():
    tokenizer = Tokenizer.from_file(PATH)
    ids, at = packing.TokenIds(PATH).texts(pa.array(["skipped", *TEXTS], pa.string()).slice(1))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def check_packed(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= limit
    return len(by)


def plain_best_fit(lengths, limit):
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else limit
        opened += gap == limit
        if gap - length:
            insort(gaps, gap - length)
    return opened


def test_documents(make_docs):
    docs = make_docs([(k, t) for k, t in enumerate(TEXTS)] + [(3, "again"), (None, "no id"), (None, None)])
    rows = packing.pack_documents(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 4096):
            own = ids[at:at + 4096]
            want.append((r["doc_id"], at // 4096, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    check_packed(rows, 4096)


@pytest.mark.parametrize("seed, limit", [(0, 10), (1, 64), (2, 4096), (3, 4096)])
def test_as_few_as_best_fit(spark, seed, limit):
    rng = random.Random(seed)
    lengths = [min(limit, max(1, int(rng.lognormvariate(4, 1.5)))) for _ in range(1500)] + [limit // 3 or 1] * 700  # one hot length
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id bigint, length bigint").repartition(7)
    rows = packing.pack(df, limit).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths)))
    assert check_packed(rows, limit) == plain_best_fit(lengths, limit)


def test_plan_depends_on_lengths_only():
    counts = {n: 10**9 + n for n in range(1, 4097)}
    plan = packing.best_fit_plan(counts)
    assert len(plan) < 200_000


def test_empty(make_docs):
    assert packing.pack_documents(make_docs([]), PATH).count() == 0
