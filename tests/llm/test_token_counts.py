"""Token counts against the tokenizer itself."""

import random

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from shelfwise.llm import token_counts as tc
from test_packing import TEXTS

WORD, BYTE = tc.tokenizer_path(), public_tokenizers.path("byte_bpe_50k.json")
MORE = [
    "x<|endoftext|>y <|startoftext|><|startoftext|> <|END|>", "z" * 200_000, "- " * 50_000, "=" * 3000 + " end", "naïve café, œuvre", "a b　c",
    "1234567 ½ ²", "don't can't I'll THEY'VE", "İI ß ẞ", "é " * 40, "tab\tnew\nline\r\n", "<|", "<|endoftext|>",
]


def plain(path, rows, limit):
    tokenizer = Tokenizer.from_file(path)
    out = []
    for doc_id, text in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        out.append((doc_id, len((text or "").encode()), n, n > limit))
    return sorted(out, key=str)


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("most", [0, 5, tc.COMMON])
def test_counts(make_docs, path, most):
    """Whatever share of the pre-tokens is looked up or joined."""
    rows = list(enumerate(TEXTS + MORE)) + [(3, "again"), (3, "again"), (None, "no id"), (None, None), (None, "no id")]
    got = tc.count_tokens(make_docs(rows).repartition(3), path, 100, most).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(path, rows, 100)


def test_hot_words(make_docs):
    """One long divider line in every text, and a third of all rows alike."""
    rng = random.Random(1)
    rows = [(k, "#" * 90 + " " + ("same text here" if k % 3 == 0 else " ".join(f"w{rng.randrange(500)}" for _ in range(30)))) for k in range(600)]
    got = tc.count_tokens(make_docs(rows), WORD, most=20).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(WORD, rows, tc.LIMIT)


def test_counts_once(make_docs):
    words = tc.vocabulary(make_docs([(1, "The cat, the CAT"), (2, "cat"), (3, None)]), WORD)
    assert sorted(tuple(r) for r in words.collect()) == [(",", 1, 1), ("cat", 3, 1), ("the", 2, 1)]


def test_common_is_bounded(spark):
    words = spark.createDataFrame([(f"k{n}", n, 1) for n in range(1, 200)] + [(f"t{n}", 50, 1) for n in range(100)], "key string, n bigint, pieces bigint")
    for most in (0, 1, 10, 120, 298, 299, 1000):
        assert words.where(f"n >= {tc.common_from(words, most)}").count() <= most
    assert tc.common_from(words, 1000) == 1


def test_empty(make_docs):
    assert tc.count_tokens(make_docs([]), WORD).count() == 0


def test_model_files_have_no_pre_tokens():
    with pytest.raises(ValueError):
        tc.PreTokens("some.model")
