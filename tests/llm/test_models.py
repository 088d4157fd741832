"""Language and quality models: updates against a plain loop, held-out accuracy, edge cases."""

import math
import zlib
from pathlib import Path

import numpy as np
import pytest

from shelfwise.llm import language_id, linear, quality

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_updates_follow_the_formula():
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(8, 3, replace=False)), rng.random(3), int(rng.integers(3))) for _ in range(60)]
    model = linear.FollowTheLeader(8, 3, alpha=0.3, beta=1.0, l1=0.5, l2=0.1)
    z, n = [[0.0] * 3 for _ in range(8)], [[0.0] * 3 for _ in range(8)]

    def weight(i, c):
        if abs(z[i][c]) <= 0.5:
            return 0.0
        return -(z[i][c] - math.copysign(0.5, z[i][c])) / ((1.0 + math.sqrt(n[i][c])) / 0.3 + 0.1)

    for ids, values, label in rows:
        model.learn(ids, values, label)
        logits = [sum(v * weight(i, c) for i, v in zip(ids, values)) for c in range(3)]
        total = sum(math.exp(x) for x in logits)
        p = [math.exp(x) / total for x in logits]
        old = {(i, c): weight(i, c) for i in ids for c in range(3)}
        for i, v in zip(ids, values):
            for c in range(3):
                g = v * (p[c] - (c == label))
                z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / 0.3 * old[i, c]
                n[i][c] += g * g
    want = np.array([[weight(i, c) for c in range(3)] for i in range(8)])
    assert np.allclose(model.weights(), want)
    assert (model.weights() == 0).any()  # the first norm leaves weights at zero


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = "Ab é\n12 c-d " * 50 + "x"
    whole = np.sort(np.concatenate(list(language_id.grams(text))))
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert (np.sort(np.concatenate(list(language_id.grams(text)))) == whole).all()
    words = np.sort(np.concatenate([ids for ids, _, _ in quality.grams(text)]))
    monkeypatch.setattr(quality, "BLOCK", 3)
    assert (np.sort(np.concatenate([ids for ids, _, _ in quality.grams(text)])) == words).all()


@pytest.mark.parametrize("word, shape", [("Word", "a"), ("WORD!!", "A!"), ("the&&&", "a&"), ("É", "A"), ("a1b22", "a0a0"), ("...", ".")])
def test_shape(word, shape):
    assert quality.shape(word) == shape


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@data
def test_language_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = language_id.op9_language_id(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(truth) and len(rows) == len(truth)
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    apart = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in apart) >= 0.98 * len(apart)


@data
def test_quality_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.op3_quality(spark, SF).collect()
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    apart = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in apart) >= 0.95 * len(apart)


def test_language_edge_cases(spark, make_docs):
    good = [(k, f"the quick brown fox number {k}", "en") for k in range(40)] + [(k + 100, f"der schnelle braune fuchs und {k}", "de") for k in range(40)]
    odd = [(None, "the fox", "en"), (501, None, "en"), (502, "", None), (503, "1234 !!", "de"), (504, "der fuchs " * 50_000, None), (1, "the quick", None), (1, "the quick", None)]
    docs = make_docs(good + odd)
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(good) + len(odd)
    by = {r["doc_id"]: r for r in rows}
    assert [by[k]["lang_pred"] for k in (501, 502, 503, 504, None)] == ["und", "und", "und", "de", "en"]
    assert by[501]["score"] == 0.0 and by[None]["held_out"] is False
    left = language_id.drop_unknown(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - 3
    assert language_id.identify(make_docs([])).count() == 0
    assert [r["lang_pred"] for r in language_id.identify(make_docs([(1, "text", None)])).collect()] == ["und"]


def test_labels_of_the_held_out_fold_teach_nothing(make_docs):
    docs = [(k, f"the quick brown fox number {k}", "xx" if fold(k) else "en") for k in range(80)]
    assert {r["lang_pred"] for r in language_id.identify(make_docs(docs)).collect()} == {"en"}


def test_quality_edge_cases(spark, make_docs):
    docs = make_docs([(k, "good words in a row here" if k % 2 else "BAD!! BAD!! JUNK&&&") for k in range(60)] + [(None, None), (98, ""), (99, "é " * 70_000), (1, "good words")])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (3, None, 0), (5, 7, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.assess(docs, labels).collect()
    assert len(rows) == 64
    assert all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in rows if r["doc_id"] is not None and r["doc_id"] < 60)
    assert {r["score"] for r in quality.assess(docs, labels.where("false")).collect()} == {0.5}
    assert quality.assess(make_docs([]), labels).count() == 0
