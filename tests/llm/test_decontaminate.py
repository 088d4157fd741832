"""Benchmark items in documents: the search against brute force, paraphrases, edge cases."""

import random
from pathlib import Path

import numpy as np
import pytest

from shelfwise.llm import decontaminate as d

SF = "/root/testdata/sf0.01"
WORDS = [a + b for a in ("ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "ti") for b in ("n", "l", "rs", "mo", "ka", "xi", "tu", "ve")]


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for k, y in enumerate(b):
            row.append(old[k] + 1 if x == y else max(old[k + 1], row[-1]))
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        item = d.Item(1, a, [])
        assert d.common_length(item.masks, len(a), b) == plain_common(a, b)
        assert sum(item.times.values()) == len(a)


def test_randomised_svd(spark):
    rng = np.random.default_rng(3)
    rows = (rng.random((30, 12)) * (rng.random((30, 12)) < 0.4)).astype(np.float32)
    sparse = [(np.flatnonzero(r).astype(np.int32).tobytes(), r[r != 0].tobytes()) for r in rows]
    basis = d.randomised_svd(spark.createDataFrame(sparse, "ids binary, values binary").repartition(3), 12, 5)
    want = np.linalg.svd(rows.astype(float))[2][:5].T
    assert basis.shape == (12, 5) and np.allclose(basis.T @ basis, np.eye(5), atol=1e-6)
    assert np.linalg.norm(rows @ basis) >= 0.999 * np.linalg.norm(rows @ want)


def item_text(rng, n=30):
    return " ".join(rng.choice(WORDS) for _ in range(n - 5)) + ". The answer: " + " ".join(rng.choice(WORDS) for _ in range(3)) + "."


@pytest.fixture(scope="module")
def tables(spark, make_docs):
    rng = random.Random(5)
    items = [(k, item_text(rng, rng.choice((16, 30, 55)))) for k in range(30)] + [(30, "too short here"), (31, None), (32, "")]
    items += [(33, items[4][1]), (34, " ".join(rng.choice(WORDS) for _ in range(500)))]
    other = lambda n: [rng.choice(WORDS) for _ in range(n)]
    rows, want = [], {}
    for k in range(30):
        text = items[k][1].split()
        answer = len(d.answer(items[k][1]))
        changed = list(text)
        for at in rng.sample(range(len(text) - answer), int(0.3 * (len(text) - answer))):
            changed[at] = "other"
        for kind, own in enumerate((text, [w.upper() + "," for w in text], changed)):
            doc = 100 * kind + k
            rows.append((doc, " ".join(other(rng.randrange(200)) + own + other(rng.randrange(200)))))
            want[doc] = {k} | ({33} if k == 4 else set())
        rows.append((1000 + k, " ".join(other(400))))
        rows.append((2000 + k, " ".join(other(50) + text[:len(text) // 3] + other(50))))
    rows += [(3000, None), (3001, ""), (3002, items[34][1]), (None, items[0][1]), (3003, "too short here")]
    rows += [(3004, " ".join(other(60_000) + items[7][1].split() + other(60_000)))]
    rows += [(3005, "Too, short; HERE!"), (3006, "too short - here"), (3007, "here too short"), (3008, "toot short here"), (3009, "too short there")]
    want |= {3002: {34}, None: {0}, 3003: {30}, 3004: {7}, 3005: {30}, 3006: {30}}
    return make_docs(rows), spark.createDataFrame(items, "item_id bigint, text string"), want


@pytest.mark.parametrize("together, in_scan", [(256, 4096), (8, 16)])
def test_items_are_found_and_clean_documents_left(tables, monkeypatch, together, in_scan):
    monkeypatch.setattr(d, "TOGETHER", together)
    monkeypatch.setattr(d, "IN_SCAN", in_scan)
    docs, benchmark, want = tables
    rows = d.find(docs, benchmark).collect()
    got = {r["doc_id"]: set(r["item_ids"]) for r in rows if r["contaminated"]}
    assert len(rows) == docs.count()
    assert got == want


def test_scans_are_bounded(tables, monkeypatch, spark):
    """Vectors hold a group's own terms, and a scan's vectors stay below their limit."""
    docs, benchmark, want = tables
    monkeypatch.setattr(d, "TOGETHER", 4)
    vocabulary, _, groups, _ = d.searchers(spark, docs, benchmark)
    assert len(groups) > 5 and all(len(g.latent) == len(g.terms) < len(vocabulary) for g in groups)
    monkeypatch.setattr(d, "SCAN_BYTES", 3 * groups[0].bytes)
    scans = d.in_scans(groups)
    assert len(scans) > 1 and sum(scans, []) == groups
    assert all(sum(g.bytes for g in scan) <= d.SCAN_BYTES or len(scan) == 1 for scan in scans)


def test_numbers_are_those_of_the_words():
    import pyarrow as pa

    texts = [None, "", " x ", "The CAT, the--dog's £5 ½x", "naïve ÉCOLE straße ß", "a\u00a0b c\u3000d\x1ce\x85f", "İstanbul i̇stanbul", "... !! --", "日本 cat", "²x ªb º", "cat\tdog\ncat"]
    vocabulary = {w: k + 3 for k, w in enumerate(["cat", "thedogs", "école", "a", "b", "d", "e", "½x", "straße", "日本", "i̇stanbul", "ªb", "dog"])}
    numbers, ends = d.TermIds(vocabulary).texts(pa.array(texts, pa.string()))
    assert [numbers[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [[vocabulary.get(w, -1) for w in d.words(t)] for t in texts]


def test_only_short_items(spark, make_docs):
    benchmark = spark.createDataFrame([(1, "yes"), (2, "no no"), (3, "no no"), (None, "a b c d")], "item_id bigint, text string")
    rows = [(1, "Yes."), (2, "no, yes no"), (3, "no No"), (4, "x a b c d"), (5, "a b c"), (6, None)]
    got = {r["doc_id"]: r["item_ids"] for r in d.find(make_docs(rows), benchmark).collect()}
    assert got == {1: [1], 2: [1], 3: [2, 3], 4: [None], 5: [], 6: []}


@pytest.mark.parametrize("size, before", [(2000, 850), (2000, 1000), (2000, 1200), (4000, 1500)])
def test_long_items_across_segments(spark, make_docs, size, before):
    rng = random.Random(size + before)
    other = lambda n: [rng.choice(WORDS) for _ in range(n)]
    item = [f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(size)]
    rows = [(1, " ".join(other(d.SEGMENT - before) + item + other(30_000))), (2, " ".join(other(70_000)))]
    benchmark = spark.createDataFrame([(5, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: (r["item_ids"], r["similarity"]) for r in d.find(make_docs(rows), benchmark).collect()}
    assert got == {1: ([5], 1.0), 2: ([], 0.0)}


def test_stage_keeps_columns(tables, make_docs, spark):
    docs, benchmark, want = tables
    left = d.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert left.count() == docs.count() - len(want)
    assert d.find(make_docs([]), benchmark).count() == 0
    assert d.find(docs, benchmark.where("false")).where("contaminated").count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_query_against_brute_force(spark):
    items = {r["item_id"]: " ".join(d.words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: f" {' '.join(d.words(r['text']))} " for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: sorted(k for k, v in items.items() if f" {v} " in t) for i, t in texts.items()}
    got = {r["doc_id"]: r["item_ids"] for r in d.op4_decontaminate(spark, SF).collect()}
    assert got == want
