"""SimHash: fingerprints, links and components against plain loops."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfwise.llm import simhash
from shelfwise.llm.components import components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = {f: f for f in prints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    values = sorted(parent)
    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in values}


TEXTS = [None, "", " \n", "One", "one  TWO", "a b c d e f", "É a É b", "x " * 5000, "w" * 100_000, "a b c\td", "😀 b c d"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("paired", [1, 3, 128])
@pytest.mark.parametrize("seed", [0, 1])
def test_links_keep_components(spark, paired, seed):
    rng = random.Random(seed)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(12):
            prints.add(base ^ sum({1 << rng.choice((rng.randrange(64), rng.randrange(6))) for _ in range(rng.randrange(1, 5))}))
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp bigint")
    got = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in components(simhash.links(df, paired)).collect()}
    want = plain_components(prints)
    groups = {}
    for f in prints:
        groups.setdefault(want[f], set()).add(f)
    found = {}
    for f in prints:
        found.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(1000, k) for k in range(1001, 1300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 1000 for k in range(1000, 1300)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_exploded_keys_are_never_broadcast(spark, monkeypatch):
    """64 rows for each fingerprint, which Spark's size estimate doesn't count."""
    plans, settle = [], simhash.settle
    planned = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    monkeypatch.setattr(simhash, "settle", lambda df, name: (planned(df), settle(df, name))[1])
    planned(simhash.links(spark.range(50).select(F.col("id").alias("fp"))))
    assert len(plans) == 2 and all("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for plan in plans)


def test_near_duplicates(spark, make_docs):
    long = " ".join(f"word{k}" for k in range(3000))
    docs = make_docs([(7, long), (3, long.upper()), (9, long + " end"), (5, None), (2, ""), (None, "   "), (11, "other text here"), (11, "other text here"), (None, "alone in the world")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    by = dict(got)
    assert by[7] == by[3] == 3 and by[5] == by[2] == 2 and (None, 2) in got and (None, None) in got and got.count((11, 11)) == 2
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = sorted((r["doc_id"] for r in left.collect()), key=str)
    near = (plain_fingerprint(long) ^ plain_fingerprint(long + " end")).bit_count() <= 2
    assert ids == sorted([2, 3, 11, None] + ([] if near else [9]), key=str)


def test_empty(make_docs):
    docs = make_docs([])
    assert simhash.near_duplicates(docs).count() == 0 and simhash.drop_near_duplicates(docs).count() == 0


def test_query_on_the_test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = simhash.op1_simhash(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    roots = plain_components(set(prints.values()))
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{f:016x}", least[roots[f]]) for i, f in prints.items()}
    assert len(rows) == len(texts)
