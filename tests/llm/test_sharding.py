"""Lookup table and placement against a plain walk of all preference lists."""

import hashlib
from collections import Counter

import pytest

from shelfwise.llm import sharding


def plain_table(shards, slots):
    number = lambda text, below: int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % below
    lists = []
    for name in shards:
        offset, step = number(f"{name}/offset", slots), number(f"{name}/step", slots - 1) + 1
        lists.append([(offset + k * step) % slots for k in range(slots)])
        assert len(set(lists[-1])) == slots
    table = {}
    while True:
        for shard, wanted in enumerate(lists):
            if len(table) == slots:
                return [table[k] for k in range(slots)]
            table[next(k for k in wanted if k not in table)] = shard


@pytest.mark.parametrize("shards, slots", [(("a",), 2), (("a", "b", "c"), 13), (tuple("abcdefgh"), 251)])
def test_table(shards, slots):
    table = sharding.lookup_table(shards, slots)
    assert table == plain_table(shards, slots)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_production_table_is_even_and_stable():
    table = sharding.lookup_table()
    sizes = Counter(table)
    assert len(sizes) == 64 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != 63)
    assert moved < 0.1 * len(table)


@pytest.mark.parametrize("shards, slots", [((), 13), (("a", "a"), 13), (("a", "b"), 12), (("a", "b", "c"), 2)])
def test_bad_parameters(shards, slots):
    with pytest.raises(ValueError, match="must|slots"):
        sharding.lookup_table(shards, slots)


def test_placement(make_docs):
    docs = make_docs([(k, "t") for k in range(3000)] + [(7, "other")] + [(None, f"text {k}") for k in range(3000)] + [(None, None)])
    rows = sharding.place_documents(docs).collect()
    assert len(rows) == 6002
    table = sharding.lookup_table()
    for r in rows:
        assert r["shard"] == sharding.SHARDS[table[r["slot"]]]
    assert len({r["slot"] for r in rows if r["doc_id"] == 7}) == 1
    assert max(Counter(r["shard"] for r in rows).values()) < 200
    assert sharding.place_documents(make_docs([])).count() == 0


def test_nothing_moves(spark, make_docs):
    plan = sharding.place_documents(make_docs([(1, "a")]))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_written_shards(spark, make_docs, tmp_path):
    placed = sharding.place_documents(make_docs([(k, "t") for k in range(200)]), ("a", "b", "c"), 13)
    sharding.write_shards(placed, str(tmp_path / "s"), files=2)
    assert sorted(p.name for p in (tmp_path / "s").glob("shard=*")) == ["shard=a", "shard=b", "shard=c"]
    assert spark.read.parquet(str(tmp_path / "s")).count() == 200
