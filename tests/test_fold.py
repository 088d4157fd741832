"""The ledger fold against a plain loop, over many block layouts."""

import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import seed
from shelfwise.functions import fold, scan
from shelfwise.session import cut_lineage


def loop(events):
    """events: sorted (key, pos, effect, start)"""
    out, balance = {}, {}
    for key, pos, effect, start in events:
        b = balance.get(key, start)
        out[key, pos] = b
        balance[key] = fold.step(b, effect) if b is not None else None
    return out


def events_of(seed, n, keys, hot, parity=1):
    rng = random.Random(seed)
    starts = {k: rng.randint(0, 40) for k in range(keys)}
    starts[0] = 41
    rows = []
    for pos in range(n):
        key = 0 if rng.random() < hot else rng.randrange(keys)
        quantity = parity * rng.randint(1, 20)
        effect = rng.choice([-quantity, -quantity, quantity, 0])
        rows.append((key, pos, effect, starts[key]))
    return sorted(rows)


@pytest.mark.parametrize(
    "seed,n,keys,hot,parity,blocks",
    [(1, 300, 7, 0.3, 1, 1), (2, 900, 5, 0.9, 1, 9), (3, 1200, 3, 1.0, 2, 12), (4, 600, 40, 0.4, 5, 7)],
)
def test_fold_equals_loop(spark, seed, n, keys, hot, parity, blocks):
    rows = events_of(seed, n, keys, hot, parity)
    df = spark.createDataFrame(rows, "k long, pos long, effect long, start long")
    placed = scan.range_blocks(df, ["k"], ["pos"], blocks)
    got = {(r.k, r.pos): r.balance_before for r in fold.balance_before(placed, "k", "effect", "start").collect()}
    assert got == loop(rows)


@pytest.mark.parametrize("blocks", [1, 4, 9, 64])
def test_blocks_without_effect_pass_the_balance_on(spark, blocks):
    rows = [(1, 0, -8, 10)] + [(1, pos, 0, 10) for pos in range(1, 400)] + [(1, 400, -5, 10), (1, 401, 9, 10)]
    rows += [(2, pos, 0, 3) for pos in range(300)] + [(None, pos, 0, None) for pos in range(50)]
    rows += [(3, pos, 0, None) for pos in range(200)]
    df = spark.createDataFrame(rows, "k long, pos long, effect long, start long")
    got = {(r.k, r.pos): r.balance_before for r in fold.balance_before(scan.range_blocks(df, ["k"], ["pos"], blocks), "k", "effect", "start").collect()}
    assert got == loop(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])))


@pytest.mark.parametrize("kind", ["log", "power"])
def test_rounds_are_bounded_for_unequal_quantities(spark, kind):
    rng = random.Random(8)
    sizes = (lambda: int(10 ** rng.uniform(0, 6))) if kind == "log" else (lambda: 2 ** rng.randrange(30))
    rows = [(7, pos, rng.choice((-1, 1)) * sizes(), 100) for pos in range(2000)]
    placed = scan.range_blocks(spark.createDataFrame(rows, "k long, pos long, effect long, start long"), ["k"], ["pos"], 32)
    blocks, rounds = placed.select(scan.BLOCK).distinct().count(), []
    names = [scan.BLOCK, "k", "effect", "start"]
    entries = fold._entries(placed, names, rounds)
    assert len(rounds) <= 2 * math.log2(blocks) + 6
    firsts = {r[scan.BLOCK]: r["pos"] for r in placed.groupBy(scan.BLOCK).agg(F.min("pos").alias("pos")).collect()}
    want = loop(rows)
    assert entries == {b: (7, want[7, pos]) for b, pos in firsts.items() if pos}


def power_events(n):
    rng = random.Random(8)
    return [(7, pos, rng.choice((-1, 1)) * 2 ** rng.randrange(30), 100) for pos in range(n)]


def test_gallop_streams_blocks_without_a_shuffle(spark):
    """Powers of two over 256 blocks: few rounds, and no round has an exchange."""
    rows = power_events(6000)
    placed = scan.range_blocks(spark.createDataFrame(rows, "k long, pos long, effect long, start long"), ["k"], ["pos"], 256)
    blocks, rounds = placed.select(scan.BLOCK).distinct().count(), []
    assert blocks > 200
    entries = fold._entries(placed, [scan.BLOCK, "k", "effect", "start"], rounds)
    assert len(rounds) <= fold.GUESSED + math.log2(blocks) + 2
    plans = [frame._jdf.queryExecution().executedPlan().toString() for frames in rounds for frame in frames]
    assert len(plans) > fold.GUESSED and not any("Exchange" in plan or "Sort" in plan for plan in plans)
    firsts = {r[scan.BLOCK]: r["pos"] for r in placed.groupBy(scan.BLOCK).agg(F.min("pos").alias("pos")).collect()}
    want = loop(rows)
    assert entries == {b: (7, want[7, pos]) for b, pos in firsts.items() if pos}


def test_folder_that_only_spark_opens(spark, monkeypatch):
    rows = power_events(800)
    placed = scan.range_blocks(spark.createDataFrame(rows, "k long, pos long, effect long, start long"), ["k"], ["pos"], 12)
    monkeypatch.setattr(fold, "shared_dir", lambda spark: "nosuchscheme://bucket/folder")
    got = {(r.k, r.pos): r.balance_before for r in fold.balance_before(placed, "k", "effect", "start").collect()}
    assert got == loop(rows)


@pytest.mark.parametrize("seed", range(3))
def test_short_histories_equal_placed_ones(spark, seed):
    rng = random.Random(seed)
    at = lambda: (rng.choice([None, *range(30)]), rng.choice([None, -5, *range(8)]))
    places = list({at() for _ in range(60)})
    changes = [(rng.choice([None, -1, 0, 5]), *place, rng.choice([None, 0, 1])) for place in places]
    probes = [(rng.choice([None, -1, 0, 5, 9]), *at(), n) for n in range(300)]
    sides = spark.createDataFrame(probes, "k long, a long, b long, n long"), spark.createDataFrame(changes, "k long, a long, b long, v int")
    known = sides[1].filter("k IS NOT NULL")
    got = {r.n: r.v for r in scan.as_of_short(*sides, "k", ["a", "b"], "v", 1000).collect()}
    assert got == {r.n: r.v for r in scan.as_of(sides[0], known, "k", ["a", "b"], ["v"], blocks=3).collect()}
    assert scan.as_of_short(*sides, "k", ["a", "b"], "v", len(changes) - 1) is None
    assert {r.v for r in scan.as_of_short(sides[0], sides[1].filter("k > 99"), "k", ["a", "b"], "v", 9).collect()} == {None}


@pytest.mark.parametrize("seed", range(6))
def test_balances_equal_the_plain_loop(seed):
    rng = np.random.default_rng(seed)
    effects = rng.integers(-40, 35 if seed % 2 else 12, 20_000) * (rng.random(20_000) < 0.9)
    want, balance = [], 17
    for e in effects.tolist():
        want.append(balance)
        balance = fold.step(balance, e)
    before, left = fold.balances(effects, 17)
    assert before.tolist() == want and left == balance


def test_hot_key_lies_in_many_blocks(spark):
    rows = events_of(5, 1000, 4, 0.8)
    placed = scan.range_blocks(
        spark.createDataFrame(rows, "k long, pos long, effect long, start long"), ["k"], ["pos"], 10
    )
    assert placed.filter("k = 0").select(scan.BLOCK).distinct().count() > 4


@pytest.mark.parametrize("blocks", [1, 6])
def test_running_sum(spark, blocks):
    rows = [(k, p, e) for k, p, e, _ in events_of(6, 500, 4, 0.7)]
    df = spark.createDataFrame(rows, "k long, pos long, v long")
    got = {(r.k, r.pos): r.s for r in scan.running_sum(df, "k", ["pos"], "v", "s", blocks).collect()}
    want, sums = {}, {}
    for k, p, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[k, p] = sums[k]
    assert got == want


@pytest.mark.parametrize("blocks", [1, 3, 20])
def test_values_cross_blocks_batches_and_null_keys(spark, blocks):
    rng = random.Random(9)
    rows = [(rng.choice((None, 1, 2, 2, 2, 2, 3)), pos, rng.choice((None, None, 1, 5))) for pos in range(400)]
    df = spark.createDataFrame(rows, "k long, pos long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sums = {r.pos: r.s for r in scan.running_sum(df, "k", ["pos"], "v", "s", blocks).collect()}
        structs = df.selectExpr("k", "pos", "IF(v IS NULL, NULL, struct(v, CAST(v AS decimal(10,2)) AS d)) AS v")
        last = {r.pos: r.s for r in scan.last_known(structs, "k", ["pos"], "v", "s", blocks).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    total, latest = {}, {}
    for k, pos, v in rows:
        total[k] = total.get(k, 0) + (v or 0)
        latest[k] = v if v is not None else latest.get(k)
        assert sums[pos] == total[k]
        assert (last[pos].v if last[pos] else None) == latest[k]


def test_placed_rows_are_stored_by_column(spark):
    """What hardly changes along a key costs next to nothing, and no shuffle file stays."""
    df = spark.range(40_000).selectExpr("id % 5 AS k", "id AS pos", "sha2(cast(id % 5 AS string), 256) AS name")
    cut_lineage(df.limit(1))  # the folder is made
    before = seed.left_on_disk(spark)
    placed = scan.range_blocks(df, ["k"], ["pos"], 4)
    new = seed.left_on_disk(spark) - before
    assert len(new) == 1 and "/rdd-" in min(new)
    assert sum(f.stat().st_size for f in Path(min(new)).iterdir()) < 400_000
    assert [(r.k, r.pos) for r in placed.collect()] == sorted((k % 5, k) for k in range(40_000))


def test_one_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS pos", "id AS v")
    out = scan.running_sum(df, "k", ["pos"], "v", "s", 4)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()  # behind the checkpoint


@pytest.mark.parametrize("blocks,strict", [(1, False), (6, False), (6, True)])
def test_as_of(spark, blocks, strict):
    rng = random.Random(7)
    changes = [(0 if rng.random() < 0.7 else rng.randrange(4), p, rng.randrange(100)) for p in rng.sample(range(600), 40)]
    probes = [(0 if rng.random() < 0.7 else rng.randrange(5), p) for p in range(600)]
    got = scan.as_of(
        spark.createDataFrame(probes, "k long, pos long"), spark.createDataFrame(changes, "k long, pos long, v long"),
        "k", ["pos"], ["v"], strict=strict, blocks=blocks,
    ).collect()
    assert len(got) == len(probes)
    for row in got:
        before = [(p, v) for k, p, v in changes if k == row.k and (p < row.pos or (p == row.pos and not strict))]
        assert row.v == (max(before)[1] if before else None)


@pytest.mark.parametrize("blocks", [1, 5])
def test_number_rows(spark, blocks):
    df = spark.range(0, 97).withColumnRenamed("id", "x").orderBy("x", ascending=False)
    got = sorted((r.x, r.n) for r in scan.number_rows(df, "n", 10, ["x"], blocks).collect())
    assert got == [(i, i + 11) for i in range(97)]


def test_short_runs_are_followed_together(monkeypatch):
    """A batch of many keys takes no Python step for each key."""
    rows = events_of(11, 4000, 900, 0.01)
    columns = [pa.array([0] * len(rows), pa.int32()), *[pa.array([r[k] for r in rows]) for k in (0, 2, 3)]]
    batch = pa.RecordBatch.from_arrays(columns, names=["block", "k", "effect", "start"])
    monkeypatch.setattr(fold, "balances", None)
    cut = [batch.slice(0, 1501), batch.slice(1501, 7), batch.slice(1508)]
    out = [b for part in fold._run(batch.schema.names, {0: (0, 5)}, iter(cut)) for b in part.column(4).to_pylist()]
    assert out == list(loop([(k, pos, e, 5 if k == 0 else s) for k, pos, e, s in rows]).values())


@pytest.mark.parametrize("blocks", [1, 7])
def test_passes_run_before_the_blocks_are_stored(spark, blocks):
    """What reads an as-of or running value later repeats no Python pass."""
    probes = spark.createDataFrame([(k, pos) for k in (1, 2, None) for pos in range(1, 60)], "k long, pos long")
    changes = spark.createDataFrame([(1, 0, "a"), (1, 30, None), (2, 5, "b"), (None, 9, "c")], "k long, pos long, v string")
    seen = scan.as_of(probes, changes, "k", ["pos"], ["v"], blocks=blocks)
    added = scan.running_sum(probes, "k", ["pos"], "pos", "total", blocks)
    for df in (seen, added):
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.k, r.pos): r.v for r in seen.collect()} == {
        (k, p): {1: "a" if p < 30 else None, 2: "b" if p >= 5 else None, None: "c" if p >= 9 else None}[k]
        for k in (1, 2, None) for p in range(1, 60)
    }
    assert {(r.k, r.pos): r.total for r in added.collect()} == {(k, p): p * (p + 1) // 2 for k in (1, 2, None) for p in range(1, 60)}
