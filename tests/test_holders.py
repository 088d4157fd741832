"""Unique columns in a batch: chains of clashes settle in few rounds, as plain inserts would."""

import random
from math import log2

import pytest

from shelfwise.operators.changes import first_holders

STORED = [("taken", None), (None, "taken@x"), ("taken", "other@x")]


def plain(rows, stored):
    names, emails, out = {n for n, _ in stored}, {e for _, e in stored}, []
    for row, name, email in sorted(rows):
        if (name is not None and name in names) or (email is not None and email in emails):
            continue
        out.append(row)
        names.add(name), emails.add(email)
    return out


def settle(spark, rows, stored=()):
    steps = []
    schema = "row_id long, Name string, Email string"
    df = spark.createDataFrame(rows, schema).repartition(4)
    existing = spark.createDataFrame(list(stored), "Name string, Email string")
    got = [r.row_id for r in first_holders(df, existing, ("Name", "Email"), "row_id", steps).select("row_id").collect()]
    return sorted(got), steps


def alternating(n, shift=0):
    """Each row clashes with the one before: in the name, in the e-mail, in the name, …"""
    return [(k + shift, f"n{k // 2}", f"e{(k + 1) // 2}") for k in range(n)]


def test_long_chain(spark):
    rows = alternating(10_000)
    got, steps = settle(spark, rows)
    assert got == plain(rows, ()) == list(range(0, 10_000, 2))
    assert len(steps) <= 2 * log2(10_000) + 4


def test_chain_that_begins_stored(spark):
    rows = [(0, "taken", "e0"), *[(k + 1, n, e) for k, n, e in alternating(200)]]
    got, _ = settle(spark, rows, STORED)
    assert got == plain(rows, STORED)


@pytest.mark.parametrize("seed", range(6))
def test_like_plain_inserts(spark, seed):
    """Chains, hot values, rows without a value and rows alike in both, mixed."""
    rng = random.Random(seed)
    few = rng.choice([4, 30, 150])
    rows = [
        (k, rng.choice([None, "hot", f"n{rng.randrange(few)}", f"n{rng.randrange(few)}"]), rng.choice([None, f"e{rng.randrange(few)}", f"e{rng.randrange(few)}"]))
        for k in rng.sample(range(5000), 240)
    ]
    chain = [(6000 + k, f"c{k // 2}", f"d{(k + 1) // 2}") for k in range(60)]
    chain = [(k, n, e) if rng.random() < 0.95 else (k, "hot", e) for k, n, e in chain]
    rows += chain
    got, _ = settle(spark, rows, STORED)
    assert got == plain(rows, STORED)


def test_nothing_open(spark):
    assert settle(spark, [], STORED)[0] == []
    assert settle(spark, [(1, "taken", "a"), (2, "b", "taken@x"), (3, None, None)], STORED)[0] == [3]
