"""The running balance that refuses a withdrawal it cannot cover.

Whether a withdrawal is accepted depends on which earlier ones were, so no
window function computes it, and one key's events must be taken in order. The
events are range-partitioned on (key, order): each partition ("block") is one
pass in order with constant memory, and a key with a third of all events lies
in many blocks. Those blocks run in parallel too:

* A block maps the balance it is entered with to the balance it leaves. Entered
  with at least ``need`` (the deepest dip of the plain running sum) it accepts
  everything and leaves ``entry + net``. Below that it is tried with candidate
  entries, all at once. A block without effect on the key leaves what it is
  entered with.
* Walking a key's blocks from its opening balance tells which entries occur. An
  entry not tried yet makes another parallel round over that key's blocks, with
  the entries seen most often as candidates. In a block of thousands of events
  different entries nearly always end in the same balance, so GUESSED rounds are
  usually enough.
* Balances that never meet (very unequal quantities, short blocks) would need a
  round for every block. A key that is not settled by then gallops: one task
  walks its next 2, 4, 8, ... blocks from the exact balance reached so far, in
  constant memory, while other keys go on beside it. So there are at most
  GUESSED + log2(blocks) + 1 rounds, and galloping visits each event about once.

Rounds don't read the placed rows again. Keys that span blocks are written once as
narrow Parquet, a folder for each block, and a task streams the folders it needs in
order: no shuffle, no sort, constant memory. Where the shared folder is on a file
system that only Spark can open, rounds filter the placed rows instead.

The driver handles one row per block and tried entry, never events.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F, types as T

from shelfwise.functions.scan import BLOCK
from shelfwise.session import set_aside, shared_dir

TRIAL = "block int, key long, start long, entry long, left long, need long, net long"
MISSING = -(2**63)  # stands for NULL in the loops; rows with it have no effect
MAX_GUESSES = 8  # extra guesses per round; the entries a walk needs are never cut
GUESSED = 2  # rounds of guesses before a key gallops
STRIDE = 4096  # events taken at once while none is refused
SHORT = 256  # events of a key up to which all keys of a batch advance together
POSITION = "_position"
LEFT = "block int, key long, entry long, left long"


def step(balance: int, effect: int) -> int:
    """One event: deposits always count, a withdrawal only if it is covered."""
    return balance + effect if effect > 0 or balance + effect >= 0 else balance


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    """The batch's named columns as plain integers, NULL as ``MISSING``."""
    out = []
    for name in names:
        column = batch.column(batch.schema.get_field_index(name))
        out.append((pc.fill_null(column, MISSING) if column.null_count else column).to_numpy(zero_copy_only=False))
    return out


Arrays = Iterator[tuple[np.ndarray, ...]]


def _arrays(names: list[str], batches: Iterable[pa.RecordBatch]) -> Arrays:
    """Block, key, effect and start of the rows of each batch."""
    return (tuple(_columns(batch, names)) for batch in batches if batch.num_rows)


def _stored_arrays(folder: str, names: list[str], blocks: Iterable[int]) -> Arrays:
    """The same of the stored events of ``blocks``, one block after the other."""
    files, base = pafs.FileSystem.from_uri(folder)
    for block in blocks:
        found = files.get_file_info(pafs.FileSelector(f"{base}/{names[0]}={block}", allow_not_found=True))
        for path in sorted(f.path for f in found if f.path.endswith(".parquet")):
            with files.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(columns=names[1:]):
                    yield np.full(batch.num_rows, block), *_columns(batch, names[1:])


def balances(effects: np.ndarray, balance: int) -> tuple[np.ndarray, int]:
    """The balance before each event of one key, and after the last.

    Events up to the first refusal follow the plain running sum; behind it the sum
    starts anew. Python steps count refusals, not events, and where refusals come
    thick, events are taken one by one for a while.
    """
    before, at, stride = np.empty(len(effects), np.int64), 0, STRIDE
    while at < len(effects):
        part = effects[at:at + stride]
        after = balance + np.cumsum(part)
        refused = np.flatnonzero((after < 0) & (part < 0))
        end = int(refused[0]) if len(refused) else len(part)
        before[at:at + end] = after[:end] - part[:end]
        balance = int(after[end - 1]) if end else balance
        at += end
        if not len(refused):
            stride = min(STRIDE, 2 * stride)
            continue
        before[at], at, stride = balance, at + 1, max(64, stride // 2)
        if end < 16:
            for k in range(at, min(at + 64, len(effects))):
                before[k], at = balance, k + 1
                balance = step(balance, int(effects[k]))
    return before, balance


def _together(effects: np.ndarray, first: np.ndarray, count: np.ndarray, balance: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Follow many short runs of events at once, one event of each at a time.

    Run k has ``count[k]`` events from ``first[k]`` on and is entered with ``balance[k]``.
    Fills ``before`` and returns what the runs leave. So Python steps count the events of
    the longest run, not keys.
    """
    turn = np.argsort(-count, kind="stable")
    first, state = first[turn], balance[turn]
    going = np.searchsorted(-count[turn], -np.arange(1, count.max() + 1), "right")  # runs with that many events
    for k, n in enumerate(going.tolist()):
        at = first[:n] + k
        part, now = effects[at], state[:n]
        before[at] = now
        after = now + part
        state[:n] = np.where((part < 0) & (after < 0), now, after)
    left = np.empty_like(state)
    left[turn] = state
    return left


def _run(names: list[str], entries: dict[int, tuple[int, int]], batches: Iterator[pa.RecordBatch]):
    """Append the balance before each event."""
    current, balance = object(), MISSING
    for batch in batches:
        if not batch.num_rows:
            continue
        block, keys, effects, starts = _columns(batch, names)
        before = np.empty(len(keys), np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
        count = np.diff(first, append=len(keys))
        entered = starts[first]
        if keys[0] != current:
            carried_key, carried = entries.get(int(block[0]), (None, None))
            balance = carried if carried_key == keys[0] else int(starts[0])
        entered[0], current = balance, keys[-1]
        short = np.flatnonzero(count <= SHORT)
        if len(short):
            entered[short] = _together(effects, first[short], count[short], entered[short], before)
        for k in np.flatnonzero(count > SHORT).tolist():
            end = first[k] + count[k]
            before[first[k]:end], entered[k] = balances(effects[first[k]:end], int(entered[k]))
        balance = int(entered[-1])
        column = pa.array(before)
        known = pc.if_else(pc.equal(column, MISSING), pa.scalar(None, pa.int64()), column)
        yield pa.RecordBatch.from_arrays([*batch.columns, known], names=[*batch.schema.names, "balance_before"])


class _Trial:
    """One key's events in one block, followed from several entries at once."""

    def __init__(self, block: int, key: int, start: int, candidates: Iterable[int]):
        self.block, self.key, self.start = block, key, start
        self.entries = sorted({start, *candidates})
        self.states = list(self.entries)
        self.slot = list(range(len(self.entries)))
        self.net = self.dip = 0

    def take(self, effect: int) -> None:
        self.net += effect
        self.dip = min(self.dip, self.net)
        self.states = [step(s, effect) for s in self.states]

    def merge(self) -> None:
        """Entries that have met stay together."""
        distinct = sorted(set(self.states))
        if len(distinct) < len(self.states):
            place = {s: i for i, s in enumerate(distinct)}
            self.slot = [place[self.states[i]] for i in self.slot]
            self.states = distinct

    def rows(self) -> list[tuple]:
        return [
            (self.block, self.key, self.start, entry, self.states[i], -self.dip, self.net)
            for entry, i in zip(self.entries, self.slot)
        ]


def _told(rows: list[tuple], layout: str) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = [pa.int32()] + [pa.int64()] * (len(rows[0]) - 1)
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in layout.split(", ")])


def _try(wanted: dict[tuple[int, int], list[int]], parts: Arrays) -> Iterator[pa.RecordBatch]:
    trial, rows = None, []
    for block, *columns in parts:
        for key, effect, start in zip(*[c.tolist() for c in columns]):
            if trial is None or trial.key != key:
                rows += trial.rows() if trial else []
                trial = _Trial(int(block[0]), key, start, wanted.get((int(block[0]), key), ()))
            trial.take(effect)
        if trial:
            trial.merge()
    rows += trial.rows() if trial else []
    yield from _told(rows, TRIAL)


def _gallop(runs: dict[int, tuple[int, int, int]], parts: Arrays) -> Iterator[pa.RecordBatch]:
    """Walk several blocks of a key from an exact entry; rows come in the order of key and position."""
    state: dict[int, int] = {}
    reached: dict[tuple[int, int], list[int]] = {}
    for block, keys, effects, *_ in parts:
        ends = [*(np.flatnonzero((np.diff(keys) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(keys)]
        at = 0
        for end in ends if len(keys) else ():
            key, here = int(keys[at]), int(block[at])
            if key in runs and runs[key][0] <= here <= runs[key][1]:
                entry = state.get(key, runs[key][2])
                state[key] = balances(effects[at:end], entry)[1]
                reached.setdefault((here, key), [entry, 0])[1] = state[key]
            at = end
    yield from _told([(block, key, entry, left) for (block, key), (entry, left) in reached.items()], LEFT)


def _chains(placed: DataFrame, key: str) -> dict[int, list[int]]:
    """Keys that lie in several blocks, with their blocks in order; rows without effect count, too."""
    ends = (
        placed.filter(F.col(key).isNotNull()).groupBy(BLOCK)
        .agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()  # one row per partition
    )
    blocks: dict[int, list[int]] = {}
    for row in sorted(ends, key=lambda r: r[BLOCK]):
        for k in {row["first"], row["last"]}:
            blocks.setdefault(k, []).append(row[BLOCK])
    return {k: at for k, at in blocks.items() if len(at) > 1}


class _Walk:
    """What is known about the blocks of the keys that span several."""

    def __init__(self, chains: dict[int, list[int]]):
        self.chains = chains
        self.left: dict[tuple[int, int], dict[int, int]] = {}
        self.limit: dict[tuple[int, int], tuple[int, int]] = {}
        self.start: dict[int, int] = {}
        self.entries: dict[int, tuple[int, int]] = {}
        self.rounds: Counter[int] = Counter()
        self.open = list(chains)

    def learn(self, row) -> None:
        at = (row["block"], row["key"])
        self.left.setdefault(at, {})[row["entry"]] = row["left"]
        if "need" in row:
            self.limit[at] = (row["need"], row["net"])
            self.start[row["key"]] = row["start"]

    def missing(self) -> tuple[dict[tuple[int, int], list[int]], dict[int, tuple[int, int, int]]]:
        """Walk every open chain; return the entries to try next and the runs to gallop (first, last block, entry).

        Both are empty when all entries are exact.
        """
        wanted: dict[tuple[int, int], set[int]] = {}
        runs: dict[int, tuple[int, int, int]] = {}
        still_open = []
        for key in self.open:
            if key not in self.start:  # no block has an effect on it: every block starts it from its own rows
                continue
            blocks, path, unknown = self.chains[key], [], []
            balance = self.start[key]
            for place, block in enumerate(blocks):
                at = (block, key)
                if place:
                    self.entries[block] = (key, balance)
                if at not in self.limit:
                    continue
                path.append(balance)
                need, net = self.limit[at]
                tried = self.left[at]
                if balance >= need:
                    balance += net
                elif balance in tried:
                    balance = tried[balance]
                else:
                    unknown.append((place, balance))
                    balance = tried[min(tried, key=lambda e: abs(e - balance))]
            if not unknown:
                continue
            still_open.append(key)
            self.rounds[key] += 1
            ahead = self.rounds[key] - GUESSED
            if ahead > 0:
                place, balance = unknown[0]  # the first one is exact
                runs[key] = (blocks[place], blocks[min(place + 2**ahead, len(blocks)) - 1], balance)
                continue
            for place, entry in unknown:
                wanted.setdefault((blocks[place], key), set()).add(entry)
            common = [entry for entry, _ in Counter(path).most_common()]
            for block in blocks[1:]:
                at = (block, key)
                if at in self.limit:
                    need, tried = self.limit[at][0], self.left[at]
                    fresh = (e for e in common if e < need and e not in tried)
                    wanted.setdefault(at, set()).update(islice(fresh, MAX_GUESSES))
        self.open = still_open
        return {at: sorted(entries) for at, entries in wanted.items() if entries}, runs


class _Events:
    """The events of keys that span blocks, and the two ways to run a round over them."""

    def __init__(self, placed: DataFrame, names: list[str], keys: list[int]):
        self.spark, self.names, self.placed = placed.sparkSession, names, placed
        block, key, effect, _ = names
        self.folder = f"{shared_dir(self.spark).rstrip('/')}/fold-{uuid.uuid4().hex}"
        try:
            pafs.FileSystem.from_uri(self.folder)
        except (pa.ArrowException, OSError, ValueError):  # only Spark can open it
            self.folder = None
            return
        moving = placed.select(*names, F.monotonically_increasing_id().alias(POSITION)).filter((F.col(effect) != 0) & F.col(key).isin(keys))
        # a task holds one block; the sort says so to the writer, which would otherwise sort by block alone
        moving.sortWithinPartitions(block, POSITION).write.partitionBy(block).parquet(set_aside(self.folder))

    def _tasks(self, count: int, work: Callable[[int], Iterator[pa.RecordBatch]], layout: str) -> DataFrame:
        """``count`` tasks, each told its number."""
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield from work(k)

        return self.spark.range(0, count, 1, max(1, count)).mapInArrow(run, layout)

    def tried(self, wanted: dict[tuple[int, int], list[int]]) -> DataFrame:
        names, folder = self.names, self.folder
        blocks, keys = sorted({b for b, _ in wanted}), sorted({k for _, k in wanted})
        if folder is None:
            part = self.placed.select(*names).filter((F.col(names[2]) != 0) & F.col(names[0]).isin(blocks) & F.col(names[1]).isin(keys))
            return part.mapInArrow(lambda batches: _try(wanted, _arrays(names, batches)), TRIAL)
        of = {b: {at: e for at, e in wanted.items() if at[0] == b} for b in blocks} if len(blocks) < 64 else dict.fromkeys(blocks, wanted)
        return self._tasks(len(blocks), lambda k: _try(of[blocks[k]], _stored_arrays(folder, names, blocks[k:k + 1])), TRIAL)

    def walked(self, runs: dict[int, tuple[int, int, int]], chains: dict[int, list[int]]) -> DataFrame:
        names, folder = self.names, self.folder
        ahead = {k: [b for b in chains[k] if a <= b <= z] for k, (a, z, _) in runs.items()}
        if folder is None:
            moving = self.placed.select(*names, F.monotonically_increasing_id().alias(POSITION)).filter(F.col(names[2]) != 0)
            part = moving.filter(F.col(names[0]).isin(sorted({b for bs in ahead.values() for b in bs})) & F.col(names[1]).isin(sorted(runs)))
            one_task_a_key = part.repartition(len(runs), names[1]).sortWithinPartitions(names[1], POSITION).select(*names)
            return one_task_a_key.mapInArrow(lambda batches: _gallop(runs, _arrays(names, batches)), LEFT)
        keys = sorted(runs)
        return self._tasks(len(keys), lambda k: _gallop({keys[k]: runs[keys[k]]}, _stored_arrays(folder, names, ahead[keys[k]])), LEFT)


def _entries(placed: DataFrame, names: list[str], rounds: list[list[DataFrame]] | None = None) -> dict[int, tuple[int, int]]:
    """The exact entry of each block that a key enters from an earlier one; ``rounds`` gets each round's frames."""
    walk = _Walk(_chains(placed, names[1]))
    if not walk.chains:
        return {}
    events = _Events(placed, names, sorted(walk.chains))
    wanted, runs = {(b, k): [0] for k, blocks in walk.chains.items() for b in blocks}, {}
    while wanted or runs:
        asked = [events.tried(wanted)] if wanted else []
        asked += [events.walked(runs, walk.chains)] if runs else []
        if rounds is not None:
            rounds.append(asked)
        for frame in asked:
            for row in frame.collect():  # a row for each block, key and tried entry
                if "need" not in row or (row["block"], row["key"]) in wanted:
                    walk.learn(row)
        wanted, runs = walk.missing()
    return walk.entries


def balance_before(placed: DataFrame, key: str, effect: str, start: str) -> DataFrame:
    """Add ``balance_before`` to events placed by ``range_blocks`` on (key, order).

    ``effect`` is the signed quantity, 0 for rows that change nothing; ``start``
    the key's opening balance, the same on all of its rows. The result does not
    depend on how the events lie in blocks.
    """
    names = [BLOCK, key, effect, start]
    schema = T.StructType([*placed.schema.fields, T.StructField("balance_before", T.LongType())])
    return placed.mapInArrow(partial(_run, names, _entries(placed, names)), schema)
