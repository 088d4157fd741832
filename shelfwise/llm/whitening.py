"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import settle, table

COMPONENTS = 8
#: An entry c becomes floor(SCALE * c) + SHIFT, held within the bounds of LARGEST.
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 40
#: Vectors of a block, and entries at most.
ROWS, ENTRIES = 1024, 1 << 20
#: Singular values below this share of the first count as none; residuals below this share as converged.
NOTHING, CONVERGED = 1e-11, 1e-14
MOST = (1 << 63) - 1

Product = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]]


def blocks_of(vectors: DataFrame) -> DataFrame:
    """``(width, rows, ids, x)``: the usable rows of ``vectors (vec_id, embedding)`` as integer blocks, row after row.

    A row whose vector is null, or holds a null, NaN or infinite entry, is left
    out. x holds little-endian long integers. Blocks hold rows of one width.
    """
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            held = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # null entries become NaN
            ends = np.cumsum(np.maximum(held, 0))
            ids = batch.column(0)
            for width in np.unique(held[held >= 0]).tolist():
                own = np.flatnonzero(held == width)
                step = max(1, min(ROWS, ENTRIES // max(1, width)))
                for at in range(0, len(own), step):
                    rows = own[at:at + step]
                    values = flat[(ends[rows] - width)[:, None] + np.arange(width)].astype(np.float64)
                    fine = np.isfinite(values).all(axis=1)
                    x = np.clip(np.floor(SCALE * values[fine]), -LARGEST, LARGEST).astype("<i8") + SHIFT
                    if len(x):
                        columns = [[width], [len(x)], [ids.take(pa.array(rows[fine])).to_pylist()], [x.tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["width", "rows", "ids", "x"])

    entries = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return settle(entries.mapInArrow(work, "width bigint, rows bigint, ids array<bigint>, x binary"), "vectors")


class Centre(NamedTuple):
    """Number of rows n and sums S of each dimension; S / n is kept as whole part and rest, so that centring rounds once."""

    n: int
    sums: np.ndarray

    def exact(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` in doubles."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole) - rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of ``(n * x - S) ** 2`` of each row as an exact integer; None beyond the range of a long."""
        whole, rest = np.divmod(self.sums, self.n)
        about = ((self.n * (x - whole).astype(np.float64) - rest) ** 2).sum(axis=1)
        small = about < 2.0 ** 62
        out: list[int | None] = [None] * len(x)
        exact = ((self.n * (x[small] - whole) - rest) ** 2).sum(axis=1)
        for k, v in zip(np.flatnonzero(small).tolist(), exact.tolist()):
            out[k] = v
        for k in np.flatnonzero(~small & (about < 2.0 ** 64)).tolist():
            v = sum((self.n * int(a) - int(s)) ** 2 for a, s in zip(x[k], self.sums))
            out[k] = v if v <= MOST else None
        return out


def _sums(blocks: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """``work`` of every block's integer matrix, added up: in each task, then across tasks by Spark."""
    arrow = pa.int64() if kind == "bigint" else pa.float64()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                made = work(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, width))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total, arrow)], ["at", "value"])

    rows = blocks.select("x").mapInArrow(run, f"at bigint, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(rows.num_rows, np.int64 if kind == "bigint" else np.float64)  # a few numbers for each dimension
    out[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
    return out


def product(blocks: DataFrame, width: int, centre: Centre) -> Product:
    """The distributed step for a direction c and earlier directions C (columns) of the centred rows X.

    With p = Xc and U = XC it gives X'p, U'p and p'p, all in one pass: a task
    multiplies its own rows, so no vector as long as the table is kept.
    """

    def step(c: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def work(x: np.ndarray) -> np.ndarray:
            rows = centre.exact(x)
            p = rows @ c
            return np.concatenate((p @ rows, p @ (rows @ earlier), [p @ p]))

        out = _sums(blocks, width, work, "double")
        return out[:width], out[width:-1], float(out[-1])

    return step


def bidiagonalise(step: Product, width: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values of X and their right singular vectors (rows), largest first.

    Left vectors u = Xc are kept by their short c and orthogonalised in full
    against all earlier ones, again where cancellation is heavy; right vectors are
    short and orthogonalised twice. Where the recurrence ends before the space
    does, it starts anew in what is left, with a zero off the diagonal. It stops
    when the space is used up, or when the wanted triplets have converged and a
    new start in the rest finds nothing as large, so equal singular values are all
    found.
    """
    rng = np.random.default_rng(seed)
    right, left, back = (np.zeros((width, 0)) for _ in range(3))  # V, C with U = XC, and X'U
    alphas: list[float] = []
    betas: list[float] = []
    begun = 0  # of the latest start
    top = 0.0

    def fresh() -> np.ndarray:
        v = rng.standard_normal(width)
        for _ in range(3):
            v -= right @ (right.T @ v)
            v /= np.linalg.norm(v)
        return v

    def triplets(a: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.diag(alphas[a:]) + np.diag(betas[a:len(alphas) - 1], 1)
        p, s, q = np.linalg.svd(b)
        return s, p[-1], q @ right[:, a:].T

    v = fresh() if width else None
    while len(alphas) < width:
        c, total = v.copy(), None
        while True:
            xp, h, pp = step(c, left)
            total = pp if total is None else total
            rest = pp - h @ h
            alpha = np.sqrt(max(rest, 0.0))
            top = max(top, np.sqrt(pp))
            if rest >= 0.01 * pp or alpha <= NOTHING * top:
                break
            c = c - left @ h
        nothing = alpha <= NOTHING * top
        right = np.column_stack((right, v))
        alphas.append(0.0 if nothing else float(alpha))
        if not nothing:
            c, w = (c - left @ h) / alpha, (xp - back @ h) / alpha
            left, back = np.column_stack((left, c)), np.column_stack((back, w))
            w = w - alpha * v
            for _ in range(2):
                w -= right @ (right.T @ w)
        beta = 0.0 if nothing else float(np.linalg.norm(w))
        if len(alphas) == width:
            break
        s, tail, _ = triplets()
        sure = len(s) > wanted and (beta * np.abs(tail[:wanted])).max() <= CONVERGED * s[0]
        if sure and begun:
            own, own_tail, _ = triplets(begun)
            sure = own[0] + beta * abs(own_tail[0]) < s[wanted - 1] * (1 - 1e-9)
            if sure:
                break
        if beta <= NOTHING * top or (sure and not begun):
            begun, beta, v = len(alphas), 0.0, fresh()
        else:
            v = w / beta
        betas.append(beta)
    if not alphas:
        return np.zeros(0), np.zeros((0, width))
    s, _, vectors = triplets()
    kept = min(wanted, int((s > NOTHING * max(s[0], 1e-300)).sum()))
    vectors = vectors[:kept]
    signs = np.sign(vectors[np.arange(kept), np.abs(vectors).argmax(axis=1)])
    return s[:kept], vectors * signs[:, None]


class Whitening(NamedTuple):
    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.exact(x) @ (self.components / np.sqrt(self.variances)[:, None]).T


def fit(blocks: DataFrame, width: int, n: int, wanted: int = COMPONENTS) -> Whitening:
    """Learn from all rows of ``blocks``, which have the same width."""
    centre = Centre(n, _sums(blocks, width, lambda x: x.sum(axis=0), "bigint") if width else np.zeros(0, np.int64))
    total = float(_sums(blocks, width, lambda x: np.array([(centre.exact(x) ** 2).sum()]), "double")[0]) / n if width else 0.0
    s, components = bidiagonalise(product(blocks, width, centre), width, min(wanted, width)) if total else (np.zeros(0), np.zeros((0, width)))
    made = Whitening(centre, components, s * s / n, s * s / n / (total or 1.0), None)
    if not len(s):
        return made

    def moments(x: np.ndarray) -> np.ndarray:
        y = made.apply(x)
        return np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

    out = _sums(blocks, width, moments, "double") / n
    mean, second = out[:len(s)], out[len(s):].reshape(len(s), -1)
    return made._replace(identity_error=float(np.abs(second - np.outer(mean, mean) - np.eye(len(s))).max()))


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each usable row of ``vectors (vec_id, embedding)`` and component.

    Rows whose vector is null or holds null or non-finite entries are dropped. So
    are rows of another width than the most frequent one (of equally frequent ones
    the largest), which no covariance takes in. Components whose variance is
    nothing beside the first one's are left out, as they can't be whitened: one row
    alone, or equal rows, give an empty result, as an empty table does. A null
    vec_id stays null, repeated rows stay and weigh each; entries beyond 2^40 are
    held at that; a deviation beyond the range of a long is null; other columns are
    ignored.
    """
    spark, blocks = vectors.sparkSession, blocks_of(vectors)
    ddl = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    most = blocks.groupBy("width").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return spark.createDataFrame([], ddl)
    width, n = most
    blocks = blocks.where(F.col("width") == width)
    model = fit(blocks, width, n, wanted)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1)):
                if not k:
                    continue
                x = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, width)
                rows = np.repeat(np.arange(len(x)), k)
                columns = [
                    pa.array(ids.as_py(), kinds[0]).take(pa.array(rows)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(rows), n),
                    pa.array(model.centre.deviations(x), kinds[3]).take(pa.array(rows)), model.apply(x).ravel(),
                    np.tile(model.explained, len(x)), np.full(len(rows), model.identity_error),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [part.split()[0] for part in ddl.split(", ")])

    return blocks.select("ids", "x").mapInArrow(run, ddl)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))
