"""Embedding whitening: Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.session import checkpointed

SCALE, SHIFT = 64, 1_000_000
#: Vectors beyond the wanted ones that the subspace carries along, and the filter's degree.
GUARD, DEGREE = 16, 10
#: A component counts if its residual is at most this part of the largest eigenvalue; passes stop there, or once
#: they gain nothing and ``ACCEPTED`` is reached. Smaller eigenvalues than ``FLAT`` of the largest are no components.
CERTIFIED, ACCEPTED, FLAT, ROUNDS = 2e-14, 1e-10, 1e-12, 300
#: Rows of a product inside a task, numbers of a task of the fit list, and the tasks whose sums are added at once.
_BLOCK, TASK, FAN_IN = 2048, 8 << 20, 64
_LONGEST = 2**63 - 1


@dataclass
class Basis:
    """Components as columns, their eigenvalues, the trace, and the exact count and sums they were centred by."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    residual: float


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): each component c becomes floor(64 * c) + 1000000. Vectors that are null or hold null or non-finite
    components are left out, and so are those of another length than the most frequent one (of two, the longer)."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)))
    # kept for the cast to long: anything beyond 2^62 is no longer exact in either form
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long") + SHIFT)
    rows = rows.select("vec_id", x.alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (length["d"] if length else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, by way of the exact n * x - S."""
    if n * max(abs(int(x.max())), abs(int(x.min())), 1) < 2**62:
        return (n * x - sums.astype(np.int64)) / n
    return np.array([[n * int(c) - int(s) for c, s in zip(row, sums)] for row in x], object).astype(float) / n


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column(0):
            part = np.frombuffer(part.as_py())
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})


def _pass(fit: DataFrame, n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """V Q = Xᵀ X Q / n over the centred fit list. A task adds up its own blocks; from ``FAN_IN`` tasks on, groups of
    about the square root of their number are added by further tasks, so that the driver adds few arrays of Q's size."""
    tasks = fit.rdd.getNumPartitions()

    def apply(q: np.ndarray) -> np.ndarray:
        def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape)
            for batch in batches:
                x = _matrix(batch.column(0)) if batch.num_rows else ()
                for at in range(0, len(x), _BLOCK):
                    block = _centred(x[at : at + _BLOCK], n, sums)
                    total += block.T @ (block @ q)
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

        parts = fit.select("x").mapInArrow(partial, "sums binary")
        if tasks > FAN_IN:
            parts = parts.repartition(math.isqrt(tasks)).mapInArrow(_added, "sums binary")
        return sum(np.frombuffer(r["sums"]).reshape(q.shape) for r in parts.collect()) / n

    return apply


def _filtered(v: Callable, q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of V on Q that is small on [low, high] and grows beyond; scaled at ``top``."""
    half, centre = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (v(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (v(now) - centre * now) * (2 * after / half) - (sigma * after) * before
        sigma = after
    return now


def _ritz(v: Callable, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling) and vectors of the span of Q, and V times the vectors."""
    q, _ = np.linalg.qr(q)
    vq = v(q)
    inner = q.T @ vq
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)
    return values[order], q @ turn[:, order], vq @ turn[:, order]


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once, written in as many parts as its size and the cluster's cores call for: every pass reads all of them."""
    fit = checkpointed(rows.select("x").distinct())
    numbers = fit.agg(F.sum(F.size("x"))).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(numbers / TASK))
    return checkpointed(fit.coalesce(parts)) if parts < fit.rdd.getNumPartitions() else fit


def components(fit: DataFrame, k: int = 16) -> Basis | None:
    """The ``k`` first components of a fit list of distinct vectors ``x``, certified; None for an empty list.

    The subspace holds ``GUARD`` vectors more than wanted. A round filters it between
    zero and its least Ritz value, orthonormalises and turns it by Rayleigh-Ritz. It
    ends when all wanted residuals are certified. A further random block, orthogonal
    to them and filtered at the last wanted value, must then hold nothing larger, or the
    rounds go on from it. Numbers of the size of d x (k + GUARD) are all that the driver holds.
    """
    sizes = fit.select(F.posexplode("x").alias("dim", "c")).groupBy("dim").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("dim").collect()
    if not sizes:
        return None
    n, sums = sizes[0]["n"], np.array([int(r["s"]) for r in sizes], object)
    d = len(sums)
    trace = float(fit.select(_deviation(n, sums).cast("double").alias("e")).agg(F.sum("e")).first()[0]) / n / n / n
    v, rng = _pass(fit, n, sums), np.random.default_rng(11)
    wide = min(d, k + GUARD)
    values, vectors, image = _ritz(v, rng.normal(size=(d, wide)))
    wanted, best, stale, probed = min(k, d), np.inf, 0, d == wide
    for _ in range(ROUNDS):
        kept = min(wanted, int((values > FLAT * max(values[0], 0)).sum()))
        if kept == 0 or trace <= 0:
            return Basis(n, sums, np.zeros((d, 0)), np.zeros(0), trace, 0.0, 0.0)
        residual = float(np.linalg.norm(image[:, :kept] - vectors[:, :kept] * values[:kept], axis=0).max() / values[0])
        stale = 0 if residual < 0.5 * best else stale + 1
        best = min(best, residual)
        if residual <= CERTIFIED or (stale >= 2 and residual <= ACCEPTED) or wide == d:
            if probed:
                break
            probed = True
            z = rng.normal(size=(d, min(8, d - kept)))
            held = vectors[:, :kept]
            z -= held @ (held.T @ z)
            missed, _, _ = _ritz(v, _off(held, _filtered(lambda q: _off(held, v(q)), z, DEGREE, 0.0, values[kept - 1], values[0])))
            if missed[0] <= values[kept - 1] * (1 + 1e-9) or kept < wanted:
                break
            vectors, best, stale = np.hstack([held, z, vectors[:, kept : wide - z.shape[1]]]), np.inf, 0
        cut = max(values[-1], FLAT * values[0])
        values, vectors, image = _ritz(v, _filtered(v, vectors, DEGREE, 0.0, cut, values[0]) if cut < values[0] * (1 - 1e-12) else vectors)
    else:
        raise ArithmeticError(f"components are not certified after {ROUNDS} rounds: residual {residual:.1e}")
    vectors, values = vectors[:, :kept], values[:kept]
    white = vectors / np.sqrt(values)
    error = float(np.abs(white.T @ v(white) - np.eye(kept)).max())
    return Basis(n, sums, vectors, values, trace, error, residual)


def _off(held: np.ndarray, q: np.ndarray) -> np.ndarray:
    return q - held @ (held.T @ q)


def _deviation(n: int, sums: np.ndarray) -> Column:
    """Sum over dimensions of (n * x - S)^2, exact up to 38 digits."""
    gap = lambda c, i: F.lit(n).cast("decimal(19,0)") * c.cast("decimal(19,0)") - F.get(F.array(*[F.lit(str(s)) for s in sums]), i).cast("decimal(38,0)")
    return F.aggregate(F.transform("x", gap), F.lit(0).cast("decimal(38,0)"), lambda a, g: (a + g * g).cast("decimal(38,0)"))


def _whitened(basis: Basis):
    n, sums, white = basis.n, basis.sums, basis.vectors / np.sqrt(basis.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            spread = n * max(abs(int(x.max())), abs(int(x.min())), 1) < 2**62
            gaps = n * x - sums.astype(np.int64) if spread else None
            if gaps is not None and float(np.abs(gaps).max()) ** 2 * x.shape[1] < 2.0**62:
                deviation = (gaps * gaps).sum(axis=1).tolist()
            else:
                deviation = [min(sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)), _LONGEST) for row in x]
            values = _centred(x, n, sums) @ white
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.array(list(values), pa.list_(pa.float64()))], ["vec_id", "deviation", "values"])

    return run


def whiten(vectors: DataFrame, k: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each row's whitened coordinates: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Components are fitted on the distinct quantised vectors, see :func:`quantised` and
    :func:`components`; all rows are projected, repeated ones too. A dimension of no
    variance gives no component, so a single vector, copies of one vector and an
    empty table give no rows, and fewer than ``k`` come where fewer vary. Of equal
    eigenvalues any basis is right. A deviation beyond 64 bits is held at the bound. A null id is an id. Other columns are ignored.
    """
    rows = quantised(vectors, id_col, vector_col)
    fit = fit_list(rows)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, values array<double>"
    basis = components(fit, k)
    if basis is None or not len(basis.values):
        return rows.sparkSession.createDataFrame([], schema).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    shares = F.array(*[F.lit(float(e / basis.trace)) for e in basis.values])
    out = rows.mapInArrow(_whitened(basis), schema).select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(basis.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(basis.identity_error).alias("identity_error"))
