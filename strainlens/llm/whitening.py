"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries are rounded to 1/256, and the distinct vectors are the fit list.  Their
covariance V is never formed: all that is asked of the data is the product VQ
for a thin block Q, one pass in which every task multiplies its centred rows
and Spark sums the partial products.  Sums of the vectors are exact, so the
centre is the rounded quotient of integers.

A few Lanczos steps bound the spectrum from below.  A round then is a
polynomial of V applied to the block by the three-term recurrence of Chebyshev,
which damps the interval between that bound and the block's smallest Ritz
value, followed by QR and a Rayleigh-Ritz step.  The Rayleigh-Ritz pass also
gives the residuals |Vq - eq| of the wanted vectors; the loop ends once they
are at rounding level, which certifies that each value is that close to an
eigenvalue.  A spectrum too flat for the block makes the block wider, at most
up to all dimensions, where Rayleigh-Ritz is exact; so the loop ends.

The driver holds the block and the sums, dimensions x block numbers; a pass
reads the written fit list again and survives lost executors.

Defined results: null vectors and those with null or non-finite entries are
dropped, as are those whose length is not the most frequent one (of equally
frequent lengths the greatest stays) and empty ones; entries beyond the range
of a long saturate; repeated rows are written as often as they come and fitted
once; components of no variance, relative to the first, are left out, so one
distinct vector has none; a deviation beyond the range of a long is null;
equal eigenvalues leave the choice of their vectors open; an empty table gives
no rows; a null vec_id stays null; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainlens import session

SCALE = 256
COMPONENTS = 4
BLOCK, DEGREE, LANCZOS = 16, 8, 8
# residuals relative to the largest eigenvalue: the goal, and what may stand if a round no longer halves it
GOAL, ENOUGH = 1e-14, 1e-12
# rounds before the block doubles, and least share of the first eigenvalue
PATIENCE, LEAST = 10, 1e-12
SEED = 13

OUT = T.StructType([T.StructField(n, t) for n, t in (
    ("vec_id", T.LongType()), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()),
    ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))])


@dataclass
class Fit:
    """Size and exact sums of the fit list; components as columns, eigenvalues, trace and the whitened covariance's distance from the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def rounded(embeddings: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id and x, the vector in units of 1/256, of the rows that count."""
    v = F.col(f"`{vector}`")
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where(F.size("v") > 0)
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(0)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and sums per dimension; high and low halves of the entries are summed apart."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column("x"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, len(x)), pa.int64()), pa.array((x >> 32).sum(axis=0)), pa.array((x & 0xFFFFFFFF).sum(axis=0))], names=["place", "n", "high", "low"])

    total = fit.mapInArrow(run, "place int, n long, high long, low long").groupBy("place").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]).collect()
    sums = {r["place"]: (int(r["high"]) << 32) + int(r["low"]) for r in total}
    return (int(total[0]["n"]) if total else 0), [sums[i] for i in sorted(sums)]


def _summed(fit: DataFrame, work, height: int, width: int) -> np.ndarray:
    """Sum over all tasks of the height x width arrays that ``work`` makes of a block of rows."""
    names = [f"c{i}" for i in range(width)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for part in parts:
            total += work(_matrix(part.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(height), pa.int32()), *[pa.array(np.ascontiguousarray(total[:, i])) for i in range(width)]], names=["place", *names])

    schema = "place int, " + ", ".join(f"{c} double" for c in names)
    out = np.zeros((height, width))
    for r in fit.mapInArrow(run, schema).groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["place"]] = r[1:]
    return out


def top_eigenpairs(product, d: int, wanted: int, block: int = BLOCK, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and unit eigenvectors of a symmetric positive operator given by ``product`` on blocks."""
    draw = np.random.default_rng(SEED)
    width = min(d, max(block, wanted))
    low = 0.0 if width == d else _lowest(product, draw.standard_normal(d))
    q = np.linalg.qr(draw.standard_normal((d, width)))[0]
    rounds, before = 0, np.inf
    while True:
        w = product(q)
        h = q.T @ w
        value, turn = np.linalg.eigh((h + h.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        top = value[0]
        if top <= 0:
            return value[:0], q[:, :0]
        residual = np.linalg.norm(w[:, :wanted] - q[:, :wanted] * value[:wanted], axis=0).max() / top
        if residual <= GOAL or width == d or (residual <= ENOUGH and 2 * residual > before):
            return value[:wanted], q[:, :wanted]
        rounds, before = rounds + 1, residual
        if rounds % PATIENCE == 0:
            width = min(d, 2 * width)
            q = np.linalg.qr(np.hstack([q, draw.standard_normal((d, width - q.shape[1]))]))[0]
            continue
        if value[-1] <= low:
            # the block met what lies below the estimate
            low = max(0.0, value[-1] / 2)
        q = np.linalg.qr(_filtered(product, q, w, low, value[-1], top, degree))[0]


def _lowest(product, start: np.ndarray) -> float:
    """Estimate of the smallest eigenvalue from a few Lanczos steps, less their residual."""
    basis, w = [start / np.linalg.norm(start)], None
    images = []
    for _ in range(LANCZOS):
        w = product(basis[-1][:, None])[:, 0]
        images.append(w)
        rest = w.copy()
        for _ in range(2):
            for b in basis:
                rest -= (b @ rest) * b
        size = np.linalg.norm(rest)
        if size <= 1e-12 * np.linalg.norm(images[0]):
            break
        basis.append(rest / size)
    b = np.array(basis[:len(images)]).T
    h = b.T @ np.array(images).T
    value, turn = np.linalg.eigh((h + h.T) / 2)
    residual = np.linalg.norm(np.array(images).T @ turn[:, 0] - value[0] * (b @ turn[:, 0]))
    return max(0.0, value[0] - residual)


def _filtered(product, q: np.ndarray, image: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of the operator on the block, small on [low, high] and scaled to 1 at ``top``; ``image`` is the operator's value on ``q``."""
    half, middle = max((high - low) / 2, 1e-300), (high + low) / 2
    first = sigma = half / (top - middle) if top > middle else 1.0
    past, now = q, (image - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        past, now = now, (product(now) - middle * now) * (2 * following / half) - sigma * following * past
        sigma = following
    return now


def fit(points: DataFrame, components: int = COMPONENTS) -> tuple[Fit | None, int]:
    """Model of the distinct vectors ``x`` of the most frequent length, and that length."""
    lengths = points.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None, 0
    d = lengths["d"]
    distinct = session.cut_lineage(points.where(F.size("x") == d).select("x").distinct(), "fit-list")
    n, sums = _exact_sums(distinct, d)
    centre = np.array([float(Fraction(s, n)) for s in sums])

    def product(block: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = x - centre
            return c.T @ (c @ block)

        return _summed(distinct, work, d, block.shape[1]) / n

    trace = float(_summed(distinct, lambda x: ((x - centre) ** 2).sum(axis=0)[:, None], d, 1).sum() / n)
    values, vectors = top_eigenpairs(product, d, min(components, d)) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    some = values > LEAST * (values[0] if len(values) else 1)
    model = Fit(n, sums, vectors[:, some], values[some], trace, 0.0)
    k = len(model.values)
    if k:
        def moments(x: np.ndarray) -> np.ndarray:
            w = whiten(x, model)
            return np.vstack([w.T @ w, w.sum(axis=0)])

        found = _summed(distinct, moments, k + 1, k) / n
        model.identity_error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return model, d


def whiten(x: np.ndarray, model: Fit) -> np.ndarray:
    return (x - model.centre) @ (model.vectors / np.sqrt(model.values))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2; null where a long cannot hold it."""
    far = np.abs(x.astype(float)).max(initial=0) * n + max(map(abs, sums))
    if far * far * len(sums) < 2.0 ** 62:
        t = x * n - np.array(sums)
        return (t * t).sum(axis=1).tolist()
    exact = (sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whitened(embeddings: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The model is fitted while the query is built.
    """
    points = rounded(embeddings, vector, vec_id)
    model, d = fit(points, components)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], OUT)
    explained = model.values / model.trace

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for part in parts:
            x = _matrix(part.column("x"))
            if not len(x):
                continue
            m = len(x)
            row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()),
                pa.array(deviations(x, model.n, model.sums), pa.int64()).take(row), pa.array(whiten(x, model).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))],
                names=OUT.names)

    return points.where(F.size("x") == d).mapInArrow(run, OUT)
