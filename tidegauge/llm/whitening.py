"""Whitening of embeddings: eigenvectors in float32, refined by matrix products in higher precision."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: An entry c becomes the whole number floor(SCALE * c) + SHIFT, cut to this magnitude, far beyond any embedding.
SCALE, SHIFT, MOST = 64, 1_000_000, 2**40
#: Rows of vectors that are multiplied at a time.
BATCH = 4096
#: Rounds of refinement, and the relative change at which they end early.
ROUNDS, SETTLED = 12, 1e-18
#: Eigenvalues closer than this share of the largest gap-free scale are one cluster, solved on their own.
CLUSTER = 1e-5
#: Eigenvalues below this share of the largest carry no variance.
NO_VARIANCE = 1e-12

WIDE = np.longdouble


def _numbers(lists: pa.ListArray, size: int) -> np.ndarray:
    """Vectors of the fit list as rows of whole numbers."""
    c = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64) + SHIFT


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            b = whole.slice(start, BATCH)
            yield b, _numbers(b.column(1), size)


def _sums(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, np.int64)
        for b, x in _chunks(batches, size):
            n += len(x)
            total += x.sum(axis=0)
        at = np.arange(-1, size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([[n], total]))], names=["dim", "total"])

    return run


def _products(size: int, project):
    """Rows i of the sum of outer products of projected vectors, of a task; the last row is their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = total = None
        for _, x in _chunks(batches, size):
            y = project(x)
            gram, total = (y.T @ y, y.sum(axis=0)) if gram is None else (gram + y.T @ y, total + y.sum(axis=0))
        if gram is not None:
            rows = np.concatenate([gram, total[None]])
            at = pa.array(np.arange(len(rows)))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            yield pa.RecordBatch.from_arrays([at, pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["i", "part"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the parts of each row i; the rows of a task are few."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        parts = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else []
        for i, part in zip(b.column(0).to_pylist(), parts):
            total[i] = total[i] + part if i in total else part.copy()
    lists = pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), lists], names=["i", "part"])


def _gram(fit: DataFrame, size: int, project) -> tuple[np.ndarray, np.ndarray]:
    """(sum of outer products, sum) of projected vectors, added up per row of the matrix across the cluster."""
    parts = fit.mapInArrow(_products(size, project), "i long, part array<double>")
    rows = parts.repartition("i").mapInArrow(_added, "i long, part array<double>").collect()
    rows = np.array([r["part"] for r in sorted(rows, key=lambda r: r["i"])])
    return rows[:-1], rows[-1]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """One Newton step towards an orthonormal basis, in the precision of ``x``."""
    return x + x @ (np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2


def refined(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of symmetric ``a`` from approximate eigenvectors, by falling eigenvalue.

    Each round takes the residual of orthogonality R = I - X'X and S = X'AX, both
    in the precision of ``a``, and from them the first-order correction E of
    X(I + E): for separate eigenvalues E_ij = (S_ij + l_j R_ij) / (l_j - l_i),
    for clustered ones R_ij / 2, which leaves their common subspace as it is.
    Between rounds each cluster's subspace is solved on its own: the small
    matrix of ``a`` within it, less its mean eigenvalue, is scaled up and
    diagonalised in double precision, which parts eigenvalues that float32 can't.
    Errors are squared with every round.
    """
    a, x = a.astype(WIDE), x.astype(WIDE)
    eye = np.eye(len(a), dtype=WIDE)
    scale = np.abs(a).max()
    values = np.zeros(len(a), WIDE)
    for _ in range(rounds if scale > 0 else 0):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        off = s - np.diag(np.diag(s))
        # below this gap the first-order correction is no correction
        close = 2 * (np.sqrt((off**2).sum()) + scale * np.sqrt((r**2).sum())) + WIDE(CLUSTER) * scale * np.finfo(np.float32).eps
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= close
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        ends = np.flatnonzero(np.concatenate([-np.diff(values) > close, [True]])) + 1
        for first, last in zip(np.concatenate([[0], ends[:-1]]), ends):
            if last - first > 1:
                basis = _orthonormal(x[:, first:last])
                x[:, first:last] = _within(a, basis)
        if np.abs(e[~near]).max(initial=0) < SETTLED and np.abs(r).max() < 10 * np.finfo(WIDE).eps * len(a):
            break
    x = _orthonormal(_orthonormal(x))
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order] / np.sqrt(np.einsum("ij,ij->j", x, x))[order]


def _within(a: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Eigenvectors of ``a`` in the subspace of an orthonormal basis, twice, as the first solve is only good to its scale."""
    for _ in range(2):
        small = basis.T @ (a @ basis)
        small = (small + small.T) / 2
        small = small - np.eye(len(small), dtype=WIDE) * np.trace(small) / len(small)
        most = np.abs(small).max()
        if most <= np.finfo(WIDE).eps * np.abs(a).max():
            break
        turn = np.linalg.eigh((small / most).astype(np.float64))[1][:, ::-1].astype(WIDE)
        basis = _orthonormal(basis @ _orthonormal(turn))
    return basis


def principal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of a covariance by falling eigenvalue: float32 first, then refined."""
    scale = float(np.abs(a).max(initial=0)) or 1.0
    start = np.linalg.eigh((a / scale).astype(np.float32))[1][:, ::-1]
    values, vectors = refined(a / scale, start)
    return (values * scale).astype(np.float64), vectors.astype(np.float64)


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that can be fitted, and their number of dimensions."""
    v = vectors.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    good = v.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    sizes = good.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    size = most["size"] if most else 0
    return good.where(F.size("embedding") == size), size


def _whitened(size: int, n: int, total: list[int], turn: np.ndarray, explained: np.ndarray, error: float):
    """A row for each vector and component."""
    mean, k = np.array([t / n for t in total]), turn.shape[1]
    center, rest = _split(n, total)

    def deviations(x: np.ndarray) -> np.ndarray | list:
        """Sum of (n * x - S)^2, exact; null where that is no long."""
        y = x - center
        if n * float(np.abs(y).max(initial=0) + 1) * math.sqrt(size) < 2**31:
            return ((n * y - rest) ** 2).sum(axis=1)
        out = [sum((n * c - r) ** 2 for c, r in zip(row, rest.tolist())) for row in y.tolist()]
        return [d if d < 2**63 else None for d in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _chunks(batches, size):
            y = ((x - center) - (mean - center)) @ turn
            at = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)), pa.array(deviations(x), pa.int64()).take(at)]
            columns += [pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def _split(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers (c, r) with S = n * c + r, c nearest to the mean."""
    center = [(2 * t + n) // (2 * n) for t in total]
    return np.array(center, np.int64), np.array([t - n * c for t, c in zip(total, center)], np.int64)


def covariance(fit: DataFrame, size: int, n: int, total: list[int]) -> np.ndarray:
    """Covariance with divisor ``n``.

    Vectors are centred by the whole number next to the mean before they are
    multiplied, so products are small whole numbers and their sums exact far
    beyond any rounding; the fraction of the mean, at most a half, goes off last.
    """
    center, rest = _split(n, total)
    gram, _ = _gram(fit, size, lambda x: (x - center).astype(np.float64))
    off = rest.astype(WIDE) / n
    return gram.astype(WIDE) / n - off[:, None] * off[None, :]


def whitened(vectors: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and up to COMPONENTS components.

    Entries become whole numbers floor(64 c) + 1,000,000. Sums and the
    covariance of all vectors are added up in tasks and then per row of the
    matrix; the driver holds one matrix of the size of a vector squared and
    solves it: eigenvectors in float32, corrected in higher precision by matrix
    products, with clustered eigenvalues solved in their own subspace (see
    ``refined``). Then vectors are projected in tasks. ``identity_error`` is
    measured on the whitened vectors themselves.

    Left out are rows without a vector and with null or non-finite entries;
    also empty vectors and those of another length than most (of equally many,
    the longer), as they lie in another space. Rows that repeat are vectors
    each. A null vec_id is kept. Components without variance are not returned,
    as nothing can be divided by it: none at all if all vectors are equal.
    ``deviation`` is null where it exceeds a long. Further columns are ignored;
    an empty table gives no rows.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    columns = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit, size = fit_list(vectors)
    nothing = vectors.sparkSession.createDataFrame([], columns)
    if not size:
        return nothing
    sums = fit.mapInArrow(_sums(size), "dim long, total long").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["dim"]: int(r["total"]) for r in sums.collect()}  # a row for each dimension
    n, total = found[-1], [found[i] for i in range(size)]
    a = covariance(fit, size, n, total)
    values, parts = principal(a)
    k = min(COMPONENTS, int(np.count_nonzero(values > NO_VARIANCE * max(values[0], 0))))
    if not k:
        return nothing
    turn = parts[:, :k] / np.sqrt(values[:k])
    center, rest = _split(n, total)
    gram, moved = _gram(fit, size, lambda x: ((x - center) - rest / n) @ turn)
    error = float(np.abs(gram / n - np.outer(moved / n, moved / n) - np.eye(k)).max())
    explained = values[:k] / float(np.trace(a))
    return fit.mapInArrow(_whitened(size, n, total, turn, explained, error), columns)
