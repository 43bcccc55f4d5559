"""Whitening of embeddings by spectral divide and conquer.

Entries become integers on a grid, so sums and, below 2^53, products are exact and don't
depend on how rows are dealt out. Tasks reduce their rows to sums of one and of two
dimensions; the covariance matrix, whose size is that of the dimensions alone, is split on
the driver: the polar factor of the matrix less a shift, found by the QDWH iteration, gives
the projectors onto the spaces of larger and of smaller eigenvalues, which are split again
until single components are left. Tasks then project their rows with the few components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import stored

#: An entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Larger numbers on the grid count as this one.
MOST = 2.0**61
#: Entries that are worked on at once.
BLOCK = 1 << 20
#: What rounding may do to a matrix of norm 1.
ROUNDING = 1e-13


def polar(a: np.ndarray, most: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps.

    Steps of large weight go through a QR decomposition, later ones through Cholesky's. A
    matrix that can't be inverted gives a factor that isn't orthogonal, or an error.
    """
    n = len(a)
    x, one = a / np.linalg.norm(a), np.eye(n)
    low = min(max(1 / np.linalg.norm(np.linalg.inv(x)), 1e-16), 1.0)  # the norm of the inverse is at least 1 / least singular value
    for _ in range(most):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            z, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))
            new = q / r * x + (p - q / r) / np.sqrt(r) * (z[:n] @ z[n:].T)
        else:
            w = np.linalg.cholesky(one + r * (x.T @ x))
            new = q / r * x + (p - q / r) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        new = (new + new.T) / 2
        low = min(low * (p + q * square) / (1 + r * square), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if 1 - low < 1e-15 and moved < 1e-5:
            break
    return x


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant spaces of eigenvalues above and below a shift; None if all are one."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= ROUNDING * scale:
        return None
    middle = np.median(np.diag(a))
    random = np.random.default_rng(n).standard_normal((n, n))
    for k in range(40):  # another shift where an eigenvalue lies on one; the mean has eigenvalues on both its sides
        shift = (middle, mean)[k] if k < 2 else mean + spread / np.sqrt(n) * (0.618034 * k % 1 - 0.5)
        try:
            above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        except np.linalg.LinAlgError:
            continue
        m = round(float(np.trace(above)))
        if 0 < m < n and np.linalg.norm(above @ above - above) < 1e-10 * n:
            upper, _ = np.linalg.qr(above @ random[:, :m])
            rest = random[:, m:] - above @ random[:, m:]
            lower, _ = np.linalg.qr(rest - upper @ (upper.T @ rest))
            return upper, lower
    return None


def components(a: np.ndarray, most: int, scale: float | None = None) -> list[tuple[float, np.ndarray]]:
    """The ``most`` largest eigenvalues of a symmetric matrix with unit eigenvectors, falling; parts that hold none of them aren't split."""
    scale = np.linalg.norm(a) if scale is None else scale
    parts = split(a, scale) if len(a) > 1 else None
    if parts is None:
        return sorted(((float(x), e) for x, e in zip(np.diag(a), np.eye(len(a)))), key=lambda x: -x[0])[:most]
    found: list[tuple[float, np.ndarray]] = []
    for basis in parts:
        if len(found) < most:
            part = basis.T @ a @ basis
            found += [(e, basis @ v) for e, v in components((part + part.T) / 2, most - len(found), scale)]
    return found


@dataclass
class Whitening:
    """Fitted on ``n`` vectors: their sums by dimension, components (rows), eigenvalues and the covariance's trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """Means, rounded to the grid."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """Sums of the vectors less their centre."""
        return np.array([s - self.n * int(c) for s, c in zip(self.sums, self.centre)], np.int64)


def _lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths (-1 for a null), places in ``values`` and the values (NaN for a null) of a column of lists."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    room = np.maximum(lengths, 0)
    return lengths, np.cumsum(room) - room, values


def _grid(lengths, starts, values, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and grid numbers of the vectors with ``dims`` finite entries."""
    rows = np.flatnonzero(lengths == dims)
    found = values.reshape(-1, dims) if len(rows) == len(lengths) else values[starts[rows][:, None] + np.arange(dims)]
    fine = np.isfinite(found).all(axis=1)
    return rows[fine], np.clip(np.floor(SCALE * found[fine]), -MOST, MOST).astype(np.int64) + OFFSET


def _blocks(batches, dims: int):
    """(batch, row numbers, grid numbers) of bounded slices; the vectors are a batch's last column."""
    for batch in batches:
        step = max(1, BLOCK // dims)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, *_grid(*_lists(part.column(part.num_columns - 1)), dims)


def _sums(batches):
    """One row per length and dimension: vectors and the sums of their entries' high and low halves."""
    found: dict[int, list] = {}
    for batch in batches:
        lists = _lists(batch.column(0))
        for dims in np.unique(lists[0]).tolist():
            if dims > 0:
                _, x = _grid(*lists, dims)
                sums = found.setdefault(dims, [0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)])
                sums[0] += len(x)
                sums[1] += (x >> 32).sum(axis=0)
                sums[2] += (x & 0xFFFFFFFF).sum(axis=0)
    for dims, (n, high, low) in found.items():
        yield pa.RecordBatch.from_pydict({"dims": pa.array([dims] * dims, pa.int32()), "at": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "high": high, "low": low})


def _matrix(partials: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' matrices, given as rows (at, entries)."""
    cells = partials.repartition("at").select("at", F.posexplode("entries").alias("to", "x")).groupBy("at", "to").agg(F.sum("x").alias("x"))
    out = np.zeros((size, size))
    table = cells.toArrow()  # size x size numbers
    out[table["at"].to_numpy(), table["to"].to_numpy()] = table["x"].to_numpy()
    return out


def _products(of):
    """A task's matrix of products of what ``of`` gives for its rows, one row a dimension."""

    def products(batches):
        total = None
        for y in of(batches):
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "entries": pa.array(list(total), pa.list_(pa.float64()))})

    return products


def fit(vectors: DataFrame, column: str = "embedding", most: int = 8) -> Whitening | None:
    """The ``most`` leading components of the vectors, or None without vectors.

    Vectors with null or non-finite entries, null and empty ones, and those of another length
    than most (of equals the longer) are left out. Repeated rows count as often as they stand.
    Components whose eigenvalue is nothing but rounding are left out, so a single vector or
    equal ones have none. The covariance matrix is held on the driver: 8 bytes x dimensions^2.
    """
    source = vectors.select(F.col(column).alias("vector"))
    sums = source.mapInArrow(_sums, "dims int, at int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    sums = stored(sums.groupBy("dims", "at").agg(F.sum("n").alias("n"), wide("high").alias("high"), wide("low").alias("low")), "sums")
    common = sums.where("at = 0 and n > 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return None
    dims, n = common["dims"], common["n"]
    rows = sums.where(F.col("dims") == dims).orderBy("at").collect()  # one a dimension
    model = Whitening(n, [(int(r["high"]) << 32) + int(r["low"]) for r in rows], np.empty((0, dims)), np.empty(0), 0.0)
    centre, rest = model.centre, model.rest.astype(float)
    centred = lambda batches: ((x - centre).astype(float) for _, _, x in _blocks(batches, dims))
    products = _matrix(source.mapInArrow(_products(centred), "at int, entries array<double>"), dims)
    covariance = products / n - np.outer(rest / n, rest / n)  # of the centres' rounding, at most half a step
    model.trace = float(np.trace(covariance))
    found = [(e, v) for e, v in components(covariance, most) if e > ROUNDING * np.linalg.norm(covariance)]
    if found:
        units = [v / np.linalg.norm(v) * np.sign(v[np.argmax(np.abs(v))]) for _, v in found]
        model.vectors = np.array(units)
        model.values = np.array([v @ covariance @ v for v in units])
    return model


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    return ((x - model.centre) - model.rest / model.n) @ model.vectors.T / np.sqrt(model.values)


def _deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Squared distances from the mean times n^2, exact; null where a long can't hold one."""
    y = x - model.centre
    high = model.n * (np.abs(y).max(initial=0).astype(float) + 1)
    if high * high * len(model.centre) < 2.0**62:
        t = model.n * y - model.rest
        return pa.array((t * t).sum(axis=1), pa.int64())
    exact = [sum((model.n * a - b) ** 2 for a, b in zip(row, model.rest.tolist())) for row in y.tolist()]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def whiten(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, deviation (squared distance from the mean times n^2, null beyond a long) and whitened (array) of each vector with finite entries.

    Rows that ``fit`` leaves out are left out here, too; a null id stays null, repeated rows give repeated rows.
    """
    dims = len(model.sums)

    def project(batches):
        for batch, rows, x in _blocks(batches, dims):
            if len(rows):
                made = pa.array(list(_projected(x, model)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _deviations(x, model), made], ["vec_id", "deviation", "whitened"])

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(column).alias("vector")).mapInArrow(project, "vec_id long, deviation long, whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured over all of them."""
    dims, k = len(model.sums), len(model.values)
    ones = lambda x: np.hstack([_projected(x, model), np.ones((len(x), 1))])  # the last row sums the others
    projected = lambda batches: (ones(x) for _, _, x in _blocks(batches, dims))
    total = _matrix(vectors.select(F.col(column).alias("vector")).mapInArrow(_products(projected), "at int, entries array<double>"), k + 1)
    mean = total[k, :k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whitened_rows(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", most: int = 8) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Null, empty and non-finite vectors, and those of an uncommon length, have no rows; nor has
    any where all vectors are equal. Extra columns are ignored.
    """
    model = fit(vectors, column, most)
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], kinds)
    error = identity_error(vectors, model, column)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    rows = whiten(vectors, model, vec_id, column).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
