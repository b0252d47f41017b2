"""Whitening of embeddings: exact sums, then a covariance of centred vectors, its eigenvectors, a projection.

Two passes go over the distinct vectors.  The first adds whole numbers and is exact.  The second takes the
mean off before it multiplies, so no digits are lost where the mean is large beside the spread.  Each task
hands on one matrix; matrices are added up as a tree, and only one of them reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.base import written
from sextant.llm.kernels import tidy

#: Numbers of a batch that are worked on at a time, and of all sums or matrices of one task (the sizes of vectors that differ have one each).
STEP, HELD = 1 << 20, 1 << 27
_INT = 1 << 62


@dataclass(frozen=True)
class Fit:
    """What whitens the vectors of one size: n vectors with sums; eigenvectors as rows, by falling eigenvalue.

    An eigenvalue that rounding alone may leave of no variance is 0.
    """

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def plain(self, k: int) -> tuple:
        """The first k components as a tuple that travels without this class."""
        return self.n, self.sums, self.values[:k], self.vectors[:k], self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean: whole numbers as far as they go, then the fraction that is left of the mean."""
        whole, left = zip(*(divmod(s, self.n) for s in self.sums))
        return (x - np.array(whole, np.int64)).astype(np.float64) - np.array(left, np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A column for each component; those without variance are nan."""
        scale = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return (self.centred(x) @ self.vectors.T) / scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n * x - sum)^2."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most * most * max(len(self.sums), 1) < _INT:
            d = x * self.n - np.array(self.sums, np.int64)
            return np.einsum("ij,ij->i", d, d).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) for v in (d * d).sum(1)]


def whole(vector: Column) -> Column:
    """floor(256 * entry) of each entry, taken as double, as long; null if the vector is, or has an entry that is null or not finite."""
    d = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(d, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(sound, F.transform(d, lambda c: F.floor(256 * c)))


def _blocks(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of a column, those of one size together, a bounded number at a time."""
    ends = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        for i in range(0, len(at), max(1, STEP // max(d, 1))):
            part = at[i : i + max(1, STEP // max(d, 1))]
            yield part, flat[ends[part][:, None] + np.arange(d)]


def _held(total: dict, d: int, n: int) -> None:
    if d not in total and n + sum(np.size(v[1]) for v in total.values()) > HELD:
        raise ValueError(f"vectors of {len(total) + 1} sizes need more than {HELD} numbers at a time")


def _sums(total: dict, x: np.ndarray) -> None:
    """Add a block's number of vectors and exact sums."""
    n, d = x.shape
    if int(np.abs(x).max(initial=0)) < _INT // max(n, 1):
        s = x.sum(0).astype(object)
    else:
        s = (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
    _held(total, d, d)
    m, t = total.get(d, (0, np.zeros(d, object)))
    total[d] = (m + n, t + s)


def _products(fits: dict[int, Fit]) -> Callable[[dict, np.ndarray], None]:
    def add(total: dict, x: np.ndarray) -> None:
        n, d = x.shape
        c = fits[d].centred(x)
        _held(total, d, d * d)
        m, t = total.get(d, (0, 0.0))
        total[d] = (m + n, t + c.T @ c)

    return add


def _moments(held: Broadcast) -> Callable[[dict, np.ndarray], None]:
    """Add a block's whitened vectors: number, mean and centred products, merged so that what is multiplied is centred."""

    def add(total: dict, x: np.ndarray) -> None:
        d = x.shape[1]
        w = Fit(*held.value[d]).whitened(x)
        mean = w.mean(0)
        c = w - mean
        total[d] = _joined(total.get(d), (len(w), mean, c.T @ c))

    return add


def _joined(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _added(a: dict, b: dict) -> dict:
    """Totals by size of vector, merged."""
    for d, v in b.items():
        if d not in a:
            _held(a, d, np.size(v[1]))
            a[d] = v
        else:
            a[d] = _joined(a[d], v) if len(v) == 3 else (a[d][0] + v[0], a[d][1] + v[1])
    return a


def gathered(vectors: DataFrame, add: Callable[[dict, np.ndarray], None]) -> dict:
    """Totals over a frame of vectors (column x): one per task by ``add``, merged as a tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        total: dict = {}
        for b in batches:
            for _, x in _blocks(b.column(0)):
                add(total, x)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.large_binary())], ["total"])

    def seen(a: dict, row) -> dict:
        import pickle

        return _added(a, pickle.loads(bytes(row.total)))

    return vectors.select("x").mapInArrow(tidy(run), "total binary").rdd.treeAggregate({}, seen, _added, depth=3)


def fitted(vectors: DataFrame) -> dict[int, Fit]:
    """By size of vector, what whitens the distinct vectors of a frame (column x of whole numbers, each vector once)."""
    sums = gathered(vectors, _sums)
    bare = {d: Fit(n, [int(v) for v in s], np.zeros(0), np.zeros((0, d)), 0.0) for d, (n, s) in sums.items() if d}
    out = {}
    for d, (n, m) in gathered(vectors.filter(F.size("x") > 0), _products(bare)).items() if bare else ():
        v = (m + m.T) / (2 * n)
        values, columns = np.linalg.eigh(v)
        values = np.where(values > d * np.finfo(float).eps * max(values[-1], 0.0), values, 0.0)
        out[d] = Fit(n, bare[d].sums, values[::-1].copy(), columns.T[::-1].copy(), float(np.trace(v)))
    return out


def _far_from_identity(v: np.ndarray) -> float:
    """The largest absolute entry of a covariance minus the identity, over components that have variance."""
    some = ~np.isnan(np.diag(v))
    return float(np.abs(v[np.ix_(some, some)] - np.eye(int(some.sum()))).max(initial=0.0))


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4) -> DataFrame:
    """Per row: vec_id, n, deviation (decimal of 38 digits, exact), whitened and explained (arrays of k at most), identity_error.

    The fit is over the distinct whole-number vectors of all rows.  Rows whose vector is null, or has an entry
    that is null or not finite, go.  Vectors of another size are another fit, with its own n; an empty vector
    has n 0 and no components.  A component without variance (there is one vector, or fewer independent ones than
    components) has whitened null and explained 0, or null where no component has any.  Components of equal
    eigenvalue are any basis of their space; signs are any, but the same for all rows.  identity_error is
    measured over the distinct vectors by a pass of its own, over components with variance, 0 without any.  Repeated rows and ids are rows of their own; null ids stay; an empty table gives an
    empty one; other columns are not read, whatever their names.  Entries of 2^54 and more are cut off at the
    bounds of a long.

    A task and the driver hold one d x d matrix for vectors of size d, and of several sizes HELD numbers at most;
    beyond, the job ends with an error.  A row's work is d * k; the fit's is d * d for each distinct vector.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col)).alias("x")).filter(F.col("x").isNotNull())
    distinct = written(rows.select("x").distinct(), "whitening-vectors")
    fits = fitted(distinct)
    share = vectors.sparkSession.sparkContext.broadcast
    held = share({d: f.plain(k) for d, f in fits.items()})
    moments = gathered(distinct.filter(F.size("x") > 0), _moments(held)) if fits else {}
    error = share({d: _far_from_identity(m / n) for d, (n, _, m) in moments.items()})
    kind = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _blocks(b.column(1)):
                ids, n, d = b.column(0).take(pa.array(at)), len(at), x.shape[1]
                f = Fit(*held.value.get(d, (0, [], np.zeros(0), np.zeros((0, d)), 0.0)))
                c = len(f.values)
                w = f.whitened(x) if c else np.zeros((n, 0))
                part = f.values / f.trace if f.trace > 0 else np.full(c, np.nan)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * c, pa.int32()), pa.array(v.ravel(), mask=np.isnan(v.ravel())))
                far = f.deviations(x) if f.n else [0] * n
                cols = [ids, pa.array([f.n] * n, pa.int64()), pa.array(far, pa.decimal128(38, 0)), lists(w), lists(np.tile(part, (n, 1))), pa.array([error.value.get(d, 0.0)] * n)]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(tidy(run), kind)


def components(whitened: DataFrame) -> DataFrame:
    """A row for each component of each vector, numbered from 1: the contract's columns.

    A deviation beyond the range of a long is null.
    """
    each = whitened.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("_i", "_c"))
    return each.select("vec_id", (F.col("_i") + 1).cast("int").alias("component"), "n", "deviation", F.col("_c.whitened").alias("whitened"), F.col("_c.explained").alias("explained"), "identity_error")
