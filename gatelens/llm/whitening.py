"""Whitening of embeddings by refined eigenvectors of their covariance.

Vectors are cut to a grid of whole numbers, so that sums are exact and equal vectors are found by
their bytes. The covariance of the distinct ones is added up over partitions. Its eigenvectors are
found in single precision and corrected in double precision by the iteration of Ogita and Aishima,
which needs matrix products only; eigenvalues too close for it are parted by small problems of
their own, shifted to where they differ.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import GROUPS, REPORT, report, summed, written

#: Components that a row gets, at most.
COMPONENTS = 16
#: Steps of the grid in a unit, and the whole number at zero.
SCALE = 64
OFFSET = 1_000_000
#: Grid values beyond this are refused: a double no longer tells neighbours apart.
LARGEST = 1 << 53
#: Corrections of the eigenvectors; each about doubles the right digits.
CORRECTIONS = 12
#: Vectors that a task holds as numbers at a time.
ROWS = 8192

_WIDTHS = (("<i1", 1), ("<i2", 2), ("<i4", 4), ("<i8", 8))


@dataclass(frozen=True)
class Whitening:
    """What is learnt from the distinct vectors; sizes depend on the dimensions only."""

    n: int
    sums: tuple[int, ...]
    #: Columns are unit eigenvectors, by falling eigenvalue.
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def known(self) -> np.ndarray:
        """Components with a variance beyond rounding; the others cannot be scaled to one."""
        floor = len(self.values) * np.finfo(float).eps * max(float(self.values[:1].sum()), 0.0)
        return self.values > floor

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean, as doubles, from exact differences."""
        return _scaled(x, self.n, self.sums).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum) ** 2 of each row, exact."""
        scaled = _scaled(x, self.n, self.sums)
        if scaled.dtype != object and (scaled.astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
            return (scaled**2).sum(axis=1).tolist()
        return [sum(v * v for v in row) for row in scaled.astype(object).tolist()]

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """Components of each row, scaled to unit variance; NaN where a component has none."""
        some = self.known[:components]
        scale = np.where(some, np.sqrt(np.where(some, self.values[:components], 1.0)), np.nan)
        return self.centred(x) @ self.vectors[:, :components] / scale


def _scaled(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - sums`` without overflow: in Python's integers where 64 bits do not hold it."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if largest < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _coded(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes: one for the width, then the numbers in the least width."""
    widths = np.full(len(x), 3)
    for at in (2, 1, 0):
        kind = np.iinfo(_WIDTHS[at][0])
        fits = (x >= kind.min).all(axis=1) & (x <= kind.max).all(axis=1)
        widths[fits] = at
    out = [b""] * len(x)
    for at, (kind, _) in enumerate(_WIDTHS):
        for i in np.flatnonzero(widths == at).tolist():
            out[i] = bytes([at]) + x[i].astype(kind).tobytes()
    return out


def _decoded(codes: list[bytes], dims: int) -> np.ndarray:
    x = np.empty((len(codes), dims), np.int64)
    by_width: dict[int, list[int]] = {}
    for i, code in enumerate(codes):
        by_width.setdefault(code[0], []).append(i)
    for at, rows in by_width.items():
        data = b"".join([codes[i][1:] for i in rows])
        x[rows] = np.frombuffer(data, _WIDTHS[at][0]).reshape(len(rows), dims)
    return x


def on_grid(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """``id, dims, x`` of the rows that take part: the coded whole numbers floor(scale * entry)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                # a missing entry counts as not finite
                lists = batch.column(1)
                flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
                dims = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
                begin = np.cumsum(np.maximum(dims, 0)) - np.maximum(dims, 0)
                ids, sizes, codes = [], [], []
                given = batch.column(0).to_pylist()
                for size in np.unique(dims[dims >= 0]).tolist():
                    rows = np.flatnonzero(dims == size)
                    entries = flat[begin[rows][:, None] + np.arange(size)]
                    good = np.isfinite(entries).all(axis=1)
                    grid = np.floor(entries[good] * scale)
                    if np.abs(grid).max(initial=0) >= LARGEST:
                        raise ValueError(f"an entry of {vector} is beyond {LARGEST} / {scale}")
                    ids += [given[i] for i in rows[good]]
                    sizes += [size] * int(good.sum())
                    codes += _coded(grid.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(codes, pa.binary())],
                    names=["id", "dims", "x"],
                )

    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    )
    return rows.mapInArrow(code, "id long, dims int, x binary")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield some, _decoded(some.column(column).to_pylist(), dims)


def _sums(distinct: DataFrame, dims: int) -> tuple[int, tuple[int, ...]]:
    """Count of the distinct vectors and their exact sums, high and low halves added apart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        count = np.zeros(1, np.int64)
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for _, x in _blocks(batches, dims, "x"):
            count += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        for key, counts in (("n", count), ("high", high), ("low", low)):
            yield from report(key, part, counts)

    found = summed(distinct.mapInArrow(add, REPORT), max(dims, 1))
    zeros = np.zeros(max(dims, 1), np.int64)
    high, low = found.get("high", zeros), found.get("low", zeros)
    sums = tuple((int(h) << 32) + int(i) for h, i in zip(high[:dims], low[:dims], strict=True))
    return int(found.get("n", zeros)[0]), sums


_MOMENTS = "part long, n long, mean binary, products binary"


def _merged(rows: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred products of several groups of rows as of one."""
    n = int(rows["n"].sum())
    means = np.array([np.frombuffer(m) for m in rows["mean"]])
    weights = rows["n"].to_numpy(float)
    mean = weights @ means / n
    apart = means - mean
    products = sum(np.frombuffer(p) for p in rows["products"]).reshape(len(mean), len(mean))
    return n, mean, products + (apart.T * weights) @ apart


def _covariance(distinct: DataFrame, dims: int, values, width: int) -> np.ndarray:
    """Covariance, divisor n, of ``values(x)`` of the distinct vectors, ``width`` numbers each.

    Each block of rows is centred on its own mean before it is multiplied, and blocks are put
    together by what their means differ; partitions are merged in two steps.
    """

    def row(part: int, n: int, mean: np.ndarray, products: np.ndarray) -> dict:
        return {"part": [part], "n": [n], "mean": [mean.tobytes()], "products": [products.tobytes()]}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None
        for _, x in _blocks(batches, dims, "x"):
            if not len(x):
                continue
            y = values(x)
            mean = y.mean(axis=0)
            apart = y - mean
            block = pd.DataFrame(row(part, len(y), mean, apart.T @ apart))
            held = block if held is None else pd.DataFrame(row(part, *_merged(pd.concat([held, block]))))
        if held is not None:
            yield pa.RecordBatch.from_pandas(held, preserve_index=False)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(row(int(rows["part"].iloc[0]), *_merged(rows)))

    parts = distinct.mapInArrow(gather, _MOMENTS).withColumn("part", F.col("part") % GROUPS)
    rows = parts.groupBy("part").applyInPandas(merge, _MOMENTS).toPandas()
    n, _, products = _merged(rows.sort_values("part"))
    return products.reshape(width, width) / n


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction of approximate eigenvectors ``x`` of ``a``; eigenvalues; the bound below which
    two eigenvalues were taken for one."""
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    bound = 2 * (
        np.linalg.norm(s - np.diag(values), 2) + np.linalg.norm(a, 2) * np.linalg.norm(r, 2)
    )
    apart = values[None, :] - values[:, None]
    split = np.abs(apart) > bound
    change = np.where(split, (s + values[None, :] * r) / np.where(split, apart, 1.0), r / 2)
    return x + x @ change, values, bound


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors of a symmetric matrix, in double precision.

    The start is a single-precision solution. Eigenvalues within the bound of a correction form a
    cluster: its vectors are turned by the solution of the cluster's own small problem, less its mean
    eigenvalue so that single precision sees the differences. Signs make each largest entry positive.
    """
    size = len(a)
    if not size:
        return np.zeros(0), np.zeros((0, 0))
    scale = float(np.abs(a).max())
    if scale == 0:
        return np.zeros(size), np.eye(size)
    unit = a / scale
    x = np.linalg.eigh(unit.astype(np.float32))[1].astype(float)
    best, best_off = x, np.inf
    for _ in range(CORRECTIONS):
        x, values, bound = refined(unit, x)
        order = np.argsort(values, kind="stable")
        x, values = x[:, order], values[order]
        first = 0
        for last in range(1, size + 1):
            if last < size and values[last] - values[last - 1] <= bound:
                continue
            if last - first > 1:
                some = x[:, first:last]
                inner = some.T @ (unit @ some) - values[first:last].mean() * (some.T @ some)
                spread = np.abs(inner).max()
                if spread > 0:
                    turned = np.linalg.eigh((inner / spread).astype(np.float32))[1].astype(float)
                    x[:, first:last] = some @ turned
            first = last
        x, _, _ = refined(unit, x)
        s = x.T @ (unit @ x)
        off = max(np.abs(s - np.diag(np.diag(s))).max(), np.abs(np.eye(size) - x.T @ x).max())
        if off < best_off:
            best, best_off = x, off
        elif off < 1e-12:
            break
    x = best / np.linalg.norm(best, axis=0)
    values = np.einsum("ij,ij->j", x, unit @ x) * scale
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(size)])
    return values[order], x * signs


def fit(distinct: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct coded vectors ``x``; None where there are none."""
    n, sums = _sums(distinct, dims)
    if not n or not dims:
        return None
    start = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, None)
    a = _covariance(distinct, dims, start.centred, dims)
    values, vectors = eigenvectors((a + a.T) / 2)
    model = Whitening(n, sums, vectors, values, float(np.trace(a)), None)
    width = int(model.known[:components].sum())
    if not width:
        return model
    white = _covariance(distinct, dims, lambda x: model.whitened(x, width), width)
    error = float(np.abs(white - np.eye(width)).max())
    return Whitening(n, sums, vectors, values, model.trace, error)


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double, exact decimal(38,0)"


def whiten(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    offset: int = OFFSET,
    components: int = COMPONENTS,
) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error, deviation_exact``.

    An entry c becomes x = floor(scale * c) + offset; the offset takes no part, since all values are
    differences of x. ``n`` counts the distinct x vectors, over which the covariance is taken.
    ``deviation`` is exact and null where 64 bits do not hold it; ``deviation_exact`` is a decimal.

    Vectors that are null or hold null, infinite or NaN entries give no rows, nor do vectors whose
    length is not the most frequent one (of equally frequent ones the longest), since they share no
    dimensions. Entries at ``2**53 / scale`` and beyond are refused. Equal vectors count once in the
    fit and get equal rows; ids may be null or repeat, each row stands for itself. There are as many
    components as dimensions, ``components`` at most; one without variance (a single vector, a
    constant dimension) has a null ``whitened`` and takes no part in ``identity_error``, which is null
    where no component has any, as is ``explained``. Vectors without entries and empty tables give no
    rows. Other columns are left aside, whatever their names.
    """
    grid = written(on_grid(vectors, id_col, vector, scale), "grid")
    lengths = grid.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = lengths[0].dims if lengths else 0
    rows = grid.where(F.col("dims") == dims)
    model = fit(written(rows.select("x").distinct(), "distinct"), dims, components)
    schema = f"id long, {_OUT}"
    if model is None:
        empty = vectors.sparkSession.createDataFrame([], schema)
        return empty.withColumnsRenamed({"id": id_col, "exact": "deviation_exact"})
    width = min(components, dims)
    shares = model.values[:width] / model.trace if model.trace else np.full(width, np.nan)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, dims, "x"):
            deviation = model.deviations(x)
            fits = [d if d < 1 << 63 else None for d in deviation]
            many = len(x)
            each = np.repeat(np.arange(many), width)

            def numbers(values: np.ndarray) -> pa.Array:
                return pa.array(values, pa.float64(), from_pandas=True)

            error = pa.scalar(model.identity_error, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * width, model.n, np.int64)),
                    pa.array(fits, pa.int64()).take(pa.array(each)),
                    numbers(model.whitened(x, width).ravel()),
                    numbers(np.tile(shares, many)),
                    pa.repeat(error, many * width),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(each)),
                ],
                schema=pa.schema(
                    [
                        ("id", pa.int64()),
                        ("component", pa.int32()),
                        ("n", pa.int64()),
                        ("deviation", pa.int64()),
                        ("whitened", pa.float64()),
                        ("explained", pa.float64()),
                        ("identity_error", pa.float64()),
                        ("exact", pa.decimal128(38, 0)),
                    ]
                ),
            )

    out = rows.select("id", "x").mapInArrow(project, schema)
    return out.withColumnsRenamed({"id": id_col, "exact": "deviation_exact"})
