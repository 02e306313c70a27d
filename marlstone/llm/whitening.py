"""Whitening of integer vectors: principal components by a Jacobi-Davidson iteration over distributed products."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.common import keep

# Residuals count as double precision below this share of the largest eigenvalue.
PRECISION = 2.0**-45
# Steps of MINRES for a correction equation, the share of its residual to reach,
# columns beyond those wanted, and the most outer steps.
INNER, INNER_SHARE, SPARE, OUTER = 6, 0.02, 4, 100
# Partial sums of all partitions meet in so many tasks.
REDUCERS = 16
_LIMIT = 1 << 62


def fixed_point(vector, scale: int, shift: int):
    """floor(scale * c) + shift of each entry; entries beyond 2^62 in size count as 2^62."""
    bound = float(_LIMIT)
    return F.transform(
        vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(bound)), F.lit(-bound))) + shift
    )


def matrix(packed: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<i8").reshape(len(packed), -1)


def _summed(points: DataFrame, measure: Callable[[np.ndarray], np.ndarray], join: Callable) -> np.ndarray | None:
    """``measure`` of all rows: of each batch of points, joined within tasks, then within a few tasks, then here."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                own = measure(matrix(batch.column("x")))
                found = own if found is None else join(found, own)
        out = [] if found is None else [found.tobytes()]
        yield pa.record_batch([pa.array(out, pa.binary())], ["part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (np.frombuffer(p) for batch in batches for p in batch.column("part").to_pylist())
        found = None
        for p in parts:
            found = p if found is None else join(found, p)
        out = [] if found is None else [found.tobytes()]
        yield pa.record_batch([pa.array(out, pa.binary())], ["part"])

    parts = points.select("x").mapInArrow(measured, "part binary").repartition(REDUCERS).mapInArrow(merge, "part binary")
    parts = [np.frombuffer(r["part"]) for r in parts.collect()]
    return functools.reduce(join, parts) if parts else None


class Centred:
    """The points' exact sums, and products with their covariance that never make it a matrix."""

    def __init__(self, points: DataFrame):
        self.points = points
        rows = points.select("x").mapInArrow(_halves, "dim int, low long, high long, n long")
        rows = rows.groupBy("dim").agg(
            *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high", "n")]
        )
        rows = sorted(rows.collect(), key=lambda r: r["dim"])
        self.dims = len(rows)
        self.n = int(rows[0]["n"]) if rows else 0
        sums = [(int(r["high"]) << 32) + int(r["low"]) for r in rows]
        # S = n * whole + rest: x - S/n is (x - whole) - rest/n, without cancellation.
        self.whole = np.array([s // self.n for s in sums], np.int64)
        self.rest = [s % self.n for s in sums]
        self.share = np.array([r / self.n for r in self.rest])

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        whole, share = self.whole, self.share
        return lambda x: (x - whole).astype(np.float64) - share

    def product(self, block: np.ndarray) -> np.ndarray:
        """Covariance times a block of columns: a pass over the points."""
        centre, shape = self.centre(), block.shape

        def measure(x: np.ndarray) -> np.ndarray:
            y = centre(x)
            return (y.T @ (y @ block)).ravel()

        return _summed(self.points, measure, np.add).reshape(shape) / self.n


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each dimension the sums of the low and the high 32 bits, which no number of rows overflows."""
    low = high = None
    n = 0
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("x"))
            a, b = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
            low, high = (a, b) if low is None else (low + a, high + b)
            n += len(x)
    dims = 0 if low is None else len(low)
    columns = [np.arange(dims, dtype=np.int32), low, high, np.full(dims, n, np.int64)] if dims else [[]] * 4
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["dim", "low", "high", "n"])


def _orthonormal(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns that span what ``block`` adds to the bases."""
    for _ in range(2):
        for base in bases:
            block = block - base @ (base.T @ block)
        sizes = np.linalg.norm(block, axis=0)
        block = block[:, sizes > 0] / sizes[sizes > 0]
        if not block.shape[1]:
            return block
        left, weight, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, weight > 1e-7 * weight[0]]
        room = len(block) - sum(b.shape[1] for b in bases)
        block = block[:, : max(room, 0)]
    return block


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, share: float) -> np.ndarray:
    """MINRES for several symmetric systems at once, a column each; a step is one product with all columns."""
    x = np.zeros_like(right)
    beta = first = np.linalg.norm(right, axis=0)
    live = first > 0
    v_old, v = np.zeros_like(right), right / np.where(live, first, 1)
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    c_old = c = np.ones(len(first))
    s_old = s = np.zeros(len(first))
    eta = first.copy()
    for step in range(steps):
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - (beta if step else 0) * v_old
        new = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta * (step > 0)
        one = np.hypot(delta, new)
        two = s * alpha + c_old * c * beta * (step > 0)
        three = s_old * beta * (step > 0)
        safe = np.where(one > 0, one, 1)
        c_old, s_old, c, s = c, s, delta / safe, new / safe
        w_old, w = w, (v - three * w_old - two * w) / safe
        x = x + np.where(one > 0, c * eta, 0) * w
        eta = -s * eta
        v_old, v, beta = v, p / np.where(new > 0, new, 1), new
        if (np.abs(eta) <= share * first).all():
            break
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues, falling, and unit eigenvectors of a symmetric positive operator.

    Each outer step takes Ritz pairs of the search space, locks those whose
    residual is at double precision, and adds to the space what MINRES gives for
    the correction equations of the others, (I - QQ')(A - t)(I - QQ') z = -r,
    where Q holds all locked and wanted Ritz vectors. The equations of all open
    pairs are solved together, so that a step costs one product. The search
    starts over from its best Ritz vectors when it has grown to several times
    the wanted number.
    """
    wanted = min(wanted, dims)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    space = _orthonormal(np.random.default_rng(11).standard_normal((dims, min(dims, wanted + SPARE))))
    image = product(space)
    scale = 0.0
    for _ in range(OUTER):
        h = space.T @ image
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        scale = max([scale, *np.abs(theta)])
        open_ = wanted - locked.shape[1]
        residual = image[:, :open_] - space[:, :open_] * theta[:open_]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        done = size <= PRECISION * scale
        if done.any():
            which = np.flatnonzero(done)
            # One fresh product tells what rotations of the image have blurred.
            fresh = product(space[:, which])
            again = fresh - space[:, which] * theta[which]
            sure = np.linalg.norm(again - locked @ (locked.T @ again), axis=0) <= 4 * PRECISION * scale
            image[:, which] = fresh
            which = which[sure]
            locked, values = np.hstack([locked, space[:, which]]), np.append(values, theta[which])
            rest = np.setdiff1d(np.arange(space.shape[1]), which)
            space, image, theta = space[:, rest], image[:, rest], theta[rest]
            residual, size = np.delete(residual, which, 1), np.delete(size, which)
            open_ = wanted - locked.shape[1]
        if not open_:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if space.shape[1] + len(size) > max(3 * wanted, wanted + 2 * SPARE) and space.shape[1] < dims - locked.shape[1]:
            space, image, theta = (z[..., : open_ + SPARE] for z in (space, image, theta))
        if space.shape[1] < dims - locked.shape[1]:
            ritz = space[:, :open_]

            def projected(z: np.ndarray) -> np.ndarray:
                z = z - locked @ (locked.T @ z)
                return z - ritz @ (ritz.T @ z)

            def equation(z: np.ndarray) -> np.ndarray:
                z = projected(z)
                return projected(product(z) - z * theta[:open_])

            grown = minres(equation, -projected(residual), INNER, INNER_SHARE)
            grown = _orthonormal(grown, locked, space)
            if not grown.shape[1]:
                grown = _orthonormal(np.random.default_rng(len(values)).standard_normal((dims, open_)), locked, space)
            space, image = np.hstack([space, grown]), np.hstack([image, product(grown)])
        else:
            # The space is whole: only the products' own rounding is left.
            image = product(space)
    raise ArithmeticError(f"residuals stay above {PRECISION} of the largest eigenvalue after {OUTER} steps")


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count, mean and centred products of two parts taken together."""
    k = int((np.sqrt(4 * len(a) - 3) - 1) / 2)
    n, m = a[0], b[0]
    mean_a, mean_b = a[1 : k + 1], b[1 : k + 1]
    gap = mean_b - mean_a
    mean = mean_a + gap * (m / (n + m))
    products = a[k + 1 :] + b[k + 1 :] + np.outer(gap, gap).ravel() * (n * m / (n + m))
    return np.concatenate([[n + m], mean, products])


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """Of each row and principal component: the whitened coordinate, and how good it is.

    ``vector`` is an array of longs. Columns: id, ``component`` (from 1, by
    falling eigenvalue), ``n`` (rows), ``deviation`` (sum over dimensions of
    (n * x - S)^2, exact; null beyond a long), ``whitened`` (the centred vector
    along the component over the square root of its eigenvalue), ``explained``
    (eigenvalue over trace), ``eigenvalue`` and ``identity_error`` (largest
    entry of the whitened rows' covariance minus the identity).

    The covariance (divisor n, centred before multiplying) is never formed: the
    iteration only multiplies blocks of columns with it, each time a pass over
    the points, whose partial sums are added in tasks before one small block
    reaches the driver. What the driver holds depends on the number of
    dimensions alone.

    Rows without a vector or with a null entry are left out, and so are rows of
    another length than the most frequent one (of equally frequent lengths the
    largest). Null and repeated ids get their rows. Components without variance,
    to double precision, are left out: equal vectors, or one, give no rows, nor
    does an empty table. Other columns are ignored.
    """
    kind = vectors.schema[id].dataType
    v = F.col(vector)
    good = vectors.select(F.col(id).alias("id"), v.alias("v")).where(
        F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    )
    schema = T.StructType(
        [T.StructField(id, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType())]
        + [T.StructField("deviation", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "eigenvalue", "identity_error")]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            values = np.asarray(lists.flatten()).astype("<i8")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
            ends = np.cumsum(sizes)
            packed = [values[e - m : e].tobytes() for e, m in zip(ends, sizes)]
            yield pa.record_batch([batch.column("id"), pa.array(packed, pa.binary())], ["id", "x"])

    packed = T.StructType([T.StructField("id", kind), T.StructField("x", T.BinaryType())])
    points = keep(good.where(F.size("v") > 0).mapInArrow(pack, packed))
    lengths = points.groupBy(F.length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).limit(2).collect()
    if len(lengths) > 1:
        points = points.where(F.length("x") == lengths[0]["bytes"])
    empty = vectors.sparkSession.createDataFrame([], schema)
    if not lengths:
        return empty
    data = Centred(points)
    centre, n = data.centre(), data.n
    trace = float(_summed(points, lambda x: np.array([np.square(centre(x)).sum()]), np.add)[0]) / n
    if trace <= 0:
        return empty
    values, axes = jacobi_davidson(data.product, data.dims, components)
    real = values > data.dims * 2.0**-50 * values[0]
    values, axes = values[real], axes[:, real]
    scaled = axes / np.sqrt(values)
    k = len(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ scaled
        mean = w.mean(axis=0)
        return np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])

    products = _summed(points, spread, _merged)[k + 1 :].reshape(k, k) / n
    error = float(np.abs(products - np.eye(k)).max())
    whole, rest, share = data.whole, data.rest, values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, least = np.arange(1, k + 1, dtype=np.int32), np.array(rest, object)
        for big in batches:
            for start in range(0, big.num_rows, 1024):
                batch = big.slice(start, 1024)
                x = matrix(batch.column("x"))
                gap = x - whole
                if len(whole) * (n * (float(np.abs(gap).max()) + 1)) ** 2 < 2.0**62:
                    own = np.square(gap * n - least.astype(np.int64)).sum(axis=1).tolist()
                else:
                    own = [int(((g.astype(object) * n - least) ** 2).sum()) for g in gap]
                    own = [o if o < 1 << 63 else None for o in own]
                rows = len(x)
                at = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    batch.column("id").take(at),
                    np.tile(numbers, rows),
                    np.full(rows * k, n, np.int64),
                    pa.array(own, pa.int64()).take(at),
                    (centre(x) @ scaled).ravel(),
                    np.tile(share, rows),
                    np.tile(values, rows),
                    np.full(rows * k, error),
                ]
                types = [to_arrow_type(f.dataType) for f in schema]
                yield pa.record_batch(
                    [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], schema.names
                )

    return points.mapInArrow(run, schema)
