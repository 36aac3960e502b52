"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With A the matrix of centred rows, every step takes a product Av and a product A'u over all rows: v is a short vector
that travels with the tasks, u has one entry per row. A row's entry of u is a product of the row with a short vector (u = Az with z
from the recurrence), so u is never stored: each task makes its entries of the new u and of all earlier ones from its rows
and sums their products. One Spark job per step so gives the norm of u, its products with all earlier u (full
reorthogonalisation; repeated when they are not small) and A'u; the driver holds vectors of as many entries as a row
has, never one per row. The v are orthogonalised twice against all earlier ones. When a run of the recurrence
ends early (an invariant subspace, as equal variances make it), it goes on with a random vector orthogonal to all before.
The singular values of the small bidiagonal matrix are the deviations (times sqrt(n)), its right vectors combine the v to components.
`steps` defaults to the length of a row, which reaches every component; fewer give the leading ones.

Entries c become x = floor(scale * c) + offset, cut off at +-2**45. Sums, squares and deviations are exact integers. Rows
whose vector is null or holds null, NaN or infinite entries are left out. The length of vectors is the most frequent one
(ties: the longer); rows of another length are left out too. Components whose deviation is zero up to rounding do not
exist: equal rows, a single row or an empty table give no rows. Repeated rows count and are returned each;
null ids stay. Columns besides the id and the vector are not read. Rows travel in blocks of BLOCK_BYTES, so length and
number of vectors do not decide what a task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import words
from lineweave.llm.shared import scratch, stored

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET, LIMIT = 1024, 100_000, 1 << 45
#: Components that the query returns.
COMPONENTS = 8
BLOCK_BYTES = 1 << 20
#: A length below this share of the largest so far is zero up to rounding.
ZERO = 1e-9
#: Products with earlier vectors above this share of the length are taken a second time.
AGAIN = 1e-6


def blocks(vectors: DataFrame, id_column: str, column: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(dims, ids, x): whole rows as integers, in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches, 4096):
            batch = batch.filter(batch["vec"].is_valid())
            if not batch.num_rows:
                continue
            sizes = np.asarray(batch["vec"].value_lengths().to_numpy(zero_copy_only=False), np.int64)
            values = np.asarray(batch["vec"].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
            ends = np.cumsum(sizes)
            odd = np.zeros(len(sizes), bool)
            odd[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(values)]] = True
            for dims in np.unique(sizes[~odd]):
                if not dims:
                    continue
                at = np.flatnonzero((sizes == dims) & ~odd)
                step = max(1, BLOCK_BYTES // (8 * int(dims)))
                for k in range(0, len(at), step):
                    rows = at[k : k + step]
                    x = np.clip(np.floor(scale * values[(ends - sizes)[rows][:, None] + np.arange(dims)]), -LIMIT, LIMIT).astype(np.int64) + offset
                    ids = batch["id"].take(pa.array(rows))
                    yield pa.record_batch([pa.array([int(dims)], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())],
                                          ["dims", "ids", "x"])

    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("vec"))
    return rows.mapInArrow(run, "dims int, ids array<long>, x binary")


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1), np.frombuffer(batch["x"][i].as_buffer(), np.int64).reshape(-1, dims)


class Fit:
    """n, the exact sum of each dimension, the trace of the covariance, components (columns) by falling deviation, and their variances."""

    def __init__(self, rows: DataFrame, dims: int, steps: int | None = None):
        self.rows, self.dims = rows.where(F.col("dims") == dims).select("ids", "x"), dims
        self.n, self.sums, squares = self._totals()
        self.mean = np.array([float(Fraction(s, self.n)) for s in self.sums])
        self.trace = float(sum(Fraction(self.n * q - s * s, self.n * self.n) for s, q in zip(self.sums, squares)))
        self._bidiagonalise(min(dims, steps or dims))

    def _totals(self) -> tuple[int, list[int], list[int]]:
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums, squares = 0, [0] * dims, [0] * dims
            for _, x in _matrices(batches, dims):
                n += len(x)
                small = np.abs(x).max() < 1 << 24
                sums = [a + int(b) for a, b in zip(sums, x.sum(0))]  # a block has at most 2**17 rows of less than 2**46
                squares = [a + int(b) for a, b in zip(squares, (x * x if small else x.astype(object) ** 2).sum(0))]
            yield pa.record_batch([pa.array(range(2 * dims + 1), pa.int32()), pa.array([str(v) for v in (n, *sums, *squares)])], ["i", "v"])

        found = self.rows.select("x").mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        total = {r["i"]: int(r["v"]) for r in found.collect()}  # two numbers a dimension
        return total[0], [total[1 + i] for i in range(dims)], [total[1 + dims + i] for i in range(dims)]

    def _summed(self, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all blocks of centred rows of a vector of `size` numbers."""
        dims, mean = self.dims, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for _, x in _matrices(batches, dims):
                total += of(x - mean)
            yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array(total)], ["i", "v"])

        found = self.rows.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(size)
        for r in found:
            out[r["i"]] = r["v"]
        return out

    def _product(self, z: np.ndarray, earlier: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """With u = Az: u'u, the products of u with the earlier ones, and A'u."""
        def of(c: np.ndarray) -> np.ndarray:
            u = c @ z
            return np.concatenate([[u @ u], (c @ earlier).T @ u, c.T @ u])

        k = earlier.shape[1]
        total = self._summed(of, 1 + k + self.dims)
        return total[0], total[1 : 1 + k], total[1 + k :]

    def _bidiagonalise(self, steps: int) -> None:
        dims, random = self.dims, np.random.default_rng(self.dims)
        v, z, back = (np.zeros((dims, 0)) for _ in range(3))  # the v, the z of every u, and every A'u
        entries: list[tuple[int, int, float]] = []  # of the bidiagonal matrix
        largest, linked = 0.0, None  # linked: the length by which the new v continues the last u

        def orthogonal(w: np.ndarray) -> np.ndarray:
            for _ in range(2):
                w = w - v @ (v.T @ w)
            return w

        new = random.standard_normal(dims)
        new /= np.linalg.norm(new)
        while True:
            v = np.column_stack([v, new])
            raw = new - linked * z[:, -1] if linked else new
            for _ in range(3):
                square, shares, onto = self._product(raw, z)
                rest = square - shares @ shares
                raw, onto = raw - z @ shares, onto - back @ shares
                if shares @ shares <= AGAIN**2 * square:
                    break
            length = np.sqrt(max(rest, 0.0))
            largest = max(largest, length)
            if length <= ZERO * largest or not length:
                if not linked:
                    break  # a random direction has no variance: no direction has any left
                linked = None
            else:
                z, back = np.column_stack([z, raw / length]), np.column_stack([back, onto / length])
                entries.append((z.shape[1] - 1, v.shape[1] - 1, length))
                new = orthogonal(back[:, -1] - length * v[:, -1])
                linked = np.linalg.norm(new)
                largest = max(largest, linked)
                linked = linked if linked > ZERO * largest else None
            if v.shape[1] == steps:
                break
            if linked:
                entries.append((z.shape[1] - 1, v.shape[1], linked))
                new = new / linked
            else:
                new = orthogonal(random.standard_normal(dims))
                new = orthogonal(new / np.linalg.norm(new))
                new /= np.linalg.norm(new)
        small = np.zeros((max(1, z.shape[1]), v.shape[1]))
        for i, j, value in entries:
            small[i, j] = value
        _, deviations, right = np.linalg.svd(small)
        there = deviations > ZERO * max(deviations[0], 1e-300)
        self.components = v @ right[: len(deviations)][there].T
        self.components /= np.linalg.norm(self.components, axis=0)
        self.components *= np.sign(self.components[np.abs(self.components).argmax(0), range(there.sum())])
        self.variances = deviations[there] ** 2 / self.n

    def identity_error(self, count: int) -> float:
        """The largest difference between the covariance of the first `count` whitened dimensions and the identity."""
        w = self.components[:, :count] / np.sqrt(self.variances[:count])
        k = w.shape[1]
        if not k:
            return 0.0
        middle = self._summed(lambda c: (c @ w).sum(0), k) / self.n
        covariance = self._summed(lambda c: ((c @ w - middle).T @ (c @ w - middle)).ravel(), k * k) / self.n
        return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())

    def whitened(self, count: int) -> DataFrame:
        """(id, component, deviation, whitened, explained) of every row and of the first `count` components.

        deviation is decimal(38,0), the sum over dimensions of (n * x - sum) ** 2."""
        n, dims, mean = self.n, self.dims, self.mean
        w = self.components[:, :count] / np.sqrt(self.variances[:count])
        k, explained = w.shape[1], (self.variances[:count] / self.trace).tolist() if self.trace else []
        sums = np.array(self.sums, object)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, x in _matrices(batches, dims):
                far = n * (int(np.abs(x - mean).max()) + 1)
                exact = dims * far * far < 1 << 62 and n * int(np.abs(x).max()) < 1 << 62 and max(map(abs, sums)) < 1 << 62
                away = n * x - sums.astype(np.int64) if exact else n * x.astype(object) - sums
                squares = (away * away).sum(1)
                ids = np.repeat(np.array(block["ids"][0].as_py(), object), k)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                                       pa.array([str(s) for s in squares for _ in range(k)], pa.string()), pa.array(((x - mean) @ w).ravel()),
                                       pa.array(explained * len(x), pa.float64())], ["id", "component", "deviation", "whitened", "explained"])

        schema = "id long, component int, deviation string, whitened double, explained double"
        return self.rows.mapInArrow(run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def fitted(rows: DataFrame, steps: int | None = None) -> Fit | None:
    """The fit over stored blocks; None where no row is left."""
    sizes = rows.groupBy("dims").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    return Fit(rows, sizes[0]["dims"], steps) if sizes else None


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to COMPONENTS whitened values of every vector of `embeddings`. A deviation beyond the range of long is null."""
    with scratch(spark):
        rows = stored(blocks(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "vectors", keep=True)
        fit = fitted(rows)
        if fit is None:
            return spark.createDataFrame([], RESULT)
        return fit.whitened(COMPONENTS).select(
            F.col("id").alias("vec_id"), "component", F.lit(fit.n).cast("long").alias("n"), F.expr("try_cast(deviation AS bigint)").alias("deviation"),
            "whitened", "explained", F.lit(fit.identity_error(COMPONENTS)).alias("identity_error"))
