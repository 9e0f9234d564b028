"""Embedding whitening: float32 eigenvectors of a distributed covariance, refined in higher precision.

Entries become integers, x = floor(64 c) + 1000000. Over the distinct x vectors Spark sums, as integers in limbs, first the
entries and then the products of entries centred by the rounded mean; what rounding left of the mean is taken off exactly.
So the covariance does not depend on how the rows are dealt to tasks, and loses no digit to cancellation.

Its eigenvectors are found in float32 and corrected by the iteration of Ogita and Aishima, which needs only matrix products
(here in extended precision): with R = I - X'X and S = X'VX, X becomes X + XE, where e_ij = (s_ij + l_j r_ij) / (l_j - l_i),
written so that e_ij + e_ji is r_ij to the last digit: what rounding puts into the quotient turns vectors, but bends none.
Eigenvalues that stand too close together for that division are a cluster: its vectors are made orthogonal, and the small
problem X_J'(V - m I)X_J of the cluster alone is solved and rotates them.

What reaches the driver is one number for each pair of dimensions, whatever the number of rows.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; an entry whose 64-fold is beyond
9e18 counts as that. Vectors of different lengths are different spaces, each with its own fit list, covariance and count; an
empty vector has no component and gives no row. Rows with null or repeated ids stay, each with its own results; other
columns are ignored. A component without
variance beyond rounding (as when there are fewer distinct vectors than dimensions) has a null `whitened` and is left
out of identity_error, which is 0.0 if all are; `explained` is null if no component has variance. `deviation` is null where
it does not fit in a long; `deviation_text` has all its digits. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recohort.llm.text import small_batches
from recohort.session import pin

COMPONENTS = 16
SCALE, OFFSET, LARGEST = 64, 1_000_000, 9.0e18
#: Integers travel as LIMBS numbers of LIMB_BITS bits, the last one with the sign: sums of millions of them fit in longs.
LIMBS, LIMB_BITS = 5, 40
#: Rows whose products are summed at once.
BLOCK = 4096


def integer_vectors(rows: DataFrame, vector_name: str = "embedding") -> DataFrame:
    """The rows with sound vectors, and their integer form as column `x`. A column of that name is replaced."""
    vector = F.col(vector_name).cast("array<double>")
    unsound = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = lambda c: F.floor(F.least(F.greatest(c * float(SCALE), F.lit(-LARGEST)), F.lit(LARGEST))).cast("long") + F.lit(OFFSET).cast("long")
    kept = rows.where(F.col(vector_name).isNotNull() & ~unsound & (F.array_size(vector_name) > 0))
    return kept.withColumn("x", F.transform(vector, scaled))


def _matrices(batches: Iterator[pa.RecordBatch], name: str = "x") -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(batch, dims, the rows of that length, their vectors as a matrix)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        for dims in np.unique(lengths):
            rows = np.flatnonzero(lengths == dims)
            for at in range(0, len(rows), BLOCK):
                some = rows[at:at + BLOCK]
                yield batch, int(dims), some, flat[offsets[some][:, None] + np.arange(dims)]


def _exact(numbers: np.ndarray, factor: int = 1) -> np.ndarray:
    """The numbers, as Python integers if a product with the factor could pass 62 bits."""
    largest = max(abs(int(numbers.max())), abs(int(numbers.min())), 1) if numbers.size else 1
    return numbers if largest * factor < 2**62 else numbers.astype(object)


def products(centred: np.ndarray) -> np.ndarray:
    """centred' centred without any rounding."""
    largest = max(abs(int(centred.max())), abs(int(centred.min())), 1)
    if largest * largest * len(centred) < 2**53:
        return (centred.astype(float).T @ centred.astype(float)).astype(np.int64)
    wide = centred.astype(object)
    return wide.T @ wide


def _limbs(numbers: np.ndarray) -> list[pa.Array]:
    if numbers.dtype != object:
        parts = [numbers >> min(k * LIMB_BITS, 63) if k == LIMBS - 1 else numbers >> min(k * LIMB_BITS, 63) & (1 << LIMB_BITS) - 1 for k in range(LIMBS)]
        return [pa.array(part, pa.int64()) for part in parts]
    parts = [[v >> k * LIMB_BITS if k == LIMBS - 1 else v >> k * LIMB_BITS & (1 << LIMB_BITS) - 1 for v in numbers.tolist()] for k in range(LIMBS)]
    return [pa.array(part, pa.int64()) for part in parts]


def _whole(row) -> int:
    return sum(int(row[f"l{k}"]) << k * LIMB_BITS for k in range(LIMBS))


_SUMS = "dims int, i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))


def _sums(frame: DataFrame, run) -> dict[int, dict[tuple[int, int], int]]:
    """{dims: {(i, j): exact sum}} of what run gives for each matrix: a matrix (i, j) of integers for a length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for _, dims, _, x in _matrices(batches):
            found = run(dims, x)
            # Python integers where the sum could pass 62 bits.
            held[dims] = _exact(held[dims], 2) + _exact(found, 2) if dims in held else found
        for dims, total in held.items():
            i, j = (k.ravel() for k in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dims), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              *_limbs(total.ravel())], names=["dims", "i", "j", *(f"l{k}" for k in range(LIMBS))])

    out: dict[int, dict[tuple[int, int], int]] = {}
    parts = frame.select("x").mapInArrow(task, _SUMS).groupBy("dims", "i", "j")
    for row in parts.agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).toLocalIterator():
        out.setdefault(row["dims"], {})[row["i"], row["j"]] = _whole(row)
    return out


def _extended(numerator: int, denominator: int) -> np.longdouble:
    """The quotient to the digits of two doubles, which extended precision keeps."""
    high = numerator / denominator
    a, b = high.as_integer_ratio()
    return np.longdouble(high) + np.longdouble((numerator * b - a * denominator) / (denominator * b))


def _clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Runs, in rising order, of eigenvalues each within `close` of the next."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order]) > close) + 1)


def refine(matrix: np.ndarray, vectors: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix to the precision of its type, from approximate vectors."""
    x = vectors.astype(matrix.dtype)
    unit = np.eye(len(matrix), dtype=matrix.dtype)
    size, before = np.sqrt((matrix * matrix).sum()), np.inf
    for _ in range(steps):
        r = unit - x.T @ x
        s = x.T @ matrix @ x
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        close = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + size * np.sqrt((r * r).sum()))
        # Below the second bound, rounding alone would turn vectors by more than the square root of the precision.
        close = max(close, size * np.sqrt(np.finfo(matrix.dtype).eps))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        e = r / 2 + np.where(apart, (s + (values[None, :] + values[:, None]) / 2 * r) / np.where(apart, gap, 1), 0)
        x = x + x @ e
        # A cluster is a problem of its own; the shift by its mean keeps the digits in which its values differ.
        for some in _clusters(values, close):
            if len(some) > 1:
                own, middle = x[:, some], values[some].mean()
                inner = own.T @ (matrix @ own - middle * own)
                inner = ((inner + inner.T) / 2).astype(float)
                if np.abs(inner - np.diag(np.diag(inner))).max() > 1e-17 * float(size):
                    x[:, some] = own @ np.linalg.eigh(inner)[1].astype(matrix.dtype)
        change = float(np.abs(e).max())
        if np.abs(r).max() < 1e-18 and change > before / 2:
            break
        before = change
    values = (x * (matrix @ x)).sum(axis=0) / (x * x).sum(axis=0)
    return values, x / np.sqrt((x * x).sum(axis=0))


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, refined from a float32 solution."""
    scale = np.abs(matrix).max()
    if not scale:
        return np.zeros(len(matrix), matrix.dtype), np.eye(len(matrix), dtype=matrix.dtype)
    scaled = matrix / scale
    values, vectors = refine(scaled, np.linalg.eigh(scaled.astype(np.float32))[1])
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order] * scale, vectors[:, order]
    # Either sign is an eigenvector; the largest entry is made positive.
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(matrix))] < 0, -1, 1)


@dataclass
class Space:
    """What was learnt of the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def sound(self) -> np.ndarray:
        """Components that have variance beyond rounding."""
        return self.values > max(float(self.values.max(initial=0.0)), 0.0) * len(self.sums) * 1e-17

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        return _exact(x, 2 * self.n) * self.n - np.array(self.sums, object if self.n * (max(map(abs, self.sums)) + 1) >= 2**62 else np.int64)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        """The projections over their standard deviations; NaN for a component without variance."""
        sound = self.sound()
        weights = np.where(sound, self.vectors / np.sqrt(np.where(sound, self.values, 1)), np.nan)
        # Each row on its own, so that equal vectors have equal results in any block.
        return np.einsum("ij,jk->ik", (deviations / self.n).astype(float), weights.astype(float), optimize=False)

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]


def _space(n: int, sums: list[int], centre: list[int], moments: dict[tuple[int, int], int], components: int) -> Space:
    dims = len(sums)
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    matrix = np.zeros((dims, dims), np.longdouble)
    for (i, j), total in moments.items():
        matrix[i, j] = _extended(n * total - left[i] * left[j], n * n)
    values, vectors = eigen(matrix)
    count = min(components, dims)
    return Space(n, sums, np.maximum(values[:count], 0), vectors[:, :count], float(np.trace(matrix)))


def _identity_errors(fit_list: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """The largest entry of covariance minus identity, from one more pass over the fit list."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for _, dims, _, x in _matrices(batches):
            z = np.nan_to_num(spaces[dims].whiten(spaces[dims].deviations(x)))
            held[dims] = held.get(dims, 0) + np.vstack([z.sum(axis=0), z.T @ z])
        for dims, total in held.items():
            i, j = (k.ravel() for k in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dims), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array(total.ravel())], names=["dims", "i", "j", "total"])

    found = fit_list.select("x").mapInArrow(task, "dims int, i int, j int, total double").groupBy("dims", "i", "j").agg(F.sum("total").alias("total"))
    totals: dict[int, np.ndarray] = {dims: np.zeros((len(s.values) + 1, len(s.values))) for dims, s in spaces.items()}
    for row in found.toLocalIterator():
        totals[row["dims"]][row["i"], row["j"]] = row["total"]
    errors = {}
    for dims, total in totals.items():
        space = spaces[dims]
        mean, sound = total[0] / space.n, space.sound()
        error = np.abs(total[1:] / space.n - np.outer(mean, mean) - np.eye(len(mean)))[np.ix_(sound, sound)]
        errors[dims] = float(error.max(initial=0.0))
    return errors


def fit(rows: DataFrame, vector_name: str = "embedding", components: int = COMPONENTS) -> dict[int, Space]:
    """The space of each vector length, fitted on the distinct integer vectors."""
    small_batches(rows.sparkSession)
    fit_list = pin(integer_vectors(rows, vector_name).select("x").distinct(), "fit-list")
    counts = {r["dims"]: r["n"] for r in fit_list.groupBy(F.array_size("x").alias("dims")).agg(F.count("*").alias("n")).toLocalIterator()}
    first = _sums(fit_list, lambda dims, x: _exact(x, len(x)).sum(axis=0)[None, :])
    sums = {dims: [first[dims][0, k] for k in range(dims)] for dims in counts}
    centres = {dims: [(2 * s + counts[dims]) // (2 * counts[dims]) for s in sums[dims]] for dims in counts}

    def centred(dims: int, x: np.ndarray) -> np.ndarray:
        return products(_exact(x, 2) - np.array(centres[dims], np.int64))

    moments = _sums(fit_list, centred)
    spaces = {dims: _space(n, sums[dims], centres[dims], moments[dims], components) for dims, n in counts.items()}
    for dims, error in _identity_errors(fit_list, spaces).items():
        spaces[dims].identity_error = error
    return spaces


def whiten(rows: DataFrame, spaces: dict[int, Space], vector_name: str = "embedding") -> DataFrame:
    """All columns of the sound rows, and `whitened` (array), `deviation_text`, `space` (dims). Columns of these names, and x, are replaced."""
    small_batches(rows.sparkSession)
    held = integer_vectors(rows.drop("whitened", "deviation_text", "space"), vector_name)
    schema = T.StructType([*held.drop("x").schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())),
                           T.StructField("deviation_text", T.StringType()), T.StructField("space", T.IntegerType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, dims, some, x in _matrices(batches):
            space = spaces[dims]
            away = space.deviations(x)
            squares = (_exact(away, dims * max(1, int(np.abs(away).max()))) ** 2).sum(axis=1)
            z = space.whiten(away)
            flat = pa.array(z.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat)
            taken = batch.drop_columns(["x"]).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*taken.columns, lists, pa.array(list(map(str, squares.tolist())), pa.string()),
                                              pa.array(np.full(len(some), dims), pa.int32())], names=schema.names)

    return held.mapInArrow(task, schema)


def components(whitened: DataFrame, spaces: dict[int, Space], id_name: str = "vec_id") -> DataFrame:
    """One row for each row and component, with what is known of its space."""
    rows = whitened.select(F.col(id_name), "whitened", "deviation_text", "space")
    if not spaces:
        rows = rows.select(id_name, "deviation_text", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("identity_error"),
                           F.posexplode("whitened").alias("at", "whitened"), F.lit(None).cast("double").alias("explained"))
    else:
        table = lambda value: F.create_map(*(F.lit(k) for dims, s in spaces.items() for k in (dims, value(s))))
        n, error = table(lambda s: s.n)[F.col("space")], table(lambda s: s.identity_error)[F.col("space")]
        shares = F.create_map(*(c for dims, s in spaces.items() for c in (F.lit(dims), F.array(*(F.lit(v).cast("double") for v in s.explained())))))
        rows = rows.select(id_name, "deviation_text", n.cast("long").alias("n"), error.alias("identity_error"), F.col("space"),
                           F.posexplode("whitened").alias("at", "whitened")).withColumn("explained", shares[F.col("space")][F.col("at")])
    return rows.select(id_name, (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation_text as long)").alias("deviation"),
                       "whitened", "explained", "identity_error", "deviation_text")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    spaces = fit(rows)
    return components(whiten(rows, spaces), spaces)
