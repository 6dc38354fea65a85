"""Whitening of embedding vectors with a compensated covariance.

Three passes over the vectors: sums and their count; outer products of the centred vectors; the projections. Sums and products
are kept as pairs of doubles (high, low) made by error-free transformations: the sum of two doubles and its rounding error,
the product of two and its error. A task adds its rows up in blocks, pairwise, and yields one row of high and low parts;
those rows are merged in two steps of about the square root of their number each, so no group grows with the rows.
The covariance, rounded to double at the very end, goes through LAPACK's symmetric solver by tridiagonal reduction and
divide and conquer (`numpy.linalg.eigh`); it is as wide as a vector, whatever the number of rows.

Defined results: a row whose vector is null, empty or holds a null or non-finite entry is left out; so is, beyond that, a vector
whose length isn't the most frequent one (of equally frequent ones the larger). Repeated rows count repeatedly; null ids
are kept; a component without variance has null instead of whitened values; an empty table, or one without such
vectors, gives an empty result. Columns that have the name of a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import free_name, written

#: Rows that are added up at once; their products take 8 bytes a pair of dimensions each.
BLOCK = 64
PARTS = "part long, n long, high array<double>, low array<double>"
SPLIT = 134217729.0  # 2^27 + 1


def two_sum(a, b):
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """a * b and its rounding error, for factors below 2^996."""
    p = a * b
    ah, bh = SPLIT * a, SPLIT * b
    ah, bh = ah - (ah - a), bh - (bh - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(x, y):
    """Sum of two pairs (high, low)."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(high, low):
    """Sum over the first axis, in halves."""
    while len(high) > 1:
        k = len(high) // 2
        h, w = add((high[:k], low[:k]), (high[k : 2 * k], low[k : 2 * k]))
        high, low = (np.concatenate([h, high[2 * k :]]), np.concatenate([w, low[2 * k :]])) if len(high) % 2 else (h, w)
    return high[0], low[0]


def usable(vector: Column) -> Column:
    """A vector with entries, all finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def same_length(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The usable rows of the most frequent length, and that length (0: there are none)."""
    df = df.filter(usable(F.col(vector)))
    lengths = df.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d")).alias("most")).first()["most"]  # one row
    d = most["d"] if most else 0
    return df.filter(F.size(vector) == d), d


def _summed(df: DataFrame, vector: str, d: int, terms, wide: int):
    """(n, high, low): the compensated sum over all rows of what `terms` makes of a block of vectors."""

    def task(batches):
        n, acc = 0, (np.zeros(wide), np.zeros(wide))
        for batch in batches:
            column = batch.column(0)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            n += len(x)
            for k in range(0, len(x), BLOCK):
                acc = add(acc, total(*terms(x[k : k + BLOCK])))
        if n:
            yield _row(TaskContext.get().partitionId(), n, acc)

    parts = df.select(F.transform(vector, lambda x: x.cast("double")).alias("x")).mapInArrow(task, PARTS)
    parts = written(parts, "moment-parts")
    groups = max(1, int(parts.count() ** 0.5))

    def merge(rows: pa.Table) -> pa.Table:
        high, low = (np.stack(rows.column(c).to_numpy()) for c in ("high", "low"))
        return pa.Table.from_batches([_row(0, sum(rows.column("n").to_pylist()), total(high, low))])

    for key in (F.pmod("part", F.lit(groups)), F.col("part")):  # the merged rows have part 0
        parts = parts.groupBy(key).applyInArrow(merge, PARTS)
    found = parts.first()  # one row
    return (found["n"], np.array(found["high"]), np.array(found["low"])) if found else (0, np.zeros(wide), np.zeros(wide))


def _row(part: int, n: int, acc) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), *(pa.array([x], pa.list_(pa.float64())) for x in acc)], ["part", "n", "high", "low"])


def sums(df: DataFrame, vector: str, d: int):
    """(n, high, low) of the vectors themselves."""
    return _summed(df, vector, d, lambda x: (x, np.zeros_like(x)), d)


def _quotient(high, low, n: int):
    """(high, low) / n."""
    q = high / n
    p, e = two_product(q, float(n))
    return two_sum(q, ((high - p) - e + low) / n)


def covariance(df: DataFrame, vector: str, d: int):
    """(n, sums, mean and covariance as pairs), divisor n: products of centred entries."""
    n, high, low = sums(df, vector, d)
    if not n:
        return 0, (high, low), (high, low), (np.zeros((d, d)), np.zeros((d, d)))
    mean = _quotient(high, low, n)
    i, j = np.triu_indices(d)

    def outer(x):
        c, e = two_sum(x, -mean[0])
        c, e = two_sum(c, e - mean[1])
        p, f = two_product(c[:, i], c[:, j])
        return p, f + (c[:, i] * e[:, j] + e[:, i] * c[:, j])

    pairs = _quotient(*_summed(df, vector, d, outer, len(i))[1:], n)
    both = []
    for part in pairs:
        full = np.zeros((d, d))
        full[i, j] = full[j, i] = part
        both.append(full)
    return n, (high, low), mean, tuple(both)


@dataclass
class Whitening:
    """vectors: the usable rows; n, sums, mean, covariance of the fit; values fall, components are their rows."""

    column: str
    vectors: DataFrame
    n: int
    sums: list[int | float]
    mean: tuple[np.ndarray, np.ndarray]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        """Share of each component in the whole variance; without variance NaN."""
        with np.errstate(invalid="ignore"):
            return self.values / np.trace(self.covariance)

    def transform(self, column: str = "whitened", k: int | None = None) -> DataFrame:
        """The vectors' rows with an array of the first k whitened coordinates; null where a component has no variance."""
        k = len(self.values) if k is None else min(k, len(self.values))
        kept = self.values[:k] > self.values[:1] * len(self.values) * np.finfo(float).eps if k else np.zeros(0, bool)
        axes = self.components[:k] / np.sqrt(np.where(kept, self.values[:k], np.inf))[:, None]
        mean, d = self.mean, len(self.values)

        @F.arrow_udf("array<double>")
        def whiten(vectors: pa.Array) -> pa.Array:
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = ((x - mean[0]) - mean[1]) @ axes.T
            flat = pa.array(y.ravel(), mask=np.broadcast_to(~kept, y.shape).ravel())
            return pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, max(k, 1), dtype=np.int32)[: len(y) + 1]), flat)

        if not k:
            return self.vectors.limit(0).withColumn(column, F.array().cast("array<double>"))
        return self.vectors.withColumn(column, whiten(F.transform(self.column, lambda x: x.cast("double"))))


def fit(df: DataFrame, vector: str = "embedding") -> Whitening:
    """The whitening of all usable vectors of df."""
    df, d = same_length(df, vector)
    n, (high, low), mean, (v, _) = covariance(df, vector, d) if d else (0, (np.zeros(0),) * 2, (np.zeros(0),) * 2, (np.zeros((0, 0)),) * 2)
    values, vectors = np.linalg.eigh(v) if n else (np.zeros(0), np.zeros((0, 0)))
    whole = [int(h) + int(w) if h == np.rint(h) and w == np.rint(w) else float(h + w) for h, w in zip(high, low, strict=True)]
    return Whitening(vector, df, n, whole, mean, v, np.maximum(values[::-1], 0.0), vectors.T[::-1].copy())


def identity_error(whitened: DataFrame, column: str, k: int) -> float | None:
    """Largest absolute entry of the covariance of whitened coordinates minus the identity; null with no rows or with a component without variance."""
    usual = whitened.filter(usable(F.col(column)))
    n, _, _, (v, _) = covariance(usual, column, k) if k else (0, None, None, (None, None))
    return float(np.abs(v - np.eye(k)).max()) if n else None


#: Entries beyond this size, times 1024, would leave the exact range of longs and their squares.
LARGEST = 2.0**40


def grid(vector: Column) -> Column:
    """x = floor(1024 * c) + 100000 of every entry; null if an entry is too large for a long."""
    whole = F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) < LARGEST, F.floor(c.cast("double") * 1024) + 100_000))
    return F.when(F.forall(whole, lambda x: x.isNotNull()), whole)


def deviation(vector: Column, n: int, sums: list[int]) -> Column:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond a long."""
    parts = F.zip_with(vector, F.array(*[F.lit(int(s)).cast("long") for s in sums]), lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(n).cast("long")), s))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, y: F.try_add(a, F.try_multiply(y, y)))


def digests(df: DataFrame, vector: str = "embedding", k: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component up to k.
    Vectors with an entry of 2^40 or more are left out as not usable, since no long holds their deviation."""
    x = free_name(df.columns, "_x")
    rows = df.filter(usable(F.col(vector))).select("vec_id", grid(F.col(vector)).alias(x))
    fitted = fit(written(rows, "grid"), x)  # read four times
    k = min(k, len(fitted.values))
    made = fitted.transform("whitened", k).select("vec_id", deviation(F.col(x), fitted.n, fitted.sums).alias("deviation") if k else F.lit(0).cast("long").alias("deviation"), "whitened")
    made = written(made, "whitened")
    error = identity_error(made, "whitened", k)
    shares = F.array(*[F.lit(float(e)) if e == e else F.lit(None).cast("double") for e in fitted.explained[:k]]) if k else F.array().cast("array<double>")
    out = made.select("vec_id", "deviation", F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), shares.alias("e"))).alias("at", "both"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        F.col("both.w").alias("whitened"),
        F.col("both.e").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
