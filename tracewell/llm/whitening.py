"""Whitening of embeddings from exact integer statistics.

Each entry c becomes the integer x = floor(SCALE * c) + OFFSET. The fit list holds each distinct x vector once. A task
takes its part of the list in slices, subtracts each dimension's least x of the slice, and packs bit b of every row's
shifted x into 64-bit words: a plane. The cross-product of two dimensions is the sum over pairs of their planes of 2**(b + c) times the number
of ones in the AND of the planes, an exact integer; shifts are taken back as integers too. Sums of the tasks meet
in one aggregate of dim * dim decimal numbers a task. Only those sums reach the driver, whose size depends on the dimension alone (at most
``MOST_ENTRIES`` of them). The covariance is centred as integers, n * sum(xy) - sum(x) * sum(y), and only then divided.

Vectors that are null or hold null or non-finite entries are dropped. Vectors of another length are a table of their
own, with a fit, components and an error of its own. A row with a null id is returned with it. Rows that repeat an id are rows each. Extra columns are ignored.
An empty vector has no component and gives no row. A component whose eigenvalue is zero but for rounding (fewer
distinct vectors than dimensions, a dimension that never changes) cannot be scaled: whitened is null there, and identity_error leaves it out (0 if nothing is left).
An entry whose x has more than 62 bits, and a deviation beyond a long, raise an error. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows and bytes of x that are sliced into planes together, sums that the driver takes at most (one length of up to 4,095).
ROWS, BYTES, MOST_ENTRIES = 1 << 15, 16 << 20, 1 << 24
#: Eigenvalues below this share of the largest, times the dimension, are rounding.
NOTHING = 1e-13
LARGEST = 1 << 62


def entries(vector: Column, scale: int, offset: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long"))


def usable(df: DataFrame, key: str, vector: str, scale: int, offset: int) -> DataFrame:
    """(id, x, dim): the rows that take part, as integers."""
    v = F.col(vector)
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, number))
    fits = F.forall(v, lambda c: F.abs(c.cast("double") * F.lit(float(scale))) < float(LARGEST - abs(offset)))
    x = F.when(fits, entries(v, scale, offset)).otherwise(F.raise_error(F.lit("an entry is too large to be an integer of 62 bits")).cast("array<bigint>"))
    return kept.select(F.col(key).alias("id"), x.alias("x"), F.size(v).alias("dim"))


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bit planes of a matrix (rows, dims) of non-negative integers: words (planes, words), each plane's dimension and weight."""
    n, dims = shifted.shape
    words, of, weight = [], [], []
    for d in range(dims):
        x = shifted[:, d]
        for b in range(int(x.max()).bit_length()):
            bits = np.packbits((x >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
            words.append(np.pad(bits, (0, -len(bits) % 8)).view(np.uint64))
            of.append(d)
            weight.append(b)
    return np.array(words, np.uint64).reshape(len(words), -(-n // 64)), np.array(of, int), np.array(weight, int)


def scatter(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Sums and cross-products of the columns of integers x, as Python's whole numbers: (dims, and dims * dims by rows)."""
    n, dims = x.shape
    low = x.min(axis=0)
    words, of, weight = planes((x - low).astype(np.uint64))
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    sums, cross = [0] * dims, np.zeros((dims, dims), object)
    for d, b, c in zip(of.tolist(), weight.tolist(), ones.tolist()):
        sums[d] += c << b
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    for p in range(len(of)):
        # Ones that this plane shares with every plane from its own dimension on.
        start = first[np.searchsorted(of[first], of[p])]
        shared = np.bitwise_count(words[start:] & words[p]).sum(axis=1, dtype=np.int64)
        # A slice has 2**15 rows at most: with weights below 2**46 the sum over a dimension's planes has less than 63 bits.
        small = weight[start:] + weight[p] < 46
        part = np.bincount(of[start:][small], np.zeros(small.sum()), dims).astype(np.int64)
        np.add.at(part, of[start:][small], shared[small] << (weight[start:][small] + weight[p]))
        cross[of[p]] += part.astype(object)
        for d, b, c in zip(of[start:][~small].tolist(), weight[start:][~small].tolist(), shared[~small].tolist()):
            cross[of[p], d] += c << (b + int(weight[p]))
    upper = np.triu(cross)
    cross = upper + np.triu(cross, 1).T
    base = [int(v) for v in low]
    total = [s + n * a for s, a in zip(sums, base)]
    plain = np.array(base, object)
    moved = np.array(sums, object)
    whole = cross + np.outer(moved, plain) + np.outer(plain, moved) + n * np.outer(plain, plain)
    return total, whole.ravel().tolist()


def matrix(batch, dim: int) -> np.ndarray:
    column = batch.column("x")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def slice_rows(dim: int) -> int:
    return max(64, min(ROWS, BYTES // (8 * dim)))


def by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Batches' rows by length of vector, a slice at a time."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
        for dim in np.unique(dims).tolist():
            held.setdefault(dim, []).append(batch.filter(pa.array(dims == dim)))
            if sum(b.num_rows for b in held[dim]) >= slice_rows(dim):
                yield from slices(dim, held.pop(dim))
    for dim, rest in held.items():
        yield from slices(dim, rest)


def slices(dim: int, batches: list[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    whole, most = pa.Table.from_batches(batches), slice_rows(dim)
    for at in range(0, whole.num_rows, most):
        yield dim, whole.slice(at, most)


def statistics(fit: DataFrame) -> dict[int, tuple[int, list[int], list[int]]]:
    """For each length: n, the sums and the cross-products of the fit list."""

    def run(batches):
        sums: dict[int, list] = {}
        for dim, part in by_dim(batches):
            got = [part.num_rows, *(v for half in scatter(matrix(part, dim)) for v in half)]
            sums[dim] = [a + b for a, b in zip(sums[dim], got)] if dim in sums else got
        for dim, values in sums.items():
            for at in range(0, len(values), 1 << 16):
                some = values[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(some), pa.int32()), pa.array(np.arange(at, at + len(some))), pa.array([str(v) for v in some])], names=["dim", "place", "value"])
        release()

    parts = fit.mapInArrow(run, "dim int, place long, value string")
    added = parts.groupBy("dim", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    entries_ = fit.select("dim").distinct().agg(F.sum(F.col("dim").cast("long") * (F.col("dim") + 1) + 1)).first()[0] or 0
    if entries_ > MOST_ENTRIES:
        raise ValueError(f"{entries_} sums are more than the {MOST_ENTRIES} that the driver takes")
    found: dict[int, dict[int, int]] = {}
    for dim, place, value in added.collect():
        found.setdefault(dim, {})[place] = int(value)
    return {dim: (v[0], [v[1 + i] for i in range(dim)], [v[1 + dim + i] for i in range(dim * dim)]) for dim, v in found.items()}


class Fit:
    """What one length's statistics say: components by falling eigenvalue, and how to project on them."""

    def __init__(self, n: int, sums: list[int], cross: list[int], most: int):
        dim = len(sums)
        s = np.array(sums, object)
        centred = n * np.array(cross, object).reshape(dim, dim) - np.outer(s, s)  # n**2 times the covariance, exact
        covariance = np.array([[v / (n * n) for v in row] for row in centred.tolist()], float)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:most]
        values, self.vectors = np.maximum(values[order], 0), vectors[:, order]
        trace = sum(centred[i, i] for i in range(dim)) / (n * n)
        self.n, self.sums = n, sums
        self.explained = values / trace if trace else np.zeros(len(order))
        self.live = values > NOTHING * dim * max(values[0], 0) if len(values) else np.zeros(0, bool)
        self.scale = np.where(self.live, 1 / np.sqrt(np.where(self.live, values, 1)), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole parts are taken off as integers, so that no digit of a small difference is lost."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors * self.scale

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n * x - S) ** 2, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        off = x - whole
        most = max(int(np.abs(off).max(initial=0)), 1) * self.n + self.n
        if most * most * x.shape[1] < 1 << 63:
            d = off * self.n - np.array(rest, np.int64)
            return (d * d).sum(axis=1)
        d = off.astype(object) * self.n - np.array(rest, object)
        out = (d * d).sum(axis=1)
        if max(out, default=0) >= 1 << 63:
            raise OverflowError("a deviation is beyond a long")
        return out.astype(np.int64)


def identity_error(fit: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """For each length, the largest entry of the whitened fit list's covariance less the identity, from its rows."""
    shared = fit.sparkSession.sparkContext.broadcast(fits)  # a matrix of a dimension and 16 for each length

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for dim, part in by_dim(batches):
            mine = shared.value[dim]
            w = mine.whitened(matrix(part, dim))[:, mine.live]
            w = np.c_[w, np.ones(len(w))]
            sums[dim] = sums.get(dim, 0) + w.T @ w
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * s.size, pa.int32()), pa.array(np.arange(s.size)), pa.array(s.ravel())], names=["dim", "place", "value"])
        release()

    added: dict[int, np.ndarray] = {}
    for dim, place, value in fit.mapInArrow(run, "dim int, place long, value double").groupBy("dim", "place").agg(F.sum("value")).collect():
        k = int(fits[dim].live.sum()) + 1
        added.setdefault(dim, np.zeros((k, k)))[divmod(place, k)] = value
    out = {}
    for dim, s in added.items():
        mean, n = s[-1, :-1] / s[-1, -1], s[-1, -1]
        out[dim] = float(np.abs(s[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))
    return out


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET, components: int = COMPONENTS) -> DataFrame:
    """(id, x, n, deviation, whitened: array of components, explained, identity_error): a row for each usable row of df."""
    rows = usable(df, key, vector, scale, offset)
    fit = written(rows.select("x", "dim").distinct())
    fits = {dim: Fit(*values, components) for dim, values in statistics(fit).items()}
    shared = df.sparkSession.sparkContext.broadcast((fits, identity_error(fit, fits)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        found, error = shared.value
        for dim, part in by_dim(batches):
            mine, x = found[dim], matrix(part, dim)
            w = mine.whitened(x)
            lists = lambda m: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel(), from_pandas=True))
            values = [part.column("id"), part.column("x"), pa.array(np.full(len(x), mine.n)), pa.array(mine.deviation(x)), lists(w), lists(np.broadcast_to(mine.explained, w.shape)), pa.array(np.full(len(x), error[dim]))]
            yield from pa.table(values, names=["id", "x", "n", "deviation", "whitened", "explained", "identity_error"]).to_batches()
        release()

    return rows.mapInArrow(run, f"id {kind}, x array<bigint>, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first 16 components, a row for each."""
    done = whiten(table(spark, sf_dir, "embeddings"))
    each = done.select(F.col("id").alias("vec_id"), "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "_c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("_c.whitened").alias("whitened"), F.col("_c.explained").alias("explained"), "identity_error")
