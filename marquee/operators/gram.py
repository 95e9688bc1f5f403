"""Linear models from one aggregate: the Gram matrix of [1, x, y], by fold if wanted.

Least squares, ridge and lasso need of the data only the sums of products of features and
target. ``grams`` adds them up in one pass for every fold; matrices of folds add and subtract, so
the training sums of a fold are the total less the fold, and any number of models is fitted
without another scan. Values are centred by overall means first, which keeps the digits.

The matrix has (features + 2) squared numbers and is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sums that one JVM aggregate adds at most; wider tables add numpy matrices instead
JVM_SUMS = 400
LINEAR_KINDS = ("linear", "ridge", "lasso")


@dataclass(frozen=True)
class Gram:
    """Sum of v v' over rows, v = [1, x - centre, y - centre]."""

    features: tuple[str, ...]
    centre: np.ndarray          # of the features and, last, of the target
    a: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.features, self.centre, self.a + other.a)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.features, self.centre, self.a - other.a)

    @property
    def n(self) -> float:
        return float(self.a[0, 0])

    def of(self, features: list[str]) -> Gram:
        """The matrix of some of the features."""
        i = [self.features.index(f) for f in features]
        keep = [0, *[k + 1 for k in i], len(self.features) + 1]
        return Gram(tuple(features), self.centre[[*i, len(self.features)]], self.a[np.ix_(keep, keep)])

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(X'X, X'y) around this matrix's own means, and those means."""
        shift = self.a[0, 1:] / self.n
        s = self.a[1:, 1:] - np.outer(shift, shift) * self.n
        return s[:-1, :-1], s[:-1, -1], self.centre + shift

    def mapped(self, weights: np.ndarray, intercepts: np.ndarray, names: list[str]) -> Gram:
        """The matrix of [1, z, y] for linear functions z = weights x + intercepts of the features."""
        p, q = len(self.features), len(names)
        t = np.zeros((q + 2, p + 2))
        t[0, 0] = t[-1, -1] = 1.0
        t[1:-1, 1:-1] = weights
        # z is centred like the target, whose scale it has
        t[1:-1, 0] = intercepts + weights @ self.centre[:-1] - self.centre[-1]
        return Gram(tuple(names), np.full(q + 1, self.centre[-1]), t @ self.a @ t.T)


@dataclass(frozen=True)
class LinearFit:
    """A fitted linear model; ``transform`` adds ``prediction`` as a plain column expression."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.weights)

    def value(self, columns: list[Column]) -> Column:
        out = F.lit(float(self.intercept))
        for w, c in zip(self.weights, columns):
            out = out + F.lit(float(w)) * c.cast("double")
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        if set(self.features) <= set(df.columns):
            columns = [F.col(f"`{f}`") for f in self.features]
        else:
            array = vector_to_array("features")
            columns = [array[i] for i in range(len(self.features))]
        return df.withColumn("prediction", self.value(columns))


def grams(df: DataFrame, features: list[str], target: str, fold: str | None = None) -> dict:
    """{fold: Gram} (key None without ``fold``), from one scan for means and one for sums.

    Rows with a null among the features and the target are left out; nulls of ``fold`` are a fold.
    """
    names = [*features, target]
    x = [F.col(f"`{c}`").cast("double") for c in names]
    there = x[0].isNotNull()
    for c in x[1:]:
        there = there & c.isNotNull()
    rows = df.where(there).select(*[c.alias(f"x{i}") for i, c in enumerate(x)], (F.col(fold) if fold else F.lit(None).cast("int")).alias("_fold"))
    p = len(names)
    centre = np.array([m or 0.0 for m in rows.agg(*[F.avg(f"x{i}") for i in range(p)]).first()])
    rows = rows.select("_fold", *[(F.col(f"x{i}") - F.lit(float(m))).alias(f"x{i}") for i, m in enumerate(centre)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    found: dict = {}
    if p + len(pairs) <= JVM_SUMS:
        sums = rows.groupBy("_fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)],
                                         *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs])
        for r in sums.collect():       # one row a fold
            a = np.zeros((p + 1, p + 1))
            a[0, 0] = r["n"]
            a[0, 1:] = a[1:, 0] = [r[f"s{i}"] for i in range(p)]
            for i, j in pairs:
                a[i + 1, j + 1] = a[j + 1, i + 1] = r[f"p{i}_{j}"]
            found[r["_fold"]] = a
    else:
        parts = rows.mapInArrow(_products(p), f"_fold {rows.schema['_fold'].dataType.simpleString()}, i int, j int, v double")
        for r in parts.groupBy("_fold", "i", "j").agg(F.sum("v").alias("v")).collect():     # a matrix a fold
            a = found.setdefault(r["_fold"], np.zeros((p + 1, p + 1)))
            a[r["i"], r["j"]] = a[r["j"], r["i"]] = r["v"]
    return {k: Gram(tuple(features), centre, a) for k, a in found.items()}


def _products(p: int):
    """Per partition and fold: the sum of v v' over its rows, upper half."""
    i, j = np.triu_indices(p + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = None
        for b in batches:
            kind = b.column(0).type
            fold = b.column(0).to_pylist()
            v = np.column_stack([np.ones(b.num_rows), *[c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]])
            for k in set(fold):
                mine = v[[f == k for f in fold]]
                sums[k] = sums.get(k, 0.0) + mine.T @ mine
        for k, a in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(i), kind), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(a[i, j])], ["_fold", "i", "j", "v"])
    return scan


def total(parts: dict) -> Gram:
    out = None
    for g in parts.values():
        out = g if out is None else out + g
    if out is None or out.n == 0:
        raise ValueError("no rows to fit")
    return out


def solve(g: Gram, kind: str, alpha: float = 1.0, sweeps: int = 100_000, tol: float = 1e-12) -> LinearFit:
    """Coefficients with an unpenalised intercept.

    linear: least squares (of least norm where features depend on each other);
    ridge: |y - Xw|^2 + alpha |w|^2; lasso: |y - Xw|^2 / 2n + alpha |w|_1, by cyclic
    coordinate descent on the matrix until no coefficient moves by more than ``tol`` of the
    largest step that its column allows.
    """
    s, c, means = g.centred()
    if kind == "linear":
        scale = np.sqrt(np.maximum(np.diag(s), 0.0))
        scale[scale == 0] = 1.0
        w = np.linalg.lstsq(s / np.outer(scale, scale), c / scale, rcond=1e-13)[0] / scale
    elif kind == "ridge":
        w = np.linalg.solve(s + alpha * np.eye(len(c)), c) if alpha > 0 else solve(g, "linear").coefficients.toArray()
    elif kind == "lasso":
        w, limit = np.zeros(len(c)), g.n * alpha
        size = np.diag(s).copy()
        reach = np.max(np.abs(c) / np.where(size > 0, size, np.inf), initial=0.0)
        for _ in range(sweeps):
            moved = 0.0
            for j in np.flatnonzero(size > 0):
                free = c[j] - s[j] @ w + size[j] * w[j]
                new = np.sign(free) * max(abs(free) - limit, 0.0) / size[j]
                moved = max(moved, abs(new - w[j]))
                w[j] = new
            if moved <= tol * reach:
                break
    else:
        raise ValueError(f"not a linear model: {kind}")
    return LinearFit(g.features, tuple(float(x) for x in w), float(means[-1] - w @ means[:-1]))
