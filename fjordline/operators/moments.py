"""Moments of windows from running sums.

Sums of every column and of every product of two are carried along a run once; the count, means, covariances and with them the scale, principal components and normal equations of
any window are the difference of two of its rows. No row is copied to the windows that hold it, so the work is rows plus windows, not rows times windows.

Columns are shifted by their mean over the run first, so that the differences keep their digits. Null values are left to the preparation by rows (``models.prepare``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .. import ship
from .folds import FoldSpec


def _pairs(columns: list[str]) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(len(columns)), 2))


def running_sums(rows: DataFrame, columns: list[str], keys: list[str], rn: str = "rn") -> DataFrame:
    """(keys, rn, shift, s, q): sums over the rows up to ``rn`` of each shifted column (``s``) and of each product of two (``q``, pairs in order), and the shifts."""
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    df = rows.select(*keys, rn, *(F.avg(c).over(whole).alias(f"_m{i}") for i, c in enumerate(columns)), *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)))
    df = df.withColumns({f"_c{i}": F.col(f"_c{i}") - F.col(f"_m{i}") for i in range(len(columns))})
    sums = F.array(*(F.sum(f"_c{i}").over(w) for i in range(len(columns))))
    products = F.array(*(F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")).over(w) for i, j in _pairs(columns)))
    return df.select(*keys, F.col(rn).cast("long").alias("rn"), F.array(*(f"_m{i}" for i in range(len(columns)))).alias("shift"), sums.alias("s"), products.alias("q"))


def training_windows(rows: DataFrame, spec: FoldSpec, keys: list[str]) -> DataFrame:
    """(keys, fold, start, stop): the training rows start .. stop - 1 of every walk-forward fold of a run, purged ones left out."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= spec.window)
    df = n.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - spec.window) / spec.stride))))
    return df.select(*keys, "fold", (F.col("fold") * spec.stride).alias("start"), (F.col("fold") * spec.stride + spec.train - spec.purge).alias("stop"))


def window_moments(sums: DataFrame, windows: DataFrame, keys: list[str], also: tuple[str, ...] = ("fold",)) -> DataFrame:
    """(keys, also, n, mean, cov): means and population covariances (pairs in order) of the rows start .. stop - 1 of each of ``windows``; two equi-joins on row numbers."""
    last = sums.select(*keys, (F.col("rn") + 1).alias("stop"), "shift", F.col("s").alias("s1"), F.col("q").alias("q1"))
    first = sums.select(*keys, (F.col("rn") + 1).alias("start"), F.col("s").alias("s0"), F.col("q").alias("q0"))
    df = windows.join(last, [*keys, "stop"]).join(first, [*keys, "start"], "left").withColumn("n", F.col("stop") - F.col("start"))
    part = lambda a, b: F.expr(f"if({b} IS NULL, {a}, zip_with({a}, {b}, (x, y) -> x - y))")
    df = df.withColumns({"_s": F.transform(part("s1", "s0"), lambda x: x / F.col("n")), "_q": F.transform(part("q1", "q0"), lambda x: x / F.col("n"))})
    outer = "flatten(transform(_s, (x, i) -> transform(slice(_s, i + 1, size(_s)), y -> x * y)))"
    return df.select(*keys, *also, "n", F.zip_with("_s", "shift", lambda x, y: x + y).alias("mean"), F.zip_with("_q", F.expr(outer), lambda x, y: x - y).alias("cov"))


def principal(cov: np.ndarray, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scale, eigenvalues, axes by row) of standardised columns; a ``constant`` column keeps scale 1. The largest entry of an axis is positive."""
    sd = np.sqrt(np.where(constant, 1.0, np.maximum(np.diag(cov), 1e-300)))
    corr = np.where(constant[:, None] | constant[None], 0.0, cov / np.outer(sd, sd))
    values, axes = np.linalg.eigh(corr)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1].T
    return sd, values, axes * np.sign(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1))


def _square(cov, m: int) -> np.ndarray:
    out = np.zeros((m, m))
    out[np.triu_indices(m)] = cov
    return out + np.triu(out, 1).T


def components(moments: DataFrame, share: float = 0.95) -> DataFrame:
    """Append ``k``, the number of principal components that keep ``share`` of the variance, ``kept``, the share each of all components keeps, and ``axes``: from the covariances of a window
    alone, one small matrix a window."""

    ship(moments.sparkSession)

    # a map over whole rows: where means and covariances are used for nothing else, Spark puts their lambda functions into the arguments of a scalar UDF and then can't extract it
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, kept, shown = [], [], []
            for m, c in zip(b.column("mean").to_pylist(), b.column("cov").to_pylist(), strict=True):
                full = _square(c, len(m))
                _, values, axes = principal(full, np.diag(full) <= 1e-18)
                part = values / max(values.sum(), 1e-300)
                k.append(int(np.searchsorted(np.cumsum(part), share - 1e-12)) + 1)
                kept.append(part.tolist())
                shown.append(axes.tolist())
            one = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int32()), pa.array(kept, one), pa.array(shown, pa.list_(one))], names=[*b.schema.names, "k", "kept", "axes"])

    schema = StructType([*moments.schema.fields, *StructType.fromDDL("k int, kept array<double>, axes array<array<double>>").fields])
    return moments.mapInArrow(found, schema)


class Cumulated:
    """Running sums of an array of rows, for windows inside a task."""

    def __init__(self, x: np.ndarray):
        self.x, self.whole = x, bool(np.isfinite(x).all())
        self.shift = x.mean(0) if self.whole and len(x) else np.zeros(x.shape[1])
        z = x - self.shift
        zero = np.zeros((1, x.shape[1]))
        self.s = np.vstack([zero, np.cumsum(z, 0)])
        self.q = np.concatenate([zero[:, :, None] * zero[:, None, :], np.cumsum(z[:, :, None] * z[:, None, :], 0)])

    def prepared(self, a: int, b: int, rest: slice, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows a .. b - 1 and ``rest`` as ``models.prepare`` (``k`` 0) or ``models.components`` make them, from the sums."""
        n = b - a
        mean = (self.s[b] - self.s[a]) / n
        cov = (self.q[b] - self.q[a]) / n - np.outer(mean, mean)
        own = self.x[a:b]
        low = np.diag(cov) <= 1e-9 * np.maximum(self.q[-1].diagonal() / len(self.x), 1e-300)
        constant = low & (own.max(0) == own.min(0))
        if (low & ~constant).any():  # too little variance for differences of sums
            mean, cov = own.mean(0) - self.shift, np.cov(own, rowvar=False, bias=True).reshape(own.shape[1], -1)
        sd, values, axes = principal(cov, constant)
        turn = lambda x: (x - self.shift - mean) / sd
        if not k:
            return turn(own), turn(self.x[rest])
        k = max(1, min(k, own.shape[1], max(1, n - 2)))
        scale = np.sqrt(values[:k])
        to = axes[:k].T / np.where(scale > 1e-9, scale, 1.0)
        return turn(own) @ to, turn(self.x[rest]) @ to
