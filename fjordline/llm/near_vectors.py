"""Near-duplicate embeddings by counting collisions of sorted one-dimensional projections.

A unit vector is rotated, halved, and each half projected on a few random directions; every sum of one projection from each half is itself a
random one-dimensional projection, so a few thousand inner products give a million projections. A vector enters those projections where it
lies in a far tail, which are found from the sorted halves without visiting the rest. Within a projection two vectors collide if they
fall into one window, centred on the query, of 2.7 standard deviations of the difference that a pair at the threshold has. The collisions of
each pair are counted over all projections, and pairs that reach a count calibrated on random pairs exactly at the threshold are verified
by their cosine in double precision.

Real embeddings share a mean direction, which would put a share of all vectors into the same tails. So projections are taken of what is left after the mean is subtracted, as far as it can
be without bringing vectors closer than ``LEFT`` (squared) to the origin, and scaled to unit length; distances keep their order, and the pairs to calibrate on go through the same steps.

The tail is set so that a projection holds about ``WINDOW`` vectors whatever the table's size, and the number of projections so that a pair at the
threshold collides about ``EXPECTED`` times; both follow the row count, so chance collisions stay proportional to the rows.

Equal vectors are compared once and counted with their multiplicity; vectors of each length are compared among themselves, one length after the other. Defined results: vectors that are
null, empty, zero, hold null or non-finite components or have a null id link with nothing (component: their own id); repeated rows count as
other vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .work import written

WINDOW, EXPECTED, ROTATIONS, RECALL = 8, 20, 24, 0.998
PAIRS_TRIED, SEED = 1500, 20240607
#: Least squared length that the share ``1 - SHORT`` of vectors keep when the mean is subtracted.
LEFT, SHORT = 0.35, 0.05


class Projections:
    """The shared random directions; a pure function of its arguments, so every task makes the same."""

    def __init__(self, rows: int, width: int, cosine: float, rotations: int = ROTATIONS):
        normal = NormalDist()
        self.tail = min(0.02, WINDOW / max(rows, 1))
        self.cut = normal.inv_cdf(1 - self.tail)
        self.window = 2.7 * math.sqrt(2 * (1 - cosine))
        x = np.linspace(self.cut, self.cut + 6, 2000)
        over = np.array([1 - normal.cdf((self.cut - cosine * v) / math.sqrt(max(1e-12, 1 - cosine * cosine))) for v in x])
        both = float((np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * over).sum() * (x[1] - x[0]))
        self.m = max(2, math.ceil(math.sqrt(EXPECTED / (2 * both) / rotations)))
        rng = np.random.default_rng(SEED)
        half = (width + 1) // 2
        self.parts = []
        for _ in range(rotations):
            turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
            self.parts.append((turn[:, :half] @ rng.standard_normal((half, self.m)), turn[:, half:] @ rng.standard_normal((width - half, self.m))))

    def tails(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, projection, value) of each row's far tails; the lower tail is a projection of its own, with its values negated."""
        rows, names, values = [], [], []
        for r, (a, b) in enumerate(self.parts):
            for side in (1, -1):
                x, y = side * (unit @ a), side * (unit @ b)
                by_x, by_y = np.argsort(-x, 1), np.argsort(-y, 1)
                x, y = np.take_along_axis(x, by_x, 1), np.take_along_axis(y, by_y, 1)
                live = np.arange(len(unit))
                for i in range(self.m):
                    live = live[x[live, i] + y[live, 0] >= self.cut]
                    if not len(live):
                        break
                    total = x[live, i, None] + y[live]
                    depth = int((total >= self.cut).sum(1).max())
                    row, j = np.nonzero(total[:, :depth] >= self.cut)
                    own = live[row]
                    rows.append(own)
                    names.append(((r * 2 + (side < 0)) * self.m + by_x[own, i]) * self.m + by_y[own, j])
                    values.append(total[row, j])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(rows), np.concatenate(names), np.concatenate(values)

    def least_count(self, sample: np.ndarray, shift: np.ndarray, cosine: float, recall: float = RECALL) -> int:
        """The largest count that a share ``recall`` of pairs at exactly the threshold reaches: vectors of ``sample`` (unit length) with partners in random directions."""
        x, rng = np.resize(sample, (PAIRS_TRIED, sample.shape[1])), np.random.default_rng(SEED + 1)
        y = rng.standard_normal(x.shape)
        y -= (x * y).sum(1)[:, None] * x
        y *= math.sqrt(max(0.0, 1 - cosine * cosine)) / np.maximum(np.linalg.norm(y, axis=1), 1e-30)[:, None]
        y += cosine * x
        count = np.zeros(PAIRS_TRIED, np.int64)
        spread = 1 << 40
        rx, nx, vx = self.tails(_scaled(x - shift))
        ry, ny, vy = self.tails(_scaled(y - shift))
        kx, ky = rx * spread + nx, ry * spread + ny
        _, i, j = np.intersect1d(kx, ky, return_indices=True)
        near = np.abs(vx[i] - vy[j]) <= self.window
        np.add.at(count, rx[i][near], 1)
        return max(1, int(np.quantile(count, 1 - recall, method="lower")))


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]


def _unit(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    # by the largest component first, so that neither very long nor very short vectors leave the range of squares
    return _scaled(x / np.abs(x).max(1)[:, None])


def mean_shift(classes: DataFrame, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(what is subtracted from unit vectors, a bounded sample of them): the mean, or as much of it as ``LEFT`` allows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            total += _unit(b.column(0), width).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["i", "x"])

    mean = np.zeros(width)
    for r in classes.select("v").mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # one row a dimension
        mean[r["i"]] = r["x"] / rows
    near = classes.orderBy(F.xxhash64("cid"), "cid").limit(PAIRS_TRIED).select("v").collect()
    sample = np.array([r["v"] for r in near], float)
    sample = _scaled(sample / np.abs(sample).max(1)[:, None])
    for part in np.linspace(1, 0, 21):
        left = ((sample - part * mean) ** 2).sum(1)
        if np.quantile(left, SHORT) >= LEFT:
            break
    return part * mean, sample


def valid(vector: str = "embedding") -> str:
    v = f"`{vector}`"
    return f"coalesce(size({v}) > 0 AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({v}, x -> x <> 0), false)"


def links(classes: DataFrame, rows: int, width: int, cosine: float) -> DataFrame:
    """(a, b), a < b: the verified pairs of ``classes`` (cid, v)."""
    shift, sample = mean_shift(classes, rows, width)
    # the least cosine that a pair at the threshold has after the shift, but for the shortest vectors
    least_left = float(np.quantile(((sample - shift) ** 2).sum(1), SHORT))
    apart = 1 - (1 - cosine) / min(1.0, least_left)
    shape = Projections(rows, width, apart)
    least = shape.least_count(sample, shift, cosine)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Projections(rows, width, apart)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                row, name, value = own.tails(_scaled(_unit(b.column(1), width) - shift))
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[row]), pa.array(name), pa.array(value)], names=["cid", "projection", "value"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dot = np.einsum("ij,ij->i", _unit(b.column(2), width), _unit(b.column(3), width))
            near = pa.array(dot >= cosine)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["a", "b"])

    tails = written(classes.select("cid", "v").mapInArrow(enter, "cid long, projection long, value double"), "tails")
    x = tails.select(F.col("cid").alias("a"), "projection", F.col("value").alias("va"))
    y = tails.select(F.col("cid").alias("b"), F.col("projection").alias("p"), F.col("value").alias("vb"))
    window = (F.col("projection") == F.col("p")) & (F.col("a") < F.col("b")) & (F.abs(F.col("va") - F.col("vb")) <= shape.window)
    pairs = x.join(y, window).groupBy("a", "b").count().where(F.col("count") >= least).select("a", "b")
    one = classes.select(F.col("cid").alias("a"), F.col("v").alias("va"))
    two = classes.select(F.col("cid").alias("b"), F.col("v").alias("vb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long")


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``table``."""
    base = table.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    base = base.withColumn("ok", F.expr(valid("v")) & F.col("id").isNotNull())
    classes = written(base.where("ok").groupBy("v").agg(F.min("id").alias("cid"), F.count("*").alias("n")), "vectors")
    widths = classes.groupBy(F.size("v").alias("w")).count().orderBy("w").collect()  # one row a length
    if not widths:
        return base.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = [links(classes.where(F.size("v") == r["w"]), r["count"], r["w"], cosine) for r in widths]
    found = written(functools.reduce(DataFrame.union, found), "links")
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("cid").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    out = classes.join(others, F.col("cid") == F.col("a"), "left").join(components(found), F.col("cid") == F.col("node"), "left")
    out = out.select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("component_id"))
    linked = base.where("ok").join(out, "v").select("id", "n_links", "component_id")
    rest = base.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.union(rest)
    return every.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
