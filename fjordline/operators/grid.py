"""Variants of all families fitted in many small windows: tuned once a batch, deployed step by step.

Rows of a run (a key such as instrument, lead, target and basis) are dealt to chunks of forecasts with the history that these need, so that a row travels to a few chunks and not to
every window that holds it. A task reads its chunks in order and fits some dozens of windows at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import ship
from . import machines, trees
from .models import chance, components, logistic, prepare
from .moments import Cumulated
from .tune import VARIANTS

#: Windows that are fitted side by side.
SIDE_BY_SIDE = 32


@dataclass(frozen=True)
class BatchSpec:
    """Batches of ``size`` rows from row ``window`` on, whose first ``forecasts`` rows (all for None) are forecast; before each, variants are fitted on ``train`` rows and scored on the next
    ``validation`` and, after these, the next ``test`` rows; forecasts are fitted on at most the ``cap`` rows before them. ``purge`` rows just before a forecast, or a scored part, are left out of what it is fitted on (lead - 1 keeps labels that are not known yet out)."""

    train: int = 200
    test: int = 50
    size: int = 25
    cap: int = 1000
    purge: int = 0
    batches_a_chunk: int = 4
    validation: int = 0
    forecasts: int | None = None

    @property
    def window(self) -> int:
        return self.train + self.validation + self.test

    @property
    def ahead(self) -> int:
        return self.forecasts or self.size


def multinomial(x: np.ndarray, y: np.ndarray, classes: int, c: float | None = 1.0, rounds: int = 60) -> np.ndarray:
    """(1 + columns, classes) coefficients by Newton steps with the full block Hessian: ridge 0.5 |w|^2 + C sum(weight * loss) with balanced weights and free intercepts, or, with
    ``c`` None, the unweighted likelihood alone."""
    x = np.hstack([np.ones((len(x), 1)), x])
    n, m = x.shape
    of = np.bincount(y, minlength=classes)
    weight = np.ones(n) if c is None else c * n / (np.count_nonzero(of) * of[y])
    hit, w = np.eye(classes)[y], np.zeros((m, classes))
    keep = np.full((m, classes), 1e-9 if c is None else 1.0)
    keep[0] = 1e-9

    def loss(w: np.ndarray) -> float:
        z = x @ w
        z = z - z.max(1, keepdims=True)
        return float((weight * (np.log(np.exp(z).sum(1)) - z[np.arange(n), y])).sum() + 0.5 * (keep * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        p = softmax(x @ w)
        slope = x.T @ (weight[:, None] * (p - hit)) + keep * w
        hess = np.zeros((classes, m, classes, m))
        for a in range(classes):
            for b in range(a, classes):
                block = x.T @ (x * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None])
                hess[a, :, b, :] = hess[b, :, a, :] = block
        full = hess.reshape(classes * m, classes * m) + np.diag(keep.T.ravel())
        step = np.linalg.lstsq(full, slope.T.ravel(), rcond=None)[0].reshape(classes, m).T
        scale = 1.0
        while (after := loss(w - scale * step)) > now and scale > 1e-6:
            scale /= 2
        if after > now:
            break
        w, gain, now = w - scale * step, now - after, after
        if np.abs(scale * step).max() < 1e-9 or gain < 1e-12 or np.abs(w).max() > 1e3:
            break
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _linear(fits: list[trees.Fit], c: float) -> list[np.ndarray]:
    out = []
    for f in fits:
        classes = int(f.y.max()) + 1
        if classes == 2:
            p = chance(f.rest, logistic(f.x, f.y, c))
            out.append(np.stack([1 - p, p], 1))
        else:
            w = multinomial(f.x, f.y, classes, c)
            out.append(softmax(f.rest @ w[1:] + w[0]))
    return out


#: Learners by family: options from a variant's parameters.
FAMILIES: dict[str, Callable[[dict[str, float]], Callable[[list[trees.Fit]], list[np.ndarray]]]] = {
    "LogReg": lambda v: lambda fits: _linear(fits, v["C"]),
    "HGB": lambda v: lambda fits: trees.boosted(fits, trees.Boosting(int(v["mi"]), v["lr"], int(v["md"]))),
    "RF": lambda v: lambda fits: trees.bagged(fits, trees.Bagging(int(v["n"]), int(v["md"]))),
    "XGB": lambda v: lambda fits: trees.boosted(fits, trees.Boosting(int(v["n"]), v["lr"], int(v["md"]), leaves=1 << 30, least_rows=1, least_hess=1.0, ridge=1.0, rows=0.85, columns=0.85, balanced=False)),
    "LGBM": lambda v: lambda fits: trees.boosted(fits, trees.Boosting(int(v["n"]), v["lr"], int(v["md"]), growth="leaf", columns=0.85)),
}


def learner(variant: str) -> Callable[[list[trees.Fit]], list[np.ndarray]]:
    family, values = VARIANTS[variant]
    return FAMILIES[family](values)


def window_fit(sums: Cumulated, y: np.ndarray, a: int, b: int, rest: slice, k: int, seed: int) -> tuple[trees.Fit, np.ndarray] | None:
    """The rows a .. b - 1 as prepared columns (``k`` principal components, scaled again, or all columns for 0) with their classes as numbers from 0, and ``rest`` to predict; None with a
    single class. Means, scales and axes come from the running sums; rows with missing values are prepared one window at a time."""
    labels, own = np.unique(y[a:b], return_inverse=True)
    if len(labels) < 2:
        return None
    if sums.whole:
        u, v = sums.prepared(a, b, rest, k)
    else:
        u, v = components(sums.x[a:b], sums.x[rest], k)[:2] if k else prepare(sums.x[a:b], sums.x[rest])
    # rounded, so that the last digits of sums made in another order do not move a split
    return trees.Fit(u.round(9), own, v.round(9), seed), labels


def chunked(rows: DataFrame, spec: BatchSpec, history: int) -> DataFrame:
    """Rows with their number ``rn`` in a run of ``n``, dealt to chunks of ``batches_a_chunk`` complete batches with ``history`` rows before them; a column ``chunk`` is added."""
    last = F.floor((F.col("n") - spec.window - spec.ahead) / spec.size) + 1  # complete batches
    size = spec.size * spec.batches_a_chunk
    low = F.greatest(F.lit(0), F.floor((F.col("rn") - spec.window) / size))
    high = F.least(F.ceil(last / spec.batches_a_chunk) - 1, F.floor((F.col("rn") + history - spec.window) / size))
    df = rows.withColumns({"_lo": low.cast("long"), "_hi": high.cast("long")}).where((F.col("_lo") <= F.col("_hi")) & (last > 0))
    return df.withColumn("chunk", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def numbered(rows: DataFrame, keys: list[str], order: str = "dt") -> DataFrame:
    w = Window.partitionBy(*keys)
    return rows.withColumns({"rn": F.row_number().over(w.orderBy(order)).cast("long") - 1, "n": F.count("*").over(w)})


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of one key at a time from frames sorted by ``keys``."""
    held, last = [], None
    for frame in frames:
        for key, part in frame.groupby(keys, sort=False, dropna=False):
            if held and key != last:
                yield pd.concat(held)
                held = []
            held.append(part)
            last = key
    if held:
        yield pd.concat(held)


def _numbers(group: pd.DataFrame, features: list[str]) -> tuple[Cumulated, np.ndarray, np.ndarray, int]:
    return Cumulated(group[features].to_numpy(float)), group.y.to_numpy(int), group.rn.to_numpy(int), int(group.n.iloc[0])


def _starts(rn: np.ndarray, n: int, chunk: int, spec: BatchSpec) -> list[tuple[int, int]]:
    """(batch, its first row) of the complete batches of a chunk."""
    batches = range(chunk * spec.batches_a_chunk, (chunk + 1) * spec.batches_a_chunk)
    return [(b, t) for b in batches if (t := spec.window + b * spec.size) + spec.ahead <= n]


def _seed(group: pd.DataFrame, keys: list[str], *more: int) -> int:
    return zlib.crc32("|".join([*(str(group[k].iloc[0]) for k in keys), *map(str, more)]).encode())


def score_batches(rows: DataFrame, features: list[str], names: list[str], spec: BatchSpec, keys: list[str], k: int = 0) -> DataFrame:
    """(keys, batch, ordinal, variant, val_acc, acc): every variant of ``names`` fitted before each batch on ``train`` rows and scored on the ``validation`` (null without any) and on the ``test``
    rows. ``rows`` hold keys, dt, rn, n, y and features; windows with one class have no scores."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[tuple, trees.Fit, np.ndarray]] = []

        def scored() -> pd.DataFrame:
            out = []
            for i, name in enumerate(names):
                for (key, fit, y), p in zip(held, learner(name)([f for _, f, _ in held]), strict=True):
                    hit = p.argmax(1) == y
                    out.append((*key, i, name, float(hit[: spec.validation].mean()) if spec.validation else None, float(hit[spec.validation :].mean())))
            return pd.DataFrame(out, columns=[*keys, "batch", "ordinal", "variant", "val_acc", "acc"])

        for group in _groups(frames, [*keys, "chunk"]):
            x, y, rn, n = _numbers(group, features)
            for batch, t in _starts(rn, n, int(group.chunk.iloc[0]), spec):
                at = np.searchsorted(rn, t)
                a = at - spec.window
                mid = a + spec.train
                made = window_fit(x, y, a, mid - spec.purge, slice(mid, at), k, _seed(group, keys, batch))
                if made is None:
                    continue
                fit, labels = made
                own = np.searchsorted(labels, y[mid:at])
                own = np.where((own < len(labels)) & (labels[np.minimum(own, len(labels) - 1)] == y[mid:at]), own, -1)
                held.append(((*(group[c].iloc[0] for c in keys), batch), fit, own))
                if len(held) >= SIDE_BY_SIDE:
                    yield scored()
                    held = []
        if held:
            yield scored()

    return _mapped(chunked(rows, spec, spec.window), keys, features, work, "batch long, ordinal int, variant string, val_acc double, acc double")


def deploy_batches(rows: DataFrame, features: list[str], chosen: DataFrame, spec: BatchSpec, keys: list[str], k: int = 0) -> DataFrame:
    """(keys, batch, dt, variant, y, forward_r, labels, p, pred): each row of each batch forecast by the batch's variant (``chosen``: keys, batch, champion), refitted on the rows
    before it; ``p`` holds a probability for each of ``labels``. Rows whose history has one class get no forecast."""
    dealt = chunked(rows, spec, spec.cap)
    byname = chosen.groupBy(*keys, F.floor(F.col("batch") / spec.batches_a_chunk).cast("long").alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("batch").cast("long"), "champion"))).alias("champions"))
    heads = dealt.withColumn("_first", F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy("rn")) == 1)
    dealt = heads.join(byname, [*keys, "chunk"]).withColumn("champions", F.when(F.col("_first"), F.col("champions"))).drop("_first")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def made(name: str) -> pd.DataFrame:
            out = []
            for (key, labels), p in zip([h[:2] for h in held[name]], learner(name)([h[2] for h in held[name]]), strict=True):
                p = p[0, : len(labels)]
                out.append((*key, name, labels.tolist(), p.tolist(), int(labels[p.argmax()])))
            held[name] = []
            return pd.DataFrame(out, columns=[*keys, "batch", "dt", "y", "forward_r", "variant", "labels", "p", "pred"])

        for group in _groups(frames, [*keys, "chunk"]):
            x, y, rn, n = _numbers(group, features)
            names = dict(group.champions.dropna().iloc[0])
            dts, moves = group.dt.to_numpy(), group.forward_r.to_numpy(float)
            for batch, t in _starts(rn, n, int(group.chunk.iloc[0]), spec):
                if batch not in names:
                    continue
                name = names[batch]
                for step in range(t, t + spec.ahead):
                    at = int(np.searchsorted(rn, step))
                    end = at - spec.purge
                    a = max(0, at - spec.cap)
                    one = window_fit(x, y, a, end, slice(at, at + 1), k, _seed(group, keys, batch, step))
                    if one is None:
                        continue
                    held.setdefault(name, []).append((((*(group[c].iloc[0] for c in keys), batch, dts[at], int(y[at]), moves[at])), one[1], one[0]))
                    if len(held[name]) >= SIDE_BY_SIDE:
                        yield made(name)
        for name in [n for n, h in held.items() if h]:
            yield made(name)

    return _mapped(dealt, keys, features, work, "batch long, dt date, y int, forward_r double, variant string, labels array<int>, p array<double>, pred int", ["forward_r", "champions"])


#: Models that are fitted once a fold at their published sizes, by a name of their own: (training columns, classes, rows to predict) as a fit to probabilities.
MODELS: dict[str, Callable[[list[trees.Fit]], list[np.ndarray]]] = {
    "Forest": lambda fits: trees.bagged(fits, trees.Bagging(300, 12)),
    "Boosted": lambda fits: trees.boosted(fits, trees.Boosting(200, 0.1, 3, least_rows=1, least_hess=1e-12, leaves=1 << 30, balanced=False)),
    "Boosted bins": lambda fits: trees.boosted(fits, trees.Boosting(200, 0.1, 6)),
    "Boosted sampled": lambda fits: trees.boosted(fits, trees.Boosting(250, 0.06, 5, leaves=1 << 30, least_rows=1, least_hess=1.0, ridge=1.0, rows=0.85, columns=0.85, balanced=False)),
    "Boosted leafwise": lambda fits: trees.boosted(fits, trees.Boosting(300, 0.05, 62, growth="leaf", columns=0.85)),
    "Boosted symmetric": lambda fits: trees.boosted(fits, trees.Boosting(400, 0.06, 6, growth="symmetric", least_rows=1, least_hess=1e-12, ridge=3.0)),
    "Radial machine": machines.radial_machine,
    "Perceptron": machines.perceptron,
    "Logistic": lambda fits: _linear(fits, 1.0),
    "Multinomial": lambda fits: [_unpenalised(f) for f in fits],
}


def _unpenalised(f: trees.Fit) -> np.ndarray:
    w = multinomial(f.x, f.y, int(f.y.max()) + 1, None)
    return softmax(f.rest @ w[1:] + w[0])


def fit_classes(rows: DataFrame, features: list[str], names: list[str], keys: list[str], k: int = 0) -> DataFrame:
    """(keys, model, dt, y, forward_r, labels, p, pred, status) of the test rows of each group (is_test), two classes or more: every model of ``names`` is fitted on the group's training
    rows; ``p`` holds a probability for each of ``labels``. A group with one class or without test rows, and a fit that fails, give one row with the reason."""
    columns = [*keys, "model", "dt", "y", "forward_r", "labels", "p", "pred", "status"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, keys):
            key = tuple(group[c].iloc[0] for c in keys)
            test = group[group.is_test]
            train = group[~group.is_test]
            out, cut = [], len(train)
            both = pd.concat([train, test])
            made = window_fit(Cumulated(both[features].to_numpy(float)), both.y.to_numpy(int), 0, cut, slice(cut, None), k, _seed(group, keys)) if len(test) and cut else None
            for name in names:
                if made is None:
                    out.append((*key, name, None, None, None, None, None, None, "one class or no test rows"))
                    continue
                try:
                    p = MODELS[name]([made[0]])[0]
                except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
                    out.append((*key, name, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                labels = made[1].tolist()
                out += [(*key, name, d, int(t), float(r), labels, q, labels[int(np.argmax(q))], "ok") for d, t, r, q in zip(test.dt, test.y, test.forward_r, p.tolist(), strict=True)]
            frame = pd.DataFrame(out, columns=columns).astype(object)
            yield frame.where(frame.notna(), None)

    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = rows.select(*keys, "dt", "y", "forward_r", "is_test", *features).repartition(parts, *keys).sortWithinPartitions(*keys, "dt")
    return df.mapInPandas(work, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", model string, dt date, y int, forward_r double, labels array<int>, p array<double>, pred int, status string")


def of_classes(p: str, labels: str, classes: int) -> Column:
    """Probabilities of classes 0 .. ``classes`` - 1; a class that a fit has not seen has 0."""
    return F.expr(f"transform(sequence(0, {classes - 1}), c -> if(array_contains({labels}, c), get({p}, cast(array_position({labels}, c) - 1 AS int)), 0D))")


def forecast_newest(rows: DataFrame, features: list[str], keys: list[str], cap: int = 1000, k: int = 0) -> DataFrame:
    """(keys, labelled_through, n_train, labels, p, pred, status): each run's champion (column ``champion``) fitted on its last ``cap`` labelled rows before its newest row (column ``newest``),
    which it forecasts."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, keys):
            key = tuple(group[c].iloc[0] for c in keys)
            known, row = group[group.y.notna()].tail(cap), group[group.newest]
            status, made = "ok", None
            if len(known) < 80:
                status = f"too_few_labeled_rows:{len(known)}"
            elif group.champion.iloc[0] not in VARIANTS:
                status = f"chosen_variant_not_in_grid:{group.champion.iloc[0]}"
            elif not (made := window_fit(Cumulated(pd.concat([known, row])[features].to_numpy(float)), known.y.to_numpy(int), 0, len(known), slice(len(known), None), k, _seed(group, keys))):
                status = "training_labels_single_class"
            if made:
                p = learner(group.champion.iloc[0])([made[0]])[0][0]
                yield pd.DataFrame([(*key, known.dt.iloc[-1], len(known), made[1].tolist(), p.tolist(), int(made[1][p.argmax()]), status)], columns=[*keys, "labelled_through", "n_train", "labels", "p", "pred", "status"])
            else:
                yield pd.DataFrame([(*key, None, len(known), None, None, None, status)], columns=[*keys, "labelled_through", "n_train", "labels", "p", "pred", "status"])

    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = rows.select(*keys, "dt", "y", "newest", "champion", *features).repartition(parts, *keys).sortWithinPartitions(*keys, "dt")
    return df.mapInPandas(work, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", labelled_through date, n_train long, labels array<int>, p array<double>, pred int, status string")


def _mapped(dealt: DataFrame, keys: list[str], features: list[str], work, schema: str, more: list[str] | None = None) -> DataFrame:
    ship(dealt.sparkSession)
    kinds = dict(dealt.dtypes)
    df = dealt.select(*keys, "chunk", "dt", "rn", "n", "y", *(more or []), *features)
    # a fixed number of parts: fits cost time, not bytes, so small parts must not be put together
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(parts, *keys, "chunk").sortWithinPartitions(*keys, "chunk", "rn")
    return df.mapInPandas(work, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", " + schema)
