"""Volatility features and sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import ratio
from .panel import by_instrument


#: Rows whose weights are taken relative to the first of them (``keep`` to this power must stay well above zero).
EWMA_BLOCK = 256


def pct_change(df: DataFrame, close: str = "close", into: str = "ret") -> DataFrame:
    return df.withColumn(into, (ratio(F.col(close), F.lag(close).over(by_instrument())) - 1) * 100)


def realized_vol(df: DataFrame, ret: str = "ret", rows: int = 20, least: int = 10, into: str = "vol") -> DataFrame:
    w = by_instrument().rowsBetween(1 - rows, 0)
    return df.withColumn(into, F.when(F.count(ret).over(w) >= least, F.stddev_samp(ret).over(w)))


def ewma_vol(df: DataFrame, ret: str = "ret", half_life: float = 60.0) -> DataFrame:
    """(instrument, dt, vol): sqrt of the exponentially weighted mean of squared returns, seeded with the first one. Blocks of ``EWMA_BLOCK`` rows are weighed each
    by itself; one number a block is carried to the next."""
    keep = 2 ** (-1 / half_life)
    rows = df.where(F.col(ret).isNotNull()).select("instrument", "dt", (F.col(ret) * F.col(ret)).alias("q")).withColumn("k", F.row_number().over(by_instrument()) - 1)
    rows = rows.withColumns({"block": F.floor(F.col("k") / EWMA_BLOCK), "at": F.col("k") % EWMA_BLOCK})
    scaled = F.when(F.col("k") == 0, F.col("q")).otherwise((1 - keep) * F.col("q")) * F.pow(F.lit(keep), -F.col("at"))
    w = Window.partitionBy("instrument", "block").orderBy("at")
    rows = rows.withColumn("own", F.sum(scaled).over(w.rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(keep), F.col("at")))
    ends = rows.groupBy("instrument", "block").agg(F.max_by("own", "at").alias("own"), F.count("*").alias("n"))
    ends = ends.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("block", "own", "n"))).alias("s"))
    carried = f"aggregate(s, struct(0D AS v, cast(array() AS array<double>) AS h), (a, x) -> struct(pow({keep!r}D, x.n) * a.v + x.own AS v, array_append(a.h, a.v) AS h), a -> a.h)"
    carry = ends.select("instrument", F.posexplode(F.expr(carried)).alias("block", "carry"))
    out = rows.join(carry, ["instrument", "block"])
    return out.select("instrument", "dt", F.sqrt(F.col("carry") * F.pow(F.lit(keep), F.col("at") + 1) + F.col("own")).alias("vol"))


def sequences(df: DataFrame, columns: list[str], length: int) -> DataFrame:
    """Append ``seq``, the last ``length`` rows of ``columns`` as array<array<double>>; rows with a shorter history go."""
    w = by_instrument().rowsBetween(1 - length, 0)
    df = df.withColumn("seq", F.collect_list(F.array(*(F.col(c).cast("double") for c in columns))).over(w))
    return df.where(F.size("seq") == length)


#: Largest persistence of a GARCH fit; rows that a recursion takes in one product; starting points that are followed to the end.
PERSISTENCE, STRIDE, FOLLOWED = 0.9995, 25, 3


def carried(u: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """x[0] = first, x[t] = u[t - 1] + b x[t - 1] for every column, one row more than ``u``: blocks of ``STRIDE`` rows are products with the powers of ``b``, one number a block is handed on."""
    rows, n = u.shape
    lag = np.arange(STRIDE)[:, None] - np.arange(STRIDE)[None]
    powers = np.where(lag[None] >= 0, b[:, None, None] ** np.maximum(lag, 0)[None], 0.0)
    blocks = np.vstack([u, np.zeros((-rows % STRIDE, n))]).reshape(-1, STRIDE, n)
    inner = np.einsum("nij,kjn->kin", powers, blocks, optimize=True)
    starts, last = np.empty((len(blocks), n)), b**STRIDE
    now = first
    for k in range(len(blocks)):
        starts[k] = now
        now = inner[k, -1] + last * now
    whole = inner + starts[:, None] * (b[None] ** np.arange(1, STRIDE + 1)[:, None])[None]
    return np.vstack([first[None], whole.reshape(-1, n)[:rows]])


def garch_likelihood(q: np.ndarray, own: np.ndarray, v: np.ndarray, omega: np.ndarray, a: np.ndarray, b: np.ndarray, slopes: bool = False):
    """Sum of log h + q / h of every column of squared returns (rows in time, ``own`` where a window has one, from the first row on) under h = omega + a q + b h from the variance ``v`` on,
    and the variances; with ``slopes`` also the score by (omega, a, b) and the sum of the outer products of its terms."""
    h = carried(omega + a * q, b, v)
    x = h[:-1]
    total = np.where(own, np.log(x) + q / x, 0.0).sum(0)
    if not slopes:
        return total, h
    term = np.where(own, (1 - q / x) / x, 0.0)
    d = np.stack([term * carried(w, b, np.zeros_like(v))[:-1] for w in (np.ones_like(q), q, x)])
    return total, h, d.sum(1), np.einsum("itn,jtn->ijn", d, d, optimize=True)


def fit_garch(q: np.ndarray, own: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameters omega, alpha, beta by row; next variance; sum of log h + q / h) of Gaussian GARCH(1, 1) models by quasi-likelihood, all windows (columns of squared returns) in each pass:
    steps along the score scaled by its outer products, halved until the likelihood grows, from the best of a few starting points."""
    n = q.shape[1]
    v = np.where(own, q, 0).sum(0) / own.sum(0)
    shapes = [(a, b) for a in (0.01, 0.05, 0.1, 0.25) for b in (0.05, 0.4, 0.7, 0.85, 0.94) if a + b < 0.995]
    starts = np.array([garch_likelihood(q, own, v, v * (1 - a - b), np.full(n, a), np.full(n, b))[0] for a, b in shapes])
    first = np.array(shapes)[np.argsort(starts, 0)[: FOLLOWED - 1]].reshape(-1, 2).T
    # one more point lies on the border where returns don't matter (alpha 0) and stays there
    border = (0.05, 0.4, 0.6, 0.8, 0.94, 0.98)
    least = np.argmin([garch_likelihood(q, own, v, v * (1 - b), np.zeros(n), np.full(n, b))[0] for b in border], 0)
    first = np.hstack([first, np.stack([np.full(n, 1e-9), np.array(border)[least]])])
    flat = np.arange(FOLLOWED * n) >= (FOLLOWED - 1) * n
    q, own, v = (np.tile(x, (1, FOLLOWED)) if x.ndim > 1 else np.tile(x, FOLLOWED) for x in (q, own, v))
    # free parameters: log omega, logits of the persistence (below its bound) and of alpha's share in it
    total = first.sum(0) / PERSISTENCE
    z = np.stack([np.log(v * (1 - first.sum(0))), np.log(total / (1 - total)), np.log(first[0] / first[1])])

    def real(z: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        s, p = 1 / (1 + np.exp(-np.clip(z[1:], -30, 30)))
        p = np.where(flat, 0.0, p)
        return np.exp(np.clip(z[0], -60, 60)), PERSISTENCE * s * p, PERSISTENCE * s * (1 - p), s, p

    now, quiet = garch_likelihood(q, own, v, *real(z, flat)[:3])[0], np.zeros(len(v), int)
    for _ in range(rounds):
        at = np.flatnonzero(quiet < 2)  # the windows that still gain
        if not len(at):
            break
        qa, oa, va, za, fa = q[:, at], own[:, at], v[at], z[:, at], flat[at]
        omega, a, b, s, p = real(za, fa)
        _, _, score, outer = garch_likelihood(qa, oa, va, omega, a, b, True)
        turn = np.zeros((3, 3, len(at)))  # slopes of (omega, a, b) by the free parameters
        turn[0, 0], turn[1, 1], turn[2, 1] = omega, a * (1 - s), b * (1 - s)
        turn[1, 2], turn[2, 2] = PERSISTENCE * s * p * (1 - p), -PERSISTENCE * s * p * (1 - p)
        g, o = np.einsum("irn,in->rn", turn, score), np.einsum("irn,ijn,jsn->nrs", turn, outer, turn)
        ridge = 1e-8 * np.maximum(np.trace(o, axis1=1, axis2=2), 1e-12)[:, None, None] * np.eye(3)
        step = np.clip(2 * np.linalg.solve(o + ridge, g.T[:, :, None])[:, :, 0].T, -3, 3)
        best, scale = now[at], np.ones(len(at))
        found = za.copy()
        for tries in range(10):
            left = np.flatnonzero(scale > 0)
            if not len(left):
                break
            tried = za[:, left] - scale[left] * step[:, left]
            after = garch_likelihood(qa[:, left], oa[:, left], va[left], *real(tried, fa[left])[:3])[0]
            ok = after < best[left]
            found[:, left[ok]], best[left[ok]] = tried[:, ok], after[ok]
            scale[left] = np.where(ok, 0.0, scale[left] / 3)
        gain = now[at] - best
        quiet[at] = np.where(gain < 1e-6, quiet[at] + np.where(gain > 0, 1, 2), 0)
        z[:, at], now[at] = found, best
    pick = now.reshape(FOLLOWED, n).argmin(0) * n + np.arange(n)
    omega, a, b = (x[pick] for x in real(z, flat)[:3])
    h = garch_likelihood(q[:, pick], own[:, pick], v[pick], omega, a, b)[1]
    return np.stack([omega, a, b], 1), h[own[:, pick].sum(0), np.arange(n)], now[pick]


def garch_vol(df: DataFrame, ret: str = "ret", first: int = 100, refit: int = 40, most: int = 500) -> DataFrame:
    """(instrument, dt, sigma): one-step forecast of a rolling GARCH(1, 1), held until the next refit. One series is one group; a series
    is one instrument's bars, and all its refits are fitted side by side."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt").reset_index(drop=True)
        r, out = pdf["r"].to_numpy(float), np.full(len(pdf), np.nan)
        ends = [i for i in range(first, len(r), refit) if r[max(0, i - most) : i].var() > 0]
        if ends:
            q, own = np.ones((most, len(ends))), np.zeros((most, len(ends)), bool)
            for k, i in enumerate(ends):
                past = r[max(0, i - most) : i]
                q[: len(past), k], own[: len(past), k] = past * past, True
            out[ends] = np.sqrt(fit_garch(q, own)[1])
        return pd.DataFrame({"instrument": pdf["instrument"], "dt": pdf["dt"], "sigma": pd.Series(out).ffill()}).dropna()

    return df.where(F.col(ret).isNotNull()).select("instrument", "dt", F.col(ret).alias("r")).groupBy("instrument").applyInPandas(work, "instrument string, dt date, sigma double")


def with_garch(panel: DataFrame, close: str = "close", realized: str = "feat_garch_realized_vol20_pct", sigma: str = "feat_garch_cond_sigma_pct") -> DataFrame:
    """Append realised volatility and the held GARCH forecast; before an instrument's first fit the forecast is null."""
    made = realized_vol(pct_change(panel, close, "_ret"), "_ret", into=realized)
    fitted = garch_vol(made, "_ret").withColumnRenamed("sigma", sigma)
    last = F.last(sigma, ignorenulls=True).over(by_instrument().rowsBetween(Window.unboundedPreceding, 0))
    return made.join(fitted, ["instrument", "dt"], "left").withColumn(sigma, last).drop("_ret")
