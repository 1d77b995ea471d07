"""Out-of-sample protocols as row arithmetic: rows are exploded to fold ids, never range-joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class FoldSpec:
    """Half-open row windows of ``window`` rows, the last ``test`` of them for testing; ``purge`` training rows before the test part
    are left out (lead - 1 keeps labels that are not known yet out of training)."""

    window: int = 250
    train_share: float = 0.8
    step: int | None = None
    purge: int = 0

    def __post_init__(self):
        if self.window < 50 or self.test < 1 or self.train < 20:
            raise ValueError("a fold needs at least 50 rows, 20 of them for training and one for testing")

    @property
    def test(self) -> int:
        return round(self.window * (1 - self.train_share))

    @property
    def train(self) -> int:
        return self.window - self.test

    @property
    def stride(self) -> int:
        return self.step or self.test


def holdout(df: DataFrame, n: str = "n", rn: str = "rn") -> DataFrame:
    """Append is_test: the second half by row number."""
    return df.withColumn("is_test", F.col(rn) >= F.floor(F.col(n) / 2))


def holdout_as_fold(df: DataFrame, n: str = "n", rn: str = "rn") -> DataFrame:
    """The hold-out as fold 0, in the form of walk-forward rows."""
    return holdout(df, n, rn).withColumn("fold", F.lit(0).cast("long"))


def with_size(df: DataFrame, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    return df.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))


def walk_forward(df: DataFrame, spec: FoldSpec, rn: str = "rn", n: str = "n") -> DataFrame:
    """Each row once for every fold it belongs to, with fold and is_test; purged rows are left out."""
    folds = F.floor((F.col(n) - spec.window) / spec.stride) + 1
    low = F.greatest(F.lit(0), F.ceil((F.col(rn) - spec.window + 1) / spec.stride)).cast("long")
    high = F.least(folds - 1, F.floor(F.col(rn) / spec.stride)).cast("long")
    df = df.where(F.col(n) >= spec.window).withColumns({"_lo": low, "_hi": high}).where("_lo <= _hi")
    df = df.withColumn("fold", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    at = F.col(rn) - F.col("fold") * spec.stride
    df = df.withColumn("is_test", at >= spec.train)
    return df.where(F.col("is_test") | (at < spec.train - spec.purge)) if spec.purge else df


def origin_pools(df: DataFrame, history: int, start: int, step: int) -> DataFrame:
    """(instrument, origin, n_pool, first_dt, last_dt): rows [origin - history, origin) for each origin, as a window frame."""
    w = Window.partitionBy("instrument").orderBy("rn").rowsBetween(-history, -1)
    df = df.withColumns({"n_pool": F.count("*").over(w), "first_dt": F.min("dt").over(w), "last_dt": F.max("dt").over(w)})
    return df.where((F.col("rn") >= start) & ((F.col("rn") - start) % step == 0)).select("instrument", F.col("rn").alias("origin"), "n_pool", "first_dt", "last_dt")


@dataclass(frozen=True)
class InnerSplit:
    """Sizes of the inner train / validation / test parts of a tuning window."""

    window: int
    test_share: float
    train_share: float = 0.8

    @property
    def test(self) -> int:
        return min(max(5, round(self.window * self.test_share)), self.window - 20)

    @property
    def train(self) -> int:
        return max(10, min(round((self.window - self.test) * self.train_share), self.window - self.test - 5))

    @property
    def validation(self) -> int:
        return self.window - self.test - self.train
