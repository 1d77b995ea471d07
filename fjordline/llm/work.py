"""Shared-folder tables: where operators cut lineage so that a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship


_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a private folder serves a session on one machine; on a cluster it is an error, since
    executors would not share it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="fjordline-"))
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block are removed at its end, but for those written with ``keep``."""
    _scratch.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _scratch.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once into the shared folder and continue from the stored table."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def once(sql: str) -> Column:
    """``sql`` as a column that Catalyst computes once per row. The always true condition on the row number leaves the value
    as it is but makes the column non-deterministic, so that a filter on it isn't rewritten into (and doesn't repeat) the
    expression."""
    return F.when(F.monotonically_increasing_id() >= 0, F.expr(sql))
