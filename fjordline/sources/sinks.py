"""Result tables and reports: parquet and csv tables, a sweep log that can be resumed, Markdown text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_ROW = (
    "model string, instrument string, lead int, target string, n_train int, n_test int, n_features int, "
    + ", ".join(f"{part}_{m} double" for part in ("train", "test") for m in ("accuracy", "balanced_accuracy", "roc_auc", "log_loss", "f1"))
    + ", extra map<string,string>"
)
SWEEP_ROW = "run string, instrument string, lead int, mode string, metric string, value double, best_model string, elapsed_sec double, error string, extra string"


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """One table a sheet; csv tables carry a header."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if kind == "csv" else writer.parquet)(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def append_runs(rows: DataFrame, path: str) -> None:
    """Add finished runs to the sweep table; ``select.unfinished`` then leaves them out of the next start."""
    rows.write.mode("append").parquet(path)


def extra_json(columns: list[str], most: int = 8000):
    """Further columns of a result row as JSON text of at most ``most`` characters: whole fields from the first on, as long as there is room."""
    fields = F.array(*(F.substring(F.to_json(F.struct(c)), 2, 1 << 30) for c in columns))
    parts = F.filter(F.transform(fields, lambda x: F.left(x, F.length(x) - 1)), lambda x: F.length(x) > 0)
    fits = F.aggregate(parts, F.lit(""), lambda a, x: F.when(F.length(a) + F.length(x) + 3 <= most, F.concat_ws(",", F.nullif(a, F.lit("")), x)).otherwise(a))
    return F.concat(F.lit("{"), fits, F.lit("}"))


def ascii_text(x):
    """Plain quotes and dashes, and ``?`` for what is outside Latin-1."""
    return F.regexp_replace(F.translate(x, "‘’“”–—", "''\"\"--"), "[^\\x00-\\xFF]", "?")


def number_text(x, digits: int = 3):
    return F.coalesce(F.format_number(x, digits), F.lit("NA"))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a table row of Markdown for each row of ``df``; written with ``.write.text``."""
    cells = [number_text(F.col(c)) if t in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c, t in df.select(*columns).dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_endorsed(rows: DataFrame, folder: str, header: dict[str, str]) -> None:
    """The endorsement document: one JSON object with the list under ``qualified``, and the same rows as csv without run and mode."""
    listed = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("qualified"))
    listed.select(*(F.lit(v).alias(k) for k, v in header.items()), "qualified").coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    rows.drop("run", "target_mode").write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
