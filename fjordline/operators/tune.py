"""Variant grids, champion choice and stability of tuned models."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAMILIES = {"logreg": "LogReg", "hgb": "HGB", "rf": "RF", "xgb": "XGB", "lgb": "LGBM", "lgbm": "LGBM"}


def _all_variants() -> list[tuple[str, str, dict[str, float]]]:
    out = [("LogReg", f"LogReg C={c}", {"C": c}) for c in (0.25, 1.0, 4.0)]
    out += [("HGB", f"HGB md={d} mi={i} lr={r}", {"md": d, "mi": i, "lr": r}) for d, i, r in product((4, 7), (100, 160), (0.06, 0.1))]
    out += [("RF", f"RF md={d} n={n}", {"md": d, "n": n}) for d, n in product((8, 12), (120, 200))]
    out += [(f, f"{f} md={d} n={n} lr={r}", {"md": d, "n": n, "lr": r}) for f, d, n, r in (("XGB", 4, 120, 0.08), ("XGB", 6, 160, 0.06), ("LGBM", 6, 160, 0.06), ("LGBM", 8, 200, 0.05))]
    return out


_FASTER = [("LogReg", "LogReg C=1.0", {"C": 1.0}), ("HGB", "HGB md=4 mi=80 lr=0.1", {"md": 4, "mi": 80, "lr": 0.1}), ("RF", "RF md=8 n=80", {"md": 8, "n": 80})]
#: Every variant's family and parameters by its name.
VARIANTS = {name: (family, values) for family, name, values in (*_all_variants(), *_FASTER)}


def names(family: str = "faster", strict: bool = True) -> list[str]:
    """The variants of a family, of ``fast`` (without the stand-ins for vendor boosters), ``faster`` (one of each of these) or ``all``. An unknown family is refused, or means all
    without ``strict``."""
    key, every = family.strip().lower(), _all_variants()
    if key == "faster":
        chosen = _FASTER
    elif key == "fast":
        chosen = [v for v in every if v[0] in ("LogReg", "HGB", "RF")]
    elif key in FAMILIES:
        chosen = [v for v in every if v[0] == FAMILIES[key]]
    elif key == "all" or not strict:
        chosen = every
    else:
        raise ValueError(f"unknown family {family!r}")
    return [name for _, name, _ in chosen]


def variants(spark: SparkSession, family: str = "faster", strict: bool = True) -> DataFrame:
    """(ordinal, family, name, params); the ordinal breaks ties."""
    rows = [(i, VARIANTS[n][0], n, {k: float(x) for k, x in VARIANTS[n][1].items()}) for i, n in enumerate(names(family, strict))]
    return spark.createDataFrame(rows, "ordinal int, family string, name string, params map<string,double>")


def combos(spark: SparkSession, **axes: list) -> DataFrame:
    """The product of small parameter lists, one column an axis."""
    rows = list(product(*axes.values()))
    kinds = ["int" if all(isinstance(x, int) for x in v) else "string" for v in axes.values()]
    return spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in zip(axes, kinds, strict=True)))


def best_variant(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Highest accuracy, first ordinal on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("acc"), "ordinal")
    return scores.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


#: Batches whose champions are found in one step of the fold over a run.
FOLD_BLOCK = 64


def champions(scores: DataFrame, sticky: bool = True, slack: float = 1e-15) -> DataFrame:
    """(run, batch, best, best_acc, champion): scores (run, batch, ordinal, variant, acc). A sticky champion keeps its place while it scores at least the batch's best less ``slack``."""
    best = best_variant(scores, ["run", "batch"]).select("run", "batch", F.col("variant").alias("best"), F.col("acc").alias("best_acc"))
    return carried(best, scores, sticky, slack)


def nested_champions(scores: DataFrame, sticky: bool = True, slack: float = 1e-15) -> DataFrame:
    """(run, batch, best, best_acc, champion) of a selection in two steps: scores (run, batch, ordinal, variant, val_acc, acc). Of each family the variant with the highest ``val_acc`` goes on, and
    of these the one with the highest ``acc`` is the best; the first ordinal wins ties. The champion holds on by ``acc``."""
    family = F.substring_index("variant", " ", 1)
    w = Window.partitionBy("run", "batch", "family").orderBy(F.desc_nulls_last("val_acc"), "ordinal")
    first = F.min("ordinal").over(Window.partitionBy("run", "batch", "family"))
    won = scores.withColumn("family", family).withColumns({"_k": F.row_number().over(w), "_f": first}).where("_k = 1")
    best = best_variant(won.drop("_k").withColumn("ordinal", F.col("_f")), ["run", "batch"])
    return carried(best.select("run", "batch", F.col("variant").alias("best"), F.col("acc").alias("best_acc")), scores, sticky, slack)


def carried(best: DataFrame, scores: DataFrame, sticky: bool, slack: float) -> DataFrame:
    """``best`` (run, batch, best, best_acc) with the champion of each batch. A batch turns each possible champion before it into one after it; these moves are composed over blocks of
    ``FOLD_BLOCK`` batches, a short fold over the blocks gives the champion each starts with, and each block is then filled in by itself."""
    if not sticky:
        return best.withColumn("champion", F.col("best"))
    accs = scores.groupBy("run", "batch").agg(F.map_from_entries(F.collect_list(F.struct("variant", "acc"))).alias("acc"))
    steps = best.join(accs, ["run", "batch"]).withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("batch")) - 1)
    rows = steps.groupBy("run", F.floor(F.col("k") / FOLD_BLOCK).alias("block")).agg(F.collect_list(F.struct("k", "batch", "best", "best_acc", "acc")).alias("a"))
    rows = rows.withColumn("a", F.expr("array_sort(a, (l, r) -> cast(l.k - r.k AS int))"))
    after = lambda h: f"if(coalesce(try_element_at(x.acc, {h}) >= x.best_acc - {slack!r}D, false), {h}, x.best)"
    names = rows.withColumn("names", F.expr("array_append(array_distinct(flatten(transform(a, x -> map_keys(x.acc)))), '')"))
    moves = names.select("run", "block", F.expr(f"map_from_arrays(names, transform(names, s -> aggregate(a, s, (h, x) -> {after('h')})))").alias("move"))
    chain = moves.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("block", F.map_entries("move").alias("move")))).alias("m"))
    went = "coalesce(try_element_at(map_from_entries(x.move), a.v), try_element_at(map_from_entries(x.move), ''))"
    fold = f"aggregate(m, struct('' AS v, cast(array() AS array<string>) AS h), (a, x) -> struct({went} AS v, array_append(a.h, a.v) AS h), a -> a.h)"
    starts = chain.select("run", F.posexplode(F.expr(fold)).alias("i", "start"))
    filled = rows.join(starts.withColumn("block", F.col("i").cast("long")), ["run", "block"])
    within = f"aggregate(a, struct(start AS v, cast(array() AS array<string>) AS h), (s, x) -> struct({after('s.v')} AS v, array_append(s.h, {after('s.v')}) AS h), s -> s.h)"
    out = filled.withColumn("c", F.expr(within)).select("run", F.posexplode("a").alias("i", "x"), "c")
    return out.select("run", "x.batch", "x.best", "x.best_acc", F.expr("get(c, i)").alias("champion"))


def stability(chosen: DataFrame) -> DataFrame:
    """(run, n_batches, same, rate): how often a batch keeps the champion of the batch before."""
    w = Window.partitionBy("run").orderBy("batch")
    df = chosen.withColumn("prev", F.lag("champion").over(w))
    df = df.groupBy("run").agg(F.count("*").alias("n_batches"), F.sum(F.coalesce((F.col("prev") == F.col("champion")).cast("long"), F.lit(0))).alias("same"))
    return df.withColumn("rate", F.when(F.col("n_batches") >= 2, F.col("same") / F.greatest(F.lit(1), F.col("n_batches") - 1)))


def variant_stability(chosen: DataFrame) -> DataFrame:
    """(run, variant, batches, pairs, retention): retention is null for a variant that never came before another batch."""
    w = Window.partitionBy("run").orderBy("batch")
    df = chosen.withColumn("next", F.lead("champion").over(w))
    df = df.groupBy("run", F.col("champion").alias("variant")).agg(
        F.count("*").alias("batches"), F.sum(F.coalesce((F.col("next") == F.col("champion")).cast("long"), F.lit(0))).alias("pairs"), F.count("next").alias("before")
    )
    return df.select("run", "variant", "batches", "pairs", F.when(F.col("before") > 0, F.col("pairs") / F.col("before")).alias("retention"))
