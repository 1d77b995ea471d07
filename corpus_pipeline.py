"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

1. quality rules: documents that fail the base rule or a learned rule go;
2. SimHash near-dedup: one document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays;
3. secret scans: secrets, also those under encodings, are replaced in the texts;
4. mixing: rows are put into the order of the Pfair schedule, so that reading the files in order gives the target weights;
5. pieces: sampled SentencePiece segmentations of the texts, with the check that decoding gives them back; ``mix_part`` and ``mix_row`` hold
   each row's place in the mixed order (file and row in it), which a scan doesn't keep.

Defined results: rows with null texts fail the base rule of the first stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordline import ship
from fjordline.llm import mixing, pieces, quality_rules, secrets, simhash
from fjordline.llm.work import read, written

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.without_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.ordered(docs)


def placed(docs: DataFrame) -> DataFrame:
    """``docs``, read from the files of a mixed table, with the number of its file and its row in that file (null for rows that come from no file)."""
    docs = docs.drop("mix_part", "mix_row")
    if not docs.inputFiles():
        return docs.withColumns({"mix_part": F.lit(None).cast("int"), "mix_row": F.lit(None).cast("long")})
    part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("int")
    return docs.select("*", part.alias("mix_part"), F.col("_metadata.row_index").alias("mix_row"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.encode(placed(docs))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mixture),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
