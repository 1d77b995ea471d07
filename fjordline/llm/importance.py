"""Resampling towards a target distribution by hashed word runs.

Each document's runs of one to ``runs`` consecutive words are hashed into buckets. A bucket's gain compares its share in a target collection with that in all documents; a
document's weight is the floored mean of the gains over its runs, and weight plus reproducible Gumbel noise is its score. The highest scores are drawn.

Long texts are skewed work, so a text of more than ``CHUNK`` bytes is cut at word boundaries into overlapping chunks: each owns the runs that start in it and carries the ``runs`` - 1
words after it. Chunks are dealt over all tasks and their counts and weights summed by document. Shorter texts are weighed where they are read and aren't shuffled.

Ranks need no order over all rows in one task: scores are counted, cumulated in blocks of 256 scores and over the blocks, and rows are numbered within one score. The noise is
spread so widely that no score holds more than about 0.04 % of all distinct ids, whatever their weights.

Defined results: a null text counts as empty and has weight 0; a null id counts as the empty string for the noise and comes first in ties; rows repeated under one id with the same weight
are ranked one after the other; an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .work import scratch, written

BUCKETS, CHUNK = 10_000, 1 << 16
#: Bytes of texts that are hashed at a time.
PIECE = 1 << 22
#: Words up to this many bytes are hashed side by side, longer ones one by one.
SIDE_BY_SIDE = 48

_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 0x20, _BYTE).astype(np.uint8)
_IN_WORD = (_BYTE >= 0x80) | (_BYTE >= 0x30) & (_BYTE <= 0x39) | (_BYTE >= 0x61) & (_BYTE <= 0x7A) | (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: crc32 of each single byte without the inversion before and after.
_STEP = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)


def _fed(crc: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each crc32 continued over the bytes ``starts`` .. ``starts + sizes`` of ``raw``."""
    order = np.argsort(-np.minimum(sizes, SIDE_BY_SIDE + 1), kind="stable")
    state, at, left = ~crc[order], starts[order], sizes[order]
    first = int(np.searchsorted(-left, -SIDE_BY_SIDE))
    for i in range(first):
        state[i] = ~np.uint32(zlib.crc32(raw[at[i] : at[i] + left[i]].tobytes(), int(~state[i])))
    done, falling = 0, -left[first:]
    while n := int(np.searchsorted(falling, -done)):
        part = slice(first, first + n)
        state[part] = _STEP[(state[part] ^ raw[at[part] + done]) & np.uint32(255)] ^ (state[part] >> np.uint32(8))
        done += 1
    out = np.empty_like(state)
    out[order] = ~state
    return out


def run_buckets(raw: np.ndarray, bounds: np.ndarray, owned: np.ndarray, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every run that starts in the first ``owned`` bytes of its text, and how many words start there; text i is ``raw[bounds[i] : bounds[i + 1]]``,
    and the byte before each bound must be no part of a word."""
    raw = _LOWER[raw]
    inside = np.concatenate([[False], _IN_WORD[raw], [False]])
    starts, ends = np.nonzero(inside[1:] & ~inside[:-1])[0], np.nonzero(inside[:-1] & ~inside[1:])[0]
    text = np.searchsorted(bounds, starts, "right") - 1
    mine = starts - bounds[text] < owned[text]
    crc, rows, found = np.zeros(len(starts), np.uint32), [], []
    for k in range(runs):
        n = len(starts) - k
        if n <= 0:
            break
        crc = crc[:n]
        if k:
            crc = ~(_STEP[(~crc ^ np.uint32(0x20)) & np.uint32(255)] ^ (~crc >> np.uint32(8)))
        crc = _fed(crc, raw, starts[k:], (ends - starts)[k:])
        ok = mine[:n] & (text[:n] == text[k:])
        rows.append(text[:n][ok])
        found.append(crc[ok].astype(np.int64) % buckets)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *found]), np.bincount(text[mine], minlength=len(owned))


def pieces_of(text: bytes, size: int, runs: int) -> Iterator[tuple[bytes, int]]:
    """(chunk, owned bytes): chunks of about ``size`` bytes that end between words, with the ``runs`` - 1 words after them."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + size)
        stop = end = gap.end() if gap else len(text)
        for _, word in zip(range(runs - 1), _WORD.finditer(text, stop), strict=False):
            end = word.end()
        yield text[start:end], stop - start
        start = stop


def _chunked(docs: DataFrame, size: int, runs: int) -> DataFrame:
    """(id, mark, no, chunk, owned) of the long texts, dealt over all tasks; ``mark`` is a digest of the whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for no, (chunk, owned) in enumerate(pieces_of(b.column(2)[i].as_py().encode(), size, runs)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([no]), pa.array([chunk], pa.binary()), pa.array([owned])], names=["id", "mark", "no", "chunk", "owned"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", F.md5("text").alias("mark"), "text").mapInArrow(work, f"id {kind}, mark string, no long, chunk binary, owned long").repartition("mark", "no")


def _blocks(chunks: pa.Array, owned: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds, owned bytes) of a column of texts, a few MB at a time; a zero byte ends each text."""
    held, first, size = [], 0, 0

    def block(stop: int):
        sizes = np.array([len(t) for t in held], np.int64)
        return first, np.frombuffer(b"\0".join([*held, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes + 1)]), sizes if owned is None else owned[first:stop]

    for i, x in enumerate(chunks):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= PIECE:
            yield block(i + 1)
            held, first, size = [], i + 1, 0
    if held:
        yield block(len(chunks))


def bucket_counts(short: DataFrame, long: DataFrame, runs: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts and chunks, summed in each task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, raw, bounds, owned in _blocks(b.column(0), b.column(1).to_numpy() if b.num_columns > 1 else None):
                total += np.bincount(run_buckets(raw, bounds, owned, runs, buckets)[1], minlength=buckets)
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    own = short.select(F.col("text").cast("binary")).mapInArrow(work, "bucket long, n long")
    return own.union(long.select("chunk", "owned").mapInArrow(work, "bucket long, n long")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets; ``buckets`` bounds what is collected."""
    s, t = (dict(map(tuple, x.collect())) for x in (source, target))
    big_s, big_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(i, 0) + 1) * big_s / ((s.get(i, 0) + 1) * big_t))) for i in range(buckets)]


def _weighed(rows: DataFrame, gain: list[int], runs: int) -> DataFrame:
    """(the columns before the text, n_features, n_words, total): of each row (.., text as binary[, owned])."""
    keys = [c for c in rows.columns if c not in ("chunk", "owned")]
    table = np.array(gain, np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owned = b.column("owned").to_numpy() if "owned" in b.schema.names else None
            for first, raw, bounds, own in _blocks(b.column("chunk"), owned):
                row, bucket, words = run_buckets(raw, bounds, own, runs, len(table))
                n, total = np.bincount(row, minlength=len(own)), np.zeros(len(own), np.int64)
                np.add.at(total, row, table[bucket])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(first, len(own)) for k in keys), pa.array(n), pa.array(words), pa.array(total)], names=[*keys, "n_features", "n_words", "total"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(work, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_features long, n_words long, total long")


def _halves(docs: DataFrame, key: str, text: str, size: int, runs: int) -> tuple[DataFrame, DataFrame]:
    """Short texts as they are, and the written chunks of the long ones."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.where(F.octet_length("text") <= size), written(_chunked(rows.where(F.octet_length("text") > size), size, runs), "chunks")


def weigh(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", runs: int = 1, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """(id, n_features, n_words, weight, copies): equal outcomes under one id are one row."""
    short, long = _halves(docs, key, text, size, runs)
    other = _halves(target, target_key, text, size, runs)
    gain = gains(bucket_counts(short, long, runs, buckets), bucket_counts(*other, runs, buckets), buckets)
    whole = _weighed(short.select("id", F.col("text").cast("binary").alias("chunk")), gain, runs).withColumn("copies", F.lit(1).cast("long"))
    parts = _weighed(long, gain, runs).groupBy("id", "mark").agg(F.sum("n_features").alias("n"), F.sum("n_words").alias("w"), F.sum("total").alias("total"), F.sum((F.col("no") == 0).cast("long")).alias("copies"))
    parts = parts.selectExpr("id", "n div copies AS n_features", "w div copies AS n_words", "total div copies AS total", "copies")
    every = whole.unionByName(parts).withColumn("weight", F.expr("if(n_features = 0, 0L, (total - pmod(total, n_features)) div n_features)"))
    return every.groupBy("id", "n_features", "n_words", "weight").agg(F.sum("copies").alias("copies"))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", runs: int = 1, buckets: int = BUCKETS,
    seed: int = 2024, least_words: int = 20, percent: int = 10, size: int = CHUNK,
) -> DataFrame:
    """(key, n_features, weight, score, rank), one row for each row of ``docs``: of the N rows with at least ``least_words`` words the floor(percent * N / 100) highest scores
    have ranks from 1 on, ties by the smaller key; the others have none."""
    with scratch(docs.sparkSession):
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
        scored = weigh(docs, target, key, text, target_key, runs, buckets, size).withColumn("score", (F.col("weight") + noise).cast("long"))
        scored = written(scored.withColumn("fit", F.col("n_words") >= least_words), "scored", keep=True)
        counted = written(scored.where("fit").groupBy("score").agg(F.sum("copies").alias("c")).withColumn("block", F.shiftright("score", 8)), "scores")
        most = percent * (counted.agg(F.sum("c")).first()[0] or 0) // 100
        down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for every 256 scores
        blocks = counted.groupBy("block").agg(F.sum("c").alias("c")).select("block", F.coalesce(F.sum("c").over(down), F.lit(0)).alias("before"))
        within = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
        inside = counted.select("block", "score", F.coalesce(F.sum("c").over(within), F.lit(0)).alias("own"))
        above = written(inside.join(blocks, "block").select(F.col("score").alias("s"), (F.col("own") + F.col("before")).alias("above")), "above", keep=True)
    ties = Window.partitionBy("score", "fit").orderBy("id", "weight", "n_features").rowsBetween(Window.unboundedPreceding, -1)
    placed = scored.join(above, (F.col("score") == F.col("s")) & F.col("fit"), "left").withColumn("at", F.col("above") + F.coalesce(F.sum("copies").over(ties), F.lit(0)))
    rows = placed.withColumn("rank", F.explode(F.sequence(F.lit(1), "copies"))).withColumn("rank", F.col("at") + F.col("rank"))
    return rows.select(F.col("id").alias(key), "n_features", "weight", "score", F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
