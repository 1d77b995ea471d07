"""Toxicity after noisy-channel deobfuscation.

A character trigram model is counted over the words of all documents. Tokens that look disguised (digits or signs among letters, letters
set apart, letters repeated) become a lattice of the letters each sign may stand for; in runs of letters set apart a word may end after any letter, so that a run holds
several words. A Viterbi search under the character model picks the likeliest reading, and the restored words join the document's own. Words and tokens may have any length. Words and their openings (four to six letters, for inflected forms) are weighed by log odds
over labelled documents, and a small logistic model turns a document's hits into a probability.

Labels are learned from at most ``MAX_LABELLED`` labelled rows outside the held-out fold, chosen by the hash of their id: two thirds weigh words, one third fits the logistic
model. Counts of the character model cover all documents. Scores use the text alone.

Defined results: a null or empty text has the score of a text without hits; repeated rows score alike; an empty table gives an empty result; without labels
of both classes every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import written

MAX_LABELLED, LEAST_SUPPORT, LEAST_ODDS = 8000, 5, 2.0
FOLDS = 5

ALPHABET = "abcdefghijklmnopqrstuvwxyzáàâäãåæçéèêëíìîïñóòôöõøœúùûüýÿß"
SIZE = 64  # symbols of the character model: 0 is a word's border, the last is any other letter
#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou"}
SIGN_COST, DROP_COST, DOUBLE_COST = 1.0, 0.7, 2.5

_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_STRETCHED = re.compile(r"(.)\1{3,}", re.S)
_SUSPECT = re.compile(r"(?:[^\W\d_][0-9@$!|+€£(*]|[0-9@$|+€£(*][^\W\d_])")
_CODE = np.full(0x10000, SIZE - 1, np.int64)
for _c in range(0x10000):
    if not chr(_c).isalpha():
        _CODE[_c] = 0
for _i, _c in enumerate(ALPHABET, 1):
    _CODE[ord(_c)] = _i


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(points, 0xFFFF)]


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(trigram, n) over the lower-cased words of all documents, summed in each task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            for start in range(0, b.num_rows, 500):
                c = codes(" " + "  ".join(t or "" for t in b.column(0).slice(start, 500).to_pylist()).lower() + "  ")
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["trigram", "n"])

    return docs.select(text).mapInArrow(work, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> np.ndarray:
    """-log P(third | first two), smoothed; its size is fixed by the alphabet."""
    table = np.zeros(SIZE**3)
    for r in counts.collect():  # at most SIZE ** 3 rows
        table[r["trigram"]] = r["n"]
    table = table.reshape(SIZE, SIZE, SIZE)
    low = table.sum((0, 1)) + 1.0
    low /= low.sum()
    return -np.log((table + 4.0 * low) / (table.sum(2, keepdims=True) + 4.0)).astype(np.float64)


def restore(token: str, cost: np.ndarray, apart: bool = False) -> str:
    """The likeliest word behind a disguised token: Viterbi over states (last two letters). ``apart``: each letter may also end a word, and the words are returned with
    blanks between them. More than three equal characters on end count as three."""
    token = _STRETCHED.sub(r"\1\1\1", token)
    # a path is (path before, letter), so that paths share what they have in common
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    run = 0
    for i, c in enumerate(token):
        run = run + 1 if i and token[i - 1] == c else 0
        options = [(x, SIGN_COST) for x in SIGNS[c]] if c in SIGNS else [(c, 0.0)] if c.isalpha() else []
        if apart and i:
            ends = [(price + cost[a, b, 0], (path, " ")) for (a, b), (price, path) in states.items() if b]
            if ends and (least := min(ends, key=lambda e: e[0]))[0] < states.get((0, 0), (math.inf,))[0]:
                states[0, 0] = least
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def offer(state, price, path, after=after):
            if state not in after or price < after[state][0]:
                after[state] = (price, path)

        for (a, b), (price, path) in states.items():
            if not options:
                offer((a, b), price + DROP_COST, path)
            for letter, extra in options:
                x = int(_CODE[min(ord(letter), 0xFFFF)])
                offer((b, x), price + extra + cost[a, b, x], (path, letter))
                if path and path[1] == letter:
                    offer((a, b), price + extra + (DROP_COST if run >= 2 or i + 1 < len(token) and token[i + 1] == c and run else DOUBLE_COST), path)
        states = after
    path, out = min(((p + cost[a, b, 0], w) for (a, b), (p, w) in states.items()), key=lambda e: e[0], default=(0.0, None))[1], []
    while path:
        out.append(path[1])
        path = path[0]
    return "".join(reversed(out))


class Reader:
    """Turns texts into their sets of words and openings, restored words included."""

    def __init__(self, cost: np.ndarray):
        self.known = lru_cache(1 << 16)(lambda token, apart: restore(token, cost, apart))
        self.cost = cost

    def word(self, token: str, apart: bool = False) -> str:
        return self.known(token, apart) if len(token) <= 64 else restore(token, self.cost, apart)

    def restored(self, low: str) -> set[str]:
        out = set()
        for m in _SPACED.finditer(low):
            letters = m[0][::2]
            out.update(self.word(letters, True).split())
            # where the model sees no border, a word may yet begin: seven letters from each place give its openings
            joined = self.word(letters)
            out.update(joined[i : i + 7] for i in range(max(1, len(joined) - 3)))
        for token in low.split():
            if _SUSPECT.search(token) or _REPEATED.search(token):
                core = token.strip(".,;:?\"'-_)")
                out.add(self.word(core))
                out.add(self.word(core.rstrip("!|*(")))
        return out

    def words(self, low: str, disguised: bool) -> set[str]:
        plain = low
        for c in ",.;:!?\"()":
            if c in plain:
                plain = plain.replace(c, " ")
        words = set(plain.split())
        if disguised:
            words |= self.restored(low)
        return words


def features(words: set[str]) -> set[str]:
    out = {w for w in words if len(w) >= 3}
    for n in (4, 5, 6):
        out |= {w[:n] + "~" for w in words if n < len(w)}
    return out


def _table(pattern: str) -> np.ndarray:
    """Which code points below 65,536 (the last stands for all others) match ``pattern``."""
    found = re.compile(pattern)
    return np.array([bool(found.match(chr(i))) for i in range(0x10000)])


_LETTER, _ALNUM, _SIGN, _GAP = _table(r"[^\W\d_]"), _table(r"\w"), _table(r"[0-9@$!|+€£(*]"), _table(r"[ .\-_*]")
_LETTER[-1] = _ALNUM[-1] = True


def disguised_rows(low: list[str]) -> np.ndarray:
    """Which lower-cased texts may hold a disguised token, from the code points of all of them at once: a sign beside a letter, three equal
    letters, or letters set apart. It is true wherever ``Reader.restored`` has something to restore."""
    sizes = np.array([len(t) + 8 for t in low], np.int64)
    raw = np.frombuffer(("\n" * 8).join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(raw, 0xFFFF)
    letter, sign, alnum, gap = _LETTER[at], _SIGN[at], _ALNUM[at], _GAP[at]
    hit = np.zeros(len(raw), bool)
    hit[1:] |= letter[1:] & sign[:-1] | sign[1:] & letter[:-1]
    hit[2:] |= letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])
    if len(raw) > 6:
        hit[6:] |= alnum[:-6] & gap[1:-5] & alnum[2:-4] & gap[3:-3] & alnum[4:-2] & gap[5:-1] & alnum[6:]
    return np.diff(np.searchsorted(np.nonzero(hit)[0], np.concatenate([[0], np.cumsum(sizes)]))) > 0


def lowered(column: pa.Array, rows: int = 250) -> Iterator[tuple[int, list[str], list[bool]]]:
    """(first row, lower-cased texts, whether each may be disguised), a few rows at a time."""
    for start in range(0, len(column), rows):
        low = [(t or "").lower() for t in column.slice(start, rows).to_pylist()]
        yield start, low, disguised_rows(low).tolist()


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, cost: np.ndarray, key: str, text: str, label: str, bound: int) -> DataFrame:
    """(y, weighs, feats) of at most ``bound`` labelled documents outside the held-out fold; the bounded side is broadcast."""
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
        .groupBy(F.col(key).alias("__k")).agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("__k"), "__k").limit(bound)
    )
    found = docs.select(F.col(key), F.col(text)).join(F.broadcast(chosen), F.col(key) == F.col("__k"))
    found = found.select("y", (F.pmod(F.xxhash64("__k", F.lit(5)), F.lit(3)) > 0).alias("weighs"), text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(cost)
        for b in batches:
            for start, low, sure in lowered(b.column(2)):
                feats = [sorted(features(reader.words(t, d))) for t, d in zip(low, sure, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(low)), b.column(1).slice(start, len(low)), pa.array(feats, pa.list_(pa.string()))], names=["y", "weighs", "feats"])

    return written(found.mapInArrow(work, "y int, weighs boolean, feats array<string>"), "labelled")


def odds(rows: DataFrame) -> dict[str, float]:
    """Log odds of the features that enough toxic documents share; bounded by the labelled sample."""
    weigh = rows.where("weighs")
    sizes = {r["y"]: r["count"] for r in weigh.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return {}
    toxic = weigh.where("y = 1").select(F.explode("feats").alias("w")).groupBy("w").count().where(F.col("count") >= LEAST_SUPPORT).select("w", F.col("count").alias("bad"))
    clean = weigh.where("y = 0").select(F.explode("feats").alias("w")).join(F.broadcast(toxic.select("w")), "w", "left_semi").groupBy("w").agg(F.count("*").alias("good"))
    both = toxic.join(clean, "w", "left").select("w", "bad", F.coalesce("good", F.lit(0)).alias("good"))
    value = F.log((F.col("bad") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1.0))
    return {r["w"]: r["v"] for r in both.select("w", value.alias("v")).where(F.col("v") >= LEAST_ODDS).collect()}


def hits(feats: set[str], weights: dict[str, float]) -> tuple[float, float, float]:
    """(best weight, sum of the five best, number) of a text's weighed features."""
    found = sorted((weights[w] for w in feats & weights.keys()), reverse=True)
    return (found[0] if found else 0.0, sum(found[:5]), math.log1p(len(found)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps for ridge logistic regression with an intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = MAX_LABELLED) -> DataFrame:
    """(key, held_out, score, predicted, n_restored) for every row of ``docs``."""
    cost = character_model(trigram_counts(docs, text))
    rows = labelled(docs, labels, cost, key, text, label, bound)
    weights = odds(rows)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [hits(set(f), weights) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in x], pa.float64()) for i in range(3))], names=["y", "best", "five", "many"])

    # four numbers a row of the bounded sample
    fitted = [(r[0], tuple(r[1:])) for r in rows.where("NOT weighs").select("y", "feats").mapInArrow(weighed, "y int, best double, five double, many double").orderBy("y", "best", "five", "many").collect()]
    classes = Counter(y for y, _ in fitted)
    if len(classes) == 2 and weights:
        model = logistic(np.array([x for _, x in fitted]), np.array([y for y, _ in fitted], float))
    else:
        share = classes[1] / len(fitted) if fitted else 0.0
        model = np.array([math.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0, 0.0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(cost)
        for b in batches:
            for start, low, sure in lowered(b.column(1)):
                x = [hits(features(reader.words(t, d)), weights) for t, d in zip(low, sure, strict=True)]
                p = 1 / (1 + np.exp(-np.clip(np.array(x).reshape(-1, 3) @ model[1:] + model[0], -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(low)), pa.array(p), pa.array(sure, pa.bool_())], names=["__key", "score", "disguised"])

    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key), F.col(text)).mapInArrow(work, f"__key {kind}, score double, disguised boolean")
    return out.select(F.col("__key").alias(key), held_out("__key").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "disguised")
