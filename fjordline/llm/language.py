"""Language identification by a byte convolutional network.

Texts are read as UTF-8 bytes in windows of ``WINDOW`` bytes. A window's bytes are embedded, filters of several widths run over them, each filter's largest answer counts, and a softmax
over these answers gives the languages' probabilities. A document's probabilities are the mean over all windows of its whole text.

The network is trained in numpy (Adam on cross-entropy) from labelled documents outside the held-out fold: of each language at most ``PER_LANGUAGE`` documents, chosen by the hash of
their id, and of each at most ``SAMPLED`` windows, chosen by hash as well, so that what reaches the driver is bounded. Predictions use the text alone.

In use an embedding times a filter is a table by byte, and two neighbouring bytes' tables are added up beforehand: a window costs a few table rows for each byte.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for every text where no labelled one was found; with one learned language every other text has
that one with score 1; repeated rows are judged alike; an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .toxicity import held_out
from .work import written

WINDOW, WIDTHS, FILTERS, EMBEDDING = 192, (2, 3, 4), 16, 8
PER_LANGUAGE, SAMPLED = 600, 4
#: Parts that the ids of a language are ranked in before the language as a whole.
SALTS = 32
EPOCHS, BATCH, RATE = 8, 64, 0.01
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


class Network:
    """Embedding (256, E), filters {width: (width, E, F)} with offsets, and the layer above them."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.parts = {"embedding": rng.normal(0, 0.5, (256, EMBEDDING))}
        for w in WIDTHS:
            self.parts[f"filter{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS))
            self.parts[f"offset{w}"] = np.zeros(FILTERS)
        self.parts["top"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        self.parts["bias"] = np.zeros(len(languages))

    def tables(self, paired: bool = True) -> dict[int, list[tuple[int, int, np.ndarray]]]:
        """For each width its lookups (first place, places, table): two places share a table by their two bytes (only if ``paired``), others have one by their byte."""
        out = {}
        for w in WIDTHS:
            one = (self.parts["embedding"] @ self.parts[f"filter{w}"]).astype(np.float32)
            one[0] += self.parts[f"offset{w}"].astype(np.float32)
            pairs = range(0, w - 1, 2) if paired else ()
            out[w] = [(i, 2, (one[i][:, None] + one[i + 1][None]).reshape(65536, FILTERS)) for i in pairs] + [(i, 1, one[i]) for i in range(2 * len(pairs), w)]
        return out

    @staticmethod
    def answers(windows: np.ndarray, tables: dict, places: dict | None = None) -> np.ndarray:
        """The filters' largest answers, at least 0, of each window; ``places`` gets by width where they were given."""
        bytes_at = np.ascontiguousarray(windows.T).astype(np.intp)
        pairs, pooled = bytes_at[:-1] << 8 | bytes_at[1:], []
        for w, lookups in tables.items():
            n, total = len(bytes_at) - w + 1, None
            for i, many, table in lookups:
                got = np.take(table, (pairs if many == 2 else bytes_at)[i : i + n].ravel(), axis=0, mode="clip")
                total = got if total is None else np.add(total, got, out=total)
            total = total.reshape(n, len(windows), FILTERS)
            if places is not None:
                places[w] = total.argmax(0)
            pooled.append(np.maximum(total.max(0), 0))
        return np.concatenate(pooled, 1)

    def chances(self, windows: np.ndarray, tables: dict) -> np.ndarray:
        z = self.answers(windows, tables) @ self.parts["top"].astype(np.float32) + self.parts["bias"].astype(np.float32)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; only the places of largest answers pass anything back."""
        places: dict[int, np.ndarray] = {}
        pooled = self.answers(windows, self.tables(paired=False), places)
        z = pooled @ self.parts["top"] + self.parts["bias"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        out = {"top": pooled.T @ p, "bias": p.sum(0), "embedding": np.zeros((256, EMBEDDING))}
        back = (p @ self.parts["top"].T) * (pooled > 0)
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            out[f"offset{w}"] = d.sum(0)
            own = np.zeros((w, EMBEDDING, FILTERS))
            for j in range(w):
                byte = np.take_along_axis(windows, places[w] + j, 1)  # (window, filter)
                own[j] = np.einsum("nfe,nf->ef", self.parts["embedding"][byte], d)
                np.add.at(out["embedding"], byte, d[..., None] * self.parts[f"filter{w}"][j].T[None])
            out[f"filter{w}"] = own
        return out

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.parts.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for start in range(0, len(y), BATCH):
                rows, step = order[start : start + BATCH], step + 1
                for k, g in self.gradients(windows[rows], y[rows]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.parts[k] = self.parts[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, window of each text that is its first): all bytes of each text, the last window filled up with blanks."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    raw = b"".join(t.ljust(n * WINDOW) for t, n in zip(texts, counts.tolist(), strict=True))
    return np.frombuffer(raw, np.uint8).reshape(-1, WINDOW), np.concatenate([[0], np.cumsum(counts)])


def sample(docs: DataFrame, key: str, text: str, lang: str, bound: int) -> DataFrame:
    """(lang, window) of the documents to learn from; ids are ranked before texts are touched, and the bounded side is broadcast."""
    ok = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(key).alias("__k"), F.col(lang).cast("string").alias("__l"))
    # first in each of SALTS parts of a language, so that no task ranks all ids of a common one
    part = Window.partitionBy("__l", F.pmod(F.xxhash64("__k", F.lit(11)), F.lit(SALTS))).orderBy(F.xxhash64("__k"), "__k")
    ok = ok.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= bound).drop("__r")
    rank = F.row_number().over(Window.partitionBy("__l").orderBy(F.xxhash64("__k"), "__k"))
    chosen = ok.withColumn("__r", rank).where(F.col("__r") <= bound).select("__k", "__l").distinct()
    found = docs.select(F.col(key), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).join(F.broadcast(chosen), (F.col(key) == F.col("__k")) & (F.col("l") == F.col("__l")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(2)[i].as_py().encode()
                n = max(1, -(-len(raw) // WINDOW))
                # windows at multiples of a step prime to most counts, from a start that the id gives
                picks = sorted({(b.column(0)[i].as_py() + k * 7919) % n for k in range(SAMPLED)})
                got = [raw[p * WINDOW : (p + 1) * WINDOW].ljust(WINDOW) for p in picks]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(1)[i].as_py()] * len(got)), pa.array(got, pa.binary())], names=["lang", "window"])

    return found.select(F.pmod(F.xxhash64("__k", F.lit(3)), F.lit(1 << 20)).alias("h"), "l", "t").mapInArrow(work, "lang string, window binary")


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = PER_LANGUAGE) -> Network | None:
    """The trained network; None where nothing is labelled."""
    rows = written(sample(docs, key, text, lang, bound), "windows").orderBy("lang", "window").collect()  # bound * SAMPLED windows a language at most
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    net = Network(languages)
    if len(languages) > 1:
        at = {x: i for i, x in enumerate(languages)}
        net.train(np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, WINDOW), np.array([at[r["lang"]] for r in rows]))
    return net


def identify(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", most: int = 48) -> DataFrame:
    """(key, held_out, lang_pred, score) for every row of ``docs``; a narrow map, ``most`` windows at a time."""
    languages = net.languages if net else []

    def summed(tables: dict, texts: list[bytes]) -> np.ndarray:
        windows, first = windows_of(texts)
        total = np.zeros((len(texts), len(languages)))
        own = np.repeat(np.arange(len(texts)), np.diff(first))
        for a in range(0, len(windows), most):
            np.add.at(total, own[a : a + most], net.chances(windows[a : a + most], tables))
        return total / np.diff(first)[:, None]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if len(languages) > 1 else {}
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                b = whole.slice(start, 200)
                texts = b.column(1).to_pylist()
                judged = [i for i, t in enumerate(texts) if languages and t is not None and _LETTER.search(t)]
                names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                if judged:
                    p = summed(tables, [texts[i].encode("utf-8", "replace") for i in judged]) if len(languages) > 1 else np.ones((len(judged), 1))
                    names[judged], scores[judged] = np.array(languages, object)[p.argmax(1)], np.clip(p.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names.tolist(), pa.string()), pa.array(scores)], names=["__key", "lang_pred", "score"])

    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(work, f"__key {kind}, lang_pred string, score double")
    return out.select(F.col("__key").alias(key), held_out("__key").alias("held_out"), "lang_pred", "score")
