"""SentencePiece encoding and decoding with sampled segmentations.

The piece lattice of a text is filtered forwards and sampled backwards: a segmentation is drawn with probability proportional to the
product of its pieces' weights. No piece crosses the border between a word and the blanks before the next one, or a line break, so
the lattice of a text falls into lattices of short segments; these are built once for each distinct segment of a batch and sampled for
all of its occurrences at once. Every draw is a hash of (seed, row key, segment number, step), so a row gets the same pieces
whatever its batch, partition or attempt.

Running totals are in double precision, since they grow with the segment; only finished chances are kept in single precision. A segment of more than ``LONG`` code points is filtered in
blocks that leave their last totals behind, and sampled backwards from block to block, each block's lattice being made again; so memory follows the block and not the segment.

Pieces and their ranks come from a given public model file; a weight is rank ** -alpha (the file ranks pieces by merge order). A code
point that no piece covers, and a literal U+2581, fall back to byte pieces, so decoding gives back every text exactly.

Defined results: a null or empty text has no pieces; equal rows with equal keys get equal pieces; an empty table gives an empty
result; rows with a null key use the key text "null". A model file without byte pieces is refused.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Rank of a byte piece, the number of lattice edges kept between batches, and the code points of a segment above which its lattice is made in blocks.
BYTE_RANK, MOST_EDGES, LONG = 200_000, 3_000_000, 50_000

_SEGMENT = re.compile(r"\n| *[^ \n]+| +")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Pieces:
    def __init__(self, model: bytes, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.alpha, self.bytes_of, by_length, self.byte_id = alpha, [], {}, np.full(256, -1, np.int64)
        plain = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                plain.append((-sp.get_score(i), i, piece))
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so decoding could lose code points")
        for rank, (_, i, piece) in enumerate(sorted(plain), 1):
            if _SEGMENT.fullmatch(piece.replace(BLANK, " ")):
                by_length.setdefault(len(piece), []).append((self._hash(piece.replace(BLANK, " ")), i, -alpha * np.log(rank)))
        self.longest = max(by_length)
        self.tables = []
        for n in range(1, self.longest + 1):
            rows = sorted(by_length.get(n, []))
            self.tables.append((np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.float32)))
        # which leading 20 bits of a hash any piece of that length has: most substrings are ruled out by one lookup
        self.maybe = [np.zeros(1 << 20, bool) for _ in self.tables]
        for seen, (hashes, _, _) in zip(self.maybe, self.tables, strict=True):
            seen[hashes >> np.uint64(44)] = True
        self.powers = _BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        self.clear()

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        return h

    def clear(self) -> None:
        self.segment_ids: dict[str, int] = {}
        self.last_node, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chance, self.steps, self.ids, self.first = np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _add(self, segments: list[str]) -> None:
        """Forward-filter the lattices of new segments, those of equal length together."""
        lengths = np.array([len(s) for s in segments], np.int64)
        last = np.zeros(len(segments), np.int64)
        chance, steps, ids, first, nodes, edges = [self.chance], [self.steps], [self.ids], [self.first], len(self.first), len(self.chance)
        for n in np.unique(lengths).tolist():
            which = np.nonzero(lengths == n)[0]
            for part in np.array_split(which, max(1, len(which) * n // 20_000)):
                points = _points("".join(segments[i] for i in part)).reshape(len(part), n)
                c, s, i, f, _ = self._lattice(points)
                chance.append(c)
                steps.append(s)
                ids.append(i)
                first.append(f + edges)
                last[part] = nodes + np.arange(len(part)) * n + n - 1
                nodes, edges = nodes + len(part) * n, edges + len(c)
        self.chance, self.steps, self.ids, self.first = (np.concatenate(x) for x in (chance, steps, ids, first))
        self.last_node, self.length = np.concatenate([self.last_node, last]), np.concatenate([self.length, lengths])

    def _lattice(self, points: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Edges into each node, the longest first: (running probability, length, piece or -1 - code point), the first
        edge of each node, and the totals of all nodes. ``before`` holds the totals of the first nodes, whose edges are left out: those of the blocks before."""
        known = 0 if before is None else before.shape[1] - 1
        rows, n = points.shape
        widest = min(n, self.longest)
        prefix = np.zeros((rows, n + 1), np.uint64)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * _BASE + points[:, j] + np.uint64(1)
        weight = np.full((rows, n, widest), -np.inf, np.float32)
        piece = np.zeros((rows, n, widest), np.int32)
        longest = 1
        for size in range(1, widest + 1):
            hashes, found, logs = self.tables[size - 1]
            if not len(hashes):
                continue
            own = prefix[:, size:] - prefix[:, :-size] * self.powers[size]
            row, start = np.nonzero(self.maybe[size - 1][own >> np.uint64(44)])
            own = own[row, start]
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = np.nonzero(hashes[at] == own)[0]
            row, node, at = row[hit], start[hit] + size - 1, at[hit]
            weight[row, node, size - 1] = logs[at]
            piece[row, node, size - 1] = found[at]
            longest = size if len(hit) else longest
        weight, piece, widest = weight[:, :, :longest], piece[:, :, :longest], longest
        # code points that no piece covers, and the literal blank mark
        bare = ~np.isfinite(weight[:, :, 0]) | (points == ord(BLANK))
        width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        weight[:, :, 0] = np.where(bare, -self.alpha * np.log(BYTE_RANK) * width, weight[:, :, 0])
        piece[:, :, 0] = np.where(bare, -1 - points.astype(np.int32), piece[:, :, 0])
        total = np.zeros((rows, n + 1))
        if known:
            total[:, : known + 1] = before
        if rows == 1:
            # one segment: plain numbers are faster than arrays of one row
            node, back = np.nonzero(np.isfinite(weight[0]))
            first, logs, reach, own = np.searchsorted(node, np.arange(n + 1)).tolist(), weight[0, node, back].tolist(), (back + 1).tolist(), total[0].tolist()
            for j in range(known + 1, n + 1):
                x = [logs[e] + own[j - reach[e]] for e in range(first[j - 1], first[j])]
                top = max(x)
                own[j] = top + math.log(sum([math.exp(y - top) for y in x]))
            total[0] = own
            weight[0, node, back] += total[0, np.maximum(node - back, 0)] - total[0, node + 1]
        for j in range(known + 1, n + 1) if rows > 1 else ():
            k = min(j, widest)
            edges = weight[:, j - 1, :k] + total[:, j - 1 :: -1][:, :k]
            top = edges.max(1)
            total[:, j] = top + np.log(np.exp(edges - top[:, None]).sum(1))
            weight[:, j - 1, :k] = edges - total[:, j, None]
        weight, piece = weight[:, known:, ::-1], piece[:, known:, ::-1]
        chance = np.exp(weight).cumsum(2)
        real = np.isfinite(weight)
        final = widest - 1 - np.argmax(real[:, :, ::-1], 2)
        np.put_along_axis(chance, final[:, :, None], 2.0, 2)
        degree = real.sum(2).ravel()
        size = np.broadcast_to(np.arange(widest, 0, -1, dtype=np.int32), real.shape)
        return chance[real], size[real], piece[real], np.cumsum(degree) - degree, total

    def _long(self, segment: str, state: np.uint64) -> np.ndarray:
        """The sampled ids of one long segment, as ``sample`` draws them for others."""
        points, block = _points(segment)[None, :], LONG // 2
        borders, totals = [], np.zeros((1, 1))
        starts = range(0, points.shape[1], block)
        for a in starts:
            borders.append(totals)
            totals = self._lattice(points[:, a + 1 - totals.shape[1] : a + block], totals)[4][:, -self.longest - 1 :]
        out, step, node, draws = [], 0, points.shape[1], []
        for a, totals in zip(reversed(starts), reversed(borders), strict=True):
            chance, steps, ids, first, _ = (x.tolist() for x in self._lattice(points[:, a + 1 - totals.shape[1] : a + block], totals))
            found = []
            while node > a:
                if step % block == 0:
                    more = np.arange(step + 1, step + block + 1, dtype=np.uint64)
                    draws = ((_mixed(state + _BASE * more) >> np.uint64(12)).astype(np.float64) / 2.0**52).tolist()
                u, edge = draws[step % block], first[node - a - 1]
                while u >= chance[edge]:
                    edge += 1
                found.append(ids[edge])
                node -= steps[edge]
                step += 1
            out.append(np.array(found[::-1], np.int64))
        return np.concatenate(out[::-1])

    def sample(self, keys: list[str], texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.chance) > MOST_EDGES:
            self.clear()
        by_text = [_SEGMENT.findall(t) for t in texts]
        counts = np.array([len(x) for x in by_text], np.int64)
        flat = list(chain.from_iterable(by_text))
        known = self.segment_ids
        new = sorted(x for x in set(flat) - known.keys() if len(x) <= LONG)
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._add(new)
        occurrences = np.fromiter((known.get(x, -1) for x in flat), np.int64, len(flat))
        n = len(occurrences)
        row = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        base = np.array([xxhash.xxh64_intdigest(k.encode(), seed % 2**64) for k in keys], np.uint64)
        state = _mixed(base[row] + _BASE * (number.astype(np.uint64) + np.uint64(1)))
        live = np.nonzero(occurrences >= 0)[0]
        node, left = self.last_node[occurrences[live]], self.length[occurrences[live]]
        chosen, taken, step = [], np.zeros(n, np.int64), 0
        whole = {k: self._long(flat[k], state[k]) for k in np.nonzero(occurrences < 0)[0].tolist()}
        for k, found in whole.items():
            taken[k] = len(found)
        while len(live):
            step += 1
            u = (_mixed(state[live] + np.uint64(int(_BASE) * step % 2**64)) >> np.uint64(12)).astype(np.float64) / 2.0**52
            edge = self.first[node]
            more = np.nonzero(u >= self.chance[edge])[0]
            while len(more):
                edge[more] += 1
                more = more[u[more] >= self.chance[edge[more]]]
            chosen.append((live, self.ids[edge]))
            taken[live] += 1
            jump = self.steps[edge]
            left = left - jump
            on = left > 0
            live, node, left = live[on], (node - jump)[on], left[on]
        starts = np.cumsum(taken) - taken
        ids = np.zeros(int(taken.sum()), np.int64)
        for back, (which, piece) in enumerate(chosen, 1):
            ids[starts[which] + taken[which] - back] = piece
        for k, found in whole.items():
            ids[starts[k] : starts[k] + taken[k]] = found
        owner = np.repeat(row, taken)
        if (ids < 0).any():
            bare = np.nonzero(ids < 0)[0]
            raw = [chr(-1 - i).encode("utf-8", "surrogatepass") for i in ids[bare].tolist()]
            sizes = np.ones(len(ids), np.int64)
            sizes[bare] = [len(r) for r in raw]
            wide = np.repeat(ids, sizes).astype(np.int64)
            wide[np.repeat(ids < 0, sizes)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            ids, owner = wide, np.repeat(owner, sizes)
        return ids, np.bincount(owner, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")


@functools.lru_cache(2)
def shared_pieces(model: bytes, alpha: float) -> Pieces:
    """One per Python worker: tasks that follow each other find the lattices of common segments ready."""
    return Pieces(model, alpha)


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """The rows and columns of ``docs`` with ``piece_ids``, ``n_pieces`` and ``lossless`` (decoding gives the text back). A column
    of ``docs`` with one of these names is replaced. The model (half a MB) travels with the task; a narrow map."""
    made = ("piece_ids", "n_pieces", "lossless")
    docs = docs.drop(*made)
    proto, at_key, at_text = read_model(model), docs.columns.index(key), docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces(proto, alpha)
        for whole in batches:
            for start in range(0, whole.num_rows, 400):
                b = whole.slice(start, 400)
                keys = ["null" if k is None else str(k) for k in b.column(at_key).to_pylist()]
                texts = [t or "" for t in b.column(at_text).to_pylist()]
                ids, counts = pieces.sample(keys, texts, seed)
                ends = np.concatenate([[0], np.cumsum(counts)])
                flat = ids.tolist()
                same = [pieces.decode(flat[a:z]) == t for a, z, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(counts, pa.int32()), pa.array(same, pa.bool_())], names=[*b.schema.names, *made])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{columns}, piece_ids array<int>, n_pieces int, lossless boolean")


def decode(rows: DataFrame, ids: str = "piece_ids", into: str = "text", model: str = MODEL) -> DataFrame:
    """The rows and columns of ``rows`` with the text that their piece ids spell; null ids give an empty text."""
    rows = rows.drop(into)
    proto, at = read_model(model), rows.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces(proto, 1.0)
        for b in batches:
            texts = [pieces.decode(i or []) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, into])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{columns}, `{into}` string")
