"""The trie of conversation prefixes.

Every conversation becomes a chain of digests, each over the digest before it and the turn's role and text, so that equal prefixes have equal digests. Prefixes are grouped by (depth, digest) to
nodes. Sums over subtrees explode nodes to their ancestors: in blocks of ``BLOCK`` depths, whose heads are again exploded to the heads before them, and so on; then the sums
below each head are handed down to the nodes of the block before it. So a node of depth d makes at most about ``BLOCK`` * log(d) rows, not d, and a very long conversation stays linear.

Digests are the first 16 bytes of SHA-256. A conversation is chained by one task that streams its sorted turns and holds a few digests for each power of ``BLOCK``.

Defined results: null roles and texts are empty; rows without a conversation id belong to none and go; turns of equal number (null comes first) are ordered by the digest of role and text, so
that repeated rows are turns of their own; an empty table gives an empty result, since no conversation starts with the root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .work import scratch, written

BLOCK, WIDTH = 16, 16
#: Conversations are rebuilt on the first of each so many ids, with fewer than ``HEADS`` of its turns.
FAMILY, HEADS = 20, 4
#: Ids that may be joined into one text before the digest over all of them: those that agree but for their last bits.
ID_BITS = 12
ROOT = hashlib.sha256(b"").digest()[:WIDTH]


def turns(conversations: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(conv, pos, turn, words): turns numbered from 1, each as a digest of role and text."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(order).alias("o"), F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256)).alias("turn"),
        F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("o"), "turn"))).drop("o")


def shared_heads(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string")) % HEADS


def rebuilt(numbered: DataFrame) -> DataFrame:
    """(conv, part, pos, turn, words): part -1 marks a conversation that exists, 0 are the turns taken from the first of its family, 1 its own ones after as many."""
    most = (1 << 63) - 1
    family = f"if(conv > 0, sequence(conv, conv + least({FAMILY - 1}L, {most}L - conv)), if(conv < 0, sequence(conv - least({FAMILY - 1}L, conv + {most}L), conv), sequence(-{FAMILY - 1}L, {FAMILY - 1}L)))"
    taken = f"if(conv % {FAMILY} = 0 AND pos < {HEADS}, transform(filter({family}, t -> t - t % {FAMILY} = conv AND crc32(cast(t AS string)) % {HEADS} >= pos), t -> struct(t AS conv, 0 AS part)), array())"
    own = F.when(F.col("pos") > shared_heads(F.col("conv")), F.array(F.struct("conv", F.lit(1).alias("part")))).otherwise(F.array())
    mark = F.when(F.col("pos") == 1, F.array(F.struct("conv", F.lit(-1).alias("part")))).otherwise(F.array())
    return numbered.select(F.explode(F.concat(mark, F.expr(taken), own)).alias("x"), "pos", "turn", "words").select("x.conv", "x.part", "pos", "turn", "words")


class _Chain:
    """The digests of one conversation's prefixes and, for each power of ``BLOCK``, the last ones at its multiples."""

    def __init__(self):
        self.depth, self.digest, self.rings = 0, ROOT, [[ROOT]]

    def put(self, turn: bytes) -> tuple[bytes, int, bytes]:
        """(parent, level, path): ``level`` is how often ``BLOCK`` divides the new depth. ``path`` holds, for each level below it, the nodes between this one and the head
        before it, nearest first, and then its ancestors within its own block."""
        parent, self.digest = self.digest, hashlib.sha256(self.digest + turn).digest()[:WIDTH]
        self.depth += 1
        level, unit, path = 0, self.depth, []
        while unit % BLOCK == 0:
            path += self.rings[level][: -BLOCK : -1]
            unit //= BLOCK
            level += 1
            if level == len(self.rings):
                self.rings.append([ROOT])
        path += self.rings[level][: -(unit % BLOCK) - 1 : -1]
        for ring in self.rings[: level + 1]:
            ring.append(self.digest)
            del ring[:-BLOCK]
        return parent, level, b"".join(path)


def prefixes(parts: DataFrame) -> DataFrame:
    """(conv, depth, digest, parent, level, path, words, ended) of every prefix, the empty one (the root, level -1) included."""
    names = ["conv", "depth", "digest", "parent", "level", "path", "words", "ended"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chain, last, out = None, None, None, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for b in batches:
            for c, part, turn, words in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if c != conv:
                    if last:
                        out.append((*last, True))
                    conv, chain, last = c, _Chain() if part < 0 else None, (c, 0, ROOT, None, -1, b"", 0) if part < 0 else None
                elif chain and part >= 0:
                    out.append((*last, False))
                    parent, level, path = chain.put(turn)
                    last = (c, chain.depth, chain.digest, parent, level, path, words)
                if len(out) >= 10_000:
                    yield batch()
                    out = []
        if last:
            out.append((*last, True))
        if out:
            yield batch()

    dealt = parts.repartition("conv").sortWithinPartitions("conv", "part", "pos", "turn").select("conv", "part", "turn", "words")
    return dealt.mapInArrow(work, "conv long, depth long, digest binary, parent binary, level int, path binary, words long, ended boolean")


def _slices(first: str, count: str) -> Column:
    return F.expr(f"if({count} > 0, transform(sequence(cast({first} AS int), cast({first} + {count} - 1 AS int)), i -> substring(path, i * {WIDTH} + 1, {WIDTH})), array())")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(digest, values): sums of ``values`` over each node's subtree, itself included, of nodes (digest, depth, level, path, values)."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    top = 1
    while BLOCK**top <= deepest:
        top += 1
    add = [F.sum(v).alias(v) for v in values]
    steps = nodes.select("digest", "depth", F.when(F.col("depth") == 0, top).otherwise(F.col("level")).alias("level"), "path", *values)
    # up: what each block holds below each of its nodes
    inside, now = [], steps
    for level in range(top):
        unit = BLOCK**level
        below = now.where(F.col("level") == level).select(F.explode(_slices(f"{level} * {BLOCK - 1}", f"depth div {unit} % {BLOCK}")).alias("digest"), *values)
        sums = written(now.select("digest", *values).union(below).groupBy("digest").agg(*add), "inside")
        placed = written(now.drop(*values).join(sums, "digest"), "level")
        inside.append(placed.where(F.col("level") == level).select("digest", *values))
        now = placed.where(F.col("level") > level)
    # down: each head's whole sum to the nodes of the block before it
    whole = now.select("digest", "depth", "path", *values)
    for level in reversed(range(top)):
        handed = whole.where("depth > 0").select(F.explode(_slices(f"{level} * {BLOCK - 1}", str(BLOCK - 1))).alias("digest"), *values)
        sums = inside[level].union(handed).groupBy("digest").agg(*add)
        settled = steps.where(F.col("level") == level).select("digest", "depth", "path").join(sums, "digest")
        whole = written(whole.unionByName(settled), "whole")
    return whole.select("digest", *values)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256): SHA-256 of the ids of the conversations that end at each node, in order and joined by commas; the ids are joined in parts, and the parts streamed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for b in batches:
            for digest, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest == node:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    out.append((node, sha.hexdigest()))
                node, sha = digest, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["digest", "ends_sha256"])
                out = []
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["digest", "ends_sha256"])

    parts = ends.groupBy("digest", F.shiftright("conv", ID_BITS).alias("part")).agg(F.expr("array_join(array_sort(collect_list(conv)), ',')").alias("ids"))
    return parts.repartition("digest").sortWithinPartitions("digest", "part").select("digest", "ids").mapInArrow(work, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a node of the trie of the rebuilt conversations: (key: its smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    with scratch(conversations.sparkSession):
        every = written(prefixes(rebuilt(turns(conversations, key, order, role, text))), "prefixes")
        grouped = every.groupBy("depth", "digest").agg(
            F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("level").alias("level"), F.first("parent").alias("parent"), F.first("path").alias("path")
        )
        grouped = written(grouped, "grouped")
        children = grouped.where("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
        nodes = grouped.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
        nodes = written(nodes, "nodes")
        sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"])
        ends = ends_digests(every.where("ended").select("digest", "conv"))
        parents = nodes.select(F.col("digest").alias("parent"), F.col("conv").alias("parent_conv_id"))
        out = nodes.select("digest", "parent", "conv", "depth", "n_convs", "n_children").join(sums, "digest").join(ends, "digest", "left").join(parents, "parent", "left")
        return written(out.select(F.col("conv").alias(key), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie", keep=True)
