"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source with the share w of all weights gives out blocks of rows. Its block i is released at slot floor(i / w) and must be out before its deadline,
slot ceil((i + 1) / w). Earliest-deadline-first over these windows keeps every source within less than one block of its target at every prefix. Shares
are exact fractions c / p: weights count in steps of 1e-12 of the next power of ten above the largest one, and nothing else is rounded.

Slots are laid out in frames that don't wait for each other. What the whole schedule would have given out before a frame is known without going through it: every
block whose deadline has passed, and of the blocks whose windows lie across the border (one a source at most) those with the earliest deadlines for which there was room.
Room is counted from every slot on: the slots from there to the border, less the blocks that must lie in them. A frame then goes on, slot by slot, from that state.
A slot costs work in proportion to the number of sources, a border sources times the longest window, and a task holds a few numbers for each source; rows never come into it.

Rows get their number within a source from hash buckets of about ``BUCKET`` rows: counts of buckets give offsets in two levels, and row_number runs within a
(source, bucket), so a source that holds a third of all rows is spread like any other. The key is taken to name a row: rows that share a key share a bucket.

Defined results: null sources form a source of their own; repeated rows each get a place; an empty table gives an empty result; extra columns pass through, and columns of
the names in ``MADE`` are replaced. The mix ends before the first slot whose source has no whole block left. No row is dropped: rows beyond that end, and all rows of sources
of weight 0 (or null, negative, not given), have ``in_mix`` false and no slot, window or position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .work import written

#: Rows in a block, exponent of source sizes that gives default weights, and rows in a bucket.
BLOCK, SMOOTHING, BUCKET = 16, 0.5, 512
#: Least and most slots of a frame.
FRAMES = (512, 65_536)
MADE = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position", "in_mix")


def _source(column: str) -> Column:
    return F.when(F.col(f"`{column}`").isNull(), "-").otherwise(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")))


def _big(x: str) -> str:
    return f"cast({x} as decimal(20, 0))"


def _release(b: str, c: str, p: str = "p") -> str:
    return f"({_big(b)} * {p} div {c})"


def _deadline(b: str, c: str, p: str = "p") -> str:
    return f"((({_big(b)} + 1) * {p} + {c} - 1) div {c})"


def shares(sizes: DataFrame, weights: DataFrame | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """(src, n, c): the whole-number weight of each source of ``sizes`` (src, n); ``weights`` is (source, weight)."""
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(smoothing)))
    else:
        given = F.col("weight").cast("double")
        w = weights.select(_source("source").alias("src"), F.when((given > 0) & (given < float("inf")), given).alias("w"))
        sizes = sizes.join(w.groupBy("src").agg(F.max("w").alias("w")), "src", "left")
    scale = sizes.agg(F.expr("pow(10D, 12 - ceil(log10(max(w))))").alias("x")).scalar()
    return sizes.select("src", "n", F.coalesce(F.round(F.col("w") * scale), F.lit(0)).cast("long").alias("c"))


def schedule(sources: DataFrame, block: int = BLOCK, frame: int | None = None) -> DataFrame:
    """(src, block, slot, whole): who has which slot, up to the slot where the first source of ``sources`` (src, n, c) is sure to have run dry. ``whole``
    says whether the source has that block. A frame has as many slots as the longest window, within ``FRAMES``."""
    chosen = f"array_sort(collect_list(if(c > 0, struct(src, c, n div {block} AS full), NULL)))"
    whole = sources.agg(F.expr(chosen).alias("s"), F.expr("coalesce(sum(c), 0L)").alias("p"))
    whole = whole.withColumn("slots", F.expr(f"coalesce(array_min(transform(s, x -> {_deadline('x.full', 'x.c')})), 0L)"))
    whole = whole.withColumn("frame", F.lit(frame) if frame else F.expr(f"least({FRAMES[1]}L, greatest({FRAMES[0]}L, p div array_min(transform(s, x -> x.c))))"))
    frames = whole.select("s", "p", "slots", "frame", F.explode(F.expr("if(slots > 0, sequence(0L, slots - 1, frame), array())")).alias("t0"))
    # a number of its own: rows are few and short, but each is a frame's work
    frames = frames.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t0")
    # at the border each source has given out its first g blocks for sure; r / p of the next one is due by then
    at = frames.withColumn("b", F.expr(f"transform(s, (x, i) -> struct({_big('t0')} * x.c div p AS g, cast({_big('t0')} * x.c % p as bigint) AS r, x.c AS c, i AS i))"))
    # blocks across the border: how far back they were released, how far off their deadlines are
    at = at.withColumn("z", F.expr("transform(filter(b, x -> x.r > 0), x -> struct((x.r + x.c - 1) div x.c AS back, (p - x.r + x.c - 1) div x.c AS due, x.i AS i))"))
    room = "y - aggregate(b, 0L, (a, x) -> a + greatest(0L, (x.c * y - x.r) div p))"
    taken = f"""aggregate(if(size(z) = 0, array(), sequence(1L, array_max(transform(z, k -> k.back)))), cast(array() as array<struct<due:bigint,i:int>>),
        (kept, y) -> slice(array_sort(concat(kept, transform(filter(z, k -> k.back = y), k -> struct(k.due AS due, k.i AS i)))), 1, cast({room} as int)))"""
    at = at.withColumn("early", F.expr(f"transform(slice({taken}, 1, cast(t0 - aggregate(b, 0L, (a, x) -> a + x.g) as int)), k -> k.i)"))
    # times count from the border: the window of a source's block g + j
    state = lambda j, x: f"named_struct('rel', ({j} * p - {x}.r) div {x}.c, 'due', (({j} + 1) * p - {x}.r + {x}.c - 1) div {x}.c, 'j', {j})"
    # ``early`` is bound by a lambda: as a plain column it would be computed again for each source
    at = at.withColumn("now", F.expr(f"transform(array(early), e -> transform(b, x -> if(array_contains(e, x.i), {state('1L', 'x')}, {state('0L', 'x')})))[0]"))
    pick = "array_min(transform(st.now, (x, i) -> if(x.rel <= t, struct(x.due AS due, i AS i, x.j AS j), NULL)))"
    one = f"""(st, t) -> transform(array({pick}), k -> struct(transform(st.now, (x, i) -> if(i = k.i, {state('(x.j + 1)', 'b[i]')}, x)) AS now,
        array_append(st.laid, struct(k.i AS i, k.j AS j)) AS laid))[0]"""
    none, size = "cast(array() as array<struct<i:int,j:bigint>>)", "least(frame, slots - t0)"
    # appended to in pieces of a few hundred slots, as each step copies its piece
    piece = f"aggregate(sequence(q, least(q + {FRAMES[0]}, {size}) - 1), struct(big.now AS now, {none} AS laid), {one})"
    laid = f"aggregate(sequence(0L, {size} - 1, {FRAMES[0]}L), struct(now, {none} AS laid), (big, q) -> transform(array({piece}), st -> struct(st.now AS now, concat(big.laid, st.laid) AS laid))[0], big -> big.laid)"
    laid = f"transform({laid}, (x, t) -> struct(s[x.i].src AS src, b[x.i].g + x.j AS block, t0 + t AS slot, b[x.i].g + x.j < s[x.i].full AS whole))"
    return at.select(F.explode(F.expr(laid)).alias("x")).select("x.*")


def _numbered(docs: DataFrame, weights: DataFrame | None, source: str, key: str, block: int, smoothing: float, bucket: int) -> tuple[DataFrame, int, int]:
    """(rows with the columns of ``MADE``, number of rows, number of slots of the mix)."""
    own = [c for c in docs.columns if c not in MADE]
    buckets = math.ceil(max(1, docs.count()) / bucket)
    rows = docs.select(*(F.col(f"`{c}`") for c in own)).withColumn("__fj_src", _source(source)).withColumn("__fj_b", F.pmod(F.xxhash64(F.lit(11), f"`{key}`"), F.lit(buckets)).cast("int"))
    counts = written(rows.groupBy(F.col("__fj_src").alias("src"), F.col("__fj_b").alias("b")).agg(F.count("*").alias("m")), "mix_counts")
    sources = written(shares(counts.groupBy("src").agg(F.sum("m").alias("n")), weights, smoothing), "mix_sources")
    laid = written(schedule(sources, block), "mix_schedule")
    ends = laid.agg(F.min(F.when(~F.col("whole"), F.col("slot"))).alias("limit")).first()
    total, limit = counts.agg(F.sum("m")).first()[0] or 0, ends["limit"] or 0
    # the number of each bucket's first row: buckets are summed in groups, so that no window holds all buckets of a large source
    counts = counts.withColumn("g", F.expr(f"b div {math.isqrt(buckets) + 1}"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("src", "g").agg(F.sum("m").alias("gm")).select("src", "g", F.coalesce(F.sum("gm").over(before("src", "g")), F.lit(0)).alias("goff"))
    counts = counts.withColumn("off", F.coalesce(F.sum("m").over(before("src", "g", "b")), F.lit(0))).join(groups, ["src", "g"]).withColumn("off", F.col("off") + F.col("goff"))
    blocks = counts.select("src", "b", "off", F.explode(F.expr(f"sequence(off div {block}, (off + m - 1) div {block})")).alias("block"))
    blocks = blocks.join(laid.where(F.col("slot") < limit).select("src", "block", "slot"), ["src", "block"], "left")
    # about BUCKET / block slots for each bucket
    place = blocks.groupBy("src", "b").agg(F.min("off").alias("__fj_off"), F.expr("transform(array_sort(collect_list(struct(block, slot))), x -> x.slot)").alias("__fj_slots"))
    place = place.join(sources.select("src", F.col("c").alias("__fj_c")), "src").withColumn("__fj_p", sources.agg(F.sum("c")).scalar())
    place = place.withColumnsRenamed({"src": "__fj_src", "b": "__fj_b"})
    within = Window.partitionBy("__fj_src", "__fj_b").orderBy(F.xxhash64(F.lit(12), f"`{key}`"), f"`{key}`")
    rows = rows.withColumn("__fj_rn", F.row_number().over(within)).join(place, ["__fj_src", "__fj_b"])
    rows = rows.withColumn("__fj_i", F.col("__fj_off") + F.col("__fj_rn") - 1).withColumn("mix_block", F.expr(f"__fj_i div {block}"))
    rows = rows.withColumn("mix_slot", F.expr(f"get(__fj_slots, cast(mix_block - __fj_off div {block} as int))")).withColumns(
        {
            "mix_release": F.expr(f"if(mix_slot IS NOT NULL, {_release('mix_block', '__fj_c', '__fj_p')}, NULL)"),
            "mix_deadline": F.expr(f"if(mix_slot IS NOT NULL, {_deadline('mix_block', '__fj_c', '__fj_p')}, NULL)"),
            "mix_position": F.expr(f"mix_slot * {block} + __fj_i % {block}"),
            "in_mix": F.col("mix_slot").isNotNull(),
        }
    )
    return rows.select(*(F.col(f"`{c}`") for c in own), *MADE), total, limit


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK, smoothing: float = SMOOTHING, bucket: int = BUCKET) -> DataFrame:
    """Append mix_block, mix_release, mix_deadline, mix_slot, mix_position and in_mix. ``weights`` is (source, weight); without it a source weighs its size to the power of ``smoothing``."""
    return _numbered(docs, weights, source, key, block, smoothing, bucket)[0]


def ordered(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK, smoothing: float = SMOOTHING, bucket: int = BUCKET, rows_in_part: int = 20_000) -> DataFrame:
    """The rows and columns of ``docs``, dealt to partitions by ranges of their mixing position and sorted there, so that files read in
    order follow the schedule; the rows that are not in the mix come after it in the order of a hash. Partition numbers are computed, not sampled; there are at least as many
    as shuffle partitions. No row is dropped."""
    clash = {c: f"__fj_own_{c}" for c in docs.columns if c in MADE}
    back = lambda name: clash.get(name, name)
    mixed, total, limit = _numbered(docs.withColumnsRenamed(clash), weights, back(source), back(key), block, smoothing, bucket)
    columns = [F.col(f"`{back(c)}`").alias(c) for c in docs.columns]
    if not total:
        return mixed.select(*columns)
    rest = max(1, total - limit * block)
    mixed = mixed.withColumn("__fj_at", F.coalesce("mix_position", limit * block + F.pmod(F.xxhash64(F.lit(13), f"`{back(key)}`"), F.lit(rest))))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / rows_in_part))
    number = F.expr(f"cast(__fj_at * {parts}L div {limit * block + rest}L as int)")
    return mixed.repartitionById(parts, number).sortWithinPartitions("__fj_at").select(*columns)
