"""Quality rules as a learned decision list.

``text_stats`` turns a text into counts with SQL functions only. ``learn_rules`` grows and prunes
threshold conjunctions by sequential covering: each growth step is one grouped count in Spark over the
binned labelled rows, and the driver only sees (feature, bin) totals. ``verdict`` emits the ordered rules
as one CASE expression, so scoring is a map over the documents with no shuffle.

Defined results: a null text counts as empty (no words: every ratio 0, so it fails the base rule); repeated
rows are judged alike; an empty table gives an empty result; other columns of the input stay as they are;
``judge`` replaces columns that are called like its results, ``good`` returns the input's columns untouched. Labels other than
0/1 and labels of missing documents are ignored; a document labelled both ways counts as bad.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import once, written

#: Rows of labels that may be used for fitting, the documented bound on the training sample.
MAX_LABELLED = 20_000

#: Threshold candidates for each feature: quantiles of the labelled rows.
BINS = 32

FEATURES = (
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share",
    "bang_share", "upper_share", "digit_share", "distinct_share", "line_words",
)

_SPACE = r"[\\x20\\x09-\\x0D]+"
_BLANKS = "concat(' ', char(9), char(10), char(11), char(12), char(13))"


def text_stats(df: DataFrame, text: str = "text", into: str = "st") -> DataFrame:
    """Append the struct ``into`` of whole-text counts; ``n_repeat_words`` counts the words inside three-word
    windows that occur at least twice."""
    df = df.withColumn("__fj_t", F.expr(f"coalesce(`{text}`, '')"))
    df = df.withColumn("__fj_w", F.expr(f"array_remove(split(__fj_t, '{_SPACE}'), '')"))
    df = df.withColumn("__fj_n", F.expr("size(__fj_w)"))
    df = df.withColumn(
        "__fj_g",
        F.expr("if(__fj_n < 4, array(), transform(sequence(0, __fj_n - 3), i -> xxhash64(get(__fj_w, i), get(__fj_w, i + 1), get(__fj_w, i + 2))))"),
    )
    df = df.withColumn("__fj_s", F.expr("sort_array(__fj_g)"))
    df = df.withColumn("__fj_d", F.expr("array_distinct(filter(__fj_s, (h, i) -> h = get(__fj_s, i - 1)))"))
    # Few repeated windows: look each window up in their list. Many: sort (window, place) pairs and keep equal neighbours.
    df = df.withColumn(
        "__fj_o",
        F.expr("if(size(__fj_d) > 24, array_sort(transform(__fj_g, (h, i) -> struct(h, i)), (a, b) -> CASE WHEN a.h < b.h THEN -1 WHEN a.h > b.h THEN 1 ELSE a.i - b.i END), array())"),
    )
    df = df.withColumn(
        "__fj_p",
        F.expr(
            "CASE WHEN size(__fj_d) = 0 THEN array()"
            " WHEN size(__fj_d) <= 24 THEN filter(transform(__fj_g, (h, i) -> if(array_contains(__fj_d, h), i, -1)), i -> i >= 0)"
            " ELSE sort_array(transform(filter(__fj_o, (s, i) -> s.h <=> get(__fj_o, i - 1).h OR s.h <=> get(__fj_o, i + 1).h), s -> s.i)) END"
        ),
    )
    df = df.withColumn("__fj_l", F.expr(f"filter(split(__fj_t, '\\n'), x -> length(translate(x, {_BLANKS}, '')) > 0)"))
    df = df.withColumn(
        into,
        once(
            f"""named_struct(
            'n_words', CAST(__fj_n AS BIGINT),
            'word_chars', CAST(length(translate(__fj_t, {_BLANKS}, '')) AS BIGINT),
            'n_symbols', CAST(length(__fj_t) - length(translate(__fj_t, '#*$%&|<>', '')) AS BIGINT),
            'n_lines', CAST(size(__fj_l) AS BIGINT),
            'n_dup_lines', CAST(size(__fj_l) - size(array_distinct(__fj_l)) AS BIGINT),
            'n_repeat_words', CAST(if(size(__fj_p) = 0, 0, 3 + aggregate(transform(__fj_p, (x, i) -> if(i = 0, 0, least(3, x - get(__fj_p, i - 1)))), 0, (a, x) -> a + x)) AS BIGINT),
            'n_bang', CAST(length(__fj_t) - length(translate(__fj_t, '!', '')) AS BIGINT),
            'n_upper', CAST(length(__fj_t) - length(translate(__fj_t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT),
            'n_digit', CAST(length(__fj_t) - length(translate(__fj_t, '0123456789', '')) AS BIGINT),
            'n_distinct', CAST(size(array_distinct(__fj_w)) AS BIGINT))"""
        ),
    )
    return df.drop("__fj_t", "__fj_w", "__fj_n", "__fj_g", "__fj_s", "__fj_d", "__fj_o", "__fj_p", "__fj_l")


def features(st: str = "st") -> Column:
    """The ratios that rules may test, as one struct; 0 where a text has no words."""
    s = lambda k: F.col(f"{st}.{k}").cast("double")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    words, chars, lines = s("n_words"), s("word_chars"), s("n_lines")
    made = {
        "n_words": words, "mean_word": part(chars, words), "symbol_share": part(s("n_symbols"), chars), "dup_line_share": part(s("n_dup_lines"), lines),
        "repeat_share": part(s("n_repeat_words"), words), "bang_share": part(s("n_bang"), words), "upper_share": part(s("n_upper"), chars),
        "digit_share": part(s("n_digit"), chars), "distinct_share": part(s("n_distinct"), words), "line_words": part(words, lines),
    }
    return F.struct(*(made[k].alias(k) for k in FEATURES))


def base_failed(st: str = "st") -> Column:
    return (F.col(f"{st}.n_words") < 50) | (100 * F.col(f"{st}.n_repeat_words") > 50 * F.col(f"{st}.n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    value: float

    def sql(self, row: str) -> str:
        return f"{row}.{self.feature} {'>' if self.above else '<='} {self.value!r}D"


Rule = tuple[Test, ...]


def rule_sql(rule: Rule, row: str = "f") -> str:
    return " AND ".join(t.sql(row) for t in rule)


def verdict(rules: list[Rule], row: str = "f") -> Column:
    """Ordered rules: the first that fits rejects, else the document is kept."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(f"WHEN {rule_sql(r, row)} THEN false" for r in rules) + " ELSE true END")


def labelled_stats(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", bound: int = MAX_LABELLED, text: str = "text") -> DataFrame:
    """(f, bad, grow) of at most ``bound`` labelled documents, chosen by the hash of their id. The bounded label side is
    broadcast, so only the chosen texts are counted and no text is shuffled."""
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(key).alias("__k"))
        .agg(F.max(1 - F.col(label)).cast("long").alias("__bad"))
        .orderBy(F.xxhash64("__k"), "__k")
        .limit(bound)
    )
    found = docs.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("__k"))
    found = text_stats(found, text).where(~base_failed())
    return found.select(features().alias("f"), F.col("__bad").alias("bad"), (F.pmod(F.xxhash64(F.col("__k"), F.lit(7)), F.lit(3)) < 2).alias("grow"))


def _counts(rows: DataFrame, wheres: list[str]) -> list[tuple[int, int]]:
    """(bad, good) rows that fit each condition, in one pass."""
    got = rows.agg(*(F.sum(F.expr(f"if({w}, {c}, 0L)")).alias(f"c{i}_{c}") for i, w in enumerate(wheres) for c in ("bad", "good"))).first()
    return [(got[f"c{i}_bad"] or 0, got[f"c{i}_good"] or 0) for i in range(len(wheres))]


def learn_rules(rows: DataFrame, max_rules: int = 10, max_tests: int = 4, least_precision: float = 0.9, least_cover: int = 5) -> list[Rule]:
    """Sequential covering over (f, bad, grow) rows.

    A rule grows by the test with the largest information gain on the growing part, then drops trailing tests while
    that does not lower (bad - good) / (bad + good) on the pruning part; it is taken if it covers at least ``least_cover``
    rows of the growing part and its precision on both parts together is at least ``least_precision``.
    """
    import math

    rows = written(rows, "labelled")
    cuts = rows.agg(*(F.percentile_approx(f"f.{k}", [i / BINS for i in range(BINS + 1)], 10_000).alias(k) for k in FEATURES)).first()
    # thresholds lie halfway between neighbouring quantiles, so that a rule keeps a margin to what it has seen
    values = {k: sorted(set(cuts[k] or [])) for k in FEATURES}
    cuts = {k: [(a + b) / 2 for a, b in zip(v, v[1:])] for k, v in values.items()}
    if not any(cuts.values()):
        return []
    bins = F.array(*(F.expr(f"size(filter(cast(array({', '.join(f'{c!r}D' for c in cuts[k])}) as array<double>), c -> c < f.{k}))") for k in FEATURES))
    # Equal binned rows are counted once: conditions only test the bins' edges.
    rows = written(
        rows.withColumn("b", bins).groupBy("grow", "b").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")),
        "binned",
    )
    place = {k: i for i, k in enumerate(FEATURES)}

    def sql(rule: Rule) -> str:
        # value <= cuts[j] holds where fewer than j + 1 cuts lie below the value
        return " AND ".join(f"b[{place[t.feature]}] {'>' if t.above else '<='} {cuts[t.feature].index(t.value)}" for t in rule) or "true"

    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.where("NOT (" + " OR ".join(f"({sql(r)})" for r in rules) + ")") if rules else rows
        grow = left.where("grow")
        rule: Rule = ()
        bad = good = None
        while len(rule) < max_tests and good != 0:
            table = (
                grow.where(sql(rule))
                .select(F.posexplode("b").alias("k", "v"), "bad", "good")
                .groupBy("k", "v").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
                .collect()
            )
            each = [dict() for _ in FEATURES]
            for r in table:
                each[r["k"]][r["v"]] = (r["bad"], r["good"])
            bad, good = (sum(x[i] for x in each[0].values()) for i in (0, 1))
            if not bad or not good:
                break
            base, best = math.log2(bad / (bad + good)), (0.0, None, 0, 0)
            for k, name in enumerate(FEATURES):
                below_bad = below_good = 0
                for j, value in enumerate(cuts[name]):
                    x = each[k].get(j, (0, 0))
                    below_bad, below_good = below_bad + x[0], below_good + x[1]
                    for above, p, n in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                        if p >= least_cover and (gain := p * (math.log2(p / (p + n)) - base)) > best[0] + 1e-9:
                            best = (gain, Test(name, above, value), p, n)
            if best[1] is None:
                break
            rule, bad, good = (*rule, best[1]), best[2], best[3]
        if not rule:
            break
        heads = [rule[: i + 1] for i in range(len(rule))]
        pruning = _counts(left.where("NOT grow"), [sql(h) for h in heads])
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in pruning]
        rule = heads[max(range(len(heads)), key=lambda i: (worth[i], -i))]
        (p, n), (all_p, all_n) = _counts(left.where("grow"), [sql(rule)])[0], _counts(left, [sql(rule)])[0]
        if p < least_cover or all_p < least_precision * (all_p + all_n):
            break
        rules.append(rule)
    return rules


def _judged(docs: DataFrame, labels: DataFrame, text: str) -> DataFrame:
    """``docs`` with __fj_st, __fj_base and __fj_kept."""
    rules = learn_rules(labelled_stats(docs, labels, text=text))
    out = text_stats(docs, text, "__fj_st").withColumn("__fj_f", features("__fj_st"))
    out = out.withColumn("__fj_base", base_failed("__fj_st"))
    return out.withColumn("__fj_kept", ~F.col("__fj_base") & verdict(rules, "__fj_f")).drop("__fj_f")


def judge(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with struct ``st``, ``base_failed`` and ``kept`` (columns of these names are replaced)."""
    made = {"st": "__fj_st", "base_failed": "__fj_base", "kept": "__fj_kept"}
    rest = [c for c in docs.columns if c not in made]
    return _judged(docs, labels, text).select(*(F.col(f"`{c}`") for c in rest), *(F.col(v).alias(k) for k, v in made.items()))


def good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` that are kept."""
    return _judged(docs, labels, text).where("__fj_kept").select(*(F.col(f"`{c}`") for c in docs.columns))
