"""Personal data by candidate gradient boosting, with SQL functions only.

Generators propose spans of whole texts with high recall, overlapping ones too: the four base patterns (some of whose matches fail their check) and looser forms (disguised
e-mail addresses, IPv6 and bracketed addresses, card numbers of other lengths and groupings, telephone numbers without a plus). Each candidate gets features of its format (length,
digits, groups, checksum, octets) and of its context (distance of the nearest word that announces its kind, words that speak against it, words of other kinds, neighbouring characters).

No table holds labels of personal data, so the boosted trees learn from candidates whose class is known by construction: ``GENERATED`` placements of looser forms after announcing,
neutral and contrary words and words of other kinds, with sound and broken checksums, go through the same generators; the corpus adds its own candidates that nothing announces, as clean ones.
A kind's threshold is the least score at which the candidates held out, those of all documents included, reach ``PRECISION``. A candidate that is no base span is added from there on;
of overlapping ones the higher score stays. Base spans that pass their check always stay, and a candidate that overlaps one says nothing new.

The positions of all matches come from the lengths of the pieces between them (``split``) and of the matches themselves, in code points.

Defined results: a null or empty text has no spans; repeated rows are judged alike; rows with a null key are judged like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import written

KINDS = ("email", "ip", "card", "phone")
#: Generated candidates, distinct feature rows of the corpus that are used for fitting at most, precision on held-out candidates, and the size of the trees.
GENERATED, MAX_ROWS, PRECISION, TREES, DEPTH, STEP_SIZE = 10_000, 5_000, 0.99, 16, 5, 0.4
#: Characters of context before a candidate.
BEFORE = 40
#: Matches that are placed by one inner loop: a loop that appends copies what it has so far at each step.
STEP = 256

_WORD = "[A-Za-z0-9._%+-]"
_AT = r" ?[\[(](?:at|AT)[\])] ?| (?:at|AT) "
_DOT = r" ?\. ?| ?[\[(](?:dot|DOT)[\])] ?| (?:dot|DOT) "
#: (kind, base?, cheap test, pattern). Base patterns are written so that a failing run is not tried again from its middle.
GENERATORS = (
    ("email", True, "contains(t, '@')", rf"(?:\G|(?<!{_WORD})){_WORD}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    ("ip", True, "d", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, "d", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, "d AND contains(t, '+')", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, "t rlike '(?i)[ \\\\[(](at|dot)[ \\\\])]'", rf"(?:\G|(?<!{_WORD})){_WORD}{{1,64}}+(?:{_AT})[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT})[A-Za-z0-9-]{{2,63}}){{1,4}}"),
    ("ip", False, "contains(t, ':')", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Fa-f:])"),
    ("ip", False, "d AND contains(t, '[.]')", r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])"),
    ("card", False, "d", r"(?<![0-9.-])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])"),
    ("card", False, "d", r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])"),
    ("phone", False, "d", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
    ("phone", False, "d", r"(?<![0-9+(.-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,8}){1,4}(?![0-9])"),
    ("phone", False, "d", r"(?<![0-9+.-])[0-9]{7,15}(?![0-9.-])"),
)

# Words that announce a kind of datum, and words that speak against any.
CUES = {
    "email": r"e-?mails?|contact|write|address|correo|courriel|kontakt",
    "ip": r"ips?|ipv[46]|hosts?|servers?|addr|address|node|gateway|dns|client",
    "card": r"cards?|visa|master ?card|amex|credit|debit|pay|paid|payment|karte|carte|tarjeta",
    "phone": r"phones?|telephone|tel|call|mobile|cell|fax|text|whatsapp|telefon|tél|móvil",
}
CONTRARY = r"orders?|invoice|isbn|version|serial|parts?|ref|reference|sku|items?|total|tracking|ticket|build|commit|dates?|pages?|id|population|lot|batch"

FORMAT = ("kind", "form", "chars", "digits", "letters", "groups", "seps", "brackets", "distinct", "luhn", "octets", "lead")
CONTEXT = ("cue", "contrary", "kin", "joined_before", "joined_after", "money")
FEATURES = FORMAT + CONTEXT


def _pattern(words: str) -> str:
    return f"\\b(?:{words})\\b".replace("\\", "\\\\")


def _appended(array: str, state: str, start: str, kind: str, step: str, name: str = "x") -> str:
    """SQL of a loop over ``array`` that appends to a list: ``step`` is a struct of the next state's fields and ``add``, the elements to append.
    The list grows in pieces, so that a long one is not copied at each step."""
    none = f"cast(array() AS array<{kind}>)"
    inner = f"aggregate(slice({array}, q + 1, {STEP}), struct(big.st AS st, {none} AS out), (a, {name}) -> transform(array({step}), r -> struct(r.st AS st, concat(a.out, r.add) AS out))[0])"
    return f"""aggregate(if(size({array}) > 0, sequence(0, size({array}) - 1, {STEP}), array()), struct(cast({start} AS {state}) AS st, {none} AS out),
        (big, q) -> transform(array({inner}), r -> struct(r.st AS st, concat(big.out, r.out) AS out))[0])"""


_PLACED = "struct<form:int,s:int,x:string,before:string,after:string>"


def _placed(i: int) -> str:
    gap = f"coalesce(get(f{i}.g, a.st.i), '')"
    step = f"""struct(struct(a.st.p + length({gap}) + length(x) AS p, a.st.i + 1 AS i, right(concat(a.st.tail, right({gap}, {BEFORE}), x), {BEFORE}) AS tail) AS st,
        array(struct({i} AS form, a.st.p + length({gap}) AS s, x AS x, right(concat(a.st.tail, right({gap}, {BEFORE})), {BEFORE}) AS before,
            left(concat(coalesce(get(f{i}.g, a.st.i + 1), ''), coalesce(get(f{i}.m, a.st.i + 1), '')), 12) AS after)) AS add)"""
    return f"if(f{i} IS NULL, cast(array() AS array<{_PLACED}>), {_appended(f'f{i}.m', 'struct<p:int,i:int,tail:string>', 'struct(0, 0, \"\")', _PLACED, step)}.out)"


_DIGITS = "translate(c.x, translate(c.x, '0123456789', ''), '')"
_LUHN = """aggregate(transform(split(reverse(D), ''), (x, i) -> if(x = '', 0, if(i % 2 = 1, if(cast(x AS int) > 4, 2 * cast(x AS int) - 9, 2 * cast(x AS int)), cast(x AS int)))), 0, (a, x) -> a + x) % 10 = 0"""
_OCTETS = """forall(split(c.x, '[^0-9]+'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(p AS decimal(38, 0)), if(ltrim('0', p) = '', 0, 999)) <= 255)"""


def _by_kind(value) -> str:
    return "CASE c.kind " + " ".join(f"WHEN {i} THEN {value(k)}" for i, k in enumerate(KINDS)) + " END"


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, c): the candidates of each document with their features; a narrow map."""
    df = docs.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).withColumn("d", F.expr("t rlike '[0-9]'"))
    found = [F.when(F.expr(test), F.struct(F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias("m"), F.split("t", p, -1).alias("g"))).alias(f"f{i}") for i, (_, _, test, p) in enumerate(GENERATORS)]
    df = df.select(F.col(f"`{key}`"), *found)
    df = df.select(F.col(f"`{key}`"), F.expr("concat(" + ", ".join(_placed(i) for i in range(len(GENERATORS))) + ")").alias("c"))
    kind = "get(array(" + ", ".join(str(KINDS.index(g[0])) for g in GENERATORS) + "), c.form)"
    base = "get(array(" + ", ".join(str(g[1]).lower() for g in GENERATORS) + "), c.form)"
    shape = f"""named_struct('form', c.form, 's', c.s, 'x', c.x, 'before', lower(c.before), 'after', c.after, 'kind', {kind}, 'base', {base}, 'dg', {_DIGITS})"""
    # short numbers are no candidates for cards or telephones
    df = df.select(F.col(f"`{key}`"), F.expr(f"filter(transform(c, c -> {shape}), c -> c.kind < 2 OR c.base AND c.kind = 3 OR length(c.dg) >= if(c.kind = 2, 12, 7))").alias("c"))
    luhn = _LUHN.replace("D", "c.dg")
    ok = f"CASE c.kind WHEN 0 THEN true WHEN 1 THEN {_OCTETS} WHEN 2 THEN length(c.dg) BETWEEN 16 AND 19 AND {luhn} ELSE length(c.dg) BETWEEN 8 AND 15 END"
    cue = lambda k: f"if(c.before rlike '{_pattern(CUES[k])}', length(regexp_extract(c.before, '(?s).*{_pattern(CUES[k])}(.*)', 1)), 60)"
    kin = lambda k: " + ".join(f"int(c.before rlike '{_pattern(CUES[o])}')" for o in KINDS if o != k)
    features = f"""transform(c, c -> named_struct('s', c.s, 'e', c.s + length(c.x), 'passes', c.base AND {ok}, 'base', c.base, 'kind', c.kind, 'form', c.form,
        'chars', least(length(c.x), 80), 'digits', least(length(c.dg), 40), 'letters', least(length(regexp_replace(c.x, '[^A-Za-z]', '')), 60),
        'groups', least(size(filter(split(c.x, '[^0-9A-Fa-f]+'), p -> p <> '')), 20), 'seps', least(length(c.x) - length(translate(c.x, ' .()-/:', '')), 20),
        'brackets', least(length(c.x) - length(translate(c.x, '[(', '')), 4),
        'distinct', size(array_distinct(split(c.dg, ''))), 'luhn', int(c.kind = 2 AND {luhn}), 'octets', int(c.kind = 1 AND {_OCTETS}),
        'lead', coalesce(try_cast(left(c.dg, 1) AS int), -1), 'cue', {_by_kind(cue)}, 'contrary', int(c.before rlike '{_pattern(CONTRARY)}'), 'kin', {_by_kind(kin)},
        'joined_before', int(right(c.before, 1) rlike '[A-Za-z0-9_]'), 'joined_after', int(left(c.after, 1) rlike '[A-Za-z0-9_]'),
        'money', int(c.before rlike '[$€£#] ?$' OR c.after rlike '^ ?[$€£%]')))"""
    return df.select(F.col(f"`{key}`"), F.expr(features).alias("c"))


# Words of the generated placements: (words before, stand for which kind or none).
NEUTRAL = ("the", "and then", "with", "it was", "we saw", "about", "near", "for", "over", "between", "und", "de la", "lorem ipsum", "values", "")


def generated(spark: SparkSession, rows: int = GENERATED) -> DataFrame:
    """(id, text, label): placements of looser forms whose class is known. A form is personal if a word of its kind announces it, no other word speaks against it and its
    checksum or octets hold; a bracketed e-mail address needs no announcement."""
    pick = lambda n, salt: f"cast(pmod(xxhash64(id, {salt}), {n}) AS int)"
    number = lambda n, salt: f"lpad(cast(pmod(xxhash64(id, {salt}), {10**n}L) AS string), {n}, '0')"
    choose = lambda options, salt: f"get(array({', '.join(repr(x) for x in options)}), {pick(len(options), salt)})"
    plain = {  # one spelling of each announcing word
        "email": ("email", "mail me: e-mail", "contact", "write to", "address", "correo"), "ip": ("ip", "host", "server", "node", "gateway", "client", "ipv6"),
        "card": ("card", "visa", "credit", "amex", "payment", "debit", "pay with"), "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "text"),
    }
    against = ("order", "invoice", "isbn", "version", "serial", "ref", "sku", "ticket", "tracking", "date", "id", "batch")
    df = spark.range(rows).withColumns({"kind": F.expr(pick(4, 1)), "how": F.expr(pick(8, 2)), "sound": F.expr(f"{pick(2, 3)} > 0"), "size": F.expr(f"12 + {pick(8, 4)}")})
    # card numbers of 12 to 19 digits, the last one sound or off by one
    df = df.withColumn("body", F.expr(f"left(concat({choose(('34', '37', '4', '51', '55', '6011', '30', '2'), 5)}, {number(18, 6)}), size - 1)"))
    total = _LUHN.replace(" % 10 = 0", "").replace("D", "concat(body, '0')")
    df = df.withColumn("card", F.expr(f"concat(body, cast((10 - ({total}) % 10 + if(sound, 0, 1 + {pick(9, 7)})) % 10 AS string))"))
    df = df.withColumn("card", F.expr(f"CASE {pick(3, 8)} WHEN 0 THEN card WHEN 1 THEN regexp_replace(card, '([0-9]{{4}})(?=[0-9])', '$1 ') ELSE regexp_replace(card, '^([0-9]{{4}})([0-9]{{6}})', '$1-$2-') END"))
    joint = choose((" ", "-", ".", "/"), 9)
    forms = (f"concat('(', {number(3, 10)}, ') ', {number(3, 11)}, '-', {number(4, 12)})", f"concat_ws({joint}, {number(3, 10)}, {number(3, 11)}, {number(4, 12)})", f"concat('0', {number(9, 10)})", f"concat('0', {number(3, 10)}, {joint}, {number(6, 11)})", f"concat_ws(' ', {number(2, 10)}, {number(2, 11)}, {number(2, 12)}, {number(2, 13)}, {number(2, 14)})")
    df = df.withColumn("phone", F.expr(f"get(array({', '.join(forms)}), {pick(len(forms), 15)})"))
    group = lambda salt: f"lower(hex(pmod(xxhash64(id, {salt}), 65536)))"
    octets = ", ".join(f"cast({pick(256, 30 + i)} + if(NOT sound AND {pick(4, 34)} = {i}, 256, 0) AS string)" for i in range(4))
    six = (f"concat_ws(':', {', '.join(group(20 + i) for i in range(8))})", f"concat({group(20)}, ':', {group(21)}, '::', {group(22)})", f"concat({group(20)}, '::', {group(21)}, ':', {group(22)}, ':', {group(23)})")
    df = df.withColumn("form", F.expr(pick(4, 29))).withColumn("ip", F.expr(f"get(array({', '.join(six)}, concat_ws('[.]', {octets})), form)"))
    names, hosts = choose(("joe", "ana.b", "k.lee22", "info", "m_r", "maria"), 40), choose(("example", "mail7", "corp-x", "uni"), 41)
    at, dot = choose((" [at] ", "(at)", " at ", " AT ", "[at]"), 42), choose((".", " [dot] ", " dot ", "(dot)"), 43)
    df = df.withColumn("email", F.expr(f"concat({names}, {at}, {hosts}, {dot}, {choose(('com', 'org', 'de', 'net'), 44)})"))
    df = df.withColumn("open", F.expr("email rlike '[\\\\[(](at)[\\\\])]'"))
    words = "CASE kind " + " ".join(f"WHEN {i} THEN {choose(plain[k], 50)}" for i, k in enumerate(KINDS)) + " END"
    filler = f"concat_ws(' ', {choose(NEUTRAL, 51)}, {choose(NEUTRAL, 52)})"
    link = choose((" ", ": ", " is ", " at ", " no. ", " number ", " my own "), 53)
    other = "CASE kind " + " ".join(f"WHEN {i} THEN {choose(plain[k], 57)}" for i, k in enumerate(("ip", "card", "phone", "card"))) + " END"
    # how: 0 to 3 announced, 4 and 5 neutral, 6 contrary, 7 a word of another kind
    lead = f"CASE WHEN how < 4 THEN concat({filler}, ' ', {words}, {link}) WHEN how < 6 THEN concat({filler}, ' ', {choose(NEUTRAL, 54)}, ' ') ELSE concat({filler}, ' ', if(how = 6, {choose(against, 55)}, {other}), {link}) END"
    value = "CASE kind " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(KINDS)) + " END"
    label = "CASE kind WHEN 0 THEN open OR how < 4 WHEN 1 THEN if(form = 3, sound AND how < 6, how < 4) WHEN 2 THEN sound AND how < 4 ELSE how < 4 END"
    tail = choose((".", " and", ", or so", " today", "", "\\n"), 56)
    return df.selectExpr("id", f"concat({lead}, {value}, {tail}) AS text", f"int({label}) AS label")


def _tree_sql(node, row: str) -> str:
    if node.subtreeDepth() == 0:
        return f"{node.prediction()!r}D"
    split = node.split()
    return f"if({row}.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {_tree_sql(node.leftChild(), row)}, {_tree_sql(node.rightChild(), row)})"


def fit(found: DataFrame, rows: int = GENERATED, bound: int = MAX_ROWS) -> tuple[str, dict[int, float]]:
    """(SQL of the score of candidate ``c``, least score of each kind), from generated candidates and those of ``found`` (c) that nothing announces."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    wide = [F.col(f"c.{k}").cast("double").alias(k) for k in FEATURES]
    made = written(generated(found.sparkSession, rows), "generated")
    own = candidates(made, "id").join(made.select("id", "label"), "id").select("label", F.explode("c").alias("c")).where("NOT c.passes").select(*wide, F.col("label").cast("double"))
    clean = found.select(F.explode("c").alias("c")).where("NOT c.passes AND c.cue = 60 AND NOT (c.kind = 0 OR c.kind = 1 AND c.octets = 1)").select(*wide, F.lit(0.0).alias("label"))
    counted = lambda df: df.groupBy(*FEATURES, "label").agg(F.count("*").cast("double").alias("n"))
    table = written(counted(own).withColumn("corpus", F.lit(False)).union(counted(clean).withColumn("corpus", F.lit(True))), "candidates")
    # all candidates of the corpus weigh together as much as the generated ones
    sums = {r["corpus"]: r["n"] for r in table.groupBy("corpus").agg(F.sum("n").alias("n")).collect()}
    even = F.when(F.col("corpus"), F.col("n") * (sums.get(False, 0.0) / max(sums.get(True, 0.0), 1.0))).otherwise(F.col("n"))
    table = table.withColumns({"weight": even, "h": F.xxhash64(*FEATURES, "label"), "fits": F.pmod(F.xxhash64(*FEATURES, F.lit(3)), F.lit(3)) > 0})
    used = table.where("fits AND NOT corpus").union(table.where("fits AND corpus").orderBy("h").limit(bound)).coalesce(1).sortWithinPartitions("h", "corpus")
    plain = written(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(used).select("features", "label", "weight"), "fitted")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP_SIZE, weightCol="weight", seed=7, cacheNodeIds=False).fit(plain)
    total = " + ".join(f"{w!r}D * {_tree_sql(t._java_obj.rootNode() if hasattr(t, '_java_obj') else t.rootNode(), 'c')}" for t, w in zip(model.trees, model.treeWeights, strict=True))
    score = f"round(1 / (1 + exp(-2 * ({total}))), 3)"
    held = table.where("NOT fits").select(F.struct(*FEATURES).alias("c"), "kind", "label", "weight").withColumn("p", F.expr(score))
    steps = held.groupBy("kind", "p").agg(F.sum(F.col("weight") * F.col("label")).alias("yes"), F.sum("weight").alias("all")).orderBy("kind", F.desc("p")).collect()
    least: dict[int, float] = {}
    for k in range(len(KINDS)):
        yes = every = 0.0
        for r in (r for r in steps if int(r["kind"]) == k and r["p"] >= 0.5):
            yes, every = yes + r["yes"], every + r["all"]
            if yes >= PRECISION * every:
                least[k] = r["p"]
    return score, least


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans): arrays of (kind, s, e), by kind as listed, then start; ``spans`` holds base and added spans."""
    found = written(candidates(docs, key, text), "pii")
    score, least = fit(found)
    span = "struct(c.kind AS kind, c.s AS s, c.e AS e)"
    cut = "CASE c.kind " + " ".join(f"WHEN {k} THEN {v!r}D" for k, v in least.items()) + " ELSE 2D END"
    # (start, end, passing base span or score): swept from left to right, the last added span being open to change
    judged = f"transform(c, c -> named_struct('s', c.s, 'e', c.e, 'kind', c.kind, 'p', if(c.passes, 2D, {score}), 'least', if(c.passes, 2D, {cut})))"
    kind = "struct<s:int,e:int,kind:int,p:double>"
    taken = f"array_sort(transform(filter({judged}, c -> c.p >= c.least), c -> struct(c.s AS s, c.e AS e, c.kind AS kind, c.p AS p)))"
    none = f"cast(array() AS array<{kind}>)"
    step = f"""CASE WHEN x.p = 2D THEN struct(struct(greatest(a.st.done, x.e) AS done, filter(a.st.last, y -> y.e <= x.s) AS last) AS st, {none} AS add)
        WHEN x.s < a.st.done THEN struct(a.st AS st, {none} AS add)
        WHEN exists(a.st.last, y -> y.e > x.s) THEN struct(struct(a.st.done AS done, if(exists(a.st.last, y -> y.p >= x.p AND y.e - y.s >= x.e - x.s OR y.p > x.p), a.st.last, array(x)) AS last) AS st, {none} AS add)
        ELSE struct(struct(a.st.done AS done, array(x) AS last) AS st, a.st.last AS add) END"""
    swept = _appended("w", f"struct<done:int,last:array<{kind}>>", f"struct(0, {none})", kind, step)
    out = found.withColumn("w", F.expr(taken))
    plain = lambda x: f"array_sort(transform(array_distinct({x}), c -> {span}))"
    out = out.withColumns({"base": F.expr(plain("filter(w, c -> c.p = 2D)")), "swept": F.expr(swept)})
    return out.select(F.col(f"`{key}`"), "base", F.expr(f"array_sort(concat(base, {plain('concat(swept.out, swept.st.last)')}))").alias("spans"))


def joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, c -> concat(get({names}, c.kind), ':', c.s, ':', c.e)), ',')"


def redacted(rows: DataFrame, text: str = "text", spans: str = "spans", mark: str = "<PII>") -> Column:
    """The text of ``rows`` with its spans replaced; overlapping spans are merged."""
    by_start = f"array_sort(transform({spans}, c -> struct(c.s AS s, c.e AS e)))"
    return F.expr(
        f"""aggregate({by_start}, struct('' AS o, 0 AS p), (a, c) -> if(c.s < a.p, struct(a.o AS o, greatest(a.p, c.e) AS p),
        struct(concat(a.o, substring(`{text}`, a.p + 1, c.s - a.p), '{mark}') AS o, c.e AS p)), a -> concat(a.o, substring(`{text}`, a.p + 1)))"""
    )
