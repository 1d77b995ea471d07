"""Language identification, the prefix trie and importance resampling against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordline.llm import importance, language, prefix_trie, queries
from fjordline.llm.work import read

# --- language


def test_network_equals_plain_convolution():
    net = language.Network(["a", "b", "c"])
    rng = np.random.default_rng(1)
    w = rng.integers(0, 256, (5, 40)).astype(np.uint8)
    e = net.parts["embedding"]
    want = []
    for row in w:
        pooled = []
        for k in language.WIDTHS:
            f, o = net.parts[f"filter{k}"], net.parts[f"offset{k}"]
            pooled += [max(0.0, max(sum(e[row[i + j]] @ f[j][:, c] for j in range(k)) + o[c] for i in range(40 - k + 1))) for c in range(language.FILTERS)]
        z = np.array(pooled) @ net.parts["top"] + net.parts["bias"]
        want.append(np.exp(z) / np.exp(z).sum())
    for paired in (False, True):
        assert np.allclose(net.chances(w, net.tables(paired)), want, atol=1e-4)


def test_gradients_equal_differences():
    net = language.Network(["a", "b"])
    rng = np.random.default_rng(2)
    w, y = rng.integers(0, 256, (4, 30)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        z = net.answers(w, net.tables(False)).astype(float) @ net.parts["top"] + net.parts["bias"]
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(4), y]))

    g = net.gradients(w, y)
    for part, at in (("top", (3, 1)), ("bias", (0,)), ("filter3", (1, 2, 5)), ("offset2", (4,)), ("embedding", (int(w[0, 0]), 1))):
        values = []
        for d in (1e-3, -1e-3):
            net.parts[part][at] += d
            values.append(loss())
            net.parts[part][at] -= d
        assert abs((values[0] - values[1]) / 2e-3 - g[part][at]) < 2e-3, part


def test_held_out_languages(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op11_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_whole_texts_are_read(spark):
    """The mean over all windows: a text whose larger second part is of another language is of that one, and the score is the mean of both parts' windows."""
    net = language.Network(["a", "b"])
    rng = np.random.default_rng(3)
    w = np.where(np.arange(400)[:, None] % 2 == 0, rng.integers(97, 103, (400, language.WINDOW)), rng.integers(110, 116, (400, language.WINDOW))).astype(np.uint8)
    net.train(w, np.arange(400) % 2, epochs=4)
    a, b = (bytes(w[i]).decode() for i in (0, 1))
    docs = spark.createDataFrame([(1, a * 3 + b * 5), (2, a), (3, b), (4, "123 \n"), (5, None), (6, ""), (7, a * 2000 + b * 2001)], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(docs, net).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["b", "a", "b", "und", "und", "und", "b"]
    p, q = 1 - got[2].score, got[3].score
    assert abs(got[1].score - (3 * p + 5 * q) / 8) < 1e-6 and abs(got[7].score - (2000 * p + 2001 * q) / 4001) < 1e-6


def test_language_edges(spark):
    rows = [(1, None, "en", 1.0), (2, "", "en", 2.0), (3, "Ä", None, 1.0), (3, "Ä", None, 1.0), (None, "x" * 100_000, "de", 0.0), (5, "12", "fr", 0.0), (6, "퟿", "fr", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    assert language.learn(docs.where("false")) is None
    for found in (docs.where("false"), docs.where("doc_id = 6"), docs):
        net = language.learn(found)
        got = language.identify(docs, net).collect()
        assert len(got) == len(rows) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 5))
        assert language.identify(docs.where("false"), net).count() == 0
    one = {r.doc_id: r for r in language.identify(docs, language.Network(["xx"])).collect()}
    assert one[3].lang_pred == "xx" and one[3].score == 1 and one[None].lang_pred == "xx" and not one[None].held_out


# --- prefix trie


def trie_by_hand(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = (role or "").encode(), (text or "").encode()
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(b"%d:" % len(r) + r + t).digest(), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = convs.get(base, [])[:h] + convs[c][h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(built):
        key = ()
        members[key].append(c)
        for x in built[c]:
            key = (key, x)
            members[key].append(c)
        ends[key].append(c)
    children, depth = collections.Counter(k[0] for k in members if k), {(): 0}
    for k in members:
        if k:
            depth[k] = depth[k[0]] + 1
    leaves = {k: int(not children[k]) for k in members}
    saved = {k: (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[1][1])) if k else 0 for k in members}
    for k in sorted(members, key=lambda k: -depth[k]):
        if k:
            leaves[k[0]] += leaves[k]
            saved[k[0]] += saved[k]
    return sorted((members[k][0], depth[k], members[k[0]][0] if k else -999, len(members[k]), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k in members)


def built_trie(df):
    return sorted((r.conv_id, r.depth, -999 if r.parent_conv_id is None else r.parent_conv_id, *tuple(r)[3:]) for r in prefix_trie.trie(df).collect())


SCHEMA = "conv_id long, turn long, role string, text string, digest string, path int, depth string"


def test_trie(spark):
    rng = np.random.default_rng(4)
    rows = [(c, t, "user" if t % 2 else None, f"a b{rng.integers(0, 2)}\tc" if t < 5 else None) for c in range(-45, 60) for t in range(rng.integers(1, 9))]
    rows += [(5, None, "x", "first"), (5, None, "x", "first"), (None, 1, "user", "gone"), (7, 3, "tie", "p"), (7, 3, "tie", "q"), (2**63 - 1, 0, "u", "t"), (-(2**63), 0, "u", "t"), (900, 0, "u", ""), (901, 0, "u", "")]
    df = spark.createDataFrame([(*r, "d", 1, "z") for r in rows], SCHEMA)
    assert built_trie(df) == trie_by_hand(rows)
    assert prefix_trie.trie(df.where("false")).count() == 0 == prefix_trie.trie(df.where("conv_id IS NULL")).count()


def test_trie_of_deep_conversations(spark):
    """Depths beyond two powers of the block, forks at several depths, and long turns."""
    rows = [(20 * c, t, "u", f"w{t} " * (1 + t % 3) if t < fork or t % 16 == 0 else f"w{t} {c}") for c, fork, n in ((1, 300, 300), (2, 15, 290), (3, 16, 40), (4, 17, 33), (5, 255, 270), (6, 257, 530), (7, 300, 16), (8, 300, 256)) for t in range(n)]
    rows.append((8, 0, "u", "x" * 300_000))
    df = spark.createDataFrame([(*r, "d", 1, "z") for r in rows], SCHEMA)
    assert built_trie(df) == trie_by_hand(rows)


# --- importance resampling


def runs_by_hand(text, runs):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)], len(words)


def resampled_by_hand(docs, target, runs, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for _, x in rows for f in runs_by_hand(x, runs)[0]) for rows in (docs, target))
    big = [float(sum(x.values()) + buckets) for x in (s, t)]
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big[0] / ((s[b] + 1) * big[1])))
    out = []
    for i, text in docs:
        found, words = runs_by_hand(text, runs)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = percent * len(fit) // 100
    ranked = [(*r[:4], i + 1 if i < drawn else 0) for i, r in enumerate(fit)] + [(*r[:4], 0) for r in out if r[4] < least]
    return sorted(ranked, key=str)


@pytest.mark.parametrize(("runs", "size", "percent"), [(1, 1 << 16, 10), (1, 60, 50), (3, 50, 50), (2, 1 << 16, 100)])
def test_resampling(spark, runs, size, percent):
    rng = np.random.default_rng(6)
    words = ["One", "two", "THREE", "vier", "fünf", "six6", "ß", "x" * 70, "Y" * 49, "é" * 24]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "..", " \x00"]) for _ in range(rng.integers(0, 60)))
    docs = [(int(i), text()) for i in range(300)] + [(1, None), (2, ""), (3, "--"), (None, "one two " * 30), (None, None)] + [(400, "one two three " * 20)] * 7 + [(401, "vier " * 40_000)] * 2
    target = [(i, text().replace("two", "vier")) for i in range(20)] + [(99, None)]
    df = spark.createDataFrame([(*r, 1, 2, "m") for r in docs], "doc_id long, text string, id int, score int, mark string")
    to = spark.createDataFrame(target, "item_id long, text string")
    got = sorted(((*tuple(r)[:4], r.rank or 0) for r in importance.resample(df, to, runs=runs, size=size, percent=percent, least_words=5).collect()), key=str)
    assert got == resampled_by_hand(docs, target, runs, importance.BUCKETS, 5, percent)


def test_chunks_own_every_run_once():
    text = ("Ab c_d  efé " * 50 + "z" * 500 + " tail").encode()
    for runs in (1, 2, 4):
        for size in (1, 7, 64, 5000):
            parts = list(importance.pieces_of(text, size, runs))
            assert sum(o for _, o in parts) == len(text)
            found = collections.Counter()
            for chunk, owned in parts:
                raw = np.frombuffer(chunk + b"\0", np.uint8)
                found.update(importance.run_buckets(raw, np.array([0, len(raw)]), np.array([owned]), runs, 2**32)[1].tolist())
            assert found == collections.Counter(zlib.crc32(f.encode()) for f in runs_by_hand(text.decode(), runs)[0])


def test_resampling_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "item_id long, text string")
    assert importance.resample(none, some).count() == 0
    only = importance.resample(some.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id"), percent=100).collect()
    assert [(r.n_features, r["rank"]) for r in only] == [(30, 1)]


def test_scores_fit_in_counted_blocks(spark):
    """No score holds more than the documented share of ids, whatever the weights."""
    df = spark.range(200_000).select(F.floor(-1000 * F.log(-F.log((F.conv(F.substring(F.sha2(F.concat(F.lit("2024:"), "id"), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0))).alias("s"))
    assert df.groupBy("s").count().agg(F.max("count")).first()[0] < 0.0006 * 200_000
