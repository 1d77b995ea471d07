"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fjordline.llm import mixing, near_vectors, pieces, pii, quality_rules, secrets, simhash, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, c int, slots string, st string, score double, fp string, id long, component_id long, t string, base string, y int"
LONG = "word other third " * 3000
TEXT = " ".join(f"w{i}" for i in range(80))


def row(i, text, source="a"):
    return (i, text, "en", source, None, True, 1, "x", "y", 0.5, "z", 9, 8, "t", "b", 1)


ROWS = [row(1, TEXT), row(1, TEXT), row(2, None), row(3, ""), row(None, TEXT + " q"), row(4, LONG, None), row(5, " \n\t"), row(6, TEXT.upper()), row(7, "a" * 30_000), row(8, "x" + "0" * 20_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (4, 0, 1), (4, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")


def test_quality(docs, none, labels):
    out = quality_rules.judge(docs, labels)
    assert out.count() == len(ROWS) and quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(docs, labels.where("false")).count() == len(ROWS)
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].base_failed and got[3].base_failed and got[2].st.n_words == 0
    assert got[4].st.n_repeat_words == 9000 and got[4].base_failed
    assert quality_rules.good(docs, labels).columns == docs.columns


def test_mixing(docs, none):
    out = mixing.mix(docs)
    assert out.count() == len(ROWS) and out.where("in_mix").isEmpty()  # one source has less than a block
    small = mixing.mix(docs, block=1)
    assert small.count() == len(ROWS) and small.where("in_mix").select("mix_position").distinct().count() == small.where("in_mix").count() > 0
    assert mixing.mix(none).count() == 0 and mixing.ordered(none).count() == 0
    assert mixing.ordered(docs).columns == docs.columns and mixing.ordered(docs).count() == len(ROWS)


def test_secrets(docs, none):
    assert secrets.scan(docs).count() == len(ROWS) and secrets.scan(none).count() == 0
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.where("text IS NULL").count() == 1


def test_pii(docs, none):
    assert pii.find(docs).count() == len(ROWS) and pii.find(none).count() == 0
    assert all(r.spans == [] for r in pii.find(docs).collect() if r.doc_id in (2, 3, 5, 7))


def test_toxicity(docs, none, labels):
    assert toxicity.score(docs, labels).count() == len(ROWS)
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(docs, labels.where("false")).where("score BETWEEN 0 AND 1").count() == len(ROWS)


def test_simhash(docs, none):
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(ROWS) and simhash.near_duplicates(none).count() == 0
    assert {c for k, f, c in got if k in (2, 3, 5)} == {2} and {f for k, f, c in got if k in (2, 3, 5)} == {0}
    assert {c for k, f, c in got if k in (1, 6)} == {1}


def test_near_copies(docs, none):
    out = simhash.without_copies(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(1) == 1 and 6 not in ids and ids.count(None) == 1 and simhash.without_copies(none).count() == 0


def test_pieces(docs, none):
    out = pieces.encode(docs)
    assert out.count() == len(ROWS) and out.where("NOT lossless").isEmpty() and pieces.encode(none).count() == 0
    back = pieces.decode(out.drop("text"))
    assert back.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("want")).distinct(), "doc_id").where("text <> want").isEmpty()


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0]), (11, [3.0]), (12, [-1.0]), (None, [1.0, 0.0]), (9, []), (10, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n string")
    got = {(r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_duplicates(df).collect()}
    assert {(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (11, 1, 8), (12, 0, 12), (9, 0, 9), (10, 0, 10), (None, 0, None)} == got
    assert near_vectors.near_duplicates(df.where("false")).count() == 0


def test_urls(spark):
    rows = [(1, None, "h"), (2, "no scheme", "h"), (3, "HTTP://A.Org/x?y", "h"), (4, "x://a.org", "h"), (5, "x://B.a.ORG/É#z", "h"), (6, "x://a.org.b/?", "h"), (7, "://", "h"), (4, "x://a.org", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = [url_filter.UrlRule("org/", "allow")]
    out = url_filter.judge_urls(df, rules, F.col("url").contains("?"))
    assert out.count() == len(rows)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got[1] == ("", "", None, "allow") == got[2] == got[7]
    assert got[3] == ("a.org", "/x", "org/", "allow") and got[4] == ("a.org", "", None, "allow")
    assert got[5] == ("b.a.org", "/É", "org/", "allow") and got[6] == ("a.org.b", "/", None, "block")
    assert url_filter.judge_urls(df.where("false"), rules, F.lit(True)).count() == 0
    assert url_filter.judge_urls(df, rules, F.lit(None).cast("boolean")).where("verdict = 'block'").isEmpty()


def test_warc(spark):
    rows = [(1, "http://a/ b\r\n", "x" * 200_000, "z"), (2, None, None, "z"), (3, "u", "", "z"), (4, "u", "é" * 40_000, "z"), (5, "u", "é" * 40_000, "z"), (5, "u", "é" * 40_000, "z"), (None, "u", "é" * 40_000, "z"), (6, "u", "\r\n\r\nWARC/1.0\r\n\r\n", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_read(df).collect())
    assert got == sorted([(1, 200_000, "response", None), (2, 0, "revisit", 3), (3, 0, "response", None), (4, 80_000, "revisit", 5), (5, 80_000, "response", None), (5, 80_000, "response", None), (0, 80_000, "response", None), (6, 16, "response", None)])
    assert warc.archive_and_read(df.where("false")).count() == 0


def test_stages_keep_the_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
