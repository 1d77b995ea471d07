import pytest

from fjordline.plans import catalogue

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLES[name], con)


def test_probabilities_sum_to_one(spark, sf_dir):
    rows = catalogue.QUERIES["fit_logistic_folds"](spark, sf_dir).collect()
    assert rows and all(abs(r.p0 + r.p1 - 1) < 1e-5 and r.pred == int(r.p1 > r.p0) for r in rows if abs(r.p1 - 0.5) > 1e-5)


def test_tuned_forecasts_use_one_variant_a_batch(spark, sf_dir):
    df = catalogue.QUERIES["tune_batch"](spark, sf_dir)
    assert df.groupBy("instrument", "fold").agg({"model": "max", "dt": "count"}).where("`count(dt)` > 25").isEmpty()
    assert df.groupBy("instrument", "fold", "dt").count().where("count > 1").isEmpty()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
