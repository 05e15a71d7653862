import pytest
from conftest import SF, held_against_sql

from parcelmill import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(name, spark, duck):
    held_against_sql(catalogue.QUERIES[name], catalogue.ORACLES[name], spark, duck)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(name, spark):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_density_integrates_to_one(spark):
    from parcelmill.operators import stats

    rows = spark.range(1000).selectExpr("cast(sqrt(id) as double) as v")
    grid = stats.kernel_density(rows, "v", 400, low=-20.0, high=60.0).collect()
    assert abs(sum(r["density"] for r in grid) * 80 / 399 - 1) < 0.01
