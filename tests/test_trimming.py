"""Trimming where the rows that set Crump's point lie on it: a last digit decides, as in the SQL."""

import duckdb
import pytest

from tripspark.operators import dml


def one_bin(spark, treated, n):
    e = treated / n * 0.8 + 0.1
    rows = [(i % 5, int(i < treated), e, float(i % 7), 1.0, 0.5) for i in range(n)]
    return e, spark.createDataFrame(rows, "pu int, tr int, e double, y double, mu1 double, mu0 double")


@pytest.mark.parametrize("treated, n", [(9, 119), (21, 296), (37, 299), (155, 324)])
def test_crump_point_has_the_digits_of_the_sql(spark, treated, n):
    e, df = one_bin(spark, treated, n)
    want = duckdb.sql(f"SELECT 0.5 - sqrt(greatest(0.25 - 1 / h, 0)) FROM (SELECT 1 / (e * (1 - e)) AS h FROM (SELECT {e!r}::DOUBLE AS e))").fetchall()[0][0]
    assert dml.crump_threshold(df, "e") == want


def test_no_row_left_counts_zero(spark):
    _, df = one_bin(spark, 155, 324)
    got = dml.trimmed(df, "y", "tr", "e", "mu1", "mu0", "pu", dml.crump_threshold(df, "e"), "crump").first()
    assert (got.rule, got.n_used) == ("crump", 0)
    assert got.n_treated is got.estimate is got.se_iid is got.se_cluster is None
