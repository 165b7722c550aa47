"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None:
            return "null"  # NaN and infinities are values of their own
        return (f"{v:.9g}" if math.isfinite(v) else str(v)) if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(name, spark, con):
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["a21_rtc_rank", "a6_empirical_p"])
def test_statistics_are_compared_with_themselves_not_with_a_second_sum(name, spark):
    """A correlation computed twice may differ in its last digit: the plan sums each one once, after the join of samples."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("corr(") == 1


@pytest.mark.parametrize("name", ["trans_histogram", "trans_hits"])
def test_threshold_is_that_of_the_sql_at_other_numbers_of_samples(name, spark, tmp_path):
    c = duckdb.connect()
    c.sql(f"copy (select * from '{SF}/embeddings.parquet' where vec_id < 120) to '{tmp_path}/embeddings.parquet' (format parquet)")
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    df, want = __spark_entry__.queries()[name](spark, str(tmp_path)), c.sql(__spark_entry__.oracle_sql()[name])
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
