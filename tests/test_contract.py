"""Every registered query against its comparison SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from checks.compare import duck, duck_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"
WITHOUT_SQL = {"d4_latency_percentile_approx", "c9_score_responses"}


def own(names):
    """Without the corpus operators, which have tests of their own and may be absent."""
    return {n for n in names if not (n[:2] == "op" and n[2].isdigit()) and n != "pipeline"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_all_queries_have_sql_but_the_known_ones():
    assert own(contract.queries()) - own(contract.oracle_sql()) == WITHOUT_SQL
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(own(contract.oracle_sql())))
def test_query_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    columns, want = duck_rows(con, contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(columns)
    assert spark_rows(df) == want


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 150


def test_approximate_percentiles_are_close(spark):
    approx = {r.model_name: r for r in contract.queries()["d4_latency_percentile_approx"](spark, SF_DIR).collect()}
    exact = contract.queries()["d4_latency_percentile_lineitem"](spark, SF_DIR).collect()
    assert len(approx) == len(exact)
    for row in exact:
        assert approx[row.model_name].n == row.n
        assert approx[row.model_name].latency_p50_approx == pytest.approx(row.latency_p50, rel=0.02)
