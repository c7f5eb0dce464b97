"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from convlytics.plans.catalog import QUERIES
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF, names=sorted(QUERIES), verbose=False)


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["status", "escalation_rate"] and df.count() > 0


def test_all_queries_match_oracle(results):
    bad = {k: v for k, v in results.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    assert not bad, bad


def test_rows_only_queries_return_rows(results):
    import __spark_entry__ as E

    rows_only = set(QUERIES) - set(E.oracle_sql())
    assert rows_only == {"evaluate_model", "escalation_training"}  # metrics of a fitted model
    for name in rows_only:
        assert results[name].startswith("rows-only") and int(results[name].split()[1]) > 0, (name, results[name])
