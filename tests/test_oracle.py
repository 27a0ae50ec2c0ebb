"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare

NAMES = sorted(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["cluster", "n_stays", "n_pos", "pos_rate", "share_stays", "share_pos"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in E.oracle_sql()])
def test_query_matches_oracle(spark, name):
    from sf_dirs import SF_SMALL
    import oracle_compare
    oracle_compare.STRICT = True   # exact float equality, as a value hash would see it
    res = compare(spark, SF_SMALL, [name], verbose=False)
    assert res[name][0] is True, res[name]
