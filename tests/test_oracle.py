"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import os
import sys


sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from conftest import SF_SMALL  # noqa: E402


#: Iterated merges are no SQL; these queries equal a brute-force learner and encoder in ``test_subword``.
WITHOUT_SQL = {"subword_vocab", "subword_encode"}


def test_entry_contract(spark):
    import __spark_entry__ as E
    from sentspark.plans.catalog import QUERIES
    qs, sql = E.queries(), E.oracle_sql()
    assert set(QUERIES) <= set(qs) and set(QUERIES) - WITHOUT_SQL <= set(sql) <= set(qs)
    df = E.entry(spark)
    assert df.columns == ["doc_id", "pos", "sentence"]
    assert df.count() > 0


def test_all_queries_match_oracle(spark):
    from oracle_check import compare
    from sentspark.plans.catalog import QUERIES
    res = compare(spark, SF_SMALL, keys=sorted(set(QUERIES) - WITHOUT_SQL), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK",)}
    assert not bad, bad
