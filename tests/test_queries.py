"""Every registered query with SQL against that SQL, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from plyforge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings games label_rows puzzles engine_lines match_games sample_draws stages sample_targets mix_targets".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 5) + 0.0
    return str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(map(repr, (tuple(plain(r[i]) for i in order) for r in values)))


def compare(spark, folder, query, sql):
    got = query(spark, folder)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, small, name):
    compare(spark, small, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, small, name):
    df = catalogue.queries()[name](spark, small)
    assert df.columns and df.count() >= 0


def test_entry_and_lists_agree(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
