"""The pN_ queries on the smallest tables, against their SQL where they have any."""

import pytest

pytest.importorskip("plyforge.llm.queries")

from plyforge.llm.oracles import oracle_sql  # noqa: E402
from plyforge.llm.queries import queries  # noqa: E402
from tests.test_queries import compare  # noqa: E402

FOUND = {
    "p1_found": ["place", "stage"], "p2_found": ["sample_name", "draw_no", "item_key"], "p3_found": ["game_id"], "p4_found": ["line_id"],
    "p5_found": ["sample_name", "category"], "p6_found": ["doc_id"], "p7_found": ["mix_name", "source"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, small, name):
    compare(spark, small, queries()[name], oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_without_sql(spark, small, name):
    df = queries()[name](spark, small)
    assert df.count() > 0
    if name in FOUND:
        assert df.columns == FOUND[name]


def test_columns_of_found_queries(spark, small):
    for name, columns in FOUND.items():
        if name in oracle_sql():
            assert queries()[name](spark, small).columns == columns
