"""Every core query against its SQL twin over the smallest tables."""

import pytest

from conftest import DATA, needs_data, rows_of
from moraine.plans import registries

QUERIES = {k: v for r in registries() for k, v in r.queries.items()}
SQL = {k: v for r in registries() for k, v in r.sql.items()}


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in SQL:
        assert df.columns
        return
    twin = duck.execute(SQL[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, rows) == rows_of(names, twin.fetchall())


def test_names_are_unique_and_have_sql():
    assert len(QUERIES) == sum(len(r.queries) for r in registries())
    without = {"ltr_rescore", "ltr_rescore_gain", "ltr_importance", "render_mediawiki", "render_namu", "render_any"}
    assert set(QUERIES) - set(SQL) == without
