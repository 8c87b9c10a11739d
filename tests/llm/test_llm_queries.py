"""Every query of the subpackage over the smallest tables, against its SQL twin where it has one."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from conftest import DATA, needs_data, rows_of  # noqa: E402

from moraine.llm import registries  # noqa: E402
from moraine.llm.tokens import DEFAULT  # noqa: E402

QUERIES = {k: v for r in registries() for k, v in r.queries.items()}
SQL = {k: v for r in registries() for k, v in r.sql.items()}
COLUMNS = {
    "p2_found": ["post_id", "seg_no", "lang"], "p3_found": ["post_id", "category"], "p4_found": ["query", "id"], "p5_found": ["post_id", "category_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name.startswith("p6") and not os.path.exists(DEFAULT):
        pytest.skip("no tokenizer")
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows))
    if name in SQL:
        twin = duck.execute(SQL[name])
        assert rows_of(df.columns, rows) == rows_of([d[0] for d in twin.description], twin.fetchall())
