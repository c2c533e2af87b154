import os

import pytest

from quern.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": ["reviewId"], "p5_found": ["src", "rec_id", "pii_kind", "starts_at"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "seg_no", "lang"]}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_on_the_smallest_tables(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows and (name not in COLUMNS or df.columns == COLUMNS[name])
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows) and all(x is not None for r in rows for x in r)
