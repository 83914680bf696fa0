import os

import pytest

import __spark_entry__ as entry
from checks.compare import ROOT, compare

SMALL = f"{ROOT}/sf0.001"
# All queries take some minutes: BITEXT_ALL_QUERIES=1 compares every one of them.
CHOSEN = ["segment_pages", "stable_tokens", "reconcile_outputs", "pair_new_files", "reading_order", "map_positions", "job_state_stream"]
NAMES = list(entry.queries()) if os.environ.get("BITEXT_ALL_QUERIES") else CHOSEN


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    ok, message = compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SMALL)
    assert ok, message


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["doc_id", "batch_id", "segments", "chars", "first_ordinal"]
