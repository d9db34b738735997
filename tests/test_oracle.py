"""Every registered query gives the rows of its SQL twin (all of them with ALL_QUERIES=1, a cross-section else)."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CROSS_SECTION = [
    "top_n", "latest_month", "last_n_days", "agg_catalog", "quantiles", "share_of_total", "safe_join", "followup_semi", "overview", "profile_top_values",
    "type_decisions", "clean_table", "fold_text", "series_pivot", "fold_other", "line_facts_complete", "tidy_report", "export_format", "daily_budget",
    "stream_daily_counts", "sliding_limit_stream", "reading_vote",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else CROSS_SECTION


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    diff, _ = difference(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert diff is None, diff


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
