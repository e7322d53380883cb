"""Registered queries against their SQL at the smallest scale. ALL_QUERIES=1 runs every one."""

from __future__ import annotations

import os

import pytest
from oracle_check import compare, duck

from threadloom.plans import catalogue

ROOT = "/root/testdata/sf0.001"
CORE = (
    "query_rows extract_refs text_to_blocks ancestors outline_order graph_links company resurface follow_diff diff_boards time_histogram "
    "search_fulltext bm25_rank repeated_furniture table_f1 kendall_tau stall_to_gesture latency_summary left_after_two_misses"
).split()
NAMES = sorted(catalogue()) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    q = catalogue()[name]
    ok, note = compare(spark, con, q, ROOT)
    assert ok, note


def test_every_query_has_distinct_columns_and_a_name():
    assert len(catalogue()) > 150
    assert all(q.build and name == q.name for name, q in catalogue().items())


def test_edited_sort_shows_the_day_it_sorts_by(spark, con):
    q = catalogue()["sort_rows_edited"]
    ok, note = compare(spark, con, q, ROOT)
    assert ok, note
    assert "edited" in [d[0] for d in con.execute(q.sql).description]
