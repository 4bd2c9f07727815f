"""Registered queries against DuckDB. A cross-section runs by default; set
RUNAUDIT_ORACLE=all for every query."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare

SF = "/root/testdata/sf0.001"
SOME = (
    "frames_at_risk separation_timeline occurrence_log region_timeline declared_bound violations "
    "passivation_spans verify_chain tamper_detect adjudicate_sql reach_cells resolution_grades "
    "scan_frames stream_intervals"
).split()
ALL = sorted(entry.queries())
NAMES = ALL if os.environ.get("RUNAUDIT_ORACLE") == "all" else SOME


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, _, _, note = compare(spark, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(ALL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
