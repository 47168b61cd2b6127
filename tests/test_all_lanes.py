"""Signals of every lane and answers of every layout, against their DuckDB statements."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from vanflow.operators import lanes
from vanflow.operators import prompts as pt

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, column, wanted", [
    # sf0.001 has no seed picks
    ("L3_signals_all_lanes", "source", set(lanes.LANES) - {"seed"}), ("P8_parsed_answers_all_layouts", "kind", set(pt.ANSWERS)),
])
def test_all_kinds_are_returned_and_checked(spark, name, column, wanted):
    out = entry.queries()[name](spark, SF)
    problem, rows = compare(out, duck(SF), entry.oracle_sql()[name])
    assert problem is None and rows, problem
    assert {r[0] for r in out.select(column).distinct().collect()} == wanted
