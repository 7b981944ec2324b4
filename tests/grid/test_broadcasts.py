import pytest

from gridtrack import scratch
from gridtrack.operators import features
from gridtrack.sources import files

DDL = "ts long, x int, y int, v double, fid long"
ROWS = [(1, 0, 0, 1.0, 0), (1, 1, 1, 2.0, 1), (1, 1, 2, 3.0, 1), (2, 5, 5, 4.0, 5)]


@pytest.fixture
def cells(spark):
    return scratch.table(spark.createDataFrame(ROWS, DDL), "cells")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_a_small_file_are_not_sent_through_the_driver(cells):
    near = features.neighbours(cells)
    assert "BroadcastHashJoin" not in plan(near)
    assert "BroadcastHashJoin" not in plan(features.boundary(cells))
    assert sorted(map(tuple, near.collect())) == [(1, 0, 1, 1), (1, 1, 0, 1)]


def test_records_merge_their_cells(cells):
    records = files.feature_records(cells, features.stats(cells), features.neighbours(cells))
    assert "BroadcastHashJoin" not in plan(records)
    got = {(r["timestep"], r["id"]): (r["neighbors"], r["pixels"], r["values"]) for r in records.collect()}
    assert got == {(1, 0): ([1], [[0, 0]], [1.0]), (1, 1): ([0], [[1, 1], [1, 2]], [2.0, 3.0]), (2, 5): (None, [[5, 5]], [4.0])}
