"""Operations by name: checks, log and replay."""

import pytest

from trackspark.operators import builtin  # noqa: F401  registers the operations
from trackspark.plans.recipes import Record, operation, replay, run_op

from .test_semantics import ordered_rows, track


def test_log_and_replay(spark):
    df, log = track(spark, [(0, 0, i, i * 1000) for i in range(10)]), []
    out = run_op(run_op(df, "offset-elevation", {"meters": 2}, log), "decimate", {"factor": 4}, log)
    assert log == [Record("offset-elevation", 1, {"meters": 2}), Record("decimate", 1, {"factor": 4})]
    assert ordered_rows(replay(df, log), "seq", "ele") == ordered_rows(out, "seq", "ele") == [(0, 2.0), (4, 6.0), (8, 10.0), (9, 11.0)]


def test_refusals(spark):
    df = track(spark, [])
    for id, params in (("nothing", {}), ("decimate", {"factor": 1.5}), ("decimate", {"by": 2}), ("shift-time", {"seconds": float("nan")})):
        with pytest.raises(ValueError):
            run_op(df, id, params)
    with pytest.raises(ValueError):
        replay(df, [Record("decimate", 2, {"factor": 2})])
    with pytest.raises(ValueError):
        operation("decimate", 1)(lambda df: df)
