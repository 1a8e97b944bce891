"""Every track query that SQL can express equals its DuckDB twin; the others give rows."""

import pandas as pd
import pytest

from trackspark import more_queries  # noqa: F401  adds to the queries
from trackspark.queries import ORACLE_SQL, QUERIES

from .conftest import DATA


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    tidy = lambda df: df[columns].astype(object).where(df[columns].notna(), None).sort_values(columns, key=lambda c: c.map(str)).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)
