"""The sorted scan: a recurrence over each track's rows in order, with a small carry between Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """df with each key's rows in one partition, by a shuffle of its own.

    A plain repartition by columns that df is dealt by already is left out of the plan. Adaptive execution may then deal
    df anew, as nothing behind asks for those columns: the parts of a union get partitions of their own. So rows are dealt
    by a hash of the columns.
    """
    return df.repartition(F.xxhash64(*keys))


def sorted_scan(df: DataFrame, step: Callable[[pd.DataFrame, object], tuple[pd.DataFrame, object]], key: str | list[str] = "track_id", order: str | list[str] = "seq") -> DataFrame:
    """step(rows, carry) -> (rows, carry) over each key's rows in order; carry is None where a key begins.

    One shuffle by key; a partition is streamed, so memory doesn't grow with a key's rows.
    """

    keys, orders = ([x] if isinstance(x, str) else list(x) for x in (key, order))

    def run(batches):
        last, carry = object(), None
        for batch in batches:
            for name, rows in batch.groupby(keys, sort=False, dropna=False):
                if name != last:
                    last, carry = name, None
                out, carry = step(rows, carry)
                yield out

    return gathered(df, *keys).sortWithinPartitions(*keys, *orders).mapInPandas(run, df.schema)
