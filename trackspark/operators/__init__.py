"""Operators: DataFrame in, DataFrame out, over many tracks at once, keyed by track_id and ordered by seq."""
