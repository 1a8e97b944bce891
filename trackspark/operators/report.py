"""The tables of an analysis report, as one tidy table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import event_counts, track_stats
from .ordered import quality_events
from .series import disclosure_counts

SECTIONS = ("overview", "metrics", "source", "events", "warnings", "operations", "bookmarks", "comparison", "fusion", "disclosure")


def _tidy(df: DataFrame, section: str, id: str | None, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    text = lambda c: F.concat_ws("; ", c) if kinds[c].startswith("array") else F.col(c).cast("string")
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), text(c).alias("value")) for c in columns))
    key = F.col(id).cast("string") if id else F.lit(None).cast("string")
    return df.select(F.lit(section).alias("section"), key.alias("track_id"), F.explode(pairs).alias("x")).select("section", "track_id", "x.metric", "x.value")


def analysis_report(points: DataFrame, datasets: DataFrame | None = None, audit: DataFrame | None = None, log: DataFrame | None = None, bookmarks: DataFrame | None = None, comparison: DataFrame | None = None, fusion: DataFrame | None = None, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(section, track_id, metric, value) of the sections asked for: those whose tables are given, in text.

    comparison: rows with pair; fusion: a fusion report; bookmarks: track_id, name, time_ms or seq; log: an operation log.
    """
    if extra := set(sections) - set(SECTIONS):
        raise ValueError(f"a report has no {', '.join(sorted(extra))}")
    stats, events = track_stats(points), event_counts(quality_events(points))
    parts: dict[str, DataFrame] = {
        "metrics": _tidy(stats, "metrics", "track_id", [c for c in stats.columns if c != "track_id"]),
        "events": events.select(F.lit("events").alias("section"), "track_id", F.col("kind").alias("metric"), F.col("n").cast("string").alias("value")),
        "disclosure": _tidy(disclosure_counts(points), "disclosure", "track_id", ["notional", "edited"]),
    }
    total = stats.agg(F.count("*").alias("datasets"), F.sum("points").alias("points"), F.sum("distance_m").alias("distance_m"))
    parts["overview"] = _tidy(total, "overview", None, ["datasets", "points", "distance_m"]).unionByName(_tidy(events.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events")), "overview", None, ["events"]))
    if datasets is not None:
        parts["source"] = _tidy(datasets, "source", "track_id", [c for c in datasets.columns if c != "track_id" and not dict(datasets.dtypes)[c].startswith("map")])
    if audit is not None:
        parts["warnings"] = audit.select(F.lit("warnings").alias("section"), "track_id", F.col("reason").alias("metric"), F.col("n").cast("string").alias("value"))
    for name, df, key in (("operations", log, "run_id"), ("bookmarks", bookmarks, "track_id"), ("comparison", comparison, "pair"), ("fusion", fusion, "entity")):
        if df is not None:
            parts[name] = _tidy(df, name, key, [c for c in df.columns if c != key])
    out = None
    for name in SECTIONS:
        if name in sections and name in parts:
            out = parts[name] if out is None else out.unionByName(parts[name])
    if out is None:
        raise ValueError("none of the sections asked for has a table")
    return out
