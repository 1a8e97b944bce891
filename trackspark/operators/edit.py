"""Projections, filters, selections and row edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..demo_tracks import by_seq
from ..functions.geo import is_valid

KINEMATICS = ("distance_m", "heading_deg", "sample_interval_s", "sample_frequency_hz", "ground_speed_mps", "vertical_speed_mps", "horizontal_accel_mps2", "turn_rate_dps")


def swap_lat_lon(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": F.col("lon"), "lon": F.col("lat")})


def drop_invalid(df: DataFrame) -> DataFrame:
    return df.filter(is_valid(F.col("lat"), F.col("lon")))


def shift_time(df: DataFrame, seconds: float) -> DataFrame:
    return df.withColumn("time_ms", F.col("time_ms") + seconds * 1000.0)


def offset_elevation(df: DataFrame, meters: float) -> DataFrame:
    return df.withColumn("ele", F.col("ele") + float(meters))


def clip_time_range(df: DataFrame, start_ms: float, end_ms: float, untimed: str = "keep") -> DataFrame:
    """Times from start to end, both included; points without time are kept or dropped."""
    if end_ms < start_ms:
        raise ValueError("end_ms must not be before start_ms")
    if untimed not in ("keep", "drop"):
        raise ValueError("untimed must be keep or drop")
    inside = F.col("time_ms").between(float(start_ms), float(end_ms))
    return df.filter(F.coalesce(inside, F.lit(untimed == "keep")))


def round_precision(df: DataFrame, coord: int, ele: int | None = None, channels: dict[str, int] | None = None, rng: tuple[int, int] | None = None) -> DataFrame:
    """Rounds to decimals: coordinates, and elevation and channels if asked for, within a range of seq. NaN and infinite stay."""
    digits = {"lat": coord, "lon": coord} | ({"ele": ele} if ele is not None else {}) | (channels or {})
    here = F.lit(True) if rng is None else F.col("seq").between(min(rng), max(rng))
    return df.withColumns({c: F.when(here & F.col(c).between(-1e300, 1e300), F.round(c, n)).otherwise(F.col(c)) for c, n in digits.items()})


def edit_points(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Overwrites fields from edits (track_id, seq, and any columns; null: as it was).

    Edited points are flagged manual_edit. An edited position, height or time makes kinematics of that point
    and the next stale (column stale).
    """
    changed = [c for c in edits.columns if c not in ("track_id", "seq")]
    moves = [c for c in changed if c in ("lat", "lon", "ele", "time_ms")]
    new = edits.select("track_id", "seq", *(F.col(c).alias(f"_e_{c}") for c in changed), F.lit(True).alias("_hit"))
    out = df.join(new, ["track_id", "seq"], "left")
    moved = F.lit(False)
    for c in moves:
        moved = moved | F.col(f"_e_{c}").isNotNull()
    out = out.withColumn("_moved", moved).withColumn("_near", F.col("_moved") | F.coalesce(F.lag("_moved").over(by_seq()), F.lit(False)))
    out = out.withColumns({c: F.coalesce(f"_e_{c}", c) for c in changed})
    out = out.withColumn("flags", F.when(F.col("_hit"), F.array_union("flags", F.array(F.lit("manual_edit")))).otherwise(F.col("flags")))
    stale = F.when(F.col("_near"), F.array(*map(F.lit, KINEMATICS))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("stale", stale).drop("_hit", "_moved", "_near", *(f"_e_{c}" for c in changed))


def changed_count(before: DataFrame, after: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(track_id, changed): points that differ in some of the columns that both have, paired by seq."""
    both = [c for c in before.columns if c in after.columns and c not in ("track_id", "seq") and not dict(before.dtypes)[c].startswith("map") and (columns is None or c in columns)]
    old = before.select("track_id", "seq", F.struct(*both).alias("_a"))
    new = after.select("track_id", "seq", F.struct(*both).alias("_b"))
    return old.join(new, ["track_id", "seq"], "full").groupBy("track_id").agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))


def delete_points(df: DataFrame, gone: DataFrame, check: bool = False) -> DataFrame:
    """Without the points of gone (track_id, seq). check refuses, by a job, a gone that is empty or names points that aren't there."""
    if check:
        lost = gone.join(df.select("track_id", "seq"), ["track_id", "seq"], "left_anti").first()
        if lost is not None or gone.isEmpty():
            raise ValueError("nothing to delete" if lost is None else f"no point {lost['seq']} in {lost['track_id']}")
    return df.join(gone.select("track_id", "seq").distinct(), ["track_id", "seq"], "left_anti")


def apply_to_range(df: DataFrame, start: int, end: int, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """op on the points of a range of seq, the others as they were. op must keep columns, and the number of points: a job of
    a track that it changes fails."""
    inside = F.col("seq").between(min(start, end), max(start, end))
    out = op(df.filter(inside).withColumn("_was", F.count("*").over(Window.partitionBy("track_id"))))
    now = F.count("*").over(Window.partitionBy("track_id"))
    told = F.raise_error(F.concat(F.lit("the operation changed the number of points of "), F.col("track_id").cast("string"))).cast("bigint")
    out = out.withColumn("seq", F.when(now == F.col("_was"), F.col("seq")).otherwise(told)).drop("_was")
    return out.unionByName(df.filter(~inside))


def index_to_time_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """(track_id, start_ms, end_ms) of the timed points in a range of seq, in either order."""
    rows = df.filter(F.col("seq").between(min(start, end), max(start, end)) & F.col("time_ms").isNotNull())
    return rows.groupBy("track_id").agg(F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"))


def selected_points(df: DataFrame, start: int, end: int) -> DataFrame:
    """Points of a range of seq, in either order, cut to the track."""
    return df.filter(F.col("seq").between(min(start, end), max(start, end)))


def time_to_index_range(df: DataFrame, start_ms: float, end_ms: float) -> DataFrame:
    """(track_id, start_seq, end_seq) of the timed points in a time range, in either order."""
    a, b = sorted((float(start_ms), float(end_ms)))
    return df.filter(F.col("time_ms").between(a, b)).groupBy("track_id").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"))


def nearest_by_time(df: DataFrame, time_ms: float) -> DataFrame:
    """(track_id, seq) of the timed point nearest to an instant; the first wins ties."""
    apart = F.struct(F.abs(F.col("time_ms") - float(time_ms)), F.col("seq"))
    return df.filter("time_ms is not null").groupBy("track_id").agg(F.min_by("seq", apart).alias("seq"))


def table_search(df: DataFrame, text: str, columns: tuple[str, ...] = ("lat", "lon", "ele", "hdop", "sat"), rng: tuple[int, int] | None = None, flagged: DataFrame | None = None) -> DataFrame:
    """Points whose columns or ISO time contain the text, in any case; only in a range of seq, or of flagged points, if given."""
    time = F.date_format(F.timestamp_millis(F.col("time_ms").cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    kinds = dict(df.dtypes)
    own = [F.col(c).cast("string") for c in (*columns, "name") if c in kinds]
    maps = [F.array_join(F.transform(F.map_values(c), lambda v: v.cast("string")), "\x1f") for c in ("ext_num", "ext_str", "ext_bool") if c in kinds]
    all_text = F.lower(F.concat_ws("\x1f", time, *own, *maps))
    out = df.filter(F.contains(all_text, F.lit(text.lower())))
    if rng is not None:
        out = out.filter(F.col("seq").between(min(rng), max(rng)))
    return out if flagged is None else out.join(flagged.select("track_id", "seq").distinct(), ["track_id", "seq"], "left_semi")


def table_sort(df: DataFrame, column: str, desc: bool = False) -> DataFrame:
    """By a column, missing always last."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if desc else c.asc_nulls_last(), "track_id", "seq")


def add_flag(df: DataFrame, flag: str, when) -> DataFrame:
    return df.withColumn("flags", F.when(when, F.array_union("flags", F.array(F.lit(flag)))).otherwise(F.col("flags")))


def is_synthesized(flags="flags"):
    return F.arrays_overlap(flags, F.array(F.lit("interpolated"), F.lit("notional")))
