"""Derived motion: kinematics, speeds, legs, angles, segments and the movement window."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..demo_tracks import by_seq, whole_track
from ..functions.geo import bearing, haversine, modulo, round_up, shortest_delta
from ..plans.chunks import Chunks
from ..plans.folders import held


def kinematics(df: DataFrame, keep: tuple[str, ...] = (), chunk: int | None = None) -> DataFrame:
    """Adds distance, heading, interval, frequency, speeds, acceleration and turn rate, and timestamp flags.

    Each point is compared with the row before, valid or not; acceleration and turn rate with the last point
    whose interval was positive. Distance is cumulative and rounded to 3 decimals, as is heading; others to 6.
    Tracks of more than chunk places (CHUNK of plans.chunks) are cut, here and in the operators that take chunk.
    """
    here = F.struct("lat", "lon", "ele", "time_ms")
    cut = Chunks(df, size=chunk)
    out = cut.carry(cut.rows, _end=(cut.last(here), "previous"))
    out = out.withColumn("_was", F.coalesce(F.lag(here).over(cut.window()), "_end"))
    out = out.withColumns({f"_{c}": F.col(f"_was.{c}") for c in ("lat", "lon", "ele", "time_ms")} | {"_first": F.col("_was").isNull()})
    leg = F.when(~F.col("_first"), haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    dt = (F.col("time_ms") - F.col("_time_ms")) / 1000
    out = out.withColumns({"_leg": leg, "_dt": dt}).withColumn("_on", F.coalesce(F.col("_dt") > 0, F.lit(False)) & ~F.col("_first"))
    heading = F.when(~F.col("_first"), round_up(bearing(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")), 3))
    out = out.withColumn("heading_deg", heading).withColumns({"_speed": F.when(F.col("_on"), F.col("_leg") / F.col("_dt")), "_turned": F.when(F.col("_on"), F.col("heading_deg"))})
    out = cut.carry(out, _m=(F.sum("_leg"), "sum"), _s=(cut.latest("_speed"), "last"), _h=(cut.latest("_turned"), "last"))
    last = lambda c, carry: F.coalesce(F.last(c, ignorenulls=True).over(cut.earlier()), carry)
    out = out.withColumns({
        "distance_m": round_up(F.coalesce("_m", F.lit(0.0)) + F.coalesce(F.sum("_leg").over(cut.so_far()), F.lit(0.0)), 3),
        "_last_speed": last("_speed", "_s"),
        "_last_heading": last("_turned", "_h"),
    })
    on = lambda x, digits=6: F.when(F.col("_on"), round_up(x, digits))
    flag = F.when(F.col("_first"), F.lit(None)).when(F.col("_dt").isNull(), "missing_timestamp").when(F.col("_dt") == 0, "duplicate_timestamp").when(F.col("_dt") < 0, "non_monotonic_timestamp")
    out = out.withColumns({
        "sample_interval_s": on(F.col("_dt")),
        "sample_frequency_hz": on(1 / F.col("_dt")),
        "ground_speed_mps": on(F.col("_speed")),
        "vertical_speed_mps": on((F.col("ele") - F.col("_ele")) / F.col("_dt")),
        "horizontal_accel_mps2": on((F.col("_speed") - F.col("_last_speed")) / F.col("_dt")),
        "turn_rate_dps": on(shortest_delta(F.col("_last_heading"), F.col("heading_deg")) / F.col("_dt")),
        "flags": F.when(flag.isNull(), F.col("flags")).otherwise(F.array_union("flags", F.array(flag))),
    })
    out = out.drop(*(c for c in out.columns if c.startswith("_") and c not in keep))
    if "stale" in out.columns:  # what was derived before is new
        out = out.withColumn("stale", F.filter("stale", lambda c: ~c.isin(*MOTION)))
    return cut.spanned(out)


MOTION = ("distance_m", "heading_deg", "sample_interval_s", "sample_frequency_hz", "ground_speed_mps", "vertical_speed_mps", "horizontal_accel_mps2", "turn_rate_dps")


def is_angular(channel: str) -> bool:
    """Whether a channel's name tells an angle that wraps at 360."""
    return re.match(r"(heading|bearing|course|track)(_|$)", channel, re.I) is not None


def ensure_kinematics(df: DataFrame) -> DataFrame:
    """kinematics for the tracks that have no value of speed, heading, vertical speed or turn rate, and some time; others as they were."""
    have = [c for c in ("ground_speed_mps", "heading_deg", "vertical_speed_mps", "turn_rate_dps") if c in df.columns]
    old = [c for c in MOTION if c in df.columns]
    any_ = F.lit(False)
    for c in have:
        any_ |= F.col(c).isNotNull()
    keep = F.max((any_ | F.lit(False)).cast("int")).over(whole_track()) == 1
    marked = df.withColumns({"_k": keep | (F.count("time_ms").over(whole_track()) == 0), "_f": F.col("flags")} | {f"_o_{c}": F.col(c) for c in old})
    out = kinematics(marked.drop(*old), keep=("_k", "_f", *(f"_o_{c}" for c in old)))
    pick = {c: F.when(F.col("_k"), F.col(f"_o_{c}") if c in old else F.lit(None)).otherwise(F.col(c)) for c in MOTION}
    return out.withColumns(pick | {"flags": F.when(F.col("_k"), F.col("_f")).otherwise(F.col("flags"))}).drop("_k", "_f", *(f"_o_{c}" for c in old))


def point_speeds(df: DataFrame) -> DataFrame:
    """Adds speed_mps: the recorded ground speed, else the recorded speed, else distance over time from the row before, if positive."""
    recorded = F.coalesce(*(F.col(c) for c in ("ground_speed_mps", "speed_mps") if c in df.columns), F.lit(None).cast("double"))
    dt = F.col("time_ms") - F.lag("time_ms").over(by_seq())
    own = F.when(dt > 0, haversine(F.lag("lat").over(by_seq()), F.lag("lon").over(by_seq()), F.col("lat"), F.col("lon")) * 1000 / dt)
    return df.withColumn("speed_mps", F.coalesce(recorded, own))


def legs(df: DataFrame) -> DataFrame:
    """Adds for the leg to the previous and to the next point: seconds, metres, speed, rise and bearing."""
    out = df
    for name, other in (("prev", F.lag), ("next", F.lead)):
        o = {c: other(c).over(by_seq()) for c in ("lat", "lon", "ele", "time_ms")}
        here = (F.col("lat"), F.col("lon"))
        there = (o["lat"], o["lon"])
        a, b = (there, here) if name == "prev" else (here, there)
        sign = 1 if name == "prev" else -1
        out = out.withColumns({f"{name}_dt_s": (F.col("time_ms") - o["time_ms"]) * sign / 1000, f"{name}_distance_m": haversine(*a, *b), f"{name}_delta_ele_m": (F.col("ele") - o["ele"]) * sign, f"{name}_bearing_deg": bearing(*a, *b)})
        out = out.withColumn(f"{name}_speed_mps", F.when(F.col(f"{name}_dt_s") > 0, F.col(f"{name}_distance_m") / F.col(f"{name}_dt_s")))
    return out


def unwrap_angle(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds a column that follows an angle without jumps of 360."""
    step = F.coalesce(shortest_delta(F.lag(column).over(by_seq()), F.col(column)), F.lit(0.0))
    out = df.withColumn("_step", step)
    return out.withColumn(to, F.first(column).over(by_seq().rowsBetween(Window.unboundedPreceding, 0)) + F.sum("_step").over(by_seq().rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def wrap_0_360(x):
    return modulo(x, 360.0)


def movement_marks(df: DataFrame, threshold: float = 1.0, displacement_m: float = 50.0, samples: int = 3) -> DataFrame:
    """df with speed_mps, _i (place from 0), and whether a run of so many fast points begins (_from) or ends (_to) there, or the track is displaced from its first point (_far)."""
    out = point_speeds(df).withColumn("_i", F.row_number().over(by_seq()) - 1)
    fast = F.coalesce(F.col("speed_mps") >= threshold, F.lit(False)).cast("int")
    ahead, behind = by_seq().rowsBetween(0, samples - 1), by_seq().rowsBetween(1 - samples, 0)
    first_lat, first_lon = (F.first(c).over(by_seq().rowsBetween(Window.unboundedPreceding, 0)) for c in ("lat", "lon"))
    out = out.withColumn("_fast", fast)
    far = F.coalesce(haversine(first_lat, first_lon, F.col("lat"), F.col("lon")) >= displacement_m, F.lit(False)) & (F.col("_i") > 0)
    return out.withColumns({"_from": F.sum("_fast").over(ahead) == samples, "_to": F.sum("_fast").over(behind) == samples, "_far": far}).drop("_fast")


def movement_span(least, most, timed) -> tuple:
    """(first, last) place of movement of rows with marks, by aggregates or windows over a track: least and most of a column, and how many are timed."""
    at = lambda when, f, shift=0: f(F.when(when, F.col("_i") - shift))
    a, b, c, d = at(F.col("_from"), least), at(F.col("_to"), most), at(F.col("_far"), least, 1), at(F.col("_far"), most)
    good = a.isNotNull() & b.isNotNull() & (a <= b)
    there = timed > 0
    return F.when(there, F.when(good, a).otherwise(F.coalesce(c, F.lit(0)))).cast("bigint"), F.when(there, F.when(good, b).otherwise(F.coalesce(d, most(F.col("_i"))))).cast("bigint")


def movement_window(df: DataFrame, threshold: float = 1.0, displacement_m: float = 50.0, samples: int = 3) -> DataFrame:
    """(track_id, start_seq, end_seq) of movement; no row for a track without times.

    From the first to the last run of so many speeds at the threshold or above; else the span over which the
    track is displaced from its first point; else the whole track.
    """
    start, end = movement_span(F.min, F.max, F.count("time_ms"))
    return movement_marks(df, threshold, displacement_m, samples).groupBy("track_id").agg(start.alias("start_seq"), end.alias("end_seq")).filter("end_seq is not null")


def segment_track(df: DataFrame, stationary: float = 1.0, vertical: float = 1.0, gap_s: float = 10.0, least: int = 2, chunk: int | None = None) -> DataFrame:
    """Runs of points of one kind: gap, stationary, unknown, level, climb or descent, with metrics of each.

    A run of fewer than least points, but for gaps, takes the kind of its longer neighbour (the earlier one
    if alike), by the kinds before any merge; then runs are built anew. Needs kinematics.
    """
    speed, climb = F.col("ground_speed_mps"), F.col("vertical_speed_mps")
    kind = (
        F.when(F.col("sample_interval_s") > gap_s, "gap").when(speed <= stationary, "stationary").when(climb.isNull() & speed.isNull(), "unknown")
        .when(climb.isNull(), "level").when(climb >= vertical, "climb").when(climb <= -vertical, "descent").otherwise("level")
    )
    cut = Chunks(df, size=chunk)
    rows = _numbered(cut, cut.rows.withColumn("kind", kind), "kind", "run")
    edge = lambda f, c: f(c, "seq")
    # Runs have all that their merged runs need, so that the points aren't read again.
    runs = rows.groupBy("track_id", "run").agg(
        F.first("kind").alias("old"), F.count("*").alias("n"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), edge(F.min_by, F.struct("time_ms", "distance_m")).alias("a"), edge(F.max_by, F.struct("time_ms", "distance_m")).alias("b"),
        F.sum("ground_speed_mps").alias("_gs"), F.count("ground_speed_mps").alias("_gn"), F.sum("vertical_speed_mps").alias("_vs"), F.count("vertical_speed_mps").alias("_vn"),
    )
    # Runs are chunked as points are, since each point can be a run; they are written, as each carry would make them anew.
    runs = held(runs) if cut.cut else runs
    beside = F.struct("old", "n")
    cut = Chunks(runs, "run", chunk, cut)
    runs = cut.carry(cut.rows, _before=(cut.last(beside), "previous"), _after=(cut.first(beside), "next"))
    runs = runs.withColumns({"_p": F.coalesce(F.lag(beside).over(cut.window()), "_before"), "_n": F.coalesce(F.lead(beside).over(cut.window()), "_after")})
    pk, pn, nk, nn = F.col("_p.old"), F.col("_p.n"), F.col("_n.old"), F.col("_n.n")
    new = F.when((F.col("n") >= least) | (F.col("old") == "gap"), F.col("old")).when(pk.isNull(), F.coalesce(nk, "old")).when(nk.isNull() | (pn >= nn), pk).otherwise(nk)
    runs = _numbered(cut, runs.withColumn("kind", new).drop("_before", "_after", "_p", "_n"), "kind", "segment")
    out = runs.groupBy("track_id", "segment").agg(
        F.first("kind").alias("kind"), F.min("start_seq").alias("start_seq"), F.max("end_seq").alias("end_seq"), F.sum("n").alias("point_count"), F.min_by("a", "run").alias("a"), F.max_by("b", "run").alias("b"),
        (F.sum("_gs") / F.nullif(F.sum("_gn"), F.lit(0))).alias("mean_ground_speed_mps"), (F.sum("_vs") / F.nullif(F.sum("_vn"), F.lit(0))).alias("mean_vertical_speed_mps"),
    )
    out = out.withColumns({"start_time": F.col("a.time_ms"), "end_time": F.col("b.time_ms")})
    duration = F.when(F.col("end_time").isNotNull() & F.col("start_time").isNotNull(), F.greatest(F.lit(0.0), (F.col("end_time") - F.col("start_time")) / 1000))
    return out.withColumns({"duration_s": duration, "distance_m": F.greatest(F.lit(0.0), F.col("b.distance_m") - F.col("a.distance_m"))}).drop("a", "b")


def _numbered(cut: Chunks, rows: DataFrame, column: str, to: str) -> DataFrame:
    """Numbers stretches of equal values of rows that are cut."""
    rows = cut.carry(rows, _end=(cut.last(F.struct(column)), "previous"))
    was = F.coalesce(F.lag(F.struct(column)).over(cut.window()), "_end")
    change = F.coalesce(F.col(column) != was[column], F.lit(True)).cast("int")
    rows = cut.carry(rows.withColumn("_c", change).drop("_end"), _all=(F.sum("_c"), "sum"))
    return cut.drop(rows.withColumn(to, F.coalesce("_all", F.lit(0)) + F.sum("_c").over(cut.so_far())).drop("_c", "_all"))


def median_sample_interval(df: DataFrame, gap_ms: float | None = None) -> DataFrame:
    """(track_id, median_interval_s) over positive intervals between neighbouring rows.

    With gap_ms longer intervals are left out, and a track that has no other has that.
    """
    dt = (F.col("time_ms") - F.lag("time_ms").over(by_seq())) / 1000
    rows = df.select("track_id", dt.alias("dt"))
    if gap_ms is None:
        return rows.filter("dt > 0").groupBy("track_id").agg(F.percentile("dt", 0.5).alias("median_interval_s"))
    return rows.groupBy("track_id").agg(F.coalesce(F.percentile(F.when((F.col("dt") > 0) & (F.col("dt") * 1000 <= gap_ms), F.col("dt")), 0.5), F.lit(gap_ms / 1000)).alias("median_interval_s"))


