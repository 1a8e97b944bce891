"""Track health: checks of each track as rows (track_id, check, weight, applicable, passed, measure), the score, and what each check blames.

Five of the checks come from one windowed pass and one aggregate over it; outliers and dwells are passes of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..demo_tracks import by_seq, earlier, whole_track
from ..functions.geo import EARTH_RADIUS_M, is_valid
from ..plans.scan import sorted_scan
from .kinematics import movement_marks, movement_span, movement_window
from .outliers import detect_outliers, turn_floor


@dataclass(frozen=True)
class Limits:
    """What the checks ask for. The defaults are fixed values."""

    min_valid: float = 0.5
    floor_m: float = 304.8
    min_coverage: float = 0.8
    ground_points: int = 5
    tolerance_m: float = 100.0
    tolerance: float = 0.15
    sustained: float = 0.1
    climb_start: float = 0.9
    min_speed: float = 5.144
    max_speed: float = 680.7
    max_outside: float = 0.02
    lead_in: float = 0.2
    min_span_ms: float = 600_000.0
    max_span_ms: float = 43_200_000.0
    window: int = 5
    threshold: float = 3.0
    max_flagged: float = 0.05
    turn_dps: float = 30.0
    radius_m: float = 402.34
    dwell_ms: float = 180_000.0
    max_hdop: float = 5.0
    min_sat: float = 4.0
    max_poor: float = 0.1
    displacement_m: float = 50.0
    moving_points: int = 3


DEFAULT = Limits()
#: Weight of each check; those without one inform, or block.
WEIGHTS = {"schema-parse": 0, "altitude-profile": 30, "speed-envelope": 10, "time-order-span": 20, "outlier": 20, "stagnant": 20, "gps-fix-quality": 0}


def _marked(df: DataFrame, limits: Limits) -> DataFrame:
    """Points with what five checks need of them, from windows over their tracks that share one sort."""
    rows = df.withColumns({c: F.lit(None).cast("double") for c in ("hdop", "sat") if c not in df.columns})
    rows = movement_marks(rows, limits.min_speed, limits.displacement_m, limits.moving_points)
    whole, so_far = whole_track(), by_seq().rowsBetween(Window.unboundedPreceding, 0)
    least, most = (lambda c, f=f: f(c).over(whole) for f in (F.min, F.max))
    start, end = movement_span(least, most, F.count("time_ms").over(whole))
    up = F.when(F.col("ele").isNotNull(), F.col("ele") >= limits.floor_m)
    rows = rows.withColumns({"_start": start, "_end": end, "_n": F.count("*").over(whole), "_up": up, "_h": F.when(up.isNotNull(), F.count("ele").over(so_far) - 1), "_heights": F.count("ele").over(whole)})
    rises = F.coalesce("_up", F.lit(False)) & ~F.coalesce(F.last("_up", ignorenulls=True).over(earlier()), F.lit(False))
    rows = rows.withColumn("_rise", F.when(rises, F.struct(F.col("_h").alias("h"), "time_ms", "seq")))
    poor = F.coalesce(F.col("hdop") > limits.max_hdop, F.lit(False)) | F.coalesce(F.col("sat") < limits.min_sat, F.lit(False))
    inside = (F.col("_i") >= F.greatest("_start", F.floor(F.col("_n") * limits.lead_in))) & (F.col("_i") <= F.col("_end")) & F.col("speed_mps").isNotNull()
    return rows.withColumns({
        "_run": F.when(F.col("_up"), F.last("_rise", ignorenulls=True).over(so_far)),
        "_invalid": ~is_valid(F.col("lat"), F.col("lon")),
        "_back": F.coalesce(F.col("time_ms") < F.last("time_ms", ignorenulls=True).over(earlier()), F.lit(False)),
        "_poor": F.when(F.col("hdop").isNotNull() | F.col("sat").isNotNull(), poor),
        "_outside": F.when(inside, (F.col("speed_mps") < limits.min_speed) | (F.col("speed_mps") > limits.max_speed)),
    })


def _measured(marked: DataFrame, limits: Limits) -> DataFrame:
    """One row for each track with all that five checks judge."""
    timed = F.when(F.col("time_ms").isNotNull(), F.col("seq"))
    share = lambda c: F.avg(F.col(c).cast("int"))
    length = F.when(F.col("_up"), F.col("_h") - F.col("_run.h") + 1)
    run = F.struct(length.alias("len"), F.col("_run.h").alias("from"), F.col("_h").alias("to"), F.col("_run.time_ms").alias("s0"), F.col("time_ms").alias("s1"), F.col("_run.seq").alias("seq0"), F.col("seq").alias("seq1"))
    high = F.when(F.col("ele").isNotNull(), F.col("seq"))
    return marked.groupBy("track_id").agg(
        share("_invalid").alias("invalid"), F.count_if("_back").alias("back"), F.count("time_ms").alias("timed"), (F.max_by("time_ms", timed) - F.min_by("time_ms", timed)).alias("span"), share("_poor").alias("poor"), share("_outside").alias("outside"),
        F.avg(F.col("ele").isNotNull().cast("int")).alias("cover"), F.count("ele").alias("n"), F.max("ele").alias("top"),
        F.percentile(F.when(F.col("_h") < limits.ground_points, F.col("ele")), 0.5).alias("low0"), F.percentile(F.when(F.col("_h") >= F.col("_heights") - limits.ground_points, F.col("ele")), 0.5).alias("low1"),
        F.min_by("time_ms", high).alias("t0"), F.max_by("time_ms", high).alias("t1"), F.max_by(run, F.when(length.isNotNull(), F.struct(length.alias("len"), (-F.col("_run.h")).alias("h")))).alias("run"),
    )


def _verdict(check: str, applicable: Column, passed: Column, measure: Column) -> Column:
    applicable = F.coalesce(applicable, F.lit(False))
    return F.struct(F.lit(check).alias("check"), F.lit(WEIGHTS[check]).alias("weight"), applicable.alias("applicable"), F.when(applicable, F.coalesce(passed, F.lit(False))).alias("passed"), measure.cast("double").alias("measure"))


def _schema(limits: Limits) -> Column:
    """Enough of the points are valid."""
    valid = 1 - F.col("invalid")
    return _verdict("schema-parse", F.lit(True), valid >= limits.min_valid, valid)


def _times(limits: Limits) -> Column:
    """Timed points never go back, and span 10 minutes to 12 hours."""
    return _verdict("time-order-span", F.col("timed") >= 2, (F.col("back") == 0) & F.col("span").between(limits.min_span_ms, limits.max_span_ms), F.col("span"))


def _fixes(limits: Limits) -> Column:
    """A tenth at most of the points that report dilution or satellites have a poor fix. Informational."""
    return _verdict("gps-fix-quality", F.col("poor").isNotNull(), F.col("poor") <= limits.max_poor, F.col("poor"))


def _speeds(limits: Limits) -> Column:
    """Inside the movement window, behind the first fifth of the track, speeds lie in the envelope."""
    return _verdict("speed-envelope", F.col("outside").isNotNull(), F.col("outside") <= limits.max_outside, F.col("outside"))


def _altitude(limits: Limits) -> Column:
    """A climb through the floor, a sustained stretch above it, a descent, and like heights at both ends.

    The stretch is the longest run of points with a height at the floor or above, the first if several are.
    """
    timed = F.col("t0").isNotNull() & F.col("t1").isNotNull()
    total = F.when(timed, F.col("t1") - F.col("t0")).otherwise(F.col("n"))
    held = F.when(timed & F.col("run.s0").isNotNull() & F.col("run.s1").isNotNull(), F.col("run.s1") - F.col("run.s0")).otherwise(F.col("run.len"))
    good = (F.col("run.from") > 0) & (F.col("run.from") < F.col("n") * limits.climb_start) & (F.col("run.to") < F.col("n") - 1) & (held >= total * limits.sustained)
    level = F.abs(F.col("low1") - F.col("low0")) <= F.greatest(F.lit(limits.tolerance_m), limits.tolerance * F.greatest(F.lit(0.0), F.col("top") - limits.floor_m))
    return _verdict("altitude-profile", (F.col("n") > 0) & (F.col("cover") >= limits.min_coverage), good & level, F.col("run.len"))


_FIVE = {"schema": _schema, "times": _times, "fixes": _fixes, "speeds": _speeds, "altitude": _altitude}


def _judged(df: DataFrame, limits: Limits, *names: str) -> DataFrame:
    verdicts = F.array(*(_FIVE[n](limits) for n in names or _FIVE))
    return _measured(_marked(df, limits), limits).select("track_id", F.explode(verdicts).alias("v")).select("track_id", "v.*")


def schema_check(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return _judged(df, limits, "schema")


def time_check(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return _judged(df, limits, "times")


def fix_check(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return _judged(df, limits, "fixes")


def speed_check(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return _judged(df, limits, "speeds")


def altitude_check(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return _judged(df, limits, "altitude")


def _of_all(df: DataFrame, found: DataFrame, check: str, most: float) -> DataFrame:
    """The verdict of a measure m that must not exceed most; tracks without one are left out of the score."""
    rows = df.select("track_id").distinct().join(found, "track_id", "left")
    return rows.select("track_id", _verdict(check, F.col("m").isNotNull(), F.col("m") <= most, F.col("m")).alias("v")).select("track_id", "v.*")


def _outliers(df: DataFrame, limits: Limits) -> DataFrame:
    """Scores with the position floor of a turn of turn_dps at the track's top speed."""
    return detect_outliers(df, limits.window, limits.threshold, floors=turn_floor(df, limits.turn_dps, limits.window))


def outlier_check(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """A twentieth at most of the evaluated points are outliers of position, height or speed."""
    return _of_all(df, _outliers(df, limits).groupBy("track_id").agg(F.avg(F.col("outlier").cast("int")).alias("m")), "outlier", limits.max_flagged)


def _dwells(df: DataFrame, limits: Limits) -> DataFrame:
    """(track_id, seq, anchor, dwell) inside the movement window: the point a stay began at, and the time since.

    The greedy anchor is a recurrence, so it is a sorted scan that carries the anchor; within a stay distances are taken
    for stretches of points at once.
    """
    window = movement_window(df, limits.min_speed, limits.displacement_m, limits.moving_points)
    rows = df.withColumn("_i", (F.row_number().over(by_seq()) - 1).cast("bigint")).join(window, "track_id").filter("_i between start_seq and end_seq")
    rows = rows.select("track_id", "seq", "lat", "lon", "time_ms", F.col("seq").alias("anchor"), F.lit(0.0).alias("dwell"))
    radius = limits.radius_m

    def stay(lat, lon, carry, a: int) -> int:
        """Where from a on a point lies beyond the radius of the anchor."""
        size = 64
        while a < len(lat):
            some = slice(a, a + size)
            p, q = np.radians(carry[0]), np.radians(lat[some])
            h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon[some] - carry[1]) / 2) ** 2
            out = np.flatnonzero(~(2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h))) <= radius))
            if len(out):
                return a + int(out[0])
            a, size = min(len(lat), a + size), size * 2
        return a

    def step(rows: pd.DataFrame, carry):
        lat, lon, time = (rows[c].to_numpy(float) for c in ("lat", "lon", "time_ms"))
        seq, dwell = rows["seq"].to_numpy(), np.zeros(len(rows))
        anchor, i = seq.copy(), 0
        while i < len(rows):
            if carry is not None:
                end = stay(lat, lon, carry, i)
                dwell[i:end], anchor[i:end] = np.where(np.isnan(time[i:end]), 0.0, time[i:end] - carry[2]), carry[3]
                if end == len(rows):
                    break
                i = end
            carry = None if np.isnan(time[i]) else (lat[i], lon[i], time[i], seq[i])
            i += 1
        return rows.assign(dwell=dwell, anchor=anchor), carry

    return sorted_scan(rows, step)


def stagnant_check(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Inside the movement window the track never stays within radius_m of an anchor for longer than dwell_ms."""
    return _of_all(df, _dwells(df, limits).groupBy("track_id").agg(F.max("dwell").alias("m")), "stagnant", limits.dwell_ms)


def health_checks(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return _judged(df, limits).unionByName(outlier_check(df, limits)).unionByName(stagnant_check(df, limits))


def health_flags(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """(track_id, check, start_seq, end_seq, measure): each point or span that a check blames, however many.

    Invalid points; points whose time goes back; poor fixes; speeds outside the envelope (the speed); outliers (the score);
    stays that are too long (the time); and where the longest stretch above the floor begins and ends.
    """
    marked = _marked(df, limits)
    point = lambda check, when, measure: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(check).alias("check"), F.col("seq").alias("start_seq"), F.col("seq").alias("end_seq"), measure.cast("double").alias("measure")))
    of_points = F.array_compact(F.array(
        point("schema-parse", F.col("_invalid"), F.lit(None)), point("time-order-span", F.col("_back"), F.col("time_ms")),
        point("gps-fix-quality", F.col("_poor"), F.coalesce("hdop", "sat")), point("speed-envelope", F.col("_outside"), F.col("speed_mps")),
    ))
    flags = marked.select("track_id", F.explode(of_points).alias("f")).select("track_id", "f.*")
    covered = _measured(marked, limits).filter(F.col("cover") >= limits.min_coverage).filter("run is not null")
    flags = flags.unionByName(covered.select("track_id", F.lit("altitude-profile").alias("check"), F.col("run.seq0").alias("start_seq"), F.col("run.seq1").alias("end_seq"), F.col("run.len").cast("double").alias("measure")))
    flags = flags.unionByName(_outliers(df, limits).filter("outlier").select("track_id", F.lit("outlier").alias("check"), F.col("seq").alias("start_seq"), F.col("seq").alias("end_seq"), F.col("score").alias("measure")))
    stays = _dwells(df, limits).groupBy("track_id", "anchor").agg(F.max("seq").alias("end_seq"), F.max("dwell").alias("measure")).filter(F.col("measure") > limits.dwell_ms)
    return flags.unionByName(stays.select("track_id", F.lit("stagnant").alias("check"), F.col("anchor").alias("start_seq"), "end_seq", "measure"))


def track_health(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """(track_id, score, blocked): checks that don't apply leave the denominator; a bad schema leaves no score."""
    counted = F.coalesce(F.col("applicable"), F.lit(False)) & (F.col("weight") > 0)
    g = health_checks(df, limits).groupBy("track_id").agg(F.sum(F.when(counted, F.col("weight"))).alias("total"), F.sum(F.when(counted & F.col("passed"), F.col("weight"))).alias("earned"), F.bool_or((F.col("check") == "schema-parse") & ~F.col("passed")).alias("blocked"))
    score = F.when(~F.col("blocked") & (F.col("total") > 0), F.floor(100 * F.coalesce("earned", F.lit(0)) / F.col("total") + 0.5))
    return g.select("track_id", score.cast("int").alias("score"), "blocked")
