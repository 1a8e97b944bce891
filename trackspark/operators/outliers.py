"""Outliers in position, height and speed, and repair within what a vehicle can do: refits of runs and of gaps."""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..demo_tracks import by_seq, whole_track
from ..functions.cubic import MonotoneCubic
from ..functions.geo import EARTH_RADIUS_M, bearing, haversine, shortest_delta
from ..plans.chunks import Chunks
from ..plans.folders import held
from .edit import is_synthesized
from .kinematics import is_angular, median_sample_interval, point_speeds

CHANNELS = ("position", "elevation", "speed")
MAD_TO_SIGMA = 1.4826


@dataclass(frozen=True)
class Profile:
    """Limits of a vehicle: metres a second, metres a second up or down, degrees a second, metres a second squared."""

    speed: float
    vertical: float
    turn: float
    accel: float
    spline: bool = True


#: Fixed values.
PROFILES = {
    "aircraft": Profile(680, 100, 30, 30),
    "ground": Profile(100, 20, 90, 15),
    "marine": Profile(40, 2, 20, 5),
    "unconstrained": Profile(inf, inf, inf, inf, spline=False),
}


def _limits(profile: str | Profile) -> Profile:
    """A profile by name, or one's own."""
    return profile if isinstance(profile, Profile) else PROFILES[profile]


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def turn_floor(df: DataFrame, turn_rate_dps: float, window: int, top_speed: float = inf) -> DataFrame:
    """(track_id, floor_m): the position residual that a steady turn gives at the track's top speed and median interval.

    A turn at that rate is laid out as points of equal steps; the floor is the residual of its middle point against
    the medians of window points on either side. 0 where speed, interval or rate aren't known or positive.
    """
    if not (0 < turn_rate_dps < inf) or window < 1:
        return df.select("track_id").distinct().withColumn("floor_m", F.lit(0.0))
    speeds = point_speeds(df).filter("speed_mps > 0 and speed_mps < double('infinity')").groupBy("track_id").agg(F.least(F.max("speed_mps"), F.lit(float(top_speed))).alias("v"))
    rows = df.select("track_id").distinct().join(speeds, "track_id", "left").join(median_sample_interval(df), "track_id", "left")
    half = F.radians(F.lit(float(turn_rate_dps)) * F.col("median_interval_s")) / 2
    step = F.col("v") * F.col("median_interval_s")

    def places(low: int, high: int, f) -> Column:
        """Sum of cosines (or sines) of the first i multiples of the turn of a step, for i from low to high."""
        ratio = lambda i: F.when(F.abs(F.sin(half)) < 1e-15, i.cast("double")).otherwise(F.sin(i * half) / F.sin(half))
        return F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: ratio(i) * f((i + 1) * half) * step)

    center = window + 1
    bx, by = (_median(places(1, window, f)) for f in (F.cos, F.sin))
    fx, fy = (_median(places(center + 1, center + window, f)) for f in (F.cos, F.sin))
    cx, cy = (F.get(places(center, center, f), F.lit(0)) for f in (F.cos, F.sin))
    far = lambda ax, ay, x, y: F.sqrt((ax - x) ** 2 + (ay - y) ** 2)
    excess = (far(cx, cy, bx, by) + far(cx, cy, fx, fy) - far(bx, by, fx, fy)) / 2
    return rows.select("track_id", F.greatest(F.lit(0.0), F.coalesce(excess, F.lit(0.0))).alias("floor_m"))


def detect_outliers(df: DataFrame, window: int = 5, threshold: float = 3.0, position_floor: float = 1.0, elevation_floor: float = 1.0, speed_floor: float = 0.5, channels: tuple[str, ...] = CHANNELS, floors: DataFrame | None = None) -> DataFrame:
    """(track_id, seq, channel, score, outlier) of points with window rows on either side that weren't made up.

    A residual is how far a point is off what the medians of the rows on either side predict: half the detour over
    both median positions, or the difference from their midpoint for height and speed (medians of what is known).
    It is scaled by the track's scaled median absolute deviation, the floor of the channel and, for height, the
    median step between different heights, whichever is largest. The score is the largest of the chosen channels,
    the first of CHANNELS if several are. floors (track_id, floor_m) raises the position floor.
    """
    if not set(channels) <= set(CHANNELS) or not channels:
        raise ValueError(f"channels are some of {', '.join(CHANNELS)}")
    w = max(1, int(window))
    rows = point_speeds(df).withColumn("_made", F.coalesce(is_synthesized(), F.lit(False)))
    whole = whole_track()
    steps = Window.partitionBy("track_id").orderBy("ele")
    rows = rows.withColumn("_rise", F.col("ele") - F.lag("ele").over(steps))
    rows = rows.withColumn("_step", F.percentile(F.when((F.col("_rise") > 0) & (F.abs("ele") < 1.7e308), F.col("_rise")), 0.5).over(whole))
    here = F.struct("lat", "lon", "ele", "speed_mps")
    rows = rows.select("track_id", "seq", "lat", "lon", "ele", "speed_mps", "_made", "_step", F.collect_list(here).over(by_seq().rowsBetween(-w, -1)).alias("_a"), F.collect_list(here).over(by_seq().rowsBetween(1, w)).alias("_b"))
    rows = rows.filter((F.size("_a") == w) & (F.size("_b") == w) & ~F.col("_made"))
    middle = lambda side, c: _median(F.array_compact(F.transform(side, lambda p: p[c])))
    rows = rows.withColumns({f"_{s}_{c}": middle(f"_{s}", c) for s in "ab" for c in ("lat", "lon", "ele", "speed_mps")}).drop("_a", "_b")
    a, b, p = ((F.col(f"{s}lat"), F.col(f"{s}lon")) for s in ("_a_", "_b_", ""))
    detour = F.greatest(F.lit(0.0), (haversine(*p, *a) + haversine(*p, *b) - haversine(*a, *b)) / 2)
    off = lambda c: F.col(c) - (F.col(f"_a_{c}") + F.col(f"_b_{c}")) / 2
    rows = rows.select("track_id", "seq", "_step", detour.alias("position"), off("ele").alias("elevation"), off("speed_mps").alias("speed"))
    finite = lambda c: F.when(F.abs(c) < 1.7e308, F.col(c))
    rows = rows.withColumns({f"_m_{c}": F.percentile(finite(c), 0.5).over(whole) for c in CHANNELS})
    rows = rows.withColumns({f"_d_{c}": F.percentile(F.abs(finite(c) - F.col(f"_m_{c}")), 0.5).over(whole) for c in CHANNELS})
    floor = {"position": F.lit(float(position_floor)), "elevation": F.greatest(F.lit(float(elevation_floor)), F.coalesce("_step", F.lit(0.0))), "speed": F.lit(float(speed_floor))}
    if floors is not None:
        rows = rows.join(floors.select("track_id", "floor_m"), "track_id", "left")
        floor["position"] = F.greatest(floor["position"], F.coalesce("floor_m", F.lit(0.0)))
    score = {c: F.abs(c) / F.greatest(F.coalesce(F.col(f"_d_{c}") * MAD_TO_SIGMA, F.lit(0.0)), floor[c]) for c in CHANNELS if c in channels}
    rows = rows.withColumns({f"_s_{c}": F.coalesce(F.nanvl(x, F.lit(None)), F.lit(0.0)) for c, x in score.items()})
    best = F.greatest(*(F.col(f"_s_{c}") for c in score), F.lit(0.0))
    known = F.coalesce(*(F.when(F.col(c).isNotNull(), c) for c in score), F.lit("position"))
    name = F.coalesce(*(F.when((F.col(f"_s_{c}") == F.col("score")) & (F.col("score") > 0), c) for c in score), known)
    return rows.withColumn("score", best).select("track_id", "seq", name.alias("channel"), "score", (F.col("score") > threshold).alias("outlier"))


def profile_violations(df: DataFrame, profile: str | Profile = "aircraft") -> DataFrame:
    """(track_id, seq, limit, value, bound): the first step of each track, in order, that breaks a limit of the profile.

    Of one step speed counts first, then vertical speed, acceleration and turn rate. Steps without time that passes
    are left out; a step of no length forgets the direction.
    """
    limits = _limits(profile)
    was = {f"_{c}": F.lag(c).over(by_seq()) for c in ("lat", "lon", "ele", "time_ms")}
    rows = df.select("track_id", "seq", "lat", "lon", "ele", "time_ms").withColumns(was)
    rows = rows.withColumn("_dt", (F.col("time_ms") - F.col("_time_ms")) / 1000).filter("_dt > 0")
    d = haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    rows = rows.withColumn("_d", d).withColumns({"_v": F.col("_d") / F.col("_dt"), "_h": F.when(F.col("_d") != 0, bearing(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))})
    rows = rows.withColumns({"_pv": F.lag("_v").over(by_seq()), "_ph": F.lag("_h").over(by_seq())})
    tests = (
        ("ground speed", F.col("_v"), limits.speed),
        ("vertical speed", F.abs(F.col("ele") - F.col("_ele")) / F.col("_dt"), limits.vertical),
        ("acceleration", F.abs(F.col("_v") - F.col("_pv")) / F.col("_dt"), limits.accel),
        ("turn rate", F.abs(shortest_delta(F.col("_ph"), F.col("_h"))) / F.col("_dt"), limits.turn),
    )
    broken = F.coalesce(*(F.when(x > bound, F.struct(F.lit(name).alias("limit"), x.alias("value"), F.lit(float(bound)).alias("bound"))) for name, x, bound in tests))
    rows = rows.withColumn("x", broken).filter("x is not null")
    return rows.groupBy("track_id").agg(F.min("seq").alias("seq"), F.min_by("x", "seq").alias("x")).select("track_id", "seq", "x.*")


def _steps(lat: np.ndarray, lon: np.ndarray):
    a, o = np.radians(lat), np.radians(lon)
    turn = np.diff(o)
    h = np.sin(np.diff(a) / 2) ** 2 + np.cos(a[:-1]) * np.cos(a[1:]) * np.sin(turn / 2) ** 2
    heading = np.degrees(np.arctan2(np.sin(turn) * np.cos(a[1:]), np.cos(a[:-1]) * np.sin(a[1:]) - np.sin(a[:-1]) * np.cos(a[1:]) * np.cos(turn)))
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(h))), heading % 360


def breaks_profile(time: np.ndarray, lat: np.ndarray, lon: np.ndarray, ele: np.ndarray, limits: Profile) -> str | None:
    """The first limit that a sequence of rising times breaks. ele: NaN where there is none."""
    dt = np.diff(time) / 1000
    d, heading = _steps(lat, lon)
    speed = d / dt
    turn = np.abs((np.diff(heading) + 540) % 360 - 180) / dt[1:]
    turn[(d[1:] == 0) | (d[:-1] == 0)] = 0
    with np.errstate(invalid="ignore"):
        tests = np.stack([speed > limits.speed, np.abs(np.diff(ele)) / dt > limits.vertical, np.r_[False, np.abs(np.diff(speed)) / dt[1:] > limits.accel], np.r_[False, turn > limits.turn]])
    if not tests.any():
        return None
    return ("ground speed", "vertical speed", "acceleration", "turn rate")[int(tests[:, tests.any(axis=0).argmax()].argmax())]


def _fitted(x: np.ndarray, y: np.ndarray, times: np.ndarray, angle: bool) -> np.ndarray:
    if angle:
        y = y[0] + np.concatenate([[0], np.cumsum((np.diff(y) + 540) % 360 - 180)])
    return MonotoneCubic(x, y)(times)


def refit(knots: list, times: np.ndarray, channels: list[str], limits: Profile, left, right):
    """(values of lat, lon, ele and channels at times, and of ext_num if knots have it; or None), and the limit broken. knots: rows with time_ms and values in order.

    Of a map's channels those are fitted that every knot has; angles the short way round.
    """
    if not limits.spline:
        knots = [left, right]
    x = np.array([k["time_ms"] for k in knots])
    out = {}
    for c in ("lat", "lon", "ele", *channels):
        y = np.array([np.nan if k[c] is None else k[c] for k in knots], float)
        if np.isnan(y).any():
            out[c] = np.full(len(times), np.nan)  # no knot may lack it
            continue
        y = _fitted(x, y, times, c == "lon" or is_angular(c))
        out[c] = (y + 540) % 360 - 180 if c == "lon" else y % 360 if is_angular(c) else y
    edge = lambda c: np.r_[np.nan if left[c] is None else left[c], out[c], np.nan if right[c] is None else right[c]].astype(float)
    why = breaks_profile(np.r_[left["time_ms"], times, right["time_ms"]], edge("lat"), edge("lon"), edge("ele"), limits)
    if why:
        return None, why
    if "ext_num" in knots[0]:
        maps = [{c: v for c, v in dict(k["ext_num"] or {}).items() if v is not None and not np.isnan(v)} for k in knots]
        shared = [c for c in maps[0] if all(c in m for m in maps)]
        fits = {c: _fitted(x, np.array([m[c] for m in maps], float), times, is_angular(c)) for c in shared}
        out["ext_num"] = [{c: float(y[i] % 360 if is_angular(c) else y[i]) for c, y in fits.items()} for i in range(len(times))]
    return out, why


def _places(df: DataFrame, values: list[str], chunk: int | None) -> tuple[DataFrame, Chunks]:
    """(track_id, seq, _p, _was, _made, _before, _upto, _place, _rises), and how tracks are cut: rows with those values, the seq and values of the row before, and how many points that weren't made up lie before it and up to it.

    The rows are written once, and windows over them see a chunk of a track; so a task holds no track.
    """
    made = F.coalesce(is_synthesized(), F.lit(False))
    rows = held(df.select("track_id", "seq", F.struct(*values).alias("_p"), made.alias("_made")))
    cut = Chunks(rows, size=chunk)
    here, known = F.struct("seq", "_p", "_made"), (~F.col("_made")).cast("bigint")
    rows = cut.carry(cut.rows, _c_was=(cut.last(here), "previous"), _c_known=(F.sum(known), "sum"), _c_rows=(F.count("*"), "sum"))
    w, upto = cut.window(), cut.so_far()
    rows = rows.withColumn("_was", F.coalesce(F.lag(here).over(w), "_c_was"))
    rows = rows.withColumns({"_upto": F.sum(known).over(upto) + F.coalesce("_c_known", F.lit(0)), "_place": F.row_number().over(w) + F.coalesce("_c_rows", F.lit(0))})
    t = F.col("_p.time_ms")
    rows = rows.withColumns({"_before": F.col("_upto") - known, "_rises": F.coalesce(t > F.col("_was._p.time_ms"), F.col("_was").isNull()) & t.isNotNull()})
    return held(rows.select("track_id", "seq", "_p", "_was", "_made", "_before", "_upto", "_place", "_rises")), cut


def _with_knots(asked: DataFrame, places: DataFrame, key: str, count: int) -> DataFrame:
    """asked (track_id, key, _low, _high, ...) with back and ahead, lists of (rank, p): the last count points of the first _low that weren't made up, and the first count behind the first _high; and timed.

    Points are joined by their rank in the track, so that only what is asked for is gathered.
    """
    asked = held(asked)
    span = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    many = F.lit(count).cast("bigint")
    ranks = F.concat(span(F.greatest(F.lit(1).cast("bigint"), F.col("_low") - many + 1), F.col("_low")), span(F.col("_high") + 1, F.col("_high") + many))
    wanted = asked.select(F.col("track_id").alias("_of"), F.col(key).alias("_key"), F.col("_low").alias("_least"), F.explode(ranks).alias("_rank"))
    known = places.filter("not _made").select("track_id", "_upto", "_p")
    found = known.join(wanted, F.col("track_id").eqNullSafe(F.col("_of")) & (F.col("_upto") == F.col("_rank")))
    point, behind = F.struct(F.col("_rank").alias("rank"), F.col("_p").alias("p")), F.col("_rank") <= F.col("_least")
    found = found.groupBy("_of", "_key").agg(F.collect_list(F.when(behind, point)).alias("back"), F.collect_list(F.when(~behind, point)).alias("ahead"))
    timed = places.groupBy(F.col("track_id").alias("_track")).agg(F.bool_and("_rises").alias("timed"))
    out = asked.join(found, F.col("track_id").eqNullSafe(F.col("_of")) & (F.col(key) == F.col("_key")), "left").drop("_of", "_key")
    return out.join(timed, F.col("track_id").eqNullSafe(F.col("_track")), "left").drop("_track")


def _values(df: DataFrame, channels: list[str] | None) -> list[str]:
    kinds = dict(df.dtypes)
    found = [c for c in (channels or ("hdop", "sat")) if kinds.get(c) == "double"]
    return ["time_ms", "lat", "lon", "ele", *found, *["ext_num"] * ("ext_num" in kinds)]


def _numbers(values: list[str]) -> list[str]:
    """Of values those that are columns of numbers."""
    return [c for c in values if c != "ext_num"]


def _type(value: str) -> str:
    return "map<string,double>" if value == "ext_num" else "double"


def _column(got: dict, value: str) -> list:
    return got[value] if value == "ext_num" else _plain(got[value])


def gap_fills(df: DataFrame, gap_ms: float, sample_ms: float, context: int = 4, profile: str | Profile = "aircraft", channels: list[str] | None = None, chunk: int | None = None) -> DataFrame:
    """(track_id, start_seq, end_seq, start_ms, end_ms, reason, points) of each interval above gap_ms.

    points are what fills it, each sample_ms strictly inside, from a monotone cubic through both ends and up to
    context - 1 points on either side that weren't made up; none, with the reason, if that breaks the profile, or
    if the track's times aren't all there and rising. A value is fitted only if each knot has it.
    """
    return _gap_fills(df, gap_ms, sample_ms, context, profile, channels, chunk)[0]


def _gap_fills(df: DataFrame, gap_ms: float, sample_ms: float, context: int, profile: str | Profile, channels: list[str] | None, chunk: int | None) -> tuple[DataFrame, Chunks]:
    """gap_fills, and how tracks were cut."""
    if not (0 < sample_ms <= gap_ms) or context < 2:
        raise ValueError("sample_ms must be above 0 and not above gap_ms, context 2 or more")
    limits, values = _limits(profile), _values(df, channels)
    places, cut = _places(df, values, chunk)
    gaps = places.filter(F.col("_p.time_ms") - F.col("_was._p.time_ms") > gap_ms)
    # Knots lie behind the left end and ahead of the right one.
    low = F.col("_before") - F.lit(1) + F.col("_was._made").cast("bigint")
    gaps = gaps.select("track_id", F.col("_was.seq").alias("start_seq"), F.col("seq").alias("end_seq"), F.col("_was._p").alias("left"), F.col("_p").alias("right"), low.alias("_low"), F.col("_upto").alias("_high"))
    gaps = _with_knots(gaps, places, "end_seq", context - 1).drop("_low", "_high")
    point = "array<struct<" + ",".join(f"{c}:{_type(c)}" for c in values) + ">>"

    def fill(batches):
        for batch in batches:
            reasons, found = [], []
            for r in batch.to_dict("records"):
                times = np.arange(r["left"]["time_ms"] + sample_ms, r["right"]["time_ms"], sample_ms)
                times = times[times < r["right"]["time_ms"]]
                got, why = (None, "times don't rise") if not r["timed"] else refit([*(_list(r["back"])), r["left"], r["right"], *_list(r["ahead"])], times, _numbers(values)[4:], limits, r["left"], r["right"])
                reasons.append(why)
                found.append([] if got is None else [dict(zip(values, (t, *v), strict=True)) for t, *v in zip(times.tolist(), *(_column(got, c) for c in values[1:]), strict=True)])
            yield pd.DataFrame({"track_id": batch["track_id"], "start_seq": batch["start_seq"], "end_seq": batch["end_seq"], "start_ms": [x["time_ms"] for x in batch["left"]], "end_ms": [x["time_ms"] for x in batch["right"]], "reason": reasons, "points": found})

    return gaps.mapInPandas(fill, f"track_id string, start_seq bigint, end_seq bigint, start_ms double, end_ms double, reason string, points {point}"), cut


def _list(x) -> list:
    """Points of (rank, p) by rank."""
    return [] if x is None else [k["p"] for k in sorted(x, key=lambda k: k["rank"])]


def _plain(x: np.ndarray) -> list:
    return [None if np.isnan(v) else float(v) for v in x]


def fill_gaps(df: DataFrame, gap_ms: float, sample_ms: float, context: int = 4, profile: str | Profile = "aircraft", channels: list[str] | None = None, chunk: int | None = None) -> DataFrame:
    """df with gap_fills among its points, flagged interpolated, and seq counted anew; other columns of them are null, lists and maps empty.

    Channels that are columns are those named, hdop and sat if none are; of the map ext_num all that the knots of a gap share.
    """
    values = _values(df, channels)
    fills, cut = _gap_fills(df, gap_ms, sample_ms, context, profile, channels, chunk)
    new = fills.select("track_id", F.col("end_seq").alias("_before"), F.posexplode("points").alias("_i", "x"))
    kinds = dict(df.dtypes)
    column = lambda c: F.col(f"x.{c}") if c in values else F.array(F.lit("interpolated")) if c == "flags" else F.col("track_id") if c == "track_id" else (F.array() if kinds[c].startswith("array") else F.create_map() if kinds[c].startswith("map") else F.lit(None)).cast(kinds[c])
    new = new.select(*(column(c).alias(c) for c in df.columns if c != "seq"), F.col("_before").cast("bigint").alias("_spot"), F.lit(0).alias("_k"), F.col("_i").cast("bigint").alias("_i"))
    old = df.select(*(c for c in df.columns if c != "seq"), F.col("seq").cast("bigint").alias("_spot"), F.lit(1).alias("_k"), F.lit(0).cast("bigint").alias("_i"))
    cuts = Chunks(old.unionByName(new), "_spot", chunk, cut)
    cuts.by = ["_spot", "_k", "_i"]
    rows = cuts.carry(cuts.rows, _c_rows=(F.count("*"), "sum"))
    return rows.withColumn("seq", (F.row_number().over(cuts.window()) - 1 + F.coalesce("_c_rows", F.lit(0))).cast("bigint")).select(*df.columns)


def drop_outliers(df: DataFrame, profile: str | Profile = "aircraft", reconstruct: bool = True, context: int = 4, rng: tuple[int, int] | None = None, channels: list[str] | None = None, chunk: int | None = None, **detection) -> DataFrame:
    """df without its outliers, or with each run of them refitted in place, flagged interpolated.

    The position floor is widened for turns within the profile. Outliers are found over whole tracks; rng, a range
    of seq, tells which of them are acted on. A refit goes through up to context points on either side that weren't
    made up, at the run's own times; a run at an edge, one that would break the profile, and tracks whose times
    aren't all there and rising stay as they are. Names, times and other columns stay.
    """
    limits = _limits(profile)
    floors = turn_floor(df, limits.turn, int(detection.get("window", 5)), limits.speed)
    found = detect_outliers(df, floors=floors, **detection).filter("outlier").select("track_id", "seq")
    if rng is not None:
        found = found.filter(F.col("seq").between(min(rng), max(rng)))
    if not reconstruct:
        return df.join(found, ["track_id", "seq"], "left_anti")
    values = _values(df, channels)
    places, _ = _places(df, values, chunk)
    hits = places.select("track_id", "seq", F.col("_p.time_ms").alias("time_ms"), "_before", "_upto", "_place").join(found, ["track_id", "seq"])
    # Neighbours among the outliers: their places in the track rise as their numbers do.
    hits = hits.withColumn("_run", F.col("_place") - F.row_number().over(Window.partitionBy("track_id").orderBy("_place")))
    runs = hits.groupBy("track_id", "_run").agg(F.min_by("_before", "seq").alias("_low"), F.max_by("_upto", "seq").alias("_high"), F.sort_array(F.collect_list(F.struct("seq", "time_ms"))).alias("run"))
    runs = _with_knots(runs, places, "_run", context).drop("_low", "_high")
    new = ", ".join(f"n_{c} {_type(c)}" for c in values[1:])

    def repair(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                back, ahead = _list(r["back"]), _list(r["ahead"])
                if not r["timed"] or not back or not ahead:
                    continue
                times = np.array([p["time_ms"] for p in r["run"]])
                got, _ = refit([*back, *ahead], times, _numbers(values)[4:], limits, back[-1], ahead[0])
                if got is not None:
                    out += [(r["track_id"], p["seq"], *v) for p, *v in zip(r["run"], *(_column(got, c) for c in values[1:]), strict=True)]
            yield pd.DataFrame(out, columns=["track_id", "seq", *(f"n_{c}" for c in values[1:])])

    fixed = runs.mapInPandas(repair, f"track_id string, seq bigint, {new}").withColumn("_fixed", F.lit(True))
    out = df.join(fixed, ["track_id", "seq"], "left")
    # A channel that a knot lacks stays; position and height are the fit's.
    merged = F.map_concat(F.map_filter(F.coalesce("ext_num", F.create_map().cast("map<string,double>")), lambda k, _: ~F.map_contains_key("n_ext_num", k)), "n_ext_num") if "ext_num" in values else None
    pick = lambda c: F.when(F.col("_fixed"), F.col(f"n_{c}") if c in ("lat", "lon", "ele") else merged if c == "ext_num" else F.coalesce(f"n_{c}", c)).otherwise(F.col(c))
    flags = F.when(F.col("_fixed"), F.array(F.lit("interpolated"))).otherwise(F.col("flags"))
    return out.withColumns({c: pick(c) for c in values[1:]} | {"flags": flags}).select(*df.columns)
