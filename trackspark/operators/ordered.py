"""Filters over a track's order: smoothing, spikes, thinning, time repair, and quality events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..demo_tracks import by_seq, earlier, whole_track
from ..functions.geo import haversine, is_valid
from ..plans.chunks import Chunks
from ..plans.scan import sorted_scan
from .simplify import simplify  # noqa: F401


def sort_by_time(df: DataFrame) -> DataFrame:
    """seq anew by time, untimed last; ties keep their order."""
    order = Window.partitionBy("track_id").orderBy(F.col("time_ms").asc_nulls_last(), "seq")
    return df.withColumn("seq", (F.row_number().over(order) - 1).cast("bigint"))


def smooth(df: DataFrame, window: int, coords: bool = True, elevation: bool = True) -> DataFrame:
    """Centred moving average over rows: positions as unit vectors, heights over those that have one."""
    half = max(1, int(window)) // 2
    near = by_seq().rowsBetween(-half, half)
    lat, lon = F.radians("lat"), F.radians("lon")
    out = df
    if coords:
        out = out.withColumns({"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)})
        out = out.withColumns({c: F.avg(c).over(near) for c in ("_x", "_y", "_z")} | ({"_e": F.avg("ele").over(near)} if elevation else {}))
        out = out.withColumns({"lat": F.degrees(F.atan2(F.col("_z"), F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2))), "lon": F.degrees(F.atan2(F.col("_y"), F.col("_x")))}).drop("_x", "_y", "_z")
    elif elevation:
        out = out.withColumn("_e", F.avg("ele").over(near))
    return out.withColumn("ele", F.when(F.col("ele").isNotNull(), F.col("_e"))).drop("_e") if elevation else out


def median_filter(df: DataFrame, window: int) -> DataFrame:
    """Rolling median of heights; missing ones stay missing."""
    half = max(1, int(window)) // 2
    return df.withColumn("ele", F.when(F.col("ele").isNotNull(), F.percentile("ele", 0.5).over(by_seq().rowsBetween(-half, half))))


def hampel(df: DataFrame, sigma: float = 3.0, window: int = 11) -> DataFrame:
    """Replaces heights far from the local median (in scaled median deviations) by it, flagged hampel_corrected.

    Needs five heights in the window and in the track. Where the deviation is 0, any difference is far.
    """
    radius = max(2, int(window) // 2)
    out = df.withColumn("_w", F.collect_list("ele").over(by_seq().rowsBetween(-radius, radius))).withColumn("_n", F.count("ele").over(whole_track()))
    out = out.withColumn("_m", _median(F.col("_w")))
    out = out.withColumn("_d", _median(F.transform("_w", lambda x: F.abs(x - F.col("_m")))))
    far = F.when(F.col("_d") == 0, F.col("ele") != F.col("_m")).otherwise(F.abs(F.col("ele") - F.col("_m")) / (1.4826 * F.col("_d")) > sigma)
    hit = F.coalesce((F.col("_n") >= 5) & (F.size("_w") >= 5) & F.col("ele").isNotNull() & far, F.lit(False))
    out = out.withColumn("_hit", hit)
    return out.withColumns({"ele": F.when(F.col("_hit"), F.col("_m")).otherwise(F.col("ele")), "flags": F.when(F.col("_hit"), F.array_union("flags", F.array(F.lit("hampel_corrected")))).otherwise(F.col("flags"))}).drop("_w", "_n", "_m", "_d", "_hit")


def _median(values):
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def decimate(df: DataFrame, factor: int) -> DataFrame:
    """Every factor-th row of a track, and its last."""
    f = max(1, int(factor))
    out = df.withColumns({"_i": F.row_number().over(by_seq()) - 1, "_n": F.count("*").over(whole_track()) - 1})
    return out.filter((F.col("_i") % f == 0) | (F.col("_i") == F.col("_n"))).drop("_i", "_n")


def dedupe(df: DataFrame, tolerance_m: float = 0.0) -> DataFrame:
    """Drops points within the tolerance of the last kept one. Exact copies by a lag; else by a sorted scan."""
    if tolerance_m == 0:
        d = haversine(F.lag("lat").over(by_seq()), F.lag("lon").over(by_seq()), F.col("lat"), F.col("lon"))
        return df.withColumn("_d", d).filter("_d is null or _d > 0").drop("_d")

    def step(rows: pd.DataFrame, carry):
        lat, lon = np.radians(rows["lat"].to_numpy(float)), np.radians(rows["lon"].to_numpy(float))
        keep = np.zeros(len(rows), bool)
        for i, (a, b) in enumerate(zip(lat, lon, strict=True)):
            if carry is not None:
                h = np.sin((a - carry[0]) / 2) ** 2 + np.cos(a) * np.cos(carry[0]) * np.sin((b - carry[1]) / 2) ** 2
                if 2 * 6371008.8 * np.arcsin(min(1.0, np.sqrt(h))) <= tolerance_m:
                    continue
            carry, keep[i] = (a, b), True
        return rows[keep], carry

    return sorted_scan(df, step)


def ema(df: DataFrame, alpha: float) -> DataFrame:
    """Causal exponential average of heights; missing ones stay; changed ones are flagged ema_smoothed."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")

    def step(rows: pd.DataFrame, carry):
        ele, out = rows["ele"].to_numpy(float), rows["ele"].to_numpy(float).copy()
        for i, x in enumerate(ele):
            if not np.isnan(x):
                carry = x if carry is None else alpha * x + (1 - alpha) * carry
                out[i] = carry
        hit = ~np.isnan(ele) & (out != ele)
        flags = [list(dict.fromkeys([*f, "ema_smoothed"])) if h else list(f) for f, h in zip(rows["flags"], hit, strict=True)]
        return rows.assign(ele=np.where(np.isnan(ele), None, out), flags=flags), carry

    return sorted_scan(df, step)


def dejitter(df: DataFrame, policy: str = "nudge", epsilon_ms: float = 1.0) -> DataFrame:
    """Strictly rising times over the timed rows.

    drop: a row not above all before it goes. nudge: it is moved epsilon_ms behind the row before, and flagged
    time_dejittered; in closed form for 1 ms and whole milliseconds, else by a sorted scan. average: it is merged into
    the last kept row, each number halving the weight of those before (longitudes as plain numbers), text and others
    as the first has them.
    """
    if not epsilon_ms > 0:
        raise ValueError("epsilon_ms must be above 0")
    timed, rest = df.filter("time_ms is not null"), df.filter("time_ms is null")
    if policy == "nudge" and epsilon_ms != 1:

        def step(rows: pd.DataFrame, last):
            out = []
            for t in rows["time_ms"].tolist():
                last = t if last is None or t > last else last + epsilon_ms
                out.append(last)
            moved = rows["time_ms"].to_numpy() != np.array(out)
            flags = [list(dict.fromkeys([*f, "time_dejittered"])) if m else list(f) for f, m in zip(rows["flags"], moved, strict=True)]
            return rows.assign(time_ms=out, flags=flags), last

        return sorted_scan(timed, step).unionByName(rest)
    if policy == "nudge":
        i = (F.row_number().over(by_seq()) - 1).cast("double")
        out = timed.withColumn("_i", i).withColumn("_t", F.max(F.col("time_ms") - F.col("_i")).over(by_seq().rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i"))
        moved = F.col("_t") > F.col("time_ms")
        out = out.withColumn("flags", F.when(moved, F.array_union("flags", F.array(F.lit("time_dejittered")))).otherwise(F.col("flags")))
        return out.withColumn("time_ms", F.col("_t")).drop("_i", "_t").unionByName(rest)
    kept = timed.withColumn("_top", F.max("time_ms").over(earlier())).withColumn("_keep", F.col("_top").isNull() | (F.col("time_ms") > F.col("_top"))).drop("_top")
    if policy == "drop":
        return kept.filter("_keep").drop("_keep").unionByName(rest)
    if policy != "average":
        raise ValueError("policy must be nudge, drop or average")
    group = F.sum(F.col("_keep").cast("int")).over(by_seq().rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("_g", group)
    inside = Window.partitionBy("track_id", "_g")
    kept = kept.withColumns({"_k": F.row_number().over(inside.orderBy("seq")) - 1, "_n": F.count("*").over(inside)})
    weight = F.pow(F.lit(2.0), F.when(F.col("_k") == 0, 1.0 - F.col("_n")).otherwise(F.col("_k") - F.col("_n")))
    kept = kept.withColumn("_w", weight)
    values = [c for c, kind in df.dtypes if kind == "double" and c != "time_ms"]
    mean = lambda c: F.sum(F.col(c) * F.col("_w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))
    merged = kept.groupBy("track_id", "_g").agg(F.min("seq").alias("seq"), F.min_by("time_ms", "seq").alias("time_ms"), F.count("*").alias("_n"), F.min_by("flags", "seq").alias("flags"), *(mean(c).alias(c) for c in values), *(F.min_by(c, "seq").alias(c) for c in df.columns if c not in ("track_id", "seq", "time_ms", "flags", *values)))
    merged = merged.withColumn("flags", F.when(F.col("_n") > 1, F.array_union("flags", F.array(F.lit("time_dejittered")))).otherwise(F.col("flags")))
    return merged.select(*df.columns).unionByName(rest)


def quality_events(df: DataFrame, gap_ms: float = 5000, jump_m: float = 10000, jump_ms: float = 5000, spike_m: float = 100, flat_run: int = 5, chunk: int | None = None) -> DataFrame:
    """(track_id, kind, severity, start_seq, end_seq, start_time, end_time, measure) of quality events.

    An invalid row has neither duplicate, gap nor jump; a jump needs a valid row before it and an interval
    from 0 to jump_ms. Spikes reverse within one row; flatlines are runs of equal heights.
    """
    here = F.struct("seq", "lat", "lon", "ele", "time_ms")
    cut = Chunks(df, size=chunk)
    out = cut.carry(cut.rows, _end=(cut.last(here), "previous"), _begin=(cut.first(F.struct("ele")), "next"), _n=(F.count("*"), "sum"))
    out = out.withColumns({"_row": F.coalesce(F.lag(here).over(cut.window()), "_end"), "_next": F.coalesce(F.lead(F.struct("ele")).over(cut.window()), "_begin")["ele"], "_i": F.coalesce("_n", F.lit(0)) + F.row_number().over(cut.window())})
    out = out.withColumns({f"_{c}": F.col(f"_row.{c}") for c in ("seq", "lat", "lon", "ele", "time_ms")})
    out = out.withColumns({"_ok": is_valid(F.col("lat"), F.col("lon")), "_fresh": ~F.coalesce(F.col("ele") == F.col("_ele"), F.lit(False))})
    # The start of the run of equal heights that a row is in; a run ends where the next height differs.
    out = out.withColumn("_opens", F.when(F.col("_fresh"), F.struct("seq", "time_ms", "_i")))
    out = cut.carry(out, _open=(cut.latest("_opens"), "last"))
    start = F.coalesce(F.last("_opens", ignorenulls=True).over(cut.so_far()), "_open")
    out = out.withColumns({"_run": start, "_ends": ~F.coalesce(F.col("ele") == F.col("_next"), F.lit(False))})
    out = out.withColumns({"_dt": F.col("time_ms") - F.col("_time_ms"), "_was": is_valid(F.col("_lat"), F.col("_lon"))})
    out = out.withColumn("_far", haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    up, down = F.col("ele") - F.col("_ele"), F.col("_next") - F.col("ele")

    def event(when, kind, severity, span, measure):
        a, ta = ("_seq", "_time_ms") if span else ("seq", "time_ms")
        row = F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col(a).alias("start_seq"), F.col("seq").alias("end_seq"), F.col(ta).alias("start_time"), F.col("time_ms").alias("end_time"), measure.cast("double").alias("measure"))
        return F.when(F.coalesce(when, F.lit(False)), row)

    valid = F.col("_ok")
    length = F.col("_i") - F.col("_run._i") + 1
    flat = F.struct(F.lit("elevation-flatline").alias("kind"), F.lit("info").alias("severity"), F.col("_run.seq").alias("start_seq"), F.col("seq").alias("end_seq"), F.col("_run.time_ms").alias("start_time"), F.col("time_ms").alias("end_time"), length.cast("double").alias("measure"))
    found = F.array_compact(F.array(
        F.when(F.col("_ends") & F.col("ele").isNotNull() & (length >= flat_run), flat),
        event(~valid, "invalid-coordinate", "error", False, F.lit(None)),
        event(valid & (F.col("_dt") == 0), "duplicate-timestamp", "warning", False, F.col("time_ms")),
        event(valid & (F.col("_dt") > gap_ms), "gap", "warning", True, F.col("_dt")),
        event(valid & F.col("_was") & F.col("_dt").between(0, jump_ms) & (F.col("_far") > jump_m), "coordinate-jump", "error", True, F.col("_far")),
        event(((up > 0) != (down > 0)) & (F.abs(up) > spike_m) & (F.abs(down) > spike_m) & (F.abs(F.col("_next") - F.col("_ele")) < spike_m), "elevation-spike", "warning", False, F.abs(up)),
    ))
    return out.select("track_id", F.explode(found).alias("e")).select("track_id", "e.*")


def events_overlapping(events: DataFrame, start: int, end: int) -> DataFrame:
    a, b = sorted((start, end))
    return events.filter((F.col("start_seq") <= b) & (F.col("end_seq") >= a))


def events_overlapping_time(events: DataFrame, start_ms: float, end_ms: float) -> DataFrame:
    """Events whose times, both known, meet a time range, in either order."""
    a, b = sorted((float(start_ms), float(end_ms)))
    return events.filter((F.col("start_time") <= b) & (F.col("end_time") >= a))


def event_source_points(events: DataFrame) -> DataFrame:
    """(track_id, seq) that events cover."""
    return events.select("track_id", F.explode(F.sequence("start_seq", "end_seq")).alias("seq")).distinct()
