"""Resampling onto grids, and repair by removing or filling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cubic import limited
from ..functions.geo import haversine, lerp, lerp_lon, shortest_delta
from ..plans.scan import sorted_scan
from ..schema import conform, number_map
from .kinematics import is_angular


def by_time():
    return Window.partitionBy("track_id").orderBy("time_ms")


def resample_fixed_rate(df: DataFrame, rate_hz: float, mode: str = "linear", max_gap_ms: float | None = None, duplicates: str = "refuse") -> DataFrame:
    """df's columns on a grid from the first to the last time of each track; seq anew.

    The last point is added if it is off the grid. Each interval between neighbours explodes its own grid instants, so
    there is no join. In an interval above max_gap_ms only its ends stay. Grid points that are samples stay as they are;
    others have the flags of both sides and interpolated. Numbers are interpolated, longitude the short way round; where
    one side lacks a value, and for names and other columns, the left value counts, else the right one. step mode keeps
    the left values. Points without time are left out. Equal times are refused when the job runs, or the first stays.
    """
    if not 0 < rate_hz <= 1000 or mode not in ("linear", "step") or duplicates not in ("refuse", "first"):
        raise ValueError("rate_hz must be above 0 and 1000 at most, mode linear or step, duplicates refuse or first")
    delta = 1000.0 / rate_hz
    kinds = dict(df.dtypes)
    columns = [c for c in df.columns if c not in ("track_id", "seq", "time_ms", "flags")]
    whole = Window.partitionBy("track_id")
    by_place = Window.partitionBy("track_id").orderBy("time_ms", "seq")
    timed = df.filter("time_ms is not null").withColumn("_same", F.lag("time_ms").over(by_place) == F.col("time_ms"))
    if duplicates == "first":
        timed = timed.filter("_same is null or not _same")
    else:
        refused = F.raise_error(F.concat(F.lit("equal times in track "), F.col("track_id").cast("string"))).cast("double")
        timed = timed.withColumn("time_ms", F.when(F.coalesce("_same", F.lit(False)), refused).otherwise(F.col("time_ms")))
    flags = F.col("flags") if "flags" in df.columns else F.array().cast("array<string>")
    p = F.struct("time_ms", *columns, flags.alias("flags"))
    rows = timed.select("track_id", p.alias("b"), F.lag(p).over(by_place).alias("a"), F.min("time_ms").over(whole).alias("t0"), F.max("time_ms").over(whole).alias("t1"))
    n = F.floor((F.col("t1") - F.col("t0")) / delta) + 1
    low = F.greatest(F.lit(1), F.floor((F.col("a.time_ms") - F.col("t0")) / delta) - 1)
    high = F.least(n - 1, F.ceil((F.col("b.time_ms") - F.col("t0")) / delta) + 1)
    grid = F.when(F.col("a").isNull(), F.array(F.lit(0).cast("bigint"))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    instants = F.transform(grid, lambda k: F.least(F.col("t1"), F.col("t0") + k * delta))
    inside = F.filter(instants, lambda t: F.col("a").isNull() | ((F.col("a.time_ms") < t) & (t <= F.col("b.time_ms"))))
    last = F.when(F.col("b.time_ms") == F.col("t1"), F.array_union(inside, F.array("t1"))).otherwise(inside)
    if max_gap_ms is not None:
        last = F.filter(last, lambda t: F.col("a").isNull() | (F.col("b.time_ms") - F.col("a.time_ms") <= max_gap_ms) | (t == F.col("b.time_ms")))
    out = rows.select("track_id", "a", "b", F.explode(last).alias("t"))
    exact = F.col("t") == F.col("b.time_ms")
    ratio = (F.col("t") - F.col("a.time_ms")) / (F.col("b.time_ms") - F.col("a.time_ms"))

    def value(c: str):
        left, right = F.col(f"a.{c}"), F.col(f"b.{c}")
        if mode == "step":
            return F.when(exact, right).otherwise(left).alias(c)
        if kinds[c] == "map<string,double>":
            both = F.map_zip_with(F.coalesce(left, F.create_map().cast(kinds[c])), F.coalesce(right, F.create_map().cast(kinds[c])), lambda _, x, y: F.when(x.isNotNull() & y.isNotNull(), lerp(x, y, ratio)).otherwise(F.coalesce(x, y)))
            return F.when(exact, right).otherwise(both).alias(c)
        if kinds[c].startswith("map"):
            # The left entry of a key that both have.
            rest = F.map_filter(right, lambda k, _: ~F.map_contains_key(left, k))
            return F.when(exact, right).otherwise(F.when(left.isNull() | right.isNull(), F.coalesce(left, right)).otherwise(F.map_concat(left, rest))).alias(c)
        one = F.coalesce(left, right)
        if kinds[c] == "double":
            one = F.when(left.isNotNull() & right.isNotNull(), (lerp_lon if c == "lon" else lerp)(left, right, ratio)).otherwise(one)
        return F.when(exact, right).otherwise(one).alias(c)

    flags = F.when(exact, F.col("b.flags")).otherwise(F.array_union(F.array_union(F.coalesce("a.flags", F.array().cast("array<string>")), F.coalesce("b.flags", F.array().cast("array<string>"))), F.array(F.lit("interpolated"))))
    out = out.select("track_id", F.col("t").alias("time_ms"), *map(value, columns), flags.alias("flags"))
    out = out.withColumn("seq", (F.row_number().over(by_time()) - 1).cast("bigint"))
    return out.select(*df.columns, *(() if "flags" in df.columns else ("flags",)))


def notional_fill(df: DataFrame, gap_ms: float = 3000.0, sample_ms: float | None = None) -> DataFrame:
    """df with evenly spaced points, flagged notional, in intervals above gap_ms between neighbouring rows; seq anew.

    floor(duration / sample) - 1 points an interval, at times rounded to whole milliseconds, halves up. The sample is
    the track's median interval of those that are no gap, if none is given. New points have position, height where
    both sides do, time, flags, and where df has channel maps what they come from; other columns are null.
    """
    if not gap_ms > 0 or (sample_ms is not None and not sample_ms > 0):
        raise ValueError("gap_ms and sample_ms must be above 0")
    gaps = notional_gaps(df, gap_ms, sample_ms).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("inserted").cast("int"))))
    f = F.col("k") / (F.col("inserted") + 1)
    t = F.floor(F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * f + 0.5).cast("double")
    kinds = dict(df.dtypes)
    made = {
        "track_id": F.col("track_id"), "time_ms": t, "lat": lerp(F.col("a.lat"), F.col("b.lat"), f), "lon": lerp_lon(F.col("a.lon"), F.col("b.lon"), f), "ele": lerp(F.col("a.ele"), F.col("b.ele"), f), "flags": F.array(F.lit("notional")),
        "ext_num": F.create_map(F.lit("derived_from_gap_start"), F.col("start_ms"), F.lit("derived_from_gap_end"), F.col("end_ms")), "ext_str": F.create_map(F.lit("notional_method"), F.lit("linear_time")), "ext_bool": F.create_map(F.lit("notional"), F.lit(True)),
    }
    rest = [c for c in df.columns if c != "seq"]
    new = gaps.select(*(made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in rest), F.col("start_seq").cast("bigint").alias("_at"), F.col("k").cast("bigint").alias("_k"))
    old = df.select(*rest, F.col("seq").cast("bigint").alias("_at"), F.lit(0).cast("bigint").alias("_k"))
    order = Window.partitionBy("track_id").orderBy("_at", "_k")
    return old.unionByName(new).withColumn("seq", (F.row_number().over(order) - 1).cast("bigint")).select(*df.columns)


def notional_gaps(df: DataFrame, gap_ms: float = 3000.0, sample_ms: float | None = None) -> DataFrame:
    """(track_id, start_seq, end_seq, start_ms, end_ms, duration_ms, inserted, sample_ms, a, b) of the intervals that notional_fill fills."""
    w = Window.partitionBy("track_id").orderBy("seq")
    p = F.struct("time_ms", "lat", "lon", "ele")
    rows = df.select("track_id", "seq", p.alias("b"), F.lag("seq").over(w).alias("start_seq"), F.lag(p).over(w).alias("a"))
    dur = F.col("b.time_ms") - F.col("a.time_ms")
    if sample_ms is None:
        own = F.when((dur > 0) & (dur <= gap_ms), dur)
        rows = rows.withColumn("sample_ms", F.coalesce(F.percentile(own, 0.5).over(Window.partitionBy("track_id")), F.lit(float(gap_ms))))
    else:
        rows = rows.withColumn("sample_ms", F.lit(float(sample_ms)))
    rows = rows.filter(dur > gap_ms).withColumn("inserted", (F.floor(dur / F.col("sample_ms")) - 1).cast("bigint")).filter("inserted > 0")
    return rows.select("track_id", "start_seq", F.col("seq").alias("end_seq"), F.col("a.time_ms").alias("start_ms"), F.col("b.time_ms").alias("end_ms"), dur.alias("duration_ms"), "inserted", "sample_ms", "a", "b")


#: What a point made along the way takes from the nearer of its neighbours, where points have it.
CARRIED = ("name", "desc", "ext_num", "ext_str", "ext_bool")


def resample_by_distance(df: DataFrame, interval_m: float, channels: tuple[str, ...] = ("hdop", "sat")) -> DataFrame:
    """Points each so many metres along the valid points, and the last point: track_id, seq, distance_m, lat, lon, ele, time_ms, channels, what is carried, flags.

    Monotone cubics over the distance, points that coincide with the one before left out. channels are columns of df;
    of the map ext_num all are fitted that every point of the track has, angles the short way round. A channel is null
    throughout a track that lacks it anywhere, and so is a time that falls. Slopes come from neighbouring legs; the
    limiter runs over the legs in order. Names, texts and numbers that aren't fitted are those of the nearer point, the
    earlier of two. A track of one place gives that point, without flags. With the maps the result has all columns of points.
    """
    w, whole = Window.partitionBy("track_id").orderBy("seq"), Window.partitionBy("track_id")
    mapped = numeric_names(df) if "ext_num" in df.columns else []
    inner = {c: f"x{i}" for i, c in enumerate(mapped)}
    df = df.withColumns({x: F.col("ext_num")[c] for c, x in inner.items()})
    angles = [*(c for c in channels if c in df.columns and is_angular(c)), *(x for c, x in inner.items() if is_angular(c))]
    names = ["lat", "lon", "ele", "time_ms", *(c for c in channels if c in df.columns), *inner.values()]
    carried = [c for c in CARRIED if c in df.columns]
    rows = df.filter("lat between -90 and 90 and lon between -180 and 180")
    before = lambda c: F.lag(c).over(w)
    rows = rows.withColumn("_leg", haversine(before("lat"), before("lon"), F.col("lat"), F.col("lon"))).filter("_leg is null or _leg > 0")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    turns = ["lon", *angles]
    rows = rows.withColumns({f"_turn_{c}": F.coalesce(shortest_delta(before(c), F.col(c)), F.lit(0.0)) for c in turns})
    unwound = {c: F.when(F.col(c).isNotNull(), F.first(c).over(upto) + F.sum(f"_turn_{c}").over(upto)) for c in turns}
    rows = rows.withColumns(unwound | {"d1": F.sum(F.coalesce("_leg", F.lit(0.0))).over(upto)})
    rows = rows.select("track_id", "seq", "d1", F.struct(*carried).alias("own") if carried else F.lit(None).alias("own"), *(F.col(c).cast("double").alias(f"y_{c}") for c in names))
    rows = rows.withColumns({"d0": before("d1"), "was": before("own"), "end": F.lead("d1").over(w).isNull(), **{f"p_{c}": before(f"y_{c}") for c in names}})
    rows = rows.withColumns({f"l_{c}": (F.col(f"y_{c}") - F.col(f"p_{c}")) / (F.col("d1") - F.col("d0")) for c in names})
    rows = rows.withColumns({f"s_{c}": F.lead(f"l_{c}").over(w) for c in names})

    def slope(c: str):
        left, right = F.col(f"l_{c}"), F.col(f"s_{c}")
        flat = (left == 0) | (right == 0) | ((left < 0) != (right < 0))
        return F.when(left.isNull() | right.isNull(), F.coalesce(left, right)).when(flat, 0.0).otherwise((left + right) / 2)

    rows = rows.withColumns({f"m_{c}": slope(c) for c in names})
    rows = rows.withColumns({f"n_{c}": F.lead(f"m_{c}").over(w) for c in names})
    has = {c: F.count(f"y_{c}").over(whole) == F.count("seq").over(whole) for c in names}
    has["time_ms"] &= F.coalesce(F.min("l_time_ms").over(whole) >= 0, F.lit(True))
    rows = rows.withColumns({f"h_{c}": x for c, x in has.items()} | {f"q_{c}": F.lit(None).cast("double") for c in names})
    held = rows.select("track_id", "seq", "own", "was")
    rows = rows.drop("own", "was")

    def step(rows, carry):
        carry = carry or {c: (math.nan, None) for c in names}
        new = {}
        for c in names:
            final, mine = carry[c]
            own, past = [], []
            for m, ahead, secant in zip(rows[f"m_{c}"].tolist(), rows[f"n_{c}"].tolist(), rows[f"s_{c}"].tolist()):
                past.append(final)
                m = m if mine is None else mine
                final, mine = (m, ahead) if secant is None or math.isnan(secant) else limited(m, ahead, secant)
                own.append(final)
            carry[c] = (final, mine)
            new |= {f"m_{c}": own, f"q_{c}": past}
        return rows.assign(**new), carry

    rows = sorted_scan(rows, step)
    if carried:  # maps and texts don't go through the scan
        held = held.select(F.col("track_id").alias("of"), F.col("seq").alias("place"), "own", "was")
        rows = rows.join(held, F.col("track_id").eqNullSafe(F.col("of")) & (F.col("seq") == F.col("place"))).drop("of", "place")
    first = F.col("d0").isNull()
    low, high = F.floor(F.col("d0") / interval_m) + 1, F.floor(F.col("d1") / interval_m)
    marks = F.when(first, F.array(F.lit(0.0))).when(low <= high, F.transform(F.sequence(low, high), lambda k: k * float(interval_m))).otherwise(F.array().cast("array<double>"))
    marks = F.when(F.col("end") & ~first & (high * float(interval_m) != F.col("d1")), F.concat(marks, F.array("d1"))).otherwise(marks)
    out = rows.withColumn("distance_m", F.explode(marks))
    h = F.col("d1") - F.col("d0")
    t = (F.col("distance_m") - F.col("d0")) / h

    def at(c: str):
        y0, y1, m0, m1 = (F.col(f"{x}_{c}") for x in "pyqm")
        cubic = (2 * t**3 - 3 * t**2 + 1) * y0 + (t**3 - 2 * t**2 + t) * h * m0 + (3 * t**2 - 2 * t**3) * y1 + (t**3 - t**2) * h * m1
        y = F.when(F.col(f"h_{c}"), F.when(first | (F.col("distance_m") == F.col("d1")), y1).otherwise(cubic))
        if c == "lon":
            return F.when(y.between(-180, 180), y).otherwise(F.pmod(y + 180, F.lit(360.0)) - 180)
        return F.when((y >= 0) & (y < 360), y).otherwise(F.pmod(y, F.lit(360.0))) if c in angles else y

    flags = F.when(first & F.col("end"), F.array().cast("array<string>")).otherwise(F.array(F.lit("interpolated"), F.lit("monotone_cubic")))
    seq = (F.row_number().over(Window.partitionBy("track_id").orderBy("distance_m")) - 1).cast("bigint")
    columns = {c: at(c) for c in names if c not in inner.values()}
    if carried:
        near = F.when(~first & (F.col("distance_m") - F.col("d0") <= F.col("d1") - F.col("distance_m")), F.col("was")).otherwise(F.col("own"))
        columns |= {c: near[c] for c in carried}
    if "ext_num" in carried:
        fitted = number_map({c: at(x) for c, x in inner.items()})
        columns["ext_num"] = F.map_concat(F.map_filter(F.coalesce(near["ext_num"], F.create_map().cast("map<string,double>")), lambda k, _: ~F.map_contains_key(fitted, k)), fitted)
    out = out.select("track_id", seq.alias("seq"), "distance_m", *(x.alias(c) for c, x in columns.items()), flags.alias("flags"))
    return conform(out) if "ext_num" in carried else out


def numeric_names(df: DataFrame) -> list[str]:
    """Channels of the map ext_num by name: as many as there are names, however many points."""
    return [r["c"] for r in df.select(F.explode(F.map_keys("ext_num")).alias("c")).distinct().orderBy("c").collect()]


def drop_flagged(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Without the points that scores (track_id, seq, outlier) call outliers."""
    return df.join(scores.filter("outlier").select("track_id", "seq"), ["track_id", "seq"], "left_anti")
