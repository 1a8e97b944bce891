"""What charts and views ask of tracks: series, samples, strips, domains and local coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..demo_tracks import by_seq, whole_track
from .aggregate import minmax_downsample
from ..functions.geo import enu, is_valid, shortest_delta


def chart_series(df: DataFrame, channel: str, x: str = "time_ms", domain: tuple[float, float] | None = None, max_samples: int | None = None) -> DataFrame:
    """(track_id, seq, x, y) of points that have both; in a domain, with one point beyond each end; at most so many, by minmax_downsample."""
    if max_samples is not None:
        rows = chart_series(df, channel, x, domain)
        return minmax_downsample(rows, "y", max_samples).join(rows.select("track_id", "seq", "x"), ["track_id", "seq"]).select("track_id", "seq", "x", "y")
    rows = df.select("track_id", "seq", F.col(x).cast("double").alias("x"), F.col(channel).cast("double").alias("y")).filter("x is not null and y is not null")
    if domain is None:
        return rows
    inside = F.col("x").between(*map(float, sorted(domain)))
    near = [F.coalesce(f(inside).over(by_seq()), F.lit(False)) for f in (F.lag, F.lead)]
    return rows.withColumn("_keep", inside | near[0] | near[1]).filter("_keep").drop("_keep")


def x_domain(df: DataFrame, x: str = "time_ms") -> DataFrame:
    """(track_id, low, high), widened by 1 where they are equal."""
    g = df.groupBy("track_id").agg(F.min(x).cast("double").alias("low"), F.max(x).cast("double").alias("high"))
    return g.withColumn("high", F.when(F.col("low") == F.col("high"), F.col("high") + 1).otherwise(F.col("high")))


def uniform_sample(df: DataFrame, n: int) -> DataFrame:
    """n rows of a track at most: both ends, and rows spread evenly between them, halves up."""
    rows = df.withColumns({"_i": F.row_number().over(by_seq()) - 1, "_n": F.count("*").over(whole_track())})
    # Row i is wanted if some k rounds to it: k = the whole number next to i * (n - 1) / (count - 1).
    k = F.floor((F.col("_i") - 0.5) * (n - 1) / (F.col("_n") - 1)) + 1
    wanted = F.floor(F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)) * (F.col("_n") - 1) / (n - 1) + 0.5)
    return rows.filter((F.col("_n") <= n) | (wanted == F.col("_i"))).drop("_i", "_n")


def neighbourhood(df: DataFrame, centers: DataFrame, k: int) -> DataFrame:
    """Adds center: points within k rows of each of centers (track_id, seq), once for each center."""
    near = centers.select("track_id", F.col("seq").alias("center"), F.explode(F.sequence(F.col("seq") - k, F.col("seq") + k)).alias("seq"))
    return near.join(df, ["track_id", "seq"])


def quality_strip(df: DataFrame, events: DataFrame, buckets: int = 960) -> DataFrame:
    """(track_id, bucket, severity): the worst severity in each of so many stretches, 0 none to 3 error."""
    rank = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    hit = events.select("track_id", F.explode(F.sequence("start_seq", "end_seq")).alias("seq"), rank.alias("r")).groupBy("track_id", "seq").agg(F.max("r").alias("r"))
    rows = df.select("track_id", "seq", F.count("*").over(whole_track()).alias("n")).join(hit, ["track_id", "seq"], "left")
    at = F.floor(F.col("seq") * F.least(F.lit(buckets), F.col("n")) / F.col("n"))
    return rows.groupBy("track_id", at.alias("bucket")).agg(F.coalesce(F.max("r"), F.lit(0)).alias("severity"))


def disclosure_counts(df: DataFrame) -> DataFrame:
    """(track_id, notional, edited): points that were made up, and that were edited by hand."""
    has = lambda flag: F.count_if(F.array_contains("flags", flag))
    return df.groupBy("track_id").agg(has("notional").alias("notional"), has("manual_edit").alias("edited"))


def chart_capability(df: DataFrame, channels: tuple[str, ...] = ("ele", "hdop", "sat")) -> DataFrame:
    """(track_id, timed, numeric, scatter, area, best): whether there are times, how many channels have numbers, and what charts they allow.

    A scatter needs two channels, an area a time and a channel; best is a time series, else a scatter, else a time series all the same.
    """
    some = [F.max(F.col(c).isNotNull().cast("int")) for c in channels]
    g = df.groupBy("track_id").agg((F.count("time_ms") > 0).alias("timed"), sum(some[1:], some[0]).alias("numeric"))
    g = g.withColumns({"scatter": F.col("numeric") >= 2, "area": F.col("timed") & (F.col("numeric") >= 1)})
    return g.withColumn("best", F.when(~F.col("timed") & F.col("scatter"), "scatter").otherwise("timeSeries"))


def trajectory_enu(df: DataFrame, exaggeration: float = 1.0) -> DataFrame:
    """(track_id, seq, east_m, north_m, up_m) of valid points about the first valid point of their track."""
    rows = df.filter(is_valid(F.col("lat"), F.col("lon")))
    first = F.first(F.struct("lat", "lon", F.coalesce("ele", F.lit(0.0)).alias("h"))).over(by_seq().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_o", first)
    e, n, u = enu(F.col("lat"), F.col("lon"), F.coalesce("ele", "_o.h"), F.col("_o.lat"), F.col("_o.lon"), F.col("_o.h"))
    return rows.select("track_id", "seq", e.alias("east_m"), n.alias("north_m"), (u * exaggeration).alias("up_m"))


def trajectory_summary(df: DataFrame, colour: str | None = None) -> DataFrame:
    """(track_id, n, east, north, up and, if asked for, colour ranges) of trajectory_enu rows; colour: a column of theirs."""
    columns = ["east_m", "north_m", "up_m", *([colour] if colour else [])]
    return df.groupBy("track_id").agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))))


def shared_trajectory_enu(df: DataFrame, exaggeration: float = 1.0) -> DataFrame:
    """trajectory_enu of all tracks about one origin: the first valid point of the first track by name."""
    rows = df.filter(is_valid(F.col("lat"), F.col("lon")))
    first = rows.agg(F.min_by(F.struct("lat", "lon", F.coalesce("ele", F.lit(0.0)).alias("h")), F.struct("track_id", "seq")).alias("o")).first()  # one row
    if first is None or first["o"] is None:
        return trajectory_enu(df, exaggeration)
    lat, lon, h = (F.lit(float(first["o"][c])) for c in ("lat", "lon", "h"))
    e, n, u = enu(F.col("lat"), F.col("lon"), F.coalesce("ele", h), lat, lon, h)
    return rows.select("track_id", "seq", e.alias("east_m"), n.alias("north_m"), (u * exaggeration).alias("up_m"))


#: Metres of a degree in a plan.
PLAN_METERS = 111320.0


def plan_projection(df: DataFrame) -> DataFrame:
    """(track_id, seq, east_m, north_m) of points with a finite position, about the track's first such point.

    Longitudes are unwrapped in order; the cosine is that of the origin's latitude, 1e-6 at least.
    """
    w = by_seq()
    fine = ~F.isnan("lat") & ~F.isnan("lon") & (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf"))
    rows = df.filter(F.coalesce(fine, F.lit(False))).select("track_id", "seq", "lat", "lon")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.coalesce(shortest_delta(F.lag("lon").over(w), F.col("lon")), F.lit(0.0)))
    rows = rows.withColumns({"_u": F.sum("_s").over(upto), "_lat": F.first("lat").over(upto)})
    cos = F.greatest(F.cos(F.radians("_lat")), F.lit(1e-6))
    return rows.select("track_id", "seq", (F.col("_u") * PLAN_METERS * cos).alias("east_m"), ((F.col("lat") - F.col("_lat")) * PLAN_METERS).alias("north_m"))


def plan_frame(plan: DataFrame) -> DataFrame:
    """(track_id, span_m, scale_bar_m) of a plan: the longer side, a metre at least, and a round length near a quarter of it."""
    side = lambda c: F.greatest(F.max(c) - F.min(c), F.lit(1.0))
    g = plan.groupBy("track_id").agg(F.greatest(side("east_m"), side("north_m")).alias("span_m"))
    target = F.col("span_m") / 4
    power = F.pow(F.lit(10.0), F.floor(F.log10(target)))
    return g.withColumn("scale_bar_m", F.when(target < power, power).when(target < 2 * power, 2 * power).when(target < 5 * power, 5 * power).otherwise(10 * power))


def plan_stride(df: DataFrame, n: int = 2000) -> DataFrame:
    """Every k-th row of a track, k the rows over n rounded up, and its last; only those with a finite position."""
    rows = df.withColumns({"_i": F.row_number().over(by_seq()) - 1, "_n": F.count("*").over(whole_track())})
    k = F.greatest(F.lit(1), F.ceil(F.col("_n") / max(1, n)))
    fine = F.coalesce(~F.isnan("lat") & ~F.isnan("lon") & (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf")), F.lit(False))
    return rows.filter(fine & ((F.col("_i") % k == 0) | (F.col("_i") == F.col("_n") - 1))).drop("_i", "_n")


def playback_lookup(df: DataFrame, fractions: DataFrame) -> DataFrame:
    """(track_id, fraction, seq, at): the row of a track at a fraction (track_id, fraction) of its time, and the fraction of that row.

    The nearest in time, the earlier if two are; where a time is missing or falls, or all are alike, the row at that
    share of the rows, halves up.
    """
    w, whole = by_seq(), whole_track()
    rows = df.select("track_id", "seq", "time_ms").withColumns({"_i": (F.row_number().over(w) - 1).cast("double"), "_n": F.count("*").over(whole), "_bad": (F.col("time_ms").isNull() | F.coalesce(F.col("time_ms") < F.lag("time_ms").over(w), F.lit(False))).cast("int")})
    rows = rows.withColumns({"_bad": F.max("_bad").over(whole), "_a": F.min("time_ms").over(whole), "_b": F.max("time_ms").over(whole)})
    timed = (F.col("_bad") == 0) & (F.col("_b") > F.col("_a"))
    rows = rows.select("track_id", "seq", "_i", F.when(timed, (F.col("time_ms") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))).alias("_x"), timed.alias("_timed"))
    point = F.struct("seq", "_i", "_x")
    have = rows.select("track_id", F.col("_x").alias("_t"), F.lit(1).alias("_side"), point.alias("p"), "_timed", F.lit(None).cast("double").alias("fraction"))
    asked = fractions.select("track_id", F.least(F.greatest(F.coalesce(F.nanvl(F.col("fraction"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(have.schema["p"].dataType).alias("p"), F.lit(None).cast("boolean").alias("_timed"), F.col("fraction").cast("double").alias("fraction"))
    both = have.unionByName(asked)
    ahead = Window.partitionBy("track_id").orderBy(F.desc("_t"), F.desc("_side"), F.desc("p._i"))
    behind = Window.partitionBy("track_id").orderBy("_t", "_side", "p._i")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"_a": F.last("p", ignorenulls=True).over(so_far(behind)), "_b": F.last("p", ignorenulls=True).over(so_far(ahead)), "_how": F.max("_timed").over(whole)}).filter("_side = 0")
    # Of rows at one share the first in order is the one at or behind the instant.
    near = (F.col("_t") - F.col("_a._x") <= F.col("_b._x") - F.col("_t")) & F.when(F.col("_how"), F.lit(True)).otherwise(F.col("_t") - F.col("_a._x") < F.col("_b._x") - F.col("_t"))
    pick = F.when(F.col("_b").isNull() | F.coalesce(near, F.lit(False)), F.coalesce("_a", "_b")).otherwise(F.col("_b"))
    return both.withColumn("_p", pick).filter("_p is not null").select("track_id", "fraction", F.col("_p.seq").alias("seq"), F.col("_p._x").alias("at"))


def shape_groups(df: DataFrame) -> DataFrame:
    """(track_id, shape, source_feature, start_seq, end_seq, points, closed): runs of points of one source feature.

    closed: four points at least, and both ends within a billionth of a degree.
    """
    change = (~F.col("source_feature").eqNullSafe(F.lag("source_feature").over(by_seq())) | (F.row_number().over(by_seq()) == 1)).cast("int")
    rows = df.withColumn("_c", change).withColumn("shape", F.sum("_c").over(by_seq()))
    g = rows.groupBy("track_id", "shape").agg(F.first("source_feature").alias("source_feature"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count("*").alias("points"), F.min_by(F.struct("lat", "lon"), "seq").alias("a"), F.max_by(F.struct("lat", "lon"), "seq").alias("b"))
    near = (F.abs(F.col("a.lat") - F.col("b.lat")) < 1e-9) & (F.abs(F.col("a.lon") - F.col("b.lon")) < 1e-9)
    return g.select("track_id", "shape", "source_feature", "start_seq", "end_seq", "points", ((F.col("points") >= 4) & near).alias("closed"))


#: Channels that belong together in a chart.
PRESETS = {"elevation-time": ["elevation"], "speed-time": ["ground_speed_mps", "speed_mps"], "vertical-speed": ["vertical_speed_mps"], "heading": ["heading_deg", "turn_rate_dps"], "fix-quality": ["hdop", "vdop", "pdop", "sat"]}


def preset_channels(channels: DataFrame, preset: str) -> DataFrame:
    """(track_id, channel, place) of a preset's channels that a track has (channels: track_id, channel); elevation always; of speeds the first only."""
    wanted = PRESETS[preset]
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("channel"))
    rows = channels.select("track_id", "channel").distinct()
    if "elevation" in wanted:
        rows = rows.unionByName(rows.select("track_id", F.lit("elevation").alias("channel"))).distinct()
    rows = rows.filter(F.col("channel").isin(wanted)).withColumn("place", place)
    return rows.withColumn("_first", F.min("place").over(Window.partitionBy("track_id"))).filter("place = _first").drop("_first") if preset == "speed-time" else rows
