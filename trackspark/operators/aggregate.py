"""Statistics over tracks, channels, ranges, cells and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..demo_tracks import by_seq, whole_track
from ..functions.geo import haversine, is_valid, shortest_delta, wrap180
from ..plans.chunks import Chunks
from ..schema import unit_of
from ..sources.text import plain_number

#: Metres of a degree of latitude for cells; fixed.
METERS_PER_DEGREE = 111320.0


def bounds(df: DataFrame) -> DataFrame:
    """(track_id, min_lat, min_lon, max_lat, max_lon) of valid points; null if there is none."""
    ok = is_valid(F.col("lat"), F.col("lon"))
    return df.groupBy("track_id").agg(*(f(F.when(ok, F.col(c))).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")))


def track_stats(df: DataFrame, chunk: int | None = None) -> DataFrame:
    """One row a track: counts, distance and speeds over neighbouring valid points, duration, heights.

    Duration is last minus first timed point in order and may be negative. A leg starts at the last valid
    point, for time as well. Gain and loss compare with the last height there was.
    """
    cut = Chunks(df, size=chunk)
    out = cut.rows.withColumn("_ok", is_valid(F.col("lat"), F.col("lon")))
    here = F.when(F.col("_ok"), F.struct("lat", "lon", "time_ms"))
    out = cut.carry(out, _cp=(cut.latest(here), "last"), _ce=(cut.latest("ele"), "last"), _ct=(cut.latest("time_ms"), "last"))
    last = lambda c, carry: F.coalesce(F.last(c, ignorenulls=True).over(cut.earlier()), carry)
    out = out.withColumns({"_p": last(here, "_cp"), "_e": last("ele", "_ce"), "_t": last("time_ms", "_ct")})
    out = out.withColumns({"_d": F.when(F.col("_ok"), haversine(F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon"))), "_dt": (F.col("time_ms") - F.col("_p.time_ms")) / 1000, "_rise": F.col("ele") - F.col("_e")})
    speed = F.when(F.col("_dt") > 0, F.col("_d") / F.col("_dt"))
    timed = F.when(F.col("time_ms").isNotNull(), F.col("seq"))
    named = F.count_if(F.col("name") != "") if "name" in df.columns else F.lit(0).cast("bigint")
    g = out.groupBy("track_id").agg(
        F.count("*").alias("points"), F.count_if("_ok").alias("valid"), F.count("ele").alias("with_ele"), F.count("time_ms").alias("with_time"),
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("distance_m"), (F.max_by("time_ms", timed) - F.min_by("time_ms", timed)).alias("duration_ms"),
        F.min("ele").alias("ele_min"), F.max("ele").alias("ele_max"), F.sum(F.when(F.col("_rise") > 0, F.col("_rise")).when(F.col("_rise").isNotNull(), 0.0)).alias("gain_m"), F.sum(F.when(F.col("_rise") <= 0, -F.col("_rise")).when(F.col("_rise").isNotNull(), 0.0)).alias("loss_m"),
        F.min(speed).alias("speed_min"), F.max(speed).alias("speed_max"), F.avg(speed).alias("speed_mean"),
        F.coalesce(F.bool_and(F.col("time_ms") >= F.col("_t")), F.lit(True)).alias("monotonic"), F.count_if(F.col("_d") == 0).alias("duplicate_coords"),
        named.alias("with_name"), (F.count("*") - F.count_if("_ok")).alias("invalid"), *(f(F.when(F.col("_ok"), F.col(c))).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")), F.min_by("time_ms", timed).alias("start_time"), F.max_by("time_ms", timed).alias("end_time"),
    )
    rate = F.when((F.col("duration_ms") > 0) & (F.col("with_time") > 1), (F.col("with_time") - 1) / (F.col("duration_ms") / 1000))
    return g.withColumn("sample_rate_hz", rate)


def channel_stats(df: DataFrame, channels: tuple[str, ...] | None = ("hdop", "sat", "ele")) -> DataFrame:
    """(track_id, channel, count, n, min, max, mean, stddev, unit): one row a track and channel, in one pass.

    Of columns, or with None of all entries of the channel maps: text counts as the number that it is, true as 1.
    count is of values, n of numbers.
    """
    if channels is None:
        entry = lambda m, f: F.transform(F.coalesce(F.map_entries(m), F.array().cast(f"array<struct<key:string,value:{'double' if m == 'ext_num' else 'string' if m == 'ext_str' else 'boolean'}>>")), lambda e: F.struct(e["key"].alias("channel"), f(e["value"]).alias("v")))
        pairs = F.concat(entry("ext_num", lambda v: v), entry("ext_str", plain_number), entry("ext_bool", lambda v: v.cast("int").cast("double")))
    else:
        pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in channels)), lambda x: x["v"].isNotNull())
    rows = df.select("track_id", F.explode(pairs).alias("x")).select("track_id", "x.*")
    fine = F.when(F.abs("v") < float("inf"), F.col("v"))
    g = rows.groupBy("track_id", "channel").agg(F.count("*").alias("count"), F.count(fine).alias("n"), F.min(fine).alias("min"), F.max(fine).alias("max"), F.avg(fine).alias("mean"), F.stddev_samp(fine).alias("stddev"))
    return g.withColumn("unit", unit_of("channel"))


def range_statistics(df: DataFrame, start: int, end: int, channels: tuple[str, ...] = ("hdop", "ele")) -> DataFrame:
    """One row a track for a range of seq: points, distance over its rows, duration; number, least, greatest and mean of channels."""
    rows = df.filter(F.col("seq").between(min(start, end), max(start, end)))
    d = haversine(F.lag("lat").over(by_seq()), F.lag("lon").over(by_seq()), F.col("lat"), F.col("lon"))
    rows = rows.withColumn("_d", d)
    return rows.groupBy("track_id").agg(F.count("*").alias("points"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("distance_m"), (F.max_by("time_ms", "seq") - F.min_by("time_ms", "seq")).alias("duration_ms"), *(f(c).alias(f"{n}_{c}") for c in channels for n, f in (("count", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg))))


def distribution_stats(df: DataFrame, column: str, by: str = "track_id") -> DataFrame:
    """(by, n, min, median, p95, max, mean, stddev) of finite values; percentiles interpolate; stddev 0 for one."""
    rows = df.filter(F.col(column).between(-1.7e308, 1.7e308))
    p = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95)))
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.min(column).alias("min"), p.alias("_p"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("stddev"))
    return g.select(by, "n", "min", F.col("_p")[0].alias("median"), F.col("_p")[1].alias("p95"), "max", "mean", "stddev")


def histogram(df: DataFrame, column: str, bins: int = 20, by: str = "track_id") -> DataFrame:
    """(by, bin, low, high, n): equal bins from least to greatest, the last closed; one bin of width 1 if all are equal."""
    rows = df.filter(F.col(column).isNotNull()).select(by, F.col(column).alias("v"))
    ends = rows.groupBy(by).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    rows = rows.join(ends, by).withColumn("w", F.when(F.col("a") == F.col("b"), 1.0).otherwise((F.col("b") - F.col("a")) / bins))
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("a")) / F.col("w")).cast("int"))
    return rows.withColumn("bin", at).groupBy(by, "bin", "a", "w").agg(F.count("*").alias("n")).select(by, "bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def spatial_bins(df: DataFrame, cell_m: float) -> DataFrame:
    """(track_id, row, col, n, south, north, west, east): cells widened by latitude, longitudes unwrapped in order."""
    if not cell_m > 0:
        raise ValueError("cell_m must be above 0")
    rows = df.filter("lat between -90 and 90 and lon between -1e300 and 1e300")
    step = F.coalesce(shortest_delta(F.lag("lon").over(by_seq()), F.col("lon")), F.lit(0.0))
    rows = rows.select("track_id", "seq", "lat", "lon", step.alias("_s"), F.avg("lat").over(whole_track()).alias("_mean"))
    so_far = by_seq().rowsBetween(Window.unboundedPreceding, 0)
    lat_step = cell_m / METERS_PER_DEGREE
    cos = F.greatest(F.cos(F.radians(F.least(F.greatest(F.col("_mean"), F.lit(-89.5)), F.lit(89.5)))), F.lit(1e-6))
    rows = rows.withColumns({"_u": F.first("lon").over(so_far) + F.sum("_s").over(so_far), "_w": lat_step / cos})
    rows = rows.select("track_id", F.floor(F.col("lat") / lat_step).alias("row"), F.floor(F.col("_u") / F.col("_w")).alias("col"), "_w")
    g = rows.groupBy("track_id", "row", "col").agg(F.count("*").alias("n"), F.first("_w").alias("_w"))
    return g.select("track_id", "row", "col", "n", (F.col("row") * lat_step).alias("south"), ((F.col("row") + 1) * lat_step).alias("north"), wrap180(F.col("col") * F.col("_w")).alias("west"), wrap180((F.col("col") + 1) * F.col("_w")).alias("east"))


def flag_counts(df: DataFrame) -> DataFrame:
    return df.select("track_id", F.explode("flags").alias("flag")).groupBy("track_id", "flag").agg(F.count("*").alias("n"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("track_id", "kind").agg(F.count("*").alias("n"))


def time_extent(df: DataFrame) -> DataFrame:
    """One row: earliest and latest time."""
    return df.agg(F.min("time_ms").alias("earliest"), F.max("time_ms").alias("latest"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(track_id, n, hash) that changes with any point, its place or its values in any column; needs no order to compute.

    The sum of hashes of all columns, modulo 2**64, as two halves: equal rows don't cancel. Map entries count in order of keys.
    """
    kinds = dict(df.dtypes)
    column = lambda c: F.array_sort(F.map_entries(c)) if kinds[c].startswith("map") else F.when(F.isnan(c), "NaN").otherwise(F.col(c).cast("string")) if kinds[c] == "double" else F.col(c)
    rest = [F.to_json(F.struct(column(c).alias("v"))) for c in sorted(df.columns) if c != "track_id"]
    h = F.xxhash64(F.lit(",".join(sorted(df.columns))), *rest)
    half = lambda x: F.pmod(F.sum(x.cast("decimal(20,0)")), F.lit(1 << 32).cast("decimal(20,0)")).cast("bigint")
    return df.groupBy("track_id").agg(F.count("*").alias("n"), half(F.shiftrightunsigned(h, 32)).alias("_a"), half(h.bitwiseAND(F.lit((1 << 32) - 1))).alias("_b")).select("track_id", "n", F.lpad(F.hex("_a"), 8, "0").alias("_x"), F.lpad(F.hex("_b"), 8, "0").alias("_y")).select("track_id", "n", F.lower(F.concat("_x", "_y")).alias("hash"))


def operation_preview(before: DataFrame, after: DataFrame, rng: tuple[int, int] | None = None) -> DataFrame:
    """(track_id, and for before and after points, distance, duration, events and in_range; bounds_changed, destructive).

    events are quality events; in_range counts points of a range of seq, all without one.
    """
    from .ordered import quality_events

    inside = F.lit(True) if rng is None else F.col("seq").between(min(rng), max(rng))

    def side(df: DataFrame, name: str) -> DataFrame:
        stats = track_stats(df).select("track_id", F.col("points").alias(f"points_{name}"), F.col("distance_m").alias(f"distance_{name}"), F.col("duration_ms").alias(f"duration_{name}"), F.struct("min_lat", "min_lon", "max_lat", "max_lon").alias(f"_b_{name}"))
        events = quality_events(df).groupBy("track_id").agg(F.count("*").alias(f"events_{name}"))
        chosen = df.groupBy("track_id").agg(F.count_if(inside).alias(f"in_range_{name}"))
        return stats.join(events, "track_id", "left").join(chosen, "track_id", "left").fillna(0, [f"events_{name}", f"in_range_{name}"])

    out = side(before, "before").join(side(after, "after"), "track_id", "left").fillna(0, ["points_after", "events_after", "in_range_after"])
    return out.withColumns({"bounds_changed": ~F.col("_b_before").eqNullSafe(F.col("_b_after")), "destructive": F.col("points_after") < F.col("points_before")}).drop("_b_before", "_b_after")


def stride_sample(df: DataFrame, n: int) -> DataFrame:
    """Every k-th row of a track and its last, k the least for which n rows suffice."""
    if n < 2:
        raise ValueError("n must be 2 or more")
    out = df.withColumns({"_i": F.row_number().over(by_seq()) - 1, "_n": F.count("*").over(whole_track())})
    k = F.greatest(F.lit(1), F.ceil((F.col("_n") - 1) / (n - 1)))
    return out.filter((F.col("_i") % k == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def minmax_downsample(df: DataFrame, column: str, samples: int) -> DataFrame:
    """(track_id, seq, column) of at most so many of a track's values: all if they are no more, else both ends and the
    least and greatest of each of (samples - 2) div 2 equal stretches between; the first of equal ones. Below 4, the ends."""
    rows = df.filter(F.col(column).isNotNull()).select("track_id", "seq", F.col(column).alias("v"))
    rows = rows.withColumns({"_i": F.row_number().over(by_seq()) - 1, "_n": F.count("*").over(whole_track())})
    buckets = max(1, (samples - 2) // 2)
    end = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1)
    # An inner row i of m is in the last stretch b that begins at it or before: floor(b * m / buckets) <= i.
    inner = F.expr(f"(_i * {buckets} - 1) div (_n - 2)")
    one = F.when((F.col("_n") <= samples) | end, -1 - F.col("_i"))
    rows = rows.filter((F.col("_n") <= samples) | end | F.lit(samples >= 4)).withColumn("_b", F.coalesce(one, inner))
    g = rows.groupBy("track_id", "_b").agg(F.min(F.struct("v", "seq")).alias("lo"), F.max(F.struct("v", (-F.col("seq")).alias("s"))).alias("hi"))
    both = g.select("track_id", F.explode(F.array(F.struct(F.col("lo.seq").alias("seq"), F.col("lo.v").alias("v")), F.struct((-F.col("hi.s")).alias("seq"), F.col("hi.v").alias("v")))).alias("x"))
    return both.select("track_id", "x.seq", F.col("x.v").alias(column)).distinct()


def path_segments(df: DataFrame, gap_ms: float, jump_m: float = 10_000.0, jump_ms: float = 5000.0) -> DataFrame:
    """Adds segment to valid points: counted anew where a gap or a jump ends, and where longitudes are more than 180 apart.

    A gap is an interval above gap_ms to the row before, valid or not; a jump more than jump_m from a valid row before
    within jump_ms. Pieces of one point are left out; numbers of pieces need not follow each other.
    """
    was = {f"_{c}": F.lag(c).over(by_seq()) for c in ("lat", "lon", "time_ms")}
    rows = df.withColumns({"_ok": is_valid(F.col("lat"), F.col("lon"))} | was)
    dt = F.col("time_ms") - F.col("_time_ms")
    jump = is_valid(F.col("_lat"), F.col("_lon")) & dt.between(0, jump_ms) & (haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) > jump_m)
    rows = rows.withColumn("_cut", F.coalesce((dt > gap_ms) | jump, F.lit(False))).filter("_ok")
    far = F.abs(F.col("lon") - F.lag("lon").over(by_seq())) > 180
    rows = rows.withColumn("_c", (F.col("_cut") | F.coalesce(far, F.lit(False))).cast("int")).withColumn("segment", F.sum("_c").over(by_seq().rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("track_id", "segment"))).filter("_n > 1")
    return rows.drop("_ok", "_cut", "_c", "_n", *was)


