"""Comparison of pairs of tracks: along and across the path, series over the common time, compatibility of what they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import enu, is_valid
from .align import align_interpolated, align_nearest, position_at_time, relative_position


def along_cross_track(ref: DataFrame, samples: DataFrame) -> DataFrame:
    """(pair, ref_seq, tgt_seq, along_m, cross_m): the offset of samples along the reference path, and across it (left is above 0).

    ref has the pair's name as track_id. The path's direction is that to the next point, or from the point before at
    the end; where there is none, or of less than a nanometre, the sample has no row.
    """
    w = Window.partitionBy("track_id").orderBy("seq")
    h = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    point = F.struct("lat", "lon", h("ele").alias("ele"))
    rows = ref.select(F.col("track_id").alias("pair"), F.col("seq").alias("ref_seq"), point.alias("o"), F.lead(point).over(w).alias("next"), F.lag(point).over(w).alias("prev"))
    rows = rows.withColumn("to", F.coalesce("next", "prev"))
    e, n, _ = enu(*(F.col(f"to.{c}") for c in ("lat", "lon", "ele")), *(F.col(f"o.{c}") for c in ("lat", "lon", "ele")))
    sign = F.when(F.col("next").isNotNull(), 1.0).otherwise(-1.0)
    rows = rows.withColumns({"_e": e * sign, "_n": n * sign}).withColumn("_s", F.sqrt(F.col("_e") ** 2 + F.col("_n") ** 2)).filter("_s >= 1e-9")
    out = samples.join(rows.select("pair", "ref_seq", (F.col("_e") / F.col("_s")).alias("_e"), (F.col("_n") / F.col("_s")).alias("_n")), ["pair", "ref_seq"])
    return out.select("pair", "ref_seq", "tgt_seq", (F.col("_e") * F.col("east_m") + F.col("_n") * F.col("north_m")).alias("along_m"), (F.col("_e") * F.col("north_m") - F.col("_n") * F.col("east_m")).alias("cross_m"))


def pairwise_at(a: DataFrame, b: DataFrame, times: DataFrame, lookback_ms: float = 1000.0, max_bracket_ms: float = float("inf")) -> DataFrame:
    """(track_id, at_ms, horizontal_m, slant_m, bearing_deg, altitude_separation_m, closure_mps) of pairs at instants.

    a and b share track_id as the pair's key. Both must be known at the instant; closure comes from the ranges there
    and lookback_ms before, and is null where either isn't known then.
    """
    asked = times.select("track_id", "at_ms").distinct()
    both = asked.unionByName(asked.select("track_id", (F.col("at_ms") - float(lookback_ms)).alias("at_ms"))).distinct()
    side = lambda df, s: position_at_time(df, both, max_bracket_ms).select("track_id", "at_ms", F.struct("lat", "lon", "ele").alias(s))
    rows = side(a, "a").join(side(b, "b"), ["track_id", "at_ms"])
    h = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    e, n, u = enu(F.col("b.lat"), F.col("b.lon"), h("b.ele"), F.col("a.lat"), F.col("a.lon"), h("a.ele"))
    rows = rows.withColumns({"_e": e, "_n": n, "_u": u}).withColumn("horizontal_m", F.sqrt(F.col("_e") ** 2 + F.col("_n") ** 2))
    rows = rows.withColumns({"slant_m": F.sqrt(F.col("horizontal_m") ** 2 + F.col("_u") ** 2), "bearing_deg": (F.degrees(F.atan2("_e", "_n")) + 360) % 360, "altitude_separation_m": F.col("b.ele") - F.col("a.ele")})
    before = rows.select("track_id", (F.col("at_ms") + float(lookback_ms)).alias("at_ms"), F.col("slant_m").alias("_was")).dropDuplicates(["track_id", "at_ms"])
    out = asked.join(rows, ["track_id", "at_ms"]).join(before, ["track_id", "at_ms"], "left")
    return out.select("track_id", "at_ms", "horizontal_m", "slant_m", "bearing_deg", "altitude_separation_m", ((F.col("_was") - F.col("slant_m")) / (lookback_ms / 1000)).alias("closure_mps"))


def pairwise_series(a: DataFrame, b: DataFrame, n: int = 200, lookback_ms: float = 1000.0, max_bracket_ms: float = float("inf")) -> DataFrame:
    """pairwise_at for n (two at least) instants spread evenly over the time that both sides of a pair have."""
    n = max(2, int(n))
    span = lambda df, s: df.groupBy("track_id").agg(F.min("time_ms").alias(f"{s}0"), F.max("time_ms").alias(f"{s}1"))
    ends = span(a, "a").join(span(b, "b"), "track_id").select("track_id", F.greatest("a0", "b0").alias("low"), F.least("a1", "b1").alias("high")).filter("high > low")
    times = ends.select("track_id", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("track_id", (F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (n - 1)).alias("at_ms"))
    return pairwise_at(a, b, times, lookback_ms, max_bracket_ms)


def compare(ref: DataFrame, tgt: DataFrame, mode: str = "nearest", tolerance_ms: float = 1000.0, max_bracket_ms: float = 10_000.0, offset_ms: float = 0.0, blocked: DataFrame | None = None) -> DataFrame:
    """Relative samples of pairs, by the nearest target or between two; derived tells which. blocked (track_id of pairs) have none."""
    if mode not in ("nearest", "interpolated"):
        raise ValueError("mode is nearest or interpolated")
    if blocked is not None:
        ref = ref.join(blocked.select("track_id").distinct(), "track_id", "left_anti")
    pairs = align_nearest(ref, tgt, tolerance_ms, offset_ms) if mode == "nearest" else align_interpolated(ref, tgt, max_bracket_ms, offset_ms)
    return relative_position(pairs).withColumn("derived", F.lit(mode == "interpolated"))


def comparison_range_stats(samples: DataFrame) -> DataFrame:
    """(pair, n, min_slant, max_slant, mean_slant, mean_horizontal, mean_closure): closure where it is known."""
    return samples.groupBy("pair").agg(F.count("*").alias("n"), F.min("slant_m").alias("min_slant"), F.max("slant_m").alias("max_slant"), F.avg("slant_m").alias("mean_slant"), F.avg("horizontal_m").alias("mean_horizontal"), F.avg("closure_mps").alias("mean_closure"))


def _matched(a: str, b: str, name: str) -> tuple[Column, Column]:
    """(level 0 to 2, reason) of two references."""
    x, y = F.coalesce(a, F.lit("UNKNOWN")), F.coalesce(b, F.lit("UNKNOWN"))
    unknown = (x == "UNKNOWN") | (y == "UNKNOWN")
    level = F.when(unknown, 1).when(x != y, 2).otherwise(0)
    return level, F.when(unknown, f"{name} reference unknown").when(x != y, F.concat(F.lit(f"{name} reference: "), x, F.lit(" against "), y))


LEVELS = ("compatible", "warning", "blocked")


def compatibility(pairs: DataFrame, datasets: DataFrame) -> DataFrame:
    """pairs (left, right) with level and reasons: unknown references of altitude or time warn, different ones block."""
    side = lambda s: datasets.select(F.col("track_id").alias(s), F.col("altitude_ref").alias(f"_{s}_a"), F.col("time_ref").alias(f"_{s}_t"))
    rows = pairs.join(side("left"), "left").join(side("right"), "right")
    (la, ra), (lt, rt) = _matched("_left_a", "_right_a", "altitude"), _matched("_left_t", "_right_t", "time")
    level = F.get(F.array(*map(F.lit, LEVELS)), F.greatest(la, lt))
    return rows.select(*pairs.columns, level.alias("level"), F.array_compact(F.array(ra, rt)).alias("reasons"))


def fusion_compatibility(sources: DataFrame, datasets: DataFrame, points: DataFrame) -> DataFrame:
    """(entity, level, reasons) before sources (track_id, entity) are fused.

    Two sources at least, one declared coordinate system, some valid point in each; references of all against those of
    the first by name.
    """
    some = points.groupBy("track_id").agg(F.max(is_valid(F.col("lat"), F.col("lon")).cast("int")).alias("_placed"))
    rows = sources.select("track_id", "entity").join(datasets.select("track_id", F.nullif(F.trim("crs"), F.lit("")).alias("crs"), "altitude_ref", "time_ref"), "track_id").join(some, "track_id", "left")
    first = Window.partitionBy("entity").orderBy("track_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_f_{c}": F.first(F.coalesce(c, F.lit("UNKNOWN"))).over(first) for c in ("track_id", "altitude_ref", "time_ref")})
    (la, ra), (lt, rt) = _matched("_f_altitude_ref", "altitude_ref", "altitude"), _matched("_f_time_ref", "time_ref", "time")
    other = F.col("track_id") != F.col("_f_track_id")
    level = F.when(other, F.greatest(la, lt)).otherwise(0)
    told = lambda l, r: F.when(other & (l == 2), F.concat(F.col("track_id"), F.lit(" to "), F.col("_f_track_id"), F.lit(", "), r)).when(other, r)
    nowhere = F.when(F.coalesce("_placed", F.lit(0)) == 0, F.concat("track_id", F.lit(": no point has a place")))
    g = rows.groupBy("entity").agg(F.count("*").alias("n"), F.count("crs").alias("declared"), F.countDistinct("crs").alias("systems"), F.max(level).alias("level"), F.array_sort(F.collect_set(nowhere)).alias("nowhere"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(told(la, ra), told(lt, rt))))))).alias("told"))
    gates = [
        (F.col("n") < 2, "fewer than two sources"),
        (F.col("declared") < F.col("n"), "a source without a coordinate system"),
        ((F.col("declared") == F.col("n")) & (F.col("systems") > 1), "more than one coordinate system"),
    ]
    blocked = (F.size("nowhere") > 0) | (F.col("level") == 2)
    for when, _ in gates:
        blocked |= when
    reasons = F.concat(F.array_compact(F.array(*(F.when(w, F.lit(text)) for w, text in gates))), "nowhere", "told")
    return g.select("entity", F.when(blocked, "blocked").when(F.col("level") == 1, "warning").otherwise("compatible").alias("level"), reasons.alias("reasons"))
