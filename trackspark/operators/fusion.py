"""Fusion of several sources into one track, with explained decisions."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import is_valid
from ..plans.chunks import Chunks
from ..plans.folders import held
from ..plans.scan import sorted_scan


def fusion_candidates(df: DataFrame, sources: DataFrame) -> DataFrame:
    """(entity, source, priority, seq, time_ms, lat, lon, ele, hdop, sat) of valid timed points of sources (track_id, entity, priority)."""
    rows = df.filter(F.col("time_ms").isNotNull() & is_valid(F.col("lat"), F.col("lon")))
    return rows.join(sources, "track_id").select("entity", F.col("track_id").alias("source"), "priority", "seq", "time_ms", "lat", "lon", "ele", "hdop", "sat")


def _grouped(times: np.ndarray, anchor: float | None, group: int, tolerance_ms: float) -> tuple[np.ndarray, float | None, int]:
    """Group of each of rising times, from the anchor and number of the group that goes on; and those of the last one. Work is by groups."""
    out, i = np.empty(len(times), np.int64), 0
    while i < len(times):
        if anchor is None or times[i] - anchor > tolerance_ms:
            anchor, group = float(times[i]), group + 1
        end = i + int(np.searchsorted(times[i:], anchor + tolerance_ms, "right"))
        while end < len(times) and times[end] - anchor <= tolerance_ms:  # the sum above can be rounded to either side
            end += 1
        while end > i + 1 and times[end - 1] - anchor > tolerance_ms:
            end -= 1
        end = max(end, i + 1)
        out[i:end], i = group, end
    return out, anchor, group


def group_by_time(candidates: DataFrame, tolerance_ms: float, chunk: int | None = None) -> DataFrame:
    """Adds group_id from 0 in time order: a candidate joins the group whose first member is within the tolerance.

    Candidates of one time are of one group, so only an entity's different times are scanned, and joined to its
    candidates in many tasks. An entity of more than chunk times is cut into islands, between which the time from one to
    the next exceeds the tolerance: a group begins there in any case. So islands are dealt to many tasks, and the greedy
    scan carries the anchor of one group only.
    """
    if not tolerance_ms >= 0:
        raise ValueError("tolerance_ms must not be negative")
    times = held(_numbered(candidates.select("entity", "time_ms").distinct(), tolerance_ms, chunk)).select(F.col("entity").alias("_e"), F.col("time_ms").alias("_t"), "group_id")
    return candidates.drop("group_id").join(times, F.col("entity").eqNullSafe(F.col("_e")) & F.col("time_ms").eqNullSafe(F.col("_t"))).drop("_e", "_t")


def _numbered(times: DataFrame, tolerance_ms: float, chunk: int | None) -> DataFrame:
    """Adds group_id to an entity's different times."""

    def step(rows, carry):
        ids, anchor, group = _grouped(rows["time_ms"].to_numpy(float), *(carry or (None, -1)), tolerance_ms)
        return rows.assign(group_id=ids), (anchor, group)

    cut = Chunks.of_times(times, "time_ms", size=chunk, key="entity")
    rows = cut.rows.withColumn("group_id", F.lit(0).cast("bigint"))
    if not cut.cut:
        return sorted_scan(rows, step, "entity", "time_ms")
    rows = cut.carry(rows, _end=(cut.last(F.col("time_ms")), "previous"))
    gap = F.col("time_ms") - F.coalesce(F.lag("time_ms").over(cut.window()), "_end")
    rows = cut.carry(rows.withColumn("_new", F.coalesce(gap > tolerance_ms, F.lit(True)).cast("int")).drop("_end"), _all=(F.sum("_new"), "sum"))
    rows = rows.withColumn("_island", F.coalesce("_all", F.lit(0)) + F.sum("_new").over(cut.so_far())).drop("_all", "_new")
    rows = sorted_scan(rows, step, ["entity", "_island"], "time_ms")
    # Groups of all islands are numbered by their first members.
    own = Window.partitionBy("entity", "_island").orderBy("time_ms")
    rows = rows.withColumn("_first", (F.col("group_id") != F.lag("group_id", 1, -1).over(own)).cast("int"))
    rows = cut.carry(rows, _all=(F.sum("_first"), "sum"))
    number = F.coalesce("_all", F.lit(0)) + F.sum("_first").over(cut.so_far()) - 1
    return cut.drop(rows.withColumn("group_id", number.cast("bigint")).drop("_first", "_all", "_island"))


def _plain(c: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def score_candidates(groups: DataFrame) -> DataFrame:
    """Adds group_time_ms (mean), score and reason. More is better: 100 for each priority, then dilution of precision, satellites, time."""
    rows = groups.withColumn("group_time_ms", F.avg("time_ms").over(Window.partitionBy("entity", "group_id")))
    precise = F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 - F.col("hdop")))
    seen = F.least(F.col("sat"), F.lit(12.0)) * 0.5
    off = F.abs(F.col("time_ms") - F.col("group_time_ms"))
    precise, seen = F.when(F.col("hdop").isNotNull(), precise), F.when(F.col("sat").isNotNull(), seen)
    score = F.col("priority") * 100.0 + F.coalesce(precise, F.lit(0.0)) + F.coalesce(seen, F.lit(0.0)) - off / 1000
    reason = F.concat_ws(
        "; ",
        F.concat(F.lit("source priority "), _plain(F.col("priority"))),
        F.when(precise.isNotNull(), F.format_string("HDOP %.2f (+%.2f)", F.col("hdop").cast("double"), precise)),
        F.when(seen.isNotNull(), F.concat(_plain(F.col("sat")), F.format_string(" satellites (+%.2f)", seen))),
        F.when(off > 0, F.format_string("%.0f ms from group time (-%.2f)", off, off / 1000)),
    )
    return rows.withColumns({"score": score, "reason": reason})


def _iso(ms: float) -> str:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=int(ms))).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def check_fusion(decisions: DataFrame, sources: DataFrame, tolerance_ms: float) -> DataFrame:
    """(entity, group_id, problem) of what can't be kept of a fusion: none in one that is sound.

    sources (track_id, entity), two at least for an entity and each once; decisions of groups that are there once, by
    sources that are known, with a finite time, a reason, and a confidence from 0 to 1.
    """
    if not 1 <= tolerance_ms <= 86_400_000:
        raise ValueError("tolerance_ms must be from 1 to 86400000")
    many = sources.groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("d"))
    own = F.when(F.col("n") < 2, "fewer than two sources").when(F.col("n") != F.col("d"), "a source twice")
    out = many.withColumn("problem", own).filter("problem is not null").select("entity", F.lit(None).cast("bigint").alias("group_id"), "problem")
    known = sources.select("entity", F.col("track_id").alias("_s")).distinct()
    rows = held(decisions.select("entity", "group_id", "group_time_ms", "chosen", "seq", "skipped", "confidence", "reason"))
    named = rows.select("entity", "group_id", F.explode(F.concat(F.array("chosen"), "skipped")).alias("_s"))
    lost = named.join(known, ["entity", "_s"], "left_anti").select("entity", "group_id", F.lit("an unknown source").alias("problem")).distinct()
    bad = F.when(F.col("group_time_ms").isNull() | F.isnan("group_time_ms") | (F.abs("group_time_ms") == float("inf")), "no time").when(F.col("seq").isNull() | (F.col("seq") < 0), "no point").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "a confidence outside 0 to 1").when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no reason")
    wrong = rows.withColumn("problem", bad).filter("problem is not null").select("entity", "group_id", "problem")
    twice = rows.groupBy("entity", "group_id").count().filter("count > 1").select("entity", "group_id", F.lit("decided twice").alias("problem"))
    return out.unionByName(lost).unionByName(wrong).unionByName(twice)


def fused_points(decisions: DataFrame) -> DataFrame:
    """The points that were chosen, a track for each entity, flagged fused; channels tell the group, the confidence and the source."""
    w = Window.partitionBy("entity").orderBy("group_time_ms", "group_id")
    return decisions.select(
        F.col("entity").alias("track_id"), (F.row_number().over(w) - 1).cast("bigint").alias("seq"), "lat", "lon", "ele", "time_ms", F.col("seq").alias("source_record"), F.col("chosen").alias("source_segment"), F.array(F.lit("fused")).alias("flags"),
        F.create_map(F.lit("fusion_confidence"), F.col("confidence"), F.lit("fusion_group"), F.col("group_id").cast("double")).alias("ext_num"), F.create_map(F.lit("fusion_source"), F.col("chosen"), F.lit("fusion_reason"), F.col("reason")).alias("ext_str"),
    )


def _check_overrides(groups: DataFrame, points: list, intervals: list, sources: DataFrame | None) -> None:
    spark = groups.sparkSession
    if any(not a <= b for _, _, a, b in intervals):
        raise ValueError("An interval override needs a start at or before its end")
    if points:
        wrong = spark.createDataFrame(points, "entity string, group_id bigint, source string").join(groups, ["entity", "group_id", "source"], "left_anti").first()
        if wrong:
            raise ValueError(f"Point override of a group or source that isn't there: {tuple(wrong)}")
    if intervals:
        known = groups.select("entity", "source") if sources is None else sources.select("entity", F.col("track_id").alias("source"))
        wrong = spark.createDataFrame([x[:2] for x in intervals], "entity string, source string").join(known, ["entity", "source"], "left_anti").first()
        if wrong:
            raise ValueError(f"Interval override of a source that isn't there: {tuple(wrong)}")


def auto_combine(groups: DataFrame, point_overrides: list | None = None, interval_overrides: list | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(entity, group_id, group_time_ms, chosen, seq, time_ms, lat, lon, ele, hdop, sat, n, skipped, confidence, reason) of each group.

    The candidate of the highest score, then of the first name, tells the source; that source's first candidate in
    the group is the point, and skipped are the sources of all other candidates in order of time, each as often as
    it has one. Confidence is 0.5 to 1 by the gap to the second score, 1 where there is none.

    point_overrides: (entity, group_id, source); interval_overrides: (entity, source, start_ms, end_ms), both ends
    inside. A point override beats an interval override, that beats the score; both have confidence 1. Only the first
    that matches counts; where an interval's source is absent from the group the score decides. Overrides of what
    isn't there (of sources, if given) are refused.
    """
    points, intervals = list(point_overrides or []), list(interval_overrides or [])
    _check_overrides(groups, points, intervals, sources)
    key = ["entity", "group_id"]
    # Groups are whole where their mean time was taken, so this aggregate needs no other exchange.
    out = score_candidates(groups).groupBy(*key).agg(
        F.first("group_time_ms").alias("group_time_ms"),
        F.min_by(F.struct("source", "reason", "score"), F.struct(-F.col("score"), "source", "time_ms", "seq")).alias("_best"),
        F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(1)).alias("_second"),
        F.sort_array(F.collect_list(F.struct("time_ms", "source", "seq", "lat", "lon", "ele", "hdop", "sat"))).alias("_all"),
    )
    exact: dict = {}
    for entity, group, source in points:
        exact.setdefault((entity, group), source)
    spans: dict = {}
    for entity, source, start, end in intervals:
        spans.setdefault(entity, []).append((source, float(start), float(end), f"manual interval override ({_iso(start)} – {_iso(end)}) selected source {source}"))
    spark = groups.sparkSession
    # Overrides are made by hand: a row for each point, and one for each entity with its intervals in order.
    kinds = {"_exact": "string", "_spans": "array<struct<source:string,start:double,end:double,reason:string>>"}
    for name, rows, on in (("_exact", [(*k, v) for k, v in exact.items()], key), ("_spans", list(spans.items()), key[:1])):
        if rows:
            out = out.join(F.broadcast(spark.createDataFrame(rows, f"entity string, {'group_id bigint, ' if len(on) > 1 else ''}{name} {kinds[name]}")), on, "left")
        else:
            out = out.withColumn(name, F.lit(None).cast(kinds[name]))
    out = out.withColumn("_span", F.get(F.filter("_spans", lambda x: (F.col("group_time_ms") >= x["start"]) & (F.col("group_time_ms") <= x["end"])), F.lit(0)))
    out = out.withColumn("_span", F.when(F.exists("_all", lambda x: x["source"] == F.col("_span.source")), F.col("_span")))
    out = out.withColumn("chosen", F.coalesce("_exact", "_span.source", "_best.source"))
    out = out.withColumn("_p", F.get(F.filter("_all", lambda x: x["source"] == F.col("chosen")), F.lit(0)))
    rest = F.filter("_all", lambda x: (x["source"] != F.col("_p.source")) | (x["seq"] != F.col("_p.seq")))
    gap = F.greatest(F.lit(0.5), F.least(F.lit(1.0), 0.5 + (F.col("_best.score") - F.col("_second")) / 100))
    reason = F.coalesce(F.concat(F.lit("manual point override selected source "), F.col("_exact")), F.col("_span.reason"), F.col("_best.reason"))
    confidence = F.when(F.col("_exact").isNotNull() | F.col("_span").isNotNull() | F.col("_second").isNull(), F.lit(1.0)).otherwise(gap)
    point = [F.col(f"_p.{c}").alias(c) for c in ("seq", "time_ms", "lat", "lon", "ele", "hdop", "sat")]
    return out.select(*key, "group_time_ms", "chosen", *point, F.size("_all").cast("bigint").alias("n"), F.transform(rest, lambda x: x["source"]).alias("skipped"), confidence.alias("confidence"), reason.alias("reason"))


def fusion_report(decisions: DataFrame, sources: DataFrame) -> DataFrame:
    """(entity, source, chosen, skipped, groups, mean_confidence): how often, with zeros; groups and their mean confidence are the entity's."""
    decisions = held(decisions.select("entity", "chosen", "skipped", "confidence"))
    chosen = decisions.groupBy("entity", F.col("chosen").alias("source")).agg(F.count("*").alias("chosen"))
    skipped = decisions.select("entity", F.explode("skipped").alias("source")).groupBy("entity", "source").agg(F.count("*").alias("skipped"))
    whole = decisions.groupBy("entity").agg(F.count("*").alias("groups"), F.avg("confidence").alias("mean_confidence"))
    out = sources.select("entity", F.col("track_id").alias("source")).join(chosen, ["entity", "source"], "left").join(skipped, ["entity", "source"], "left").join(whole, "entity", "left")
    return out.fillna(0, ["chosen", "skipped", "groups", "mean_confidence"])
