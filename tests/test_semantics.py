"""Edge rules and properties that the demo tracks don't reach."""

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackspark.functions.geo import ecef, geodetic, haversine, round_up, shortest_delta
from trackspark.operators import align, edit, fusion, kinematics, ordered, resample

SCHEMA = "track_id string, seq bigint, lat double, lon double, ele double, time_ms double, hdop double, sat double, flags array<string>"


def track(spark, rows, name="A"):
    """rows: (lat, lon, ele, time_ms)"""
    return spark.createDataFrame([(name, i, *map(lambda x: None if x is None else float(x), r), 1.0, 8.0, []) for i, r in enumerate(rows)], SCHEMA)


def ordered_rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("track_id", "seq").collect()]


def test_geodesy_round_trip(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0), (-89.9, 179.9, -100.0), (0.0, -180.0, 8000.0)], "a double, o double, h double")
    back = geodetic(*ecef(F.col("a"), F.col("o"), F.col("h")))
    for a, o, h, a2, o2, h2 in df.select("a", "o", "h", *back).collect():
        assert math.isclose(a, a2, abs_tol=1e-9) and math.isclose(h, h2, abs_tol=1e-3)
        assert math.isclose((o - o2 + 540) % 360 - 180, 0, abs_tol=1e-9)


def test_null_coordinates_have_no_distance(spark):
    row = spark.range(1).select(haversine(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)), round_up(F.lit(-0.5), 0), shortest_delta(F.lit(350.0), F.lit(10.0))).first()
    assert tuple(row) == (None, 0.0, 20.0)


def test_swap_twice_and_opposite_shifts(spark):
    df = track(spark, [(1, 2, 3, 4), (5, 6, None, None)])
    same = edit.shift_time(edit.shift_time(edit.swap_lat_lon(edit.swap_lat_lon(df)), 5), -5)
    assert ordered_rows(same, "lat", "lon", "ele", "time_ms") == ordered_rows(df, "lat", "lon", "ele", "time_ms")


def test_dedupe_keeps_the_last_kept_as_anchor(spark):
    step = 0.0005  # about 56 m
    df = track(spark, [(i * step, 0, 0, i) for i in range(6)])
    assert [r[0] for r in ordered_rows(ordered.dedupe(df, 100), "seq")] == [0, 2, 4]
    assert ordered.dedupe(track(spark, [(1, 1, 0, 0), (1, 1, 0, 1), (2, 1, 0, 2)])).count() == 2


def test_ema_skips_missing(spark):
    df = track(spark, [(0, 0, 10, 0), (0, 0, None, 1), (0, 0, 20, 2)])
    assert ordered_rows(ordered.ema(df, 0.5), "ele", "flags") == [(10.0, []), (None, []), (15.0, ["ema_smoothed"])]


def test_sorted_scan_over_batches_equals_one_batch(spark):
    rng = np.random.default_rng(1)
    df = track(spark, [(0, 0, x, i) for i, x in enumerate(rng.random(500))])
    whole = ordered_rows(ordered.ema(df, 0.2), "ele")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert ordered_rows(ordered.ema(df, 0.2), "ele") == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose([x[0] for x in whole], pd.Series([r["ele"] for r in df.orderBy("seq").collect()]).ewm(alpha=0.2, adjust=False).mean())


def test_simplify_keeps_ends_and_corner(spark):
    df = track(spark, [(0, 0, 0, 0), (0, 0.001, 0, 1), (0, 0.002, 0, 2), (0.002, 0.002, 0, 3)])
    assert [r[0] for r in ordered_rows(ordered.simplify(df, 5), "seq")] == [0, 2, 3]


def test_nearest_tie_takes_the_earlier_and_tolerance_is_inclusive(spark):
    ref, tgt = track(spark, [(0, 0, 0, 1000)], "p"), track(spark, [(0, 0, 0, 900), (0, 0, 0, 1100)], "p")
    assert [(r["tgt_seq"], r["delta_ms"]) for r in align.align_nearest(ref, tgt, 100).collect()] == [(0, -100.0)]
    assert align.align_nearest(ref, tgt, 99).count() == 0


def test_bracket_refuses_wide_gap_on_exact_hit_but_position_accepts_it(spark):
    ref, tgt = track(spark, [(0, 0, 0, 5000)], "p"), track(spark, [(0, 0, 0, 0), (1, 0, 0, 5000)], "p")
    assert align.align_interpolated(ref, tgt, 1000).count() == 0
    at = spark.createDataFrame([("p", 5000.0)], "track_id string, at_ms double")
    assert [(r["lat"], r["derived"]) for r in align.position_at_time(tgt, at, 1000).collect()] == [(1.0, False)]


def test_longitude_interpolates_over_the_date_line(spark):
    ref, tgt = track(spark, [(0, 0, 0, 500)], "p"), track(spark, [(0, 179.5, 0, 0), (0, -179.5, 0, 1000)], "p")
    assert abs(align.align_interpolated(ref, tgt, 2000).first()["p"]["lon"]) == 180.0


def test_resample_keeps_samples_and_respects_gaps(spark):
    df = track(spark, [(0, 0, 0, 0), (1, 0, 10, 1000), (2, 0, 20, 10_000)])
    out = resample.resample_fixed_rate(df, 1.0, max_gap_ms=5000)
    assert ordered_rows(out, "time_ms", "flags") == [(0.0, []), (1000.0, []), (10000.0, [])]
    half = resample.resample_fixed_rate(df.filter("seq < 2"), 2.0)
    assert ordered_rows(half, "time_ms", "lat", "flags") == [(0.0, 0.0, []), (500.0, 0.5, ["interpolated"]), (1000.0, 1.0, [])]


def test_short_segments_merge_into_the_longer_neighbour(spark):
    rows = [(0, i * 0.0002, 0, i * 1000) for i in range(4)] + [(0, 0.0006, 0, 4000)] + [(0, 0.0006 + i * 0.0002, 0, 4000 + i * 1000) for i in range(1, 3)]
    kinds = [(r["kind"], r["point_count"]) for r in kinematics.segment_track(kinematics.kinematics(track(spark, rows))).orderBy("segment").collect()]
    assert kinds == [("level", 7)]


def test_groups_begin_at_the_anchor(spark):
    rows = [("E", "A", 1, i, float(t), 0.0, 0.0, None, 1.0) for i, t in enumerate([0, 60, 120, 180, 500])]
    df = spark.createDataFrame(rows, "entity string, source string, priority int, seq bigint, time_ms double, lat double, lon double, ele double, hdop double")
    assert [r[0] for r in fusion.group_by_time(df, 100).orderBy("seq").select("group_id").collect()] == [0, 0, 1, 1, 2]


FUSED = "entity string, source string, priority int, seq bigint, time_ms double, lat double, lon double, ele double, hdop double, sat double, group_id bigint"


def plain_fusion(rows, points=(), intervals=()):
    """Fusion in plain Python: {(entity, group): (source, seq, skipped, confidence, reason)}."""
    fixed = lambda x, n=2: f"{Decimal(x).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP)}"  # noqa: E731  as toFixed
    groups, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[4], r[1], r[3])):
        groups.setdefault((r[0], r[10]), []).append(r)
    for (entity, group), all in groups.items():
        mean, ranked = sum(r[4] for r in all) / len(all), []
        for r in all:
            score, why = r[2] * 100, [f"source priority {r[2]}"]
            if r[8] is not None:
                bonus = max(0, min(10, 10 - r[8]))
                score, why = score + bonus, [*why, f"HDOP {fixed(r[8])} (+{fixed(bonus)})"]
            if r[9] is not None:
                bonus = min(r[9], 12) * 0.5
                score, why = score + bonus, [*why, f"{r[9]:.0f} satellites (+{fixed(bonus)})"]
            off = abs(r[4] - mean)
            if off > 0:
                score, why = score - off / 1000, [*why, f"{fixed(off, 0)} ms from group time (-{fixed(off / 1000)})"]
            ranked.append((-score, r[1], "; ".join(why)))
        ranked.sort(key=lambda x: x[:2])
        source, why = ranked[0][1:]
        sure = 1 if len(ranked) == 1 else max(0.5, min(1, 0.5 + (ranked[1][0] - ranked[0][0]) / 100))
        span = next((x for x in intervals if x[0] == entity and x[2] <= mean <= x[3]), None)
        exact = next((x[2] for x in points if x[:2] == (entity, group)), None)
        if exact:
            source, sure, why = exact, 1, f"manual point override selected source {exact}"
        elif span and any(r[1] == span[1] for r in all):
            source, sure, why = span[1], 1, "manual interval"
        first = next(r for r in all if r[1] == source)
        out[entity, group] = (source, first[3], [r[1] for r in all if r is not first], sure, why)
    return out


def test_fusion_equals_plain_scoring(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        group, k = divmod(i, 4)
        if rng.random() < 0.8:
            hdop, sat = (None if rng.random() < 0.2 else float(x) for x in (rng.integers(0, 60) / 4, rng.integers(0, 16)))
            source = "ABC"[rng.integers(3)]
            rows.append((f"E{group % 2}", source, {"A": 1, "B": 2, "C": 2}[source], i, group * 10_000.0 + 500 * int(rng.integers(0, 4)), 0.0, float(i), None, hdop, sat, group // 2))
    groups = spark.createDataFrame(rows, FUSED)
    intervals = [("E0", "A", 0, 150_000), ("E0", "B", 100_000, 400_000), ("E1", "A", 300_000, 500_000)]
    points = [(r[0], r[10], r[1]) for r in rows[20:120:25]]
    for case in ((), (points, ()), ((), intervals), (points, intervals)):
        want, got = plain_fusion(rows, *case), fusion.auto_combine(groups, *case).collect()
        assert len(got) == len(want)
        for r in got:
            source, seq, skipped, sure, why = want[r["entity"], r["group_id"]]
            assert (r["chosen"], r["seq"], r["skipped"], r["n"]) == (source, seq, skipped, len(skipped) + 1)
            assert math.isclose(r["confidence"], sure, abs_tol=1e-9)
            assert r["reason"].startswith(why) if why == "manual interval" else r["reason"] == why
    sources = spark.createDataFrame([(e, s) for e in ("E0", "E1", "E2") for s in "ABC"], "entity string, track_id string")
    want = plain_fusion(rows)
    report = {(r["entity"], r["source"]): r for r in fusion.fusion_report(fusion.auto_combine(groups), sources).collect()}
    assert len(report) == 9 and tuple(report["E2", "A"])[2:] == (0, 0, 0, 0.0)
    for (e, s), r in report.items():
        own = [x for k, x in want.items() if k[0] == e]
        assert (r["chosen"], r["skipped"], r["groups"]) == (sum(x[0] == s for x in own), sum(x[2].count(s) for x in own), len(own))
        assert math.isclose(r["mean_confidence"], sum(x[3] for x in own) / max(1, len(own)))


def test_fusion_takes_the_highest_priority_and_refuses_wrong_overrides(spark):
    rows = [("E", "A", 1, 0, 0.0, 0.0, 0.0, None, 0.5, 12.0, 0), ("E", "B", 3, 0, 100.0, 0.0, 0.0, None, 20.0, 3.0, 0)]
    groups = spark.createDataFrame(rows, FUSED)
    assert tuple(fusion.auto_combine(groups).select("chosen", "confidence").first()) == ("B", 1.0)
    for case in (([("E", 0, "C")], []), ([("E", 7, "A")], []), ([], [("E", "C", 0, 1)]), ([], [("E", "A", 1, 0)])):
        with pytest.raises(ValueError):
            fusion.auto_combine(groups, *case)


def test_track_diff_pairs_by_order(spark):
    rows = [(i / 100, 0, i, i * 1000) for i in range(40)]
    diff = lambda after: align.track_diff_ordered(track(spark, rows), track(spark, after)).first()
    pick = lambda r: (r["alignment"], r["unchanged"], r["modified"], r["added"], r["removed"])
    assert pick(diff([r for i, r in enumerate(rows) if i % 10])) == ("subsequence", 36, 0, 0, 4)  # renumbered by the deletion
    assert pick(diff([*rows[:5], (50, 0, 0, 1), (51, 0, 0, 2), *rows[5:]])) == ("subsequence", 40, 0, 2, 0)
    assert pick(diff([(9, 9, *r[2:]) for r in rows[1:]])) == ("rebuilt", 0, 0, 0, 0)
    shifted = diff([(r[0], r[1], None if i == 3 else r[2] + (i == 7), r[3] + 500 * (i == 9)) for i, r in enumerate(rows)])
    assert pick(shifted) == ("index", 37, 3, 0, 0) and (shifted["position"], shifted["elevation"], shifted["time"]) == (False, True, True)
    assert (shifted["max_position_shift_m"], shifted["max_elevation_shift_m"], shifted["max_time_shift_ms"]) == (0, 1, 500)
    moved = diff([(r[0] + (i == 2), *r[1:]) for i, r in enumerate(rows)])
    assert abs(moved["max_position_shift_m"] - 111195) < 1
    long = [(i / 1000, 0, i, i) for i in range(200)]
    ahead = align.track_diff_ordered(track(spark, long), track(spark, long[63:])).first()
    beyond = align.track_diff_ordered(track(spark, long), track(spark, long[65:])).first()
    assert pick(ahead) == ("subsequence", 137, 0, 0, 63) and pick(beyond)[0] == "rebuilt"


def plain_cubic(xs, ys, x):
    """A monotone cubic in Bezier form: control points from slopes that are the mean of neighbouring legs, 0 at a turn, and within a circle of radius 3 about no slope."""
    legs = list(zip(zip(xs, ys), zip(xs[1:], ys[1:])))
    rise = [(q[1] - p[1]) / (q[0] - p[0]) for p, q in legs]
    tilt = [rise[0]] + [(p + q) / 2 if p * q > 0 else 0.0 for p, q in zip(rise, rise[1:])] + [rise[-1]]
    for k, r in enumerate(rise):
        pair = [0.0 if r == 0 else max(0.0, t / r) for t in tilt[k : k + 2]]
        tilt[k : k + 2] = [r * u * min(1.0, 3 / (math.hypot(*pair) or 1)) for u in pair]
    for k, ((x0, y0), (x1, y1)) in enumerate(legs):
        if x <= x1 or k == len(legs) - 1:
            t, third = min(1.0, (x - x0) / (x1 - x0)), (x1 - x0) / 3
            points = [y0, y0 + tilt[k] * third, y1 - tilt[k + 1] * third, y1]
            while len(points) > 1:
                points = [p + (q - p) * t for p, q in zip(points, points[1:])]
            return points[0]


def test_resample_by_distance_equals_plain_cubic(spark):
    rng = np.random.default_rng(6)
    rows, lon = [], 179.97
    for i in range(60):
        lon += float(rng.choice([0.0001, 0.002, 0.004]))
        rows.append((10 + float(rng.integers(0, 5)) / 1000 * (i % 7 > 2), (lon + 180) % 360 - 180, float(rng.integers(0, 3)) * 50, i * 1000 + float(rng.integers(0, 900))))
        if i % 9 == 0:
            rows.append(rows[-1])  # coincides
    df = track(spark, rows).unionByName(track(spark, [(0, 0, 0, 0), (0, 0.01, None, 5), (0, 0.02, 3, 4)], "B")).unionByName(track(spark, [(5, 5, 1, 1), (5, 5, 2, 2)], "C"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {n: [r for r in all if r["track_id"] == n] for all in [resample.resample_by_distance(df, 500.0).orderBy("track_id", "distance_m").collect()] for n in "ABC"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    knots = [r for i, r in enumerate(rows) if i == 0 or r != rows[i - 1]]
    legs = spark.createDataFrame([(i, *map(float, (*p[:2], *q[:2]))) for i, (p, q) in enumerate(zip(knots, knots[1:]))], "i int, a double, b double, c double, d double")
    xs = [0.0, *np.cumsum([r[0] for r in legs.orderBy("i").select(haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()])]
    want = [k * 500.0 for k in range(int(xs[-1] // 500) + 1)] + [xs[-1]]
    assert np.allclose([r["distance_m"] for r in got["A"]], want)
    for j, (name, close) in enumerate([("lat", 1e-9), ("lon", 1e-9), ("ele", 1e-6), ("time_ms", 1e-5)]):
        ys = [r[j] + 360 * (j == 1 and r[1] < 0) for r in knots]
        for r, x in zip(got["A"], want):
            y = plain_cubic(xs, ys, x)
            assert abs(r[name] - (y - 360 * (j == 1 and y > 180))) < close, (name, x)
    assert all(r["flags"] == ["interpolated", "monotone_cubic"] and r["hdop"] == 1 and r["sat"] == 8 for r in got["A"])
    assert math.isclose(got["B"][-1]["lon"], 0.02) and {(r["ele"], r["time_ms"]) for r in got["B"]} == {(None, None)}
    assert [(r["lat"], r["ele"], r["flags"]) for r in got["C"]] == [(5.0, 1.0, [])]


def test_empty_input(spark):
    df = track(spark, [])
    assert kinematics.kinematics(df).count() == ordered.quality_events(df).count() == ordered.dedupe(df, 5).count() == 0


def test_rounds_as_sql(spark, duck):
    from trackspark.queries import _round

    values = [34.105, 34.1149999, -34.105, 34.18500000000001, 34.0350, -117.645, 0.0, None, *(34.0 + k * 0.0005 + j / 1e6 for k in range(400) for j in range(0, 100, 7)), *(-118 + k * 0.0007 for k in range(700))]
    got = [r[0] for r in spark.createDataFrame([(x, i) for i, x in enumerate(values)], "x double, i int").orderBy("i").select(_round("x", 2)).collect()]
    assert got == [r[0] for r in duck.execute("SELECT round(unnest($1::DOUBLE[]), 2)", [values]).fetchall()]


def test_places_of_a_sorted_table(spark):
    """Rows enough that the sort is cut into parts."""
    from trackspark.demo_tracks import points
    from trackspark.operators.edit import table_sort
    from trackspark.queries import _placed

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        placed = _placed(table_sort(points(spark, "/root/testdata/sf0.1"), "ele", True)).select("place", "ele", "track_id", "seq")
        assert "Sort [" not in placed._jdf.queryExecution().optimizedPlan().toString()  # sorted once: two sorts can be cut in two ways
        got = placed.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got.sort(key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(100_000))
    order = [(r["ele"] is None, -(r["ele"] or 0), r["track_id"], r["seq"]) for r in got]
    assert order == sorted(order)


def test_geodetic_far_from_the_ground(spark):
    from trackspark.functions.geo import enu, enu_to_geodetic

    rows = spark.createDataFrame([(e, h) for e in (0.0, 1e5, 1.3e6, 7.6e6, 4.6e7) for h in (0.0, 4000.0)], "east double, up double")
    anchor = F.lit(39.4166), F.lit(-118.7005), F.lit(1199.0)
    lat, lon, ele = enu_to_geodetic(F.col("east"), F.lit(3000.0), F.col("up"), *anchor)
    e, n, u = enu(lat, lon, ele, *anchor)
    assert rows.select(F.max(F.greatest(F.abs(e - F.col("east")), F.abs(n - 3000), F.abs(u - F.col("up"))))).first()[0] < 1e-5


def test_fusion_groups_of_many_candidates_of_one_time(spark, tmp_path):
    """Only the different times of an entity are scanned in order."""
    from trackspark.operators import fusion

    rows = spark.range(0, 5000, 1, 4).selectExpr("'E' entity", "'T' || id % 3 source", "id div 3 seq", "cast(id % 50 * 1000 as double) time_ms")
    got = fusion.group_by_time(rows, 1500.0).groupBy("group_id").agg(F.count("*").alias("n"), F.min("time_ms").alias("t")).orderBy("group_id").collect()
    assert [(r["group_id"], r["n"], r["t"]) for r in got] == [(k, 200, k * 2000.0) for k in range(25)]
    fusion_scan = fusion._numbered(rows.select("entity", "time_ms").distinct(), 1500.0, None)
    assert fusion_scan.columns == ["entity", "time_ms", "group_id"] and fusion_scan.count() == 50
