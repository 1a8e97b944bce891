"""Outliers, gaps and refits against plain Python, and their edge rules."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions.cubic import MonotoneCubic
from trackspark.operators import health, kinematics, ordered, outliers, resample
from trackspark.schema import POINTS, conform, number_map

from .test_semantics import SCHEMA, ordered_rows, plain_cubic, track

R = 6371008.8


def metres(a, b):
    (p, q), (r, s) = (map(math.radians, a), map(math.radians, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


def wavy(n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(10 + i * 1e-4 + float(rng.normal()) * 1e-6, 20 + i * 2e-4, 100 + i + float(rng.normal()), i * 1000.0) for i in range(n)]
    for i, (dlat, dele) in {20: (0.002, 0), 35: (0, 400), 36: (0, 380)}.items():
        rows[i] = (rows[i][0] + dlat, rows[i][1], rows[i][2] + dele, rows[i][3])
    return rows


def test_outliers_equal_plain_statistics(spark):
    rows, w = wavy(), 5
    speed = [None, *(metres(p[:2], q[:2]) for p, q in zip(rows, rows[1:]))]
    mid = lambda xs: statistics.median([x for x in xs if x is not None])
    res = {"position": [], "elevation": [], "speed": []}
    for i in range(w, len(rows) - w):
        a, b = rows[i - w : i], rows[i + 1 : i + 1 + w]
        back, ahead = ((mid(r[0] for r in s), mid(r[1] for r in s)) for s in (a, b))
        res["position"].append((metres(rows[i][:2], back) + metres(rows[i][:2], ahead) - metres(back, ahead)) / 2)
        res["elevation"].append(rows[i][2] - (mid(r[2] for r in a) + mid(r[2] for r in b)) / 2)
        res["speed"].append(speed[i] - (mid(speed[i - w : i]) + mid(speed[i + 1 : i + 1 + w])) / 2)
    steps = np.diff(sorted({r[2] for r in rows}))
    floor = {"position": 1.0, "elevation": max(1.0, float(np.median(steps))), "speed": 0.5}
    scale = {c: max(1.4826 * statistics.median(abs(x - statistics.median(v)) for x in v), floor[c]) for c, v in res.items()}
    got = outliers.detect_outliers(track(spark, rows)).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(w, len(rows) - w))
    for k, r in enumerate(got):
        score = {c: abs(v[k]) / scale[c] for c, v in res.items()}
        assert math.isclose(r["score"], max(score.values()), rel_tol=1e-6, abs_tol=1e-6)
        assert r["channel"] == max(score, key=score.get) and r["outlier"] == (max(score.values()) > 3)
    assert {20, 35, 36} <= {r["seq"] for r in got if r["outlier"]}


def test_made_up_points_are_not_judged_and_short_tracks_neither(spark):
    df = track(spark, wavy()).withColumn("flags", F.when(F.col("seq") == 20, F.array(F.lit("interpolated"))).otherwise(F.col("flags")))
    assert 20 not in [r["seq"] for r in outliers.detect_outliers(df).collect()]
    assert outliers.detect_outliers(track(spark, wavy()[:10])).count() == 0
    with pytest.raises(ValueError):
        outliers.detect_outliers(df, channels=("colour",))


def test_turn_floor_is_that_of_a_turn(spark):
    """A steady turn laid out point by point."""
    v, dt, turn, w = 50.0, 2.0, 30.0, 5
    x, y, head, places = 0.0, 0.0, 0.0, []
    for _ in range(2 * w + 3):
        places.append((x, y))
        head += math.radians(turn) * dt
        x, y = x + v * dt * math.cos(head), y + v * dt * math.sin(head)
    mid = lambda ps: (statistics.median(p[0] for p in ps), statistics.median(p[1] for p in ps))
    c, back, ahead = places[w + 1], mid(places[1 : w + 1]), mid(places[w + 2 : 2 * w + 2])
    want = max(0, (math.dist(c, back) + math.dist(c, ahead) - math.dist(back, ahead)) / 2)
    step = math.degrees(v * dt / R)
    df = track(spark, [(i * step, 0, 0, i * dt * 1000) for i in range(20)])
    assert math.isclose(outliers.turn_floor(df, turn, w).first()["floor_m"], want, rel_tol=1e-6)
    assert outliers.turn_floor(df, math.inf, w).first()["floor_m"] == 0


def test_cubic_equals_plain_cubic():
    rng = np.random.default_rng(5)
    for n in (2, 3, 7):
        for _ in range(50):
            x, y = np.cumsum(rng.integers(1, 9, n)).astype(float), rng.integers(0, 4, n).astype(float)
            at = rng.uniform(x[0], x[-1], 20)
            assert np.allclose(MonotoneCubic(x, y)(at), [plain_cubic(list(x), list(y), t) for t in at])
            assert MonotoneCubic(x, y)(at).min() >= y.min() - 1e-12 and MonotoneCubic(x, y)([x[0] - 5, x[-1] + 5]).tolist() == [y[0], y[-1]]
    with pytest.raises(ValueError):
        MonotoneCubic([1, 1], [0, 1])


def gapped(spark, synth=()):
    rows = [(1 + i * 1e-4, 179.9995 + i * 1e-4, 100 + i * i / 10, i * 1000.0 + (20_000 if i >= 10 else 0)) for i in range(20)]
    rows = [(a, (o + 180) % 360 - 180, e, t) for a, o, e, t in rows]
    df = track(spark, rows)
    return rows, df.withColumn("flags", F.when(F.col("seq").isin(*synth), F.array(F.lit("interpolated"))).otherwise(F.col("flags"))) if synth else df


def test_gap_is_filled_by_the_cubic_through_real_neighbours(spark):
    rows, df = gapped(spark, (8, 11))
    got = [r for r in outliers.fill_gaps(df, 5000, 4000, context=3, profile="unconstrained").orderBy("seq").collect() if r["time_ms"] not in [x[3] for x in rows]]
    assert [r["time_ms"] for r in got] == [13_000.0, 17_000.0, 21_000.0, 25_000.0, 29_000.0] and [r["seq"] for r in got] == [10, 11, 12, 13, 14]
    left, right = rows[9], rows[10]
    assert all(math.isclose(r["ele"], left[2] + (right[2] - left[2]) * (r["time_ms"] - 9000) / 21_000) for r in got)  # a straight line
    got = [r for r in outliers.fill_gaps(df, 5000, 4000, context=3).orderBy("seq").collect() if r["time_ms"] not in [x[3] for x in rows]]
    knots = [rows[i] for i in (6, 7, 9, 10, 12, 13)]  # 8 and 11 were made up
    for j, name in ((0, "lat"), (1, "lon"), (2, "ele")):
        ys = [k[j] + 360 * (j == 1 and k[1] < 0) for k in knots]
        for r in got:
            y = plain_cubic([k[3] for k in knots], ys, r["time_ms"])
            assert abs(r[name] - (y - 360 * (j == 1 and y > 180))) < 1e-9
    assert all(r["flags"] == ["interpolated"] and r["hdop"] == 1.0 for r in got)


def test_gap_that_breaks_the_profile_stays(spark):
    df = track(spark, [(0, 0, 0, 0), (0, 1e-5, 0, 1000), (3, 0, 0, 11_000), (3, 1e-5, 0, 12_000)])
    assert [(r["start_seq"], r["reason"], len(r["points"])) for r in outliers.gap_fills(df, 5000, 1000, profile="ground").collect()] == [(1, "ground speed", 0)]
    assert outliers.fill_gaps(df, 5000, 1000, profile="ground").count() == 4
    untimed = track(spark, [(0, 0, 0, 0), (0, 0, 0, None), (0, 0, 0, 9000), (0, 0, 0, 29_000)])
    assert [r["reason"] for r in outliers.gap_fills(untimed, 5000, 1000).collect()] == ["times don't rise"]


def test_violations_and_the_same_in_numpy(spark):
    rng = np.random.default_rng(9)
    for k in range(6):
        rows = [(float(i) * 1e-4 + float(rng.normal()) * 2e-4 * (k > 1), float(rng.normal()) * 1e-4 * (k > 2), float(rng.normal()) * 30 * (k > 3), i * 2000.0) for i in range(12)]
        first = outliers.profile_violations(track(spark, rows), "ground").collect()
        t = np.array(rows)
        why = outliers.breaks_profile(t[:, 3], t[:, 0], t[:, 1], t[:, 2], outliers.PROFILES["ground"])
        assert [r["limit"] for r in first] == ([why] if why else [])


def test_drop_outliers_removes_or_refits_runs_in_place(spark):
    rows = wavy()
    df = track(spark, rows).withColumn("name", F.lit("n"))
    found = {r["seq"] for r in outliers.detect_outliers(df, floors=outliers.turn_floor(df, math.inf, 5)).collect() if r["outlier"]}
    gone = outliers.drop_outliers(df, "unconstrained", reconstruct=False)
    assert {r["seq"] for r in df.collect()} - {r["seq"] for r in gone.collect()} == found
    fixed = outliers.drop_outliers(df, "unconstrained").orderBy("seq").collect()
    assert [r["time_ms"] for r in fixed] == [r[3] for r in rows] and {r["seq"] for r in fixed if r["flags"] == ["interpolated"]} == found
    assert all(r["name"] == "n" for r in fixed)
    run = sorted(found & {34, 35, 36, 37})
    a, b = rows[run[0] - 1], rows[run[-1] + 1]
    assert all(math.isclose(fixed[i]["ele"], a[2] + (b[2] - a[2]) * (rows[i][3] - a[3]) / (b[3] - a[3])) for i in run)
    some = outliers.drop_outliers(df, "unconstrained", rng=(0, 25)).collect()
    assert {r["seq"] for r in some if r["flags"]} == {i for i in found if i <= 25}
    assert outliers.drop_outliers(df.limit(0)).count() == 0


def test_notional_fill_keeps_columns_and_counts_anew(spark):
    df = track(spark, [(0, 0, 0, 0), (0, 1e-3, 10, 1000), (0, 2e-3, None, 6000)])
    out = resample.notional_fill(df, 3000).orderBy("seq").collect()
    assert [(r["seq"], r["time_ms"], r["ele"], r["flags"]) for r in out] == [(0, 0, 0, []), (1, 1000, 10, []), (2, 2000, None, ["notional"]), (3, 3000, None, ["notional"]), (4, 4000, None, ["notional"]), (5, 5000, None, ["notional"]), (6, 6000, None, [])]
    assert [(r["inserted"], r["sample_ms"]) for r in resample.notional_gaps(df, 3000).collect()] == [(4, 1000.0)]
    assert kinematics.kinematics(resample.notional_fill(df, 3000)).count() == 7


def test_equal_times_are_refused_unless_told(spark):
    df = track(spark, [(0, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 1000)])
    with pytest.raises(Exception, match="equal times in track A"):
        resample.resample_fixed_rate(df, 1).collect()
    assert ordered_rows(resample.resample_fixed_rate(df, 1, duplicates="first"), "lat") == [(0.0,), (2.0,)]


def test_dejitter_by_other_steps_and_with_text(spark):
    df = track(spark, [(0, 0, 0, 10), (0, 0, 4, 10), (0, 0, 0, None), (0, 0, 0, 12), (0, 0, 0, 50)]).withColumn("name", F.concat(F.lit("p"), F.col("seq").cast("string")))
    assert sorted(ordered_rows(ordered.dejitter(df, epsilon_ms=5), "seq", "time_ms", "flags")) == [(0, 10.0, []), (1, 15.0, ["time_dejittered"]), (2, None, []), (3, 20.0, ["time_dejittered"]), (4, 50.0, [])]
    assert sorted(ordered_rows(ordered.dejitter(df, "average"), "seq", "ele", "name")) == [(0, 2.0, "p0"), (2, 0.0, "p2"), (3, 0.0, "p3"), (4, 0.0, "p4")]


def test_kinematics_only_for_tracks_without(spark):
    df = track(spark, [(0, 0, 0, 0), (0, 1e-3, 0, 1000)]).unionByName(track(spark, [(0, 0, 0, 0), (0, 1e-3, 0, 1000)], "B")).withColumn("heading_deg", F.when(F.col("track_id") == "B", 7.0))
    got = {(r["track_id"], r["seq"]): (r["heading_deg"], r["ground_speed_mps"] is None) for r in kinematics.ensure_kinematics(df).collect()}
    assert got == {("A", 0): (None, True), ("A", 1): (90.0, False), ("B", 0): (7.0, True), ("B", 1): (7.0, True)}
    recorded = kinematics.point_speeds(track(spark, [(0, 0, 0, 0), (0, 1, 0, 1000)]).withColumn("speed_mps", F.when(F.col("seq") == 1, 5.0)))
    assert ordered_rows(recorded, "speed_mps") == [(None,), (5.0,)]
    assert SCHEMA


def test_maps_are_fitted_where_all_knots_have_a_channel(spark):
    rows, df = gapped(spark)
    angle = (350 + 3 * F.col("seq")) % 360
    own = {"heading_deg": angle.cast("double"), "rate": (F.col("seq") ** 2).cast("double"), "rare": F.when(F.col("seq") < 11, 1.0)}
    df = conform(df.drop("hdop", "sat").withColumn("ext_num", number_map(own)).withColumn("ext_str", F.create_map(F.lit("note"), F.col("seq").cast("string"))))
    made = [r for r in outliers.fill_gaps(df, 5000, 4000, context=3).orderBy("seq").collect() if "interpolated" in r["flags"]]
    knots = [rows[i] + (i,) for i in (7, 8, 9, 10, 11, 12)]
    for r in made:
        want = {"rate": plain_cubic([k[3] for k in knots], [k[4] ** 2 for k in knots], r["time_ms"]), "heading_deg": plain_cubic([k[3] for k in knots], [350 + 3 * k[4] for k in knots], r["time_ms"]) % 360}
        assert set(r["ext_num"]) == set(want) and all(math.isclose(r["ext_num"][c], v) for c, v in want.items())
    assert len(made) == 5 and all(r["ext_str"] == {} for r in made)
    spiked = df.filter("seq < 10").withColumns({"lat": F.when(F.col("seq") == 5, F.col("lat") + 0.01).otherwise(F.col("lat")), "ext_num": F.when(F.col("seq") == 5, F.map_concat(F.map_filter("ext_num", lambda k, _: k != "rate"), F.create_map(F.lit("rate"), F.lit(1e9), F.lit("own"), F.lit(7.0)))).otherwise(F.col("ext_num"))})
    fixed = outliers.drop_outliers(spiked, "unconstrained", window=2).filter("seq = 5").first()
    assert fixed["flags"] == ["interpolated"] and fixed["ext_num"]["rate"] == 26 and fixed["ext_num"]["own"] == 7.0 and fixed["ext_str"] == {"note": "5"}


def test_distance_resampling_keeps_the_points_schema(spark):
    df = track(spark, [(0, i / 100, i, i * 1000.0) for i in range(5)]).drop("hdop", "sat")
    own = {"heading_deg": ((350 + 5 * F.col("seq")) % 360).cast("double"), "rate": (2 * F.col("seq")).cast("double"), "rare": F.when(F.col("seq") != 2, F.col("seq") * 1.0)}
    df = conform(df.withColumns({"ext_num": number_map(own), "ext_str": F.create_map(F.lit("n"), F.col("seq").cast("string")), "name": F.concat(F.lit("p"), F.col("seq").cast("string"))}))
    got = resample.resample_by_distance(df, 300.0).orderBy("seq").collect()
    leg = 2 * math.pi * 6371008.8 * 0.01 / 360
    assert [r["seq"] for r in got] == list(range(len(got))) and set(POINTS) <= set(got[0].asDict()) and len(got) == int(4 * leg // 300) + 2
    for r in got:
        at = r["distance_m"] / leg
        near = min(range(5), key=lambda i: (abs(at - i), i))
        assert math.isclose(r["ext_num"]["rate"], 2 * at, abs_tol=1e-9) and abs((r["ext_num"]["heading_deg"] - 350 - 5 * at + 180) % 360 - 180) < 1e-6
        assert r["ext_str"] == {"n": str(near)} and r["name"] == f"p{near}" and r["ext_num"].get("rare") == (None if near == 2 else float(near))


def test_health_flags_every_span_and_takes_limits(spark):
    rng, rows, t = random.Random(6), [], 0.0
    lat = 34.0
    for i in range(400):
        t += 5000.0
        lat += 0.0 if 150 <= i < 260 else 0.001
        rows.append((lat if i != 300 else 99.0, -118 + rng.random() * 1e-5, 100 + max(0, min(i - 20, 380 - i)) * 10.0, t - (20_000 if i == 40 else 0)))
    df = track(spark, rows).withColumn("hdop", F.when(F.col("seq") == 7, 9.0).otherwise(F.col("hdop")))
    flags = {}
    for r in health.health_flags(df).collect():
        flags.setdefault(r["check"], []).append((r["start_seq"], r["end_seq"], r["measure"]))
    assert flags["schema-parse"] == [(300, 300, None)] and [f[0] for f in flags["time-order-span"]] == [40] and flags["gps-fix-quality"] == [(7, 7, 9.0)]
    high = [i for i, r in enumerate(rows) if r[2] >= 304.8]
    assert flags["altitude-profile"] == [(high[0], high[-1], float(len(high)))]

    def far(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    start, end = kinematics.movement_window(df, 5.144).select("start_seq", "end_seq").first()
    stays, anchor = {}, None
    for i in range(start, end + 1):
        if anchor is not None and far(rows[anchor], rows[i]) <= 402.34:
            stays[anchor] = (i, max(stays.get(anchor, (0, 0.0))[1], rows[i][3] - rows[anchor][3]))
        else:
            anchor = i
    assert flags["stagnant"] == [(a, b, d) for a, (b, d) in stays.items() if d > 180_000] and len(flags["stagnant"]) == 1
    easy = health.Limits(dwell_ms=1e9, min_span_ms=0.0, max_span_ms=1.0, max_hdop=10.0, floor_m=1e6)
    got = {r["check"]: r["passed"] for r in health.health_checks(df, easy).collect()}
    want = {r["check"]: r["passed"] for r in health.health_checks(df).collect()}
    assert got["stagnant"] and not want["stagnant"] and not got["time-order-span"] and not got["altitude-profile"] and want["altitude-profile"]
    assert {r["check"] for r in health.health_flags(df, easy).collect()} & {"stagnant", "gps-fix-quality", "altitude-profile"} == set()
    assert health.health_flags(df.limit(0)).count() == 0
