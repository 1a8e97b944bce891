"""Tracks longer than a chunk give what whole tracks give, from many tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import aggregate, align, fusion, kinematics, ordered, outliers
from trackspark.plans import chunks
from trackspark.sources.inventory import synthetic_tracks

from .test_semantics import track

OPERATORS = {
    "kinematics": kinematics.kinematics,
    "track_stats": aggregate.track_stats,
    "quality_events": ordered.quality_events,
    "segment_track": lambda df: kinematics.segment_track(kinematics.kinematics(df)),
}


@pytest.fixture(scope="module")
def odd(spark):
    """Tracks with holes in seq, nulls, invalid points, equal heights and times that stand still or go back."""
    rng, rows = random.Random(1), []
    for t in ("a", "b", None):
        seq, time, ele = 0, 0.0, 100.0
        for _ in range(400):
            seq += rng.choice([1, 1, 1, 2, 9, 40])
            time += rng.choice([0, 1000, 1000, 1000, 30_000, -2000])
            ele = ele if rng.random() < 0.6 else ele + rng.choice([-150.0, 0.5, 150.0])
            rows.append((t, seq, 95.0 if rng.random() < 0.03 else 34 + rng.random() / (2 if rng.random() < 0.02 else 2000), None if rng.random() < 0.02 else -118 + rng.random() / 2000, None if rng.random() < 0.1 else ele, None if rng.random() < 0.1 else time, None, []))
    rows += [("one", 7, 1.0, 2.0, 3.0, 4.0, "n", []), ("two", 100, 1.0, 2.0, None, None, None, ["f"]), ("two", 5000, 1.0, 2.0, None, None, None, [])]
    return spark.createDataFrame(rows, "track_id string, seq bigint, lat double, lon double, ele double, time_ms double, name string, flags array<string>").repartition(5).cache()


def rows_of(df):
    near = df.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes))
    return sorted((tuple(r) for r in near.collect()), key=str)


@pytest.mark.parametrize("name", list(OPERATORS))
@pytest.mark.parametrize("size", [1, 50])
def test_chunks_equal_whole_tracks(odd, monkeypatch, name, size):
    want = OPERATORS[name](odd)
    monkeypatch.setattr(chunks, "CHUNK", size)
    got = OPERATORS[name](odd)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_rows(odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["kinematics", "quality_events"])  # the others end in sums
def test_one_track_is_dealt_to_many_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(chunks, "CHUNK", 2000)
    points = synthetic_tracks(spark, 1, 60_000).withColumn("ele", F.floor(F.col("seq") / 10) * 1.0)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = OPERATORS[name](points).withColumn("task", F.spark_partition_id())
        dealt = out.groupBy("task").agg(*(F.count(c).alias(c) for c in out.columns)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) >= 8


@pytest.mark.parametrize("name", ["kinematics", "quality_events", "position_at_time"])
def test_tasks_follow_the_rows_not_the_number_of_shuffle_partitions(spark, monkeypatch, name):
    monkeypatch.setattr(chunks, "CHUNK", 1000)
    monkeypatch.setattr(chunks, "TASK", 1000)
    points = synthetic_tracks(spark, 1, 60_000).withColumn("ele", F.floor(F.col("seq") / 10) * 1.0)
    run = OPERATORS.get(name) or (lambda df: align.position_at_time(df, df.select("track_id", (F.col("time_ms") + 1).alias("at_ms"))))
    dealt = run(points).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(dealt) >= 20 and max(r["count"] for r in dealt) < 10_000


def test_simplify_by_rounds_equals_the_whole(spark):
    rng, rows = random.Random(2), []
    for t, n in (("a", 300), ("b", 90), ("c", 2), ("d", 40), (None, 120), ("nan", 60), ("same", 50)):
        x = y = 0.0
        for i in range(n):
            x, y = (0.0, 0.0) if t == "same" else (x + rng.gauss(0, 1e-4), y + rng.gauss(0, 1e-4))
            rows.append((t, 3 * i, None if t == "nan" and i == 20 else 34 + y, -118 + x, 1.0))
    df = spark.createDataFrame(rows, "track_id string, seq bigint, lat double, lon double, ele double").repartition(4)
    for epsilon in (0.0, 5.0, 30.0, 1e9):
        want = rows_of(ordered.simplify(df, epsilon))
        for local in (1, 7, 100):
            assert rows_of(ordered.simplify(df, epsilon, local)) == want
    assert ordered.simplify(df.limit(0), 5.0).count() == 0 and len(want) == 7 * 2


def test_cut_pairs_equal_whole_ones(spark):
    rng, sides = random.Random(3), []
    for _ in range(2):
        rows = []
        for t, n in (("p", 300), ("q", 20), ("one", 1), (None, 60), ("still", 30)):
            time = 0.0
            for i in range(n):
                time += 0.0 if t == "still" else rng.choice([0, 500, 1000, 1000, 90_000])
                rows.append((t, i, None if rng.random() < 0.05 else time, 34 + rng.random(), -118.0, rng.random()))
        sides.append(spark.createDataFrame(rows, "track_id string, seq bigint, time_ms double, lat double, lon double, ele double").repartition(4))
    ref, tgt = sides
    times = ref.select("track_id", (F.col("time_ms") + 250).alias("at_ms"))
    for run in (lambda c: align.align_nearest(ref, tgt, 3000, 250.0, c), lambda c: align.align_interpolated(ref, tgt, 100_000, -250.0, c), lambda c: align.position_at_time(tgt, times, 100_000, c)):
        want = rows_of(run(None))
        assert len(want) > 100
        for chunk in (1, 5, 64):
            assert rows_of(run(chunk)) == want
    assert align.align_nearest(ref.limit(0), tgt.limit(0), 3000).count() == 0


def test_fusion_groups_of_islands_equal_the_greedy_scan(spark):
    rng, rows = random.Random(4), []
    for entity, n in (("E", 400), ("F", 90), ("G", 1), (None, 30), ("H", 50)):
        time = 1.7e12
        for i in range(n):
            time += rng.choice([0.0, 100.0, 400.0, 0.1, 1500.0, 1500.000001, 9000.0]) if entity != "H" else 700.0
            rows.append((entity, rng.choice("ab"), i, time))
    df = spark.createDataFrame(rows, "entity string, source string, seq bigint, time_ms double").repartition(4)
    for tolerance in (0.0, 1500.0, 1e9):
        want, last = [], {}
        for e, s, i, t in sorted(rows, key=lambda r: (str(r[0]), r[3], r[1], r[2])):
            anchor, group = last.get(e, (None, -1))
            if anchor is None or t - anchor > tolerance:
                anchor, group = t, group + 1
            last[e] = anchor, group
            want.append((e, s, i, t, group))
        for chunk in (None, 1, 7, 64):
            assert rows_of(fusion.group_by_time(df, tolerance, chunk)) == sorted(want, key=str)
    assert fusion.group_by_time(df.limit(0), 1.0).count() == 0


def plain_walk(before, after):
    """Counts of a walk point by point: the definition."""
    i = j = same = 0
    while i < len(before) and j < len(after):
        if before[i] == after[j]:
            i, j, same = i + 1, j + 1, same + 1
            continue
        a = next((k for k in range(1, 65) if j + k < len(after) and after[j + k] == before[i]), 999)
        b = next((k for k in range(1, 65) if i + k < len(before) and before[i + k] == after[j]), 999)
        step = (0, a) if a <= b and a < 999 else (b, 0) if b < 999 else (1, 1)
        i, j = i + step[0], j + step[1]
    return same


def test_runs_of_equal_points_equal_a_walk_point_by_point():
    rng = random.Random(5)
    for _ in range(300):
        before = [rng.randrange(rng.choice([3, 40, 1000])) for _ in range(rng.randint(0, 300))]
        after = list(before)
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(after))
            after = after[:k] + [rng.randrange(50) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 70]))] + after[k + rng.choice([0, 1, 5, 63, 64, 65, 70]) :]
        assert sum(n for _, _, n in align._matched_runs(np.array(before, np.int64), np.array(after, np.int64))) == plain_walk(before, after)


def test_streamed_walk_equals_a_walk_over_whole_versions():
    """Versions that come in small parts, one far ahead of the other: only what it is ahead by is held."""
    rng = np.random.default_rng(8)
    before = rng.integers(0, 6, (6000, 4)).astype(float)
    before[::11, 2] = np.nan
    after = np.delete(before, np.r_[np.arange(0, 6000, 10), np.arange(3000, 3050)], axis=0)
    numbers = np.unique(np.nan_to_num(np.vstack([before, after]), nan=-1), axis=0, return_inverse=True)[1].ravel()
    place, side = np.r_[np.arange(6000), np.arange(len(after))], np.repeat([0, 1], [6000, len(after)])
    order = np.lexsort([side, place])
    walk, most = align._Versions(), 0
    for part in np.array_split(order, 90):
        walk.add(side[part], np.vstack([before, after])[part], np.zeros(len(part), np.int64))
        most = max(most, *(len(q.rows()) for q in walk.sides))
    walk.walk(True)
    assert walk.same == sum(n for _, _, n in align._matched_runs(numbers[:6000], numbers[6000:])) and most < 1500


def test_diff_in_chunks(spark):
    rows = [(i / 100, 0, None if i == 5 else i, i * 1000) for i in range(40)]
    before = track(spark, rows).unionByName(track(spark, rows).withColumn("track_id", F.lit(None).cast("string")))
    after = before.filter("seq % 10 > 0 or track_id is null").withColumn("ele", F.when(F.col("track_id").isNull() & (F.col("seq") == 7), 70.0).otherwise(F.col("ele")))
    whole = align.track_diff_ordered(before, after).orderBy("track_id").collect()
    assert whole == align.track_diff_ordered(before, after, chunk=7).orderBy("track_id").collect()
    assert [(r["alignment"], r["unchanged"], r["modified"], r["removed"], r["max_elevation_shift_m"]) for r in whole] == [("index", 39, 1, 0, 63.0), ("subsequence", 36, 0, 4, 0.0)]


def test_diff_of_one_sided_tracks_nulls_and_channels(spark):
    schema = "track_id string, seq bigint, lat double, lon double, ele double, time_ms double, ext_num map<string,double>"
    before = spark.createDataFrame([("a", i, float(i), -0.0, None, None, {"x": 1.0, "y": 2.0}) for i in range(6)] + [("only", 0, 1.0, 1.0, 1.0, 1.0, {})], schema)
    after = spark.createDataFrame([("a", i, float(i), 0.0, None, None, {"y": 2.0, "x": 1.0 + (i == 4)}) for i in range(5)] + [("new", 0, 1.0, None, 1.0, 1.0, None)], schema)
    got = {r["track_id"] or "": r for r in align.track_diff_ordered(before, after).collect()}
    assert (got["a"]["alignment"], got["a"]["unchanged"], got["a"]["removed"], got["a"]["elevation"], got["a"]["channels"]) == ("subsequence", 5, 1, False, True)
    assert align.track_diff_ordered(before, before).filter("channels or modified > 0").count() == 0
    assert sorted((r["n_before"], r["n_after"], r["alignment"]) for r in got.values()) == [(0, 1, "rebuilt"), (1, 0, "rebuilt"), (6, 5, "subsequence")]


def test_repair_in_chunks(spark):
    """Knots, runs and numbers are the same however a track is cut; no window of the knots sees a whole track."""
    rows = [(1 + i * 1e-4, 2 + (i % 7) * 1e-4, None if i == 30 else 100.0 + i % 5, i * 1000.0 + 20_000 * (i >= 10) + 9_000 * (i >= 41)) for i in range(60)]
    rows[25] = (1.5, 2.5, 100.0, rows[25][3])
    made = F.when(F.col("seq").isin(6, 7, 8, 11, 12, 40, 41), F.array(F.lit("interpolated"))).otherwise(F.col("flags"))
    df = track(spark, rows).withColumn("flags", made)
    df = df.unionByName(df.withColumns({"track_id": F.lit("B"), "time_ms": F.when(F.col("seq") != 50, F.col("time_ms"))}))
    key = lambda x: sorted(map(repr, x.collect()))
    for f in (lambda **k: outliers.gap_fills(df, 5000, 2000, context=3, profile="unconstrained", **k), lambda **k: outliers.fill_gaps(df, 5000, 2000, context=3, profile="unconstrained", **k), lambda **k: outliers.drop_outliers(df, "unconstrained", **k)):
        whole = key(f())
        assert len(whole) and all(key(f(chunk=n)) == whole for n in (3, 7))
    assert {(r["track_id"], r["start_seq"]) for r in outliers.gap_fills(df, 5000, 2000, chunk=3).collect()} == {(t, s) for t in "AB" for s in (9, 40)}
