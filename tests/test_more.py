"""Recipes with ranges and fingerprints, comparison and views against plain Python, workspaces and checks."""

import math

import pytest
from pyspark.sql import functions as F

from trackspark.operators import aggregate, align, builtin, compare, edit, fusion, ordered, report, series  # noqa: F401  builtin registers the operations
from trackspark.plans import recipes
from trackspark.schema import collect_channels, demote
from trackspark.sources import inventory, sinks, workspace

from .test_semantics import FUSED, ordered_rows, track


def line(spark, n=10, name="A"):
    return track(spark, [(0, i * 1e-3, i, i * 1000) for i in range(n)], name)


def test_recipe_with_range_and_fingerprints(spark):
    df, log = line(spark), []
    out = recipes.run_op(df, "offset-elevation", {"meters": 5}, log, scope=(7, 2), fingerprints=True)
    assert ordered_rows(out, "ele") == [(float(i + 5 * (2 <= i <= 7)),) for i in range(10)]
    assert ordered_rows(recipes.replay(df, log), "ele") == ordered_rows(out, "ele")
    with pytest.raises(ValueError, match="input isn't"):
        recipes.replay(edit.shift_time(df, 1), log)
    with pytest.raises(ValueError, match="whole tracks"):
        recipes.run_op(df, "decimate", {"factor": 2}, scope=(0, 3))
    for id, params in (("decimate", {}), ("round-precision", {"coord": -1}), ("dejitter", {"policy": "other"}), ("ema", {"alpha": True})):
        with pytest.raises(ValueError):
            recipes.run_op(df, id, params)
    table = recipes.log_table(spark, "r", log).first()
    assert (table["op"], table["params"], table["scope"], table["in_fp"] != table["out_fp"]) == ("offset-elevation", '{"meters": 5}', "7-2", True)


def test_an_operation_that_changes_the_count_fails_in_a_range(spark):
    with pytest.raises(Exception, match="changed the number of points"):
        edit.apply_to_range(line(spark), 2, 7, lambda x: ordered.decimate(x, 2)).collect()


def test_derivations(spark):
    out = recipes.run_derivation(recipes.run_derivation(line(spark), "standard-kinematics"), "standard-kinematics")
    assert out.columns.count("ground_speed_mps") == 1
    with pytest.raises(ValueError, match="needs"):
        recipes.run_derivation(line(spark).drop("time_ms"), "standard-kinematics")
    with pytest.raises(ValueError):
        recipes.derivation("legs", 1)(lambda df: df)


def test_fingerprint_sees_every_change(spark):
    df = line(spark).withColumn("ext_num", F.create_map(F.lit("x"), F.col("ele")))
    mark = lambda d: aggregate.fingerprint(d).first()["hash"]
    same = mark(df)
    doubled = df.unionByName(df)
    changed = [df.withColumn("ext_num", F.create_map(F.lit("y"), F.col("ele"))), df.withColumn("seq", 9 - F.col("seq")), df.withColumn("hdop", F.lit(2.0)), doubled, df.withColumn("lat", F.when(F.col("seq") == 3, F.lit(float("nan"))).otherwise(F.col("lat")))]
    assert same == mark(df.repartition(5)) and len({same, *map(mark, changed)}) == 6 and mark(doubled) != mark(doubled.unionByName(df))


def test_edits_that_are_refused_and_counted(spark):
    df = line(spark)
    assert edit.changed_count(df, edit.offset_elevation(df.filter("seq < 9"), 1)).first()["changed"] == 10
    for gone in (df.limit(0), df.filter("seq = 0").withColumn("seq", F.lit(77).cast("bigint"))):
        with pytest.raises(ValueError):
            edit.delete_points(df, gone, check=True)
    there = demote(df.withColumn("name", F.when(F.col("seq") == 4, "Needle")), "hdop", "sat").withColumn("ext_str", F.when(F.col("seq") == 6, F.create_map(F.lit("k"), F.lit("a NEEDLE too"))))
    assert ordered_rows(edit.table_search(there, "needle"), "seq") == [(4,), (6,)]
    assert [tuple(r) for r in edit.index_to_time_range(df, 5, 2).collect()] == [("A", 2000.0, 5000.0)]


def metres(a, b):
    (p, q), (r, s) = (map(math.radians, a), map(math.radians, b))
    return 2 * 6371008.8 * math.asin(math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2))


def test_pairwise_series_of_meeting_tracks(spark):
    a = track(spark, [(0, 0, 0, 0), (0, 1e-2, 0, 100_000)], "p")
    b = track(spark, [(0, 2e-2, 30, -5000), (0, 1e-2, 30, 95_000)], "p")
    got = compare.pairwise_series(a, b, n=11).orderBy("at_ms").collect()
    assert [r["at_ms"] for r in got] == [i * 9500.0 for i in range(11)]
    gap = lambda t: metres((0, 1e-7 * t), (0, 2e-2 - 1e-7 * (t + 5000)))
    for r in got:
        assert math.isclose(r["horizontal_m"], gap(r["at_ms"]), rel_tol=2e-3, abs_tol=0.1) and r["altitude_separation_m"] == 30
        assert (r["closure_mps"] is None) == (r["at_ms"] < 1000)
    assert math.isclose(got[3]["closure_mps"], gap(0) / 97_500 * 1000, rel_tol=0.02) and math.isclose(got[3]["bearing_deg"], 90, abs_tol=0.1)
    assert compare.pairwise_series(a, edit.shift_time(b, 1000)).count() == 0
    assert compare.pairwise_series(a, b, max_bracket_ms=50_000).count() == 0


def test_along_and_across(spark):
    ref, tgt = track(spark, [(0, 0, 0, 0), (0, 1e-3, 0, 1000)], "p"), track(spark, [(1e-3, 0, 0, 0), (0, 2e-3, 0, 1000)], "p")
    got = compare.along_cross_track(ref, align.relative_position(align.align_nearest(ref, tgt, 1))).orderBy("ref_seq").collect()
    assert abs(got[0]["along_m"]) < 1e-3 and 110 < got[0]["cross_m"] < 111 and abs(got[1]["along_m"] - 111.3) < 0.1 and abs(got[1]["cross_m"]) < 1e-6
    alone = track(spark, [(0, 0, 0, 0)], "p")
    assert compare.along_cross_track(alone, align.relative_position(align.align_nearest(alone, tgt, 1))).count() == 0


def test_playback_by_time_or_by_index(spark):
    asked = spark.createDataFrame([("A", x) for x in (-1.0, 0.24, 0.25, 0.5, 2.0)], "track_id string, fraction double")
    timed = track(spark, [(0, 0, 0, 0), (0, 0, 0, 500), (0, 0, 0, 1000)])
    pick = lambda df: {r["fraction"]: r["seq"] for r in series.playback_lookup(df, asked).collect()}
    assert pick(timed) == {-1.0: 0, 0.24: 0, 0.25: 0, 0.5: 1, 2.0: 2}
    falling = track(spark, [(0, 0, 0, 5), (0, 0, 0, 0), (0, 0, 0, 9)])
    assert pick(falling) == {-1.0: 0, 0.24: 0, 0.25: 1, 0.5: 1, 2.0: 2}  # halves up


def test_plan_unwraps_and_strides(spark):
    df = track(spark, [(0, 179.5, 0, 0), (0.5, -179.5, 0, 1), (float("nan"), 0, 0, 2), (1, -178.5, 0, 3)])
    got = ordered_rows(series.plan_projection(df), "seq", "east_m", "north_m")
    assert [g[0] for g in got] == [0, 1, 3] and [round(g[1]) for g in got] == [0, 111320, 222640] and round(got[2][2]) == 111320
    assert series.plan_frame(series.plan_projection(df)).first()["scale_bar_m"] == 100_000
    assert ordered_rows(series.plan_stride(line(spark), 3), "seq") == [(0,), (4,), (8,), (9,)]
    assert series.shared_trajectory_enu(line(spark).unionByName(line(spark, name="B"))).filter("abs(east_m) < 1e-6").count() == 2


def test_minmax_and_series_limit(spark):
    df = track(spark, [(0, 0, (i * 7) % 10, i) for i in range(100)])
    got = ordered_rows(aggregate.minmax_downsample(df, "ele", 10), "seq")
    assert got[0] == (0,) and got[-1] == (99,) and len(got) <= 10
    assert ordered_rows(aggregate.minmax_downsample(df, "ele", 3), "seq") == [(0,), (99,)]
    assert aggregate.minmax_downsample(df, "ele", 100).count() == 100
    assert series.chart_series(df, "ele", max_samples=10).count() == len(got)


def test_workspaces_refuse_points_without_dataset(spark, tmp_path):
    df = line(spark).unionByName(line(spark, name="B"))
    datasets, channels = inventory.make_dataset(demote(df, "hdop", "sat"), "gpx")
    assert (datasets.count(), collect_channels(demote(df, "hdop")).filter("channel = 'hdop'").count(), channels.count()) == (2, 2, 4)
    log = recipes.log_table(spark, "r", [recipes.Record("x", 1, {})])
    sinks.save_workspace({"points": df, "datasets": datasets, "operation_log": log}, str(tmp_path / "w"), history=False)
    assert not list((tmp_path / "w").glob("versions/*/operation_log"))
    got = sinks.load_workspace(spark, str(tmp_path / "w"), ["points", "datasets"])
    assert got["points"].count() == 20
    sinks.save_workspace({"points": df, "datasets": datasets.filter("track_id = 'A'")}, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="B"):
        sinks.load_workspace(spark, str(tmp_path / "v"), ["points", "datasets"])
    with pytest.raises(ValueError):
        sinks.save_workspace({"other": df}, str(tmp_path / "u"))


def test_a_workspace_is_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "w")
    with pytest.raises(ValueError, match="no workspace"):
        workspace.load_workspace(spark, path, ["points"])
    df = line(spark).unionByName(line(spark, name="007")).withColumn("ext_num", F.create_map(F.lit("x"), F.col("ele")))
    datasets, _ = inventory.make_dataset(df, "gpx")
    first = workspace.save_workspace({"points": df, "datasets": datasets}, path)
    assert {r["table"]: r["rows"] for r in workspace.workspace_manifest(spark, path).collect()} == {"points": 20, "datasets": 2}
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    same = lambda: workspace.load_workspace(spark, path, ["points", "datasets"])
    assert key(same()["points"]) == key(df) and key(same()["datasets"]) == key(datasets)
    # A save that fails after its first table leaves the old version, and nothing of its own.
    broken = datasets.withColumn("name", F.when(F.col("track_id") == "007", F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken"):
        workspace.save_workspace({"points": df.limit(3), "datasets": broken}, path)
    assert key(same()["points"]) == key(df) and [p.name for p in (tmp_path / "w" / "versions").iterdir()] == [first]
    # The next replaces it, and one old version stays.
    for n in (5, 6, 7):
        last = workspace.save_workspace({"points": df.filter("track_id = 'A'").limit(n), "datasets": datasets}, path)
    assert same()["points"].count() == 7 and len(list((tmp_path / "w" / "versions").iterdir())) == 2
    with pytest.raises(ValueError, match="no channels"):
        workspace.load_workspace(spark, path, ["channels"])
    file = next((tmp_path / "w" / "versions" / last / "points").glob("*/*.parquet"))
    file.rename(tmp_path / "gone")
    with pytest.raises(ValueError, match="points is damaged"):
        same()
    assert workspace.load_workspace(spark, path, ["points", "datasets"], verify=False)["datasets"].count() == 2


def test_comparisons_fusion_and_rows_are_written(spark, tmp_path):
    a, b = line(spark), line(spark)
    samples = align.relative_position(align.align_nearest(a, b, 3000))
    drift = align.clock_drift(align.align_nearest(a, b, 3000)).withColumn("epoch_ms", F.lit(0.0))
    sinks.write_comparison(samples, str(tmp_path / "c"), drift)
    back = spark.read.option("header", True).csv(str(tmp_path / "c" / "samples"))
    assert back.count() == 10 and {r["derived"] for r in back.collect()} == {"observed"}
    assert spark.read.option("header", True).csv(str(tmp_path / "c" / "drift")).first()["clock_drift_sample_count"] == "10"
    sinks.write_visible_rows(a.filter("seq < 4"), str(tmp_path / "v"), order=[F.desc("seq")])
    rows = [r for p in sorted((tmp_path / "v").glob("part*.csv")) for r in p.read_text().splitlines()[1:]]
    assert [r.split(",")[1] for r in rows] == ["3", "2", "1", "0"]
    decisions = spark.createDataFrame([("E", 0, 1.0, "A", ["B", "C"])], "entity string, group_id bigint, group_time_ms double, chosen string, skipped array<string>")
    sinks.write_fusion(decisions, spark.createDataFrame([("E", "A", 1)], "entity string, source string, chosen bigint"), str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f" / "decisions")).first()["skipped"] == "B|C"
    assert spark.read.json(str(tmp_path / "f" / "report")).first()["chosen"] == 1


def test_fusion_checks(spark):
    rows = [("E", "A", 1, 0, 0.0, 0.0, 0.0, None, 0.5, 12.0, 0), ("E", "B", 3, 0, 100.0, 0.0, 0.0, None, 20.0, 3.0, 0)]
    made = fusion.auto_combine(spark.createDataFrame(rows, FUSED))
    both = spark.createDataFrame([("A", "E"), ("B", "E")], "track_id string, entity string")
    assert fusion.check_fusion(made, both, 1000).count() == 0
    wrong = made.unionByName(made.withColumns({"confidence": F.lit(2.0), "chosen": F.lit("Z")}))
    assert {r["problem"] for r in fusion.check_fusion(wrong, both.limit(1), 1000).collect()} == {"fewer than two sources", "an unknown source", "a confidence outside 0 to 1", "decided twice"}
    for bad in (0.5, float("nan")):
        with pytest.raises(ValueError):
            fusion.check_fusion(made, both, bad)
    with pytest.raises(ValueError):
        fusion.group_by_time(spark.createDataFrame(rows, FUSED), -1)
    assert [tuple(r) for r in fusion.fused_points(made).select("track_id", "seq", "source_segment", F.col("ext_num")["fusion_confidence"]).collect()] == [("E", 0, "B", 1.0)]


def test_report_sections(spark):
    rows = report.analysis_report(line(spark), audit=spark.createDataFrame([("A", "bad-time", 3)], "track_id string, reason string, n bigint"), sections=("overview", "warnings", "disclosure")).collect()
    assert {(r["section"], r["track_id"], r["metric"]): r["value"] for r in rows if r["metric"] != "distance_m"} == {("overview", None, "datasets"): "1", ("overview", None, "points"): "10", ("overview", None, "events"): "0", ("warnings", "A", "bad-time"): "3", ("disclosure", "A", "notional"): "0", ("disclosure", "A", "edited"): "0"}
    for sections in (("other",), ("fusion",)):
        with pytest.raises(ValueError):
            report.analysis_report(line(spark), sections=sections)
