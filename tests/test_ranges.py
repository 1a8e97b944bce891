"""Record ranges of binary files, and files that are written as streams."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import kinematics
from trackspark.schema import promote
from trackspark.sources import binary, formats, ranges
from trackspark.sources.inventory import synthetic_points

from .test_formats import audit, recording, rows
from .test_semantics import track


def test_a_packed_file_is_read_by_many_tasks(spark, tmp_path):
    points = synthetic_points(spark, 3, 5000)
    formats.write_tracks(points, str(tmp_path / "out"), "gpb")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["S000000.gpb", "S000001.gpb", "S000002.gpb"]
    got, dropped = binary.read_gpb(spark, str(tmp_path / "out"), split=20_000)
    assert dropped.count() == 0 and got.rdd.getNumPartitions() >= 24
    near = lambda df: rows(promote(df, "hdop", "sat").withColumn("hdop", F.col("hdop").cast("float")), "track_id", "seq", "lat", "lon", "time_ms", "sat", "hdop")
    whole, _ = formats.read_tracks(spark, str(tmp_path / "out" / "*.gpb"))
    assert near(got) == near(whole) == near(points)
    assert all(math.isclose(a, b, rel_tol=1e-6) for (a,), (b,) in zip(rows(got, "ele"), rows(points, "ele"), strict=True))
    assert kinematics.kinematics(got).filter("ground_speed_mps > 0").count() == 14_997


def test_ranges_of_every_width_hold_each_record_once(spark, tmp_path):
    df = track(spark, [(float(i) / 10, 2.0, i, 1000 * i) for i in range(23)])
    binary.write_gpb(df, str(tmp_path))
    size = (tmp_path / "A.gpb").stat().st_size
    reader = lambda split, n: ranges.RecordReader(str(tmp_path), binary._gpb_layout, 0, split, n)
    for split in (1, 7, 30, 31, 64, size - 1, size, size + 1):
        found = [r for part in reader(split, 5).partitions() for batch in reader(split, 5).read(part) for r in batch.to_pylist()]
        data = b"".join(r["data"] for r in sorted(found, key=lambda r: r["number"]))
        assert data == (tmp_path / "A.gpb").read_bytes()[-len(data) :] and len(data) == 23 * 36
        assert len({r["number"] for r in found if r["data"]}) == len([r for r in found if r["data"]])


def test_broken_packed_files_are_counted(spark, tmp_path):
    binary.write_gpb(track(spark, [(1.5, 2.5, 3, 4000), (5, 6, None, None)]), str(tmp_path))
    whole = (tmp_path / "A.gpb").read_bytes()
    for name, raw in (("cut", whole[:-1]), ("no", b"GPB2"), ("old", b"GPB1\x02" + whole[5:]), ("head", whole[:12]), ("empty", b""), ("none", whole[: whole.index(b"sat") + 3] + struct.pack("<I", 0))):
        (tmp_path / f"{name}.gpb").write_bytes(raw)
    points, dropped = binary.read_gpb(spark, str(tmp_path), split=10)
    assert rows(promote(points, "sat"), "track_id", "lat", "ele", "time_ms", "sat") == [("A", 1.5, 3.0, 4000.0, 8.0), ("A", 5.0, 0.0, 0.0, 8.0)]
    assert audit(dropped) == {("cut", "cut short in the points"): 1, ("no", "no GPB1 at the start"): 1, ("old", "version 2"): 1, ("head", "cut short in the header"): 1, ("empty", "no GPB1 at the start"): 1}


def test_written_bytes_equal_those_in_memory(spark, tmp_path):
    df = track(spark, [(1.5, 2.5, 3, 4000), (5, 6, None, None)])
    df = df.unionByName(track(spark, [(None, 1, None, None)]).withColumn("track_id", F.lit("b/ü+%20")))
    binary.write_gpb(df, str(tmp_path))
    blobs = {r["track_id"]: bytes(r["content"]) for r in binary.encode_gpb(df).collect()}
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"A.gpb": blobs["A"], "b%2F%C3%BC%2B%2520.gpb": blobs["b/ü+%20"]}
    assert {r["track_id"] for r in binary.read_gpb(spark, str(tmp_path))[0].collect()} == {"A", "b/ü+%20"}


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    binary.write_gpb(track(spark, [(1, 2, 3, 4)]), str(tmp_path))
    before = (tmp_path / "A.gpb").read_bytes()
    bad = synthetic_points(spark, 5, 100).withColumn("lat", F.when((F.col("track_id") == "S000003") & (F.col("seq") == 50), F.raise_error(F.lit("broken"))).otherwise(F.col("lat")))
    with pytest.raises(Exception, match="broken"):
        binary.write_gpb(bad, str(tmp_path), ["hdop"])
    assert {p.name for p in tmp_path.iterdir()} == {"A.gpb"} and (tmp_path / "A.gpb").read_bytes() == before
    binary.write_gpb(synthetic_points(spark, 2, 3), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"S000000.gpb", "S000001.gpb"}


def test_a_recording_is_read_by_many_tasks(spark, tmp_path):
    live = {(f, s): (f * 1.0, s * 2.0, 30.0) for f in range(0, 49, 2) for s in (1, 50)}
    raw = recording(live, start=8_640_000 - 200, blocks=5)
    (tmp_path / "R.msnp5").write_bytes(raw)
    (tmp_path / "bad.msnp5").write_bytes(bytes(raw[:-1]))
    held = spark.createDataFrame([("R", raw)], "track_id string, content binary")
    frames = binary.p5_frames(spark, str(tmp_path), blocks=1, split=50_000)
    assert frames.rdd.getNumPartitions() >= 8 and frames.count() == 5
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(binary.read_p5(spark, str(tmp_path))) == key(binary.read_p5(spark, held))
    assert len(key(binary.read_p5(spark, str(tmp_path)))) == len(live)
    assert key(binary.p5_roster(spark, str(tmp_path))) == key(binary.p5_roster(spark, held))
    for f in (binary.p5_validation, binary.p5_slot_coverage):
        assert f(spark, str(tmp_path)).collect() == f(spark, held).collect()
    points, dropped = formats.read_tracks(spark, str(tmp_path / "*.msnp5"))
    assert audit(dropped) == {("bad", "no recording"): 1}
    assert {r["track_id"]: r["n"] for r in points.groupBy("track_id").agg(F.count("*").alias("n")).collect()} == {"R-1": 25, "R-50": 25}
    assert np.isclose(points.filter("track_id = 'R-1'").orderBy("seq").first()["lat"], 39.4166)


def test_files_of_a_pattern(tmp_path):
    for name in ("a/x.gpb", "a/y.bin", "b/x.gpb", "_hidden/x.gpb", "a/.z.gpb"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    found = lambda p: [x.removeprefix(f"{tmp_path}/") for x, _ in ranges.listed(f"{tmp_path}{p}")]
    assert found("") == ["a/x.gpb", "a/y.bin", "b/x.gpb"] and found("/*/*.gpb") == ["a/x.gpb", "b/x.gpb"] and found("/a*") == ["a/x.gpb", "a/y.bin"] and found("/a/y.bin") == ["a/y.bin"]
    assert ranges.listed(f"file://{tmp_path}/b/*") == [(f"{tmp_path}/b/x.gpb", 1)]
    with pytest.raises(FileNotFoundError):
        ranges.listed(f"{tmp_path}/none")


def test_small_ranges_are_widened(tmp_path):
    """A task for a few records each would be more tasks the larger a file is."""
    from trackspark.sources.ranges import RANGES, RecordReader

    (tmp_path / "a.gpb").write_bytes(bytes(3_000_000))
    parts = RecordReader(str(tmp_path), None, 0, 2_000, 100).partitions()
    assert len(parts) <= RANGES and parts[0].begin == 0 and parts[-1].end == 3_000_000 and all(a.end == b.begin for a, b in zip(parts, parts[1:]))
    assert len(RecordReader(str(tmp_path), None, 0, 1_000_000, 100).partitions()) == 3


def test_live_records_are_small_until_they_are_written(spark):
    """The one task that writes a recording sorts all of them."""
    from trackspark.more_queries import _live_blocks

    rows = spark.createDataFrame([(0, 3, 8, 1.5), (0, 4, 8, None), (2, 11, 19, 2.25), (2, 0, 28, -1.0), (3, 1, 29, None)], "block bigint, slot int, seq bigint, z double")
    blocks = _live_blocks(rows)
    assert blocks.schema["live"].dataType.simpleString() == "array<struct<i:tinyint,k:tinyint,z:float>>"
    assert {r["block"]: sorted(map(tuple, r["live"])) for r in blocks.collect()} == {0: [(8, 3, 1.5)], 2: [(0, 11, 2.25), (9, 0, -1.0)], 3: []}


def test_days_of_a_recording_are_told_by_its_stretches(spark, tmp_path, monkeypatch):
    """No window sees a recording's samples, and days are the same in stretches of any length."""
    live = {(f, 1): (f * 1.0, 2.0, 30.0) for f in range(0, 49, 2)}
    (tmp_path / "R.msnp5").write_bytes(recording(live, start=8_640_000 - 200, blocks=5))
    whole = sorted(map(tuple, binary.read_p5(spark, str(tmp_path)).collect()))
    frames = binary.p5_frames
    monkeypatch.setattr(binary, "p5_frames", lambda spark, path: frames(spark, path, blocks=1, split=50_000))
    cut = binary.read_p5(spark, str(tmp_path))
    assert sorted(map(tuple, cut.collect())) == whole and len(whole) == 25
    times = [r["time_ms"] for r in cut.orderBy("subframe").collect()]
    assert all(b - a == 200 for a, b in zip(times, times[1:])) and len({t // 86_400_000 for t in times}) == 2
    windows = [x for x in cut._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert windows and not any("subframe" in x for x in windows)
