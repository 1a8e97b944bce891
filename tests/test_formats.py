"""Readers and writers on small files of each format, whole and broken."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.demo_tracks import points
from trackspark.operators import kinematics, ordered, outliers
from trackspark.schema import POINTS, conform, demote, promote
from trackspark.sources import binary, files, formats, inventory, sinks, text

from .conftest import DATA
from .test_semantics import track


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("track_id", "seq").collect()]


def audit(df):
    return {(r["track_id"], r["reason"]): r["n"] for r in df.collect()}


GPX = """<?xml version="1.0"?><gpx version="1.1" creator="x" xmlns="http://www.topografix.com/GPX/1/1" xmlns:e="http://e">
<wpt lat="9" lon="8"><name>W &amp; V</name></wpt><rte><rtept lat="7" lon="7"/></rte>
<trk><trkseg><trkpt lat="1" lon="2"><ele>3.5</ele><time>2024-01-01T00:00:00Z</time><cmt>c</cmt><sat>7</sat><hdop>0.9</hdop><fix>3d</fix><extensions><e:hr>120</e:hr><e:x><e:mode>fast</e:mode></e:x></extensions></trkpt>
<trkpt lat="north" lon="2"/><trkpt lat="1.001" lon="2"><time>2024-01-01T00:00:01Z</time></trkpt></trkseg></trk></gpx>"""


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    (tmp_path / "r.gpx").write_text('<gpx><rte><rtept lat="5" lon="6"/></rte><trk><trkseg><trkpt lat="x" lon="1"/></trkseg></trk></gpx>')
    points, dropped = files.read_gpx(spark, str(tmp_path))
    assert points.columns == list(POINTS)
    got = rows(points, "track_id", "seq", "lat", "lon", "ele", "time_ms", "name", "desc", "ext_num", "ext_str")
    assert got[0] == ("a", 0, 1.0, 2.0, 3.5, 1704067200000.0, None, "c", {"sat": 7.0, "hdop": 0.9, "hr": 120.0}, {"fix": "3d", "mode": "fast"})
    assert [r[:4] for r in got[1:]] == [("a", 1, 1.001, 2.0), ("a", 2, 9.0, 8.0), ("r", 0, 5.0, 6.0)] and got[2][6] == "W & V"
    assert audit(dropped) == {("a", "bad-coordinate"): 1, ("r", "bad-coordinate"): 1}
    assert kinematics.kinematics(points).filter("ground_speed_mps > 100").count() == 1  # an operator behind the reader


def test_geojson(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[null,{"type":"Feature","properties":{"time":"2024-01-01T00:00:00Z","mag":4.5,"place":"x, y","deep":{"a":1},"ok":true,"n":"5"},"geometry":{"type":"Point","coordinates":[10,20,30]}},{"type":"Feature","properties":{"t":1704067200,"name":"p"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":null,"geometry":{"type":"GeometryCollection","geometries":[]}}]}')
    (tmp_path / "b.geojson").write_text('{"type":"LineString","coordinates":[[1,2],[3,4,5]]}')
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","features":[')
    points, dropped = files.read_geojson(spark, str(tmp_path))
    got = rows(points, "track_id", "lat", "lon", "ele", "time_ms", "name", "ext_num", "ext_str")
    assert got[0] == ("a", 20.0, 10.0, 30.0, 1704067200000.0, None, {"mag": 4.5}, {"place": "x, y", "n": "5"})
    assert [r[1:6] for r in got[1:5]] == [(0.0, 0.0, None, 1704067200000.0, "p"), (0.0, 1.0, None, 1704067200000.0, "p"), (1.0, 1.0, None, 1704067200000.0, "p"), (0.0, 0.0, None, 1704067200000.0, "p")]
    assert [r[:4] for r in got[5:]] == [("b", 2.0, 1.0, None), ("b", 4.0, 3.0, 5.0)]
    assert audit(dropped) == {("a", "unsupported-geometry GeometryCollection"): 1, ("c", "not-geojson"): 1}


def test_kml(spark, tmp_path):
    (tmp_path / "a.kml").write_text("""<kml xmlns:gx="g"><Document><name>doc</name><Placemark><name>One</name><Point><coordinates> 10,20,30 </coordinates></Point></Placemark>
<Placemark><name>Two &lt;</name><LineString><coordinates>1,2 x,3
4,5,6</coordinates></LineString><gx:Track><when>2024-01-01T00:00:00Z</when><gx:coord>7 8 9</gx:coord><gx:coord>8 9</gx:coord></gx:Track></Placemark></Document></kml>""")
    points, dropped = files.read_kml(spark, str(tmp_path))
    got = rows(points, "lat", "lon", "ele", "time_ms", "name", "source_segment", "source_feature")
    assert got == [(8.0, 7.0, 9.0, 1704067200000.0, None, "Two <", 0), (9.0, 8.0, None, None, None, "Two <", 0), (20.0, 10.0, 30.0, None, "One", "One", 1), (2.0, 1.0, None, None, None, "Two <", 2), (5.0, 4.0, 6.0, None, None, "Two <", 2)]
    assert audit(dropped) == {("a", "bad-coordinate"): 1, ("a", "times-paired-by-index"): 1}


def test_a_large_kml_file_is_read_by_many_tasks(spark, tmp_path):
    point = '<kml:Placemark id="p{0}"><kml:name>N{0}</kml:name><kml:Point><kml:coordinates>{0},1</kml:coordinates></kml:Point></kml:Placemark>\n'
    plain = "<Placemark><name>N{0}</name><!-- {0} --><LineString><coordinates>{0},1,2 {0},2,3</coordinates></LineString></Placemark>"
    body = "".join((point if i % 3 else plain).format(i) for i in range(150))
    loose = "<Point><coordinates>7,8</coordinates></Point>"
    (tmp_path / "big.kml").write_text(f"<kml><Document><name>doc</name>{loose}{body}{loose}</Document></kml>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        points, dropped = files.read_kml(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path), lineSep="Placemark>").rdd.getNumPartitions() >= 8
        got = rows(points, "lon", "lat", "ele", "name", "source_segment", "source_feature")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [r for i in range(150) for r in ([(i, 1, None, f"N{i}", f"N{i}", i)] if i % 3 else [(i, 1, 2, None, f"N{i}", i), (i, 2, 3, None, f"N{i}", i)])]
    assert got == [*want, (7, 8, None, None, None, 150), (7, 8, None, None, None, 151)] and dropped.count() == 0


def test_a_large_geojson_file_is_read_by_many_tasks(spark, tmp_path):
    import json
    import random

    rng, want, features = random.Random(1), [], []
    for i in range(200):
        kind = i % 4
        properties = {"name": f'N{i} "}}]{{', "kind": "Feature", "deep": {"a": [{"b": i}]}, "mag": i / 2}
        place = [float(i), 1.0] if kind < 2 else [[float(i), 1.0], [float(i), 2.0, 3.0]]
        one = {"type": "Feature", "properties": properties, "geometry": {"type": "Point" if kind < 2 else "LineString", "coordinates": place}}
        items = list(one.items())
        rng.shuffle(items)  # members in any order
        features.append(dict(items) if kind != 1 or i % 8 else None)
        if features[-1] is not None:
            want += [(p[0], p[1], p[2] if len(p) > 2 else None, properties["name"], {"mag": i / 2}, {"kind": "Feature"}) for p in ([place] if kind < 2 else place)]
    root = {"crs": {"type": "name", "properties": {"name": "x"}}, "features": features, "type": "FeatureCollection", "links": [{"href": "]"}]}
    (tmp_path / "big.geojson").write_text(json.dumps(root, indent=1))
    (tmp_path / "cut.geojson").write_text(json.dumps(root)[:-40])
    (tmp_path / "one.geojson").write_text(json.dumps(features[2]))
    (tmp_path / "none.geojson").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        points, dropped = files.read_geojson(spark, str(tmp_path))
        got = rows(points, "track_id", "lon", "lat", "ele", "name", "ext_num", "ext_str")
        assert audit(dropped) == {("cut", "not-geojson"): 1}  # Spark skips files of no bytes
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r[1:] for r in got if r[0] == "big"] == want
    assert [r[1:] for r in got if r[0] == "one"] == want[2:4]


def sentence(body):
    total = 0
    for c in body:
        total ^= ord(c)
    return f"${body}*{total:02X}"


def test_nmea_carries_what_other_sentences_tell(spark, tmp_path):
    lines = ["GPGLL,3400.000,N,11800.000,W,000000,A", "GPZDA,000000,02,01,2024,00,00", "GPVTG,45.0,T,,M,20.0,N,37.0,K", "GPGSA,A,3,,,,,,,,,,,,,2.5,1.5,2.0", "GPGSV,3,1,12", "GPGGA,000003.57,3400.000,N,11800.000,W,1,07,,100.0,M", "GPGGA,000004,3400.000,N,11800.000,W,1,07,0.8,,M", "GPRMC,000005,A,3400.000,N,11800.000,W,10.0,90.0,030124,,", "GPGLL,3400.000,N,11800.000,W,000006,A"]
    (tmp_path / "n.nmea").write_text("\n".join(map(sentence, lines)))
    points, _ = files.read_nmea(spark, str(tmp_path))
    got = rows(points, "time_ms", "ext_num", "ele")
    day = 1704153600000.0
    assert got[0] == (None, {}, None)
    assert got[1][0] == day + 3569 and {k: round(v, 5) for k, v in got[1][1].items()} == {"speed_mps": 10.28888, "heading_deg": 45.0, "sat": 7.0, "hdop": 1.5, "fix_quality": 1.0, "pdop": 2.5, "vdop": 2.0, "sat_in_view": 12.0}
    assert got[2][1]["hdop"] == 0.8 and got[3][0] == day + 86_405_000 and got[3][1]["heading_deg"] == 90.0 and set(got[3][1]) == {"speed_mps", "heading_deg"}
    assert got[4][0] == day + 86_406_000 and round(got[4][1]["speed_mps"], 5) == 10.28888  # that of VTG, not of RMC


def test_eag_round_trip_days_and_counts(spark, tmp_path):
    df = track(spark, [(51.5, -0.1, 100, 1_746_489_599_000), (51.6, -0.2, 50, 1_746_489_600_500)], "06MAY25_X")
    told = sinks.write_eag(df.unionByName(track(spark, [(95, 0, 0, 0)], "bad")), str(tmp_path / "out"))
    assert {tuple(r) for r in told.collect()} == {("06MAY25_X", 2, 0, 0), ("bad", 0, 1, 0)}
    lines = (next((tmp_path / "out" / "track_id=06MAY25_X").glob("part*"))).read_text().splitlines()
    assert lines[0].split("\t") == ["A", "1", "0", "0", "25", "1", "06MAY25_X"] and lines[1].split("\t")[0] == "86399000" and lines[2].split("\t")[10] == "00:00:00.50"
    lines += ["1\t2", lines[2].replace("\t1\t0\t0\t", "\t1\t9\t0\t"), "\t".join(["5", "1", "0", "0", "x", "1", "1", " 0.0", "  0.0", " 0.0", "00:00:01.00"])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "06MAY25_X.txt").write_text("\r\n".join(lines))
    points, dropped = files.read_eag(spark, str(tmp_path / "in"))
    got = rows(points, "lat", "lon", "ele", "time_ms")
    for g, w in zip(got, [(51.5, -0.1, 100), (51.6, -0.2, 50)], strict=True):
        assert abs(g[0] - w[0]) < 3e-5 and abs(g[1] - w[1]) < 3e-5 and abs(g[2] - w[2]) < 2
    assert [g[3] for g in got] == [1_746_575_999_000.0, 1_746_576_000_500.0]  # the counter fell: the next day
    assert audit(dropped) == {("06MAY25_X", "wrong-field-count"): 1, ("06MAY25_X", "header-mismatch"): 1, ("06MAY25_X", "bad-position"): 1}


def test_gpb_bytes_and_broken_containers(spark):
    df = track(spark, [(1.5, 2.5, 3, 4000), (5, 6, None, None)])
    blob = bytes(binary.encode_gpb(df).first()["content"])
    head = b"GPB1" + struct.pack("<BBH", 1, 3, 1) + b"A" + struct.pack("<H", 2) + b"\x04hdop\x03sat" + struct.pack("<I", 2)
    assert blob == head + struct.pack("<ddfdff", 1.5, 2.5, 3, 4000, 1, 8) + struct.pack("<ddfdff", 5, 6, 0, 0, 1, 8)
    blobs = spark.createDataFrame([("g", bytearray(blob)), ("cut", bytearray(blob[:-1])), ("no", bytearray(b"GPB2")), ("old", bytearray(b"GPB1\x02" + blob[5:]))], "track_id string, content binary")
    points, dropped = binary.decode_gpb(blobs)
    assert rows(promote(points, "sat"), "track_id", "lat", "ele", "time_ms", "sat") == [("g", 1.5, 3.0, 4000.0, 8.0), ("g", 5.0, 0.0, 0.0, 8.0)]
    assert audit(dropped) == {("cut", "cut short in the points"): 1, ("no", "no GPB1 at the start"): 1, ("old", "version 2"): 1}


def recording(live, date=b"4 APR 26", start=0, blocks=2):
    """A recording of so many blocks; live: {(subframe, slot): (x, y, z)}."""
    n = 9 + 10 * (blocks - 1)
    out = bytearray(56772 + 44932 * (blocks - 1))
    out[:4], out[48 : 48 + len(date)] = b"\0\0\1\0", date
    for s in range(50):
        out[0x110 + 80 * s + 2] = s + 1
    out[0x110 + 28 : 0x110 + 32] = b"HAWK"
    for f in range(n):
        at = 12 + 16332 + 4492 * f if f < 9 else 56772 + 44932 * ((f - 9) // 10) + 12 + 4492 * ((f - 9) % 10)
        cs = (start + f * 10) % 8_640_000
        clock = bytes([cs // 360_000, cs // 6000 % 60, cs // 100 % 60, cs % 100])
        out[at : at + 8], out[at + 8 : at + 12] = bytes([0, 0, 4, 0x52, 4, 1, 0, 3]), clock
        out[at + 12 : at + 16] = struct.pack(">I", struct.unpack(">I", clock)[0] ^ 0x04010003)
        total = 0x0332044E
        for s in range(50):
            r = at + 20 + 88 * s
            out[r + 7], out[r + 1] = s + 1, 0 if (f, s + 1) in live else 1
            if (f, s + 1) in live:
                out[r + 8 : r + 20] = struct.pack(">fff", *live[f, s + 1])
            for i in range(0, 88, 4):
                total ^= struct.unpack(">I", out[r + i : r + i + 4])[0]
        out[at + 4420 : at + 4428] = struct.pack(">I", total) + b"\xff\0\0\0"
    return out


def test_recordings(spark):
    live = {(f, 1): (f * 1.0, 2.0, 30.0) for f in range(19) if f not in (5, 6, 12)} | {(3, 7): (4.0, 5.0, 6.0)}
    blobs = spark.createDataFrame([("R", recording(live, start=8_640_000 - 100)), ("bad", bytearray(b"nothing"))], "track_id string, content binary")
    got = {(r["subframe"], r["slot"]): (r["x"], r["y"], r["z"], r["time_ms"]) for r in binary.read_p5(spark, blobs).collect()}
    day = 1_775_260_800_000.0
    assert {k: v[:3] for k, v in got.items()} == live and got[0, 1][3] == day + 86_399_000 and got[18, 1][3] == day + 86_400_800
    assert {(r["subframe"], r["slot"]) for r in binary.read_p5(spark, blobs, [7, 9]).collect()} == {(3, 7)}
    assert {r["subframe"] for r in binary.read_p5(spark, blobs, decimation=4).collect()} == {0, 4, 8, 16}
    cover = {r["slot"]: r for r in binary.p5_slot_coverage(spark, blobs, buckets=4).collect()}
    assert [tuple(g) for g in cover[1]["missing"]] == [(5, 6), (12, 12)] and cover[1]["live"] == 16 and cover[7]["first_subframe"] == cover[7]["last_subframe"] == 3
    assert np.allclose(cover[1]["shares"], [1.0, 0.6, 0.8, 1.0])
    check = binary.p5_validation(spark, blobs).first().asDict()
    assert check == {"recording": "R", "subframes": 19, "records": 950, "live": 17} | {k: 0 for k in ("bad_signatures", "bad_trailers", "bad_checksums", "bad_slots", "bad_states", "clock_anomalies", "derived_clock_mismatches")}
    broken = recording(live)
    broken[12 + 16332 + 20 + 8] ^= 1
    broken[12 + 16332 + 4492 + 11] = 50
    bad = binary.p5_validation(spark, spark.createDataFrame([("B", broken)], "track_id string, content binary")).first()
    assert (bad["bad_checksums"], bad["clock_anomalies"], bad["derived_clock_mismatches"]) == (1, 2, 1)
    points = binary.p5_georeference(binary.read_p5(spark, blobs), binary.p5_roster(spark, blobs))
    first = points.filter("track_id = 'R-1'").orderBy("seq").first()
    assert abs(first["lat"] - 39.4166) < 1e-9 and abs(first["lon"] + 118.7005) < 1e-9 and abs(first["ele"] - 1199) < 1e-6
    assert (first["flags"], first["source_segment"], first["source_record"], first["ext_num"]["p5_z"]) == (["p5_assumed_georeference"], "HAWK", 1, 30.0)
    with pytest.raises(ValueError):
        binary.p5_georeference(binary.read_p5(spark, blobs), horizontal_m=0)


def test_csv_with_rows_to_skip_quotes_and_range_time(spark, tmp_path):
    (tmp_path / "a.csv").write_text('made by hand\nla;lo;t;note\n1;2;160:00:00:01,5;"a\nb"\n')
    points, _ = files.read_csv_track(spark, str(tmp_path), {"lat": "la", "lon": "lo", "time": "t"}, sep=";", time_format="irig_doy", anchor_ms=1704067200000, columns=["la", "lo", "t", "note"], start_row=3, multi_line=True)
    assert rows(points, "lat", "time_ms", "ext_str") == [(1.0, 1704067200000.0 + 159 * 86_400_000 + 1500, {"note": "a\nb"})]


def test_written_text_is_escaped_and_counted(spark, tmp_path):
    df = track(spark, [(1, 2, 3, 2000), (95, 0, 0, 0), (4, 5, None, 1000), (None, 1, 0, 0)]).withColumn("name", F.lit('<"&'))
    told = sinks.write_gpx(df, str(tmp_path / "g")).collect()
    assert [tuple(r) for r in told] == [("A", 2, 1, 1)]
    body = next((tmp_path / "g" / "track_id=A").glob("part*")).read_text()
    assert body.index('<trkpt lat="4"') < body.index('<trkpt lat="1"') and "<name>&lt;&quot;&amp;</name>" in body and '<bounds minlat="1" minlon="2" maxlat="4" maxlon="5"/>' in body and "<time>1970-01-01T00:00:01Z</time>" in body
    sinks.write_csv(df.withColumn("odd", F.lit(float("nan"))), str(tmp_path / "c"))
    raw = next((tmp_path / "c" / "track_id=A").glob("part*.csv")).read_bytes()
    assert raw.startswith(b"lat,lon,elevation_m,time_iso,name,description,") and raw.count(b"\r\n") == 5


def test_inventory_and_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lat,lon\n1,2\n")
    (tmp_path / "b.gpx").write_text("<kml ></kml>")
    (tmp_path / "c.txt").write_text("\t".join("1234567") + "\n" + "\t".join("12345678901") + "\n")
    (tmp_path / "d.bin").write_bytes(b"GPB1....")
    got = {r["file"]: (r["declared"], r["sniffed"], r["mismatch"], r["over_budget"]) for r in inventory.source_inventory(spark, str(tmp_path), {"csv": (0, 1)}).collect()}
    assert got == {"a.csv": ("csv", "csv", False, True), "b.gpx": ("gpx", "kml", True, False), "c.txt": ("eag", "eag", False, False), "d.bin": ("gpb", "gpb", False, False)}
    with pytest.raises(ValueError):
        formats.register_format("mine", ["csv"], read=lambda s, p: None)
    with pytest.raises(ValueError):
        formats.read_tracks(spark, "x.unknown")
    formats.register_format("pairs", ["pairs"], read=lambda s, p: files.read_csv_track(s, p, {"lat": "_c0", "lon": "_c1"}, columns=["_c0", "_c1"], start_row=1))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.pairs").write_text("1,2\n3,4\n")
    assert rows(formats.read_tracks(spark, str(tmp_path / "p" / "x.pairs"))[0], "lat", "lon") == [(1.0, 2.0), (3.0, 4.0)]


def test_schema_helpers_and_generator(spark):
    df = track(spark, [(1, 2, 3, 4)])
    there = demote(df, "hdop", "sat")
    assert there.columns == list(POINTS) and rows(promote(there, "hdop", "sat"), "hdop", "sat") == [(1.0, 8.0)]
    assert conform(there).columns == there.columns
    a, b = (inventory.synthetic_tracks(spark, 3, 200).orderBy("track_id", "seq").collect() for _ in range(2))
    assert a == b and len(a) == 600
    outliers.detect_outliers(inventory.synthetic_tracks(spark, 1, 50)).collect()
    assert ordered.quality_events(inventory.synthetic_tracks(spark, 2, 4000)).filter("kind = 'gap'").count() > 0


def test_text_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    x = lambda v: F.lit(v).cast("double")
    assert [one(text.trimmed(x(v), 3)) for v in (1.5, 2.0, 1e-9, None)] == ["1.5", "2", "0", None]
    assert one(text.duration(x(3_723_400.0))) == "01:02:03"
    assert [one(text.readout(x(v), "distance", n)) for v, n in ((1500.0, False), (15.0, False), (3704.0, True), (3.048, True))] == ["1.50 km", "15.0 m", "2.00 NM", "10.0 ft"]
    assert [one(text.readout(x(300.0), "altitude")), one(text.readout(x(10.0), "speed", True))] == ["300 m", "19.4 kn"]
    assert [one(text.parse_range_time(F.lit(v), 1704067200000)) for v in ("01:02:03.5", "99:99:99", "2:00:00:00", "x")] == [1704067200000.0 + 3_723_500, None, 1704153600000.0, None]


@pytest.fixture
def dealt_anew(spark):
    """Shuffles are read again in parts of some bytes, so that those of a union's sides are cut differently, as large ones are."""
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("fmt", ["gpx", "geojson", "kml", "eag"])
def test_one_file_a_track(spark, tmp_path, dealt_anew, fmt):
    df = points(spark, DATA).withColumn("name", F.col("seq").cast("string"))
    getattr(sinks, f"write_{fmt}")(df, str(tmp_path / fmt))
    files = [sorted(x for x in d.iterdir() if x.name.startswith("part")) for d in (tmp_path / fmt).iterdir() if d.is_dir()]
    assert len(files) == 12 and all(len(f) == 1 for f in files)
    first = {"gpx": "<?xml", "geojson": '{"type":"FeatureCollection"', "kml": "<?xml", "eag": "A\t1"}[fmt]
    assert all(f.read_text().startswith(first) for f, in files)


def test_kml_points_leave_the_lists_behind(spark, tmp_path):
    (tmp_path / "a.kml").write_text(f"<kml><Placemark><gx:Track>{'<when>2024-01-01T00:00:00Z</when>' * 3}{'<gx:coord>1 2 3</gx:coord>' * 3}</gx:Track></Placemark></kml>")
    points, _ = files.read_kml(spark, str(tmp_path))
    plan = points._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]  # what is done with single points
    assert "row_number" in plan and "whens" not in plan and "parts" not in plan
    assert points.filter("time_ms = 1704067200000").count() == 3


def test_geojson_positions_leave_the_text_behind(spark, tmp_path):
    """A position that takes its feature's text along makes a line's work grow with the square of its length."""
    line = {"type": "Feature", "properties": {"name": "L", "time": "2024-01-01T00:00:00Z", "hr": 7}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4], [5, 6]]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line]}))
    points, _ = files.read_geojson(spark, str(tmp_path))
    assert [(r["lon"], r["name"], r["time_ms"], r["ext_num"]) for r in points.orderBy("seq").collect()] == [(x, "L", 1704067200000.0, {"hr": 7.0}) for x in (1.0, 3.0, 5.0)]
    explodes = [x for x in points._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate posexplode(" in x and "value#" not in x]
    assert explodes and not any("geometry" in x or ", [x#" in x or "g#" in x for x in explodes)


def test_kml_points_on_lines_are_rows_of_their_own(spark, tmp_path):
    """Lines of nothing but points leave the text, so that no row grows with a geometry; results are those of a file of one line."""
    when, coord = "<when>2024-01-01T00:00:{:02d}Z</when>", "<gx:coord>{0} {0}.5 3</gx:coord>"
    body = [
        "<kml><Document><name>", "1,2", "</name><Placemark>", "<name>", "3,4", "</name>", "<TimeStamp>", when.format(1), "</TimeStamp><LineString><coordinates>", *(f"{i},{i + 1},{i + 2}" for i in range(5)), "x,1", "6,7 8,9", "</coordinates>",
        "</LineString></Placemark>", '<Placemark id="a">', "<name>T</name>", "<gx:Track>", *(when.format(i) for i in range(4)), when.format(4) + when.format(5), *(coord.format(i) for i in range(7)), "</gx:Track>", "</Placemark>",
        "<Placemark><gx:Track>", when.format(9), coord.format(1), when.format(8), "", coord.format(2), "</gx:Track><Point><coordinates>", " 5,6 ", "</coordinates></Point></Placemark>", "<LineString><coordinates>", "9,9", "</coordinates></LineString></Document></kml>",
    ]
    got = []
    for name, between in (("lines", "\n"), ("dos", "\r\n"), ("one", " ")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.kml").write_bytes(between.join(body).encode())
        points, dropped = files.read_kml(spark, str(tmp_path / name))
        points = points.withColumn("source_segment", F.trim(F.regexp_replace("source_segment", r"\s", " ")))
        got.append((rows(points, "seq", "lat", "lon", "ele", "time_ms", "name", "source_segment", "source_feature", "source_record"), audit(dropped)))
    assert got[0] == got[1] == got[2] and len(got[0][0]) == 18 and got[0][1] == {("a", "bad-coordinate"): 1, ("a", "times-paired-by-index"): 1}
    text = "".join(r["value"] for r in files._kml_parts(files._kml_lines(spark, str(tmp_path / "lines"))).collect())
    assert "4,5,6" not in text and ":00:03Z" not in text and "6.5" not in text and "3,4" in text
