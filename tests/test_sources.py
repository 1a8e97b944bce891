"""Readers on small files of their formats."""

from pyspark.sql import functions as F

from trackspark.sources import files, text


def test_numbers_coordinates_and_times(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(text.parse_number(F.lit(x))) for x in ("1,5", "1,234.5", " 7 ", "", "x", "3d", "1e3", "NaN", "-.5")] == [1.5, 1234.5, 7.0, None, None, None, 1000.0, None, -0.5]
    assert [round(one(text.parse_coordinate(F.lit(x))), 6) for x in ("12.5", "34°30'36\"S", "10 15 W")] == [12.5, -34.51, -10.25]
    assert [one(text.parse_time(F.lit(x))) for x in ("1704067200", "1704067200000", "1704067200000000", "45292", "2024-01-01T00:00:00Z", "nope")] == [1704067200000.0] * 5 + [None]
    assert one(text.checksum(F.lit("GPGLL,5057.970,N,00146.110,E,142451,A"))) == "27"
    texts = spark.createDataFrame([("",), (None,), ("A",), ("AB",), ("é€",), ("AAB",)], "t string").coalesce(1)
    assert [r[0] for r in texts.select(text.checksum(F.col("t"))).collect()] == ["00", None, "41", "03", "20", "42"]


def test_csv_rejects_and_channels(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,la,lo,alt,hdop,note\n2024-01-01T00:00:00Z,1,2,10,0.9,x\nbad,3,4,,,\n,north,5,1,1,\n")
    points, audit = files.read_csv_track(spark, str(tmp_path), {"lat": "la", "lon": "lo", "ele": "alt", "time": "t"}, ele_unit="ft")
    got = points.orderBy("seq").collect()
    assert [(r["track_id"], r["seq"], r["lat"], r["time_ms"]) for r in got] == [("a", 0, 1.0, 1704067200000.0), ("a", 1, 3.0, None)]
    assert (round(got[0]["ele"], 3), got[0]["ext_num"], got[0]["ext_str"]) == (3.048, {"hdop": 0.9}, {"note": "x"})
    assert {(r["reason"], r["n"]) for r in audit.collect()} == {("bad-time", 1), ("bad-coordinate", 1)}


def test_nmea_date_carries_and_checksum_counts(spark, tmp_path):
    def sentence(body):
        total = 0
        for c in body:
            total ^= ord(c)
        return f"${body}*{total:02X}"

    lines = [sentence("GPRMC,000001,A,3400.000,N,11800.000,W,10.0,90.0,010124,,"), sentence("GPGGA,000002,3400.600,N,11800.000,W,1,07,0.9,100.0,M,,M,,"), "$GPGGA,000003,3400.000,N,11800.000,W,1,07,0.9,100.0,M,,M,,*00"]
    (tmp_path / "b.nmea").write_text("\r\n".join(lines))
    points, audit = files.read_nmea(spark, str(tmp_path))
    got = points.orderBy("seq").collect()
    assert [(round(r["lat"], 6), round(r["lon"], 6), r["time_ms"], r["ele"], r["ext_num"].get("sat")) for r in got] == [(34.0, -118.0, 1704067201000.0, None, None), (34.01, -118.0, 1704067202000.0, 100.0, 7.0)]
    assert round(got[0]["ext_num"]["speed_mps"], 5) == 5.14444
    assert [(r["reason"], r["n"]) for r in audit.collect()] == [("bad-checksum", 1)]


def test_texts_are_read_where_they_are_scanned(spark, tmp_path):
    """Behind the windows over a file, which one task holds, there is no more work on a row's text."""
    (tmp_path / "a.txt").write_text("$GPGLL,5057.970,N,00146.110,E,142451,A*27\n")
    (tmp_path / "a.csv").write_text("la,lo,t,x\n1,2,2024-01-01T00:00:00Z,3\n")
    nmea, audit = files.read_nmea(spark, str(tmp_path / "a.txt"))
    csv, _ = files.read_csv_track(spark, str(tmp_path / "a.csv"), {"lat": "la", "lon": "lo", "time": "t"})
    for df in (nmea, csv):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        deepest = max(i for i, line in enumerate(lines) if "Window [" in line)
        assert not [line for line in lines[: deepest + 1] if "RLIKE" in line or "aggregate(" in line]
    assert "Window" not in audit._jdf.queryExecution().optimizedPlan().toString()
    assert nmea.count() == csv.filter("lat = 1 and ext_num['x'] = 3 and seq = 0").count() == 1
