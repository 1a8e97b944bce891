"""Queries of formats, repair, comparison, views and reports over the demo tracks, and their DuckDB twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .demo_tracks import sql_bearing, sql_haversine, sql_valid
from .operators import aggregate as A
from .operators import align as J
from .operators import compare as X
from .operators import edit as P
from .operators import kinematics as K
from .operators import ordered as W
from .operators import outliers as O
from .operators import resample as R
from .operators import series as S
from .operators.report import analysis_report
from .plans.folders import work_folder
from .plans.recipes import run_derivation
from .plans.scan import gathered
from .queries import _BRACKET, _EVENTS, _KIN3, _PREV, _REL, _SIDES, _STATS, W_SQL, _add, _base, _ecef, _pair, _rel, _round
from .schema import channel_value, collect_channels, conform, demote, promote
from .sources import binary, files, formats, inventory, ranges, sinks, workspace
from .sources.text import checksum, duration, readout, to_feet, to_knots, to_nautical_miles, trimmed

VALID = f"SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS seq, lat, lon, ele, time_ms, hdop, sat FROM points WHERE {sql_valid()}"
_KIN_OF = "SELECT track_id, seq, CASE WHEN d > 0 THEN leg / d END AS ground_speed_mps FROM (SELECT track_id, seq, (time_ms - lag(time_ms) OVER w) / 1000 AS d, {} AS leg FROM ({}) {})"


def _through(df: DataFrame, fmt: str, **options) -> DataFrame:
    """Written and read again in a format; track_id is that of the folder."""
    folder = work_folder(df.sparkSession)
    formats.write_tracks(df, folder, fmt)
    got, _ = formats.read_tracks(df.sparkSession, f"{folder}/*", fmt, **options)
    return got


CSV = {"lat": "lat", "lon": "lon", "ele": "elevation_m", "time": "time_iso", "name": "name", "desc": "description"}


def _of_one(df: DataFrame) -> DataFrame:
    """Files of folders have names of their own; a track's points are told by their place among all."""
    return promote(df, "hdop", "sat").select("lat", "lon", "ele", "time_ms", "hdop", "sat")


# Files, and an operator behind each reader.
_add("csv_round_trip", lambda df: _of_one(_through(df, "csv", mapping=CSV)), "SELECT lat, lon, ele, time_ms, hdop, sat FROM points", "lat lon ele time_ms hdop sat", 5)
_add("gpx_round_trip", lambda df: _of_one(_through(df, "gpx")), f"SELECT lat, lon, round(ele, 3) AS ele, time_ms, hdop, sat FROM points WHERE {sql_valid()}", "lat lon ele time_ms hdop sat", 5)
_add("geojson_round_trip", lambda df: _through(df.withColumn("name", F.when(F.col("seq") % 7 == 0, F.concat(F.lit("p"), F.col("seq").cast("string")))), "geojson").select("lat", "lon", "ele", "name", "time_ms"), f"""
  SELECT lat, lon, round(ele, 3) AS ele, CASE WHEN mark = 0 THEN track_id ELSE 'p' || seq END AS name, CASE WHEN mark = 1 THEN time_ms END AS time_ms FROM (SELECT *, unnest(CASE WHEN seq % 7 = 0 THEN [0, 1] ELSE [0] END) AS mark FROM points WHERE {sql_valid()})""", "lat lon ele time_ms", 5)
_add("kml_round_trip", lambda df: _through(df, "kml").select("lat", "lon", "ele", "time_ms", "source_segment"), f"""
  SELECT lat, lon, coalesce(round(ele, 3), 0) AS ele, CASE WHEN k = 1 THEN time_ms END AS time_ms, track_id AS source_segment FROM (SELECT *, unnest([0, 1]) AS k FROM points WHERE {sql_valid()}) WHERE k = 0 OR time_ms IS NOT NULL""", "lat lon ele time_ms", 5)
# "eag_round_trip", lambda df: _through(df, "eag").select(F.floor(F.col("lat") * 1000 + 0.5).alias("lat"), F.floor(F.col("lon") * 1000 + 0.5).alias("lon")).groupBy("lat", "lon").agg(F.count("*").alias("n")), f"SELECT floor(lat * 1000 + 0.5)::BIGINT AS lat, floor(lon * 1000 + 0.5)::BIGINT AS lon, count(*) AS n FROM (SELECT floor(lat * 2000 + 0.5) / 2000 AS lat, floor(lon * 2000 + 0.5) / 2000 AS lon FROM points WHERE {sql_valid()}) GROUP BY ALL"


def _eag(df: DataFrame) -> DataFrame:
    """The demo tracks as range files of one name each with a date, read again; whole metres lose up to 0.87 m."""
    folder = work_folder(df.sparkSession)
    sinks.write_eag(df.filter("time_ms is not null").withColumn("track_id", F.concat("track_id", F.lit("-20240101"))), folder)
    text = df.sparkSession.read.option("wholetext", False).text(f"{folder}/*").groupBy(F.regexp_extract(F.input_file_name(), r"track_id=([^/]+)", 1).alias("f")).agg(F.count("*").alias("n"))
    return text.select("f", (F.col("n") - 1).alias("rows"))


_add("eag_rows", _eag, f"SELECT track_id || '-20240101' AS f, count(*) AS rows FROM points WHERE time_ms IS NOT NULL AND {sql_valid()} GROUP BY track_id")


def _eag_back(df: DataFrame) -> DataFrame:
    folder = work_folder(df.sparkSession)
    sinks.write_eag(df.filter("time_ms is not null"), folder)
    got, _ = files.read_eag(df.sparkSession, f"{folder}/*")
    return got.select(F.floor("ele").alias("metres"), (F.col("ext_num")["heading_deg"] == 0).alias("level")).filter("abs(metres) < 1e6").groupBy("level").agg(F.count("*").alias("n"))


_add("eag_round_trip", _eag_back, f"SELECT true AS level, count(*) AS n FROM points WHERE time_ms IS NOT NULL AND {sql_valid()}")
def _ranges_of_gpb(df: DataFrame) -> DataFrame:
    """Packed files read in ranges of 2,000 bytes: what each task has is added up, and whether a file had several."""
    folder = work_folder(df.sparkSession)
    formats.write_tracks(df, folder, "gpb")
    got = promote(binary.read_gpb(df.sparkSession, folder, split=2_000)[0], "sat").withColumn("task", F.spark_partition_id())
    parts = got.groupBy("track_id", "task").agg(F.count("*").alias("n"), F.sum("seq").alias("places"), F.sum("sat").alias("sat"))
    return parts.groupBy("track_id").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.sum("sat").alias("sat"), (F.count("*") > 1).alias("many"))


_add("gpb_round_trip", lambda df: promote(_through(df, "gpb"), "hdop", "sat").select("track_id", "seq", "lat", "lon", "ele", "time_ms", "hdop", "sat"), "SELECT track_id, seq, lat, lon, coalesce(ele, 0)::FLOAT::DOUBLE AS ele, coalesce(time_ms, 0) AS time_ms, hdop::FLOAT::DOUBLE AS hdop, sat FROM points", "lat lon ele time_ms hdop sat", 5)
_add("gpb_ranges", _ranges_of_gpb, "SELECT track_id, count(*) AS n, sum(seq) AS places, sum(sat) AS sat, true AS many FROM points GROUP BY track_id", "sat", 2)


def _nmea(df: DataFrame) -> DataFrame:
    """Valid timed points as GGA and RMC sentences of a file a track, read again."""
    spark, folder = df.sparkSession, work_folder(df.sparkSession)
    degrees = lambda x, n: F.concat(F.lpad(F.floor(F.abs(x)).cast("int").cast("string"), n, "0"), F.format_string("%010.7f", (F.abs(x) - F.floor(F.abs(x))) * 60))
    side = lambda x, a, b: F.when(x < 0, b).otherwise(a)
    when = F.timestamp_millis(F.floor("time_ms").cast("bigint"))
    clock = F.concat(F.date_format(when, "HHmmss"), F.lit("."), F.lpad((F.floor("time_ms") % 1000).cast("int").cast("string"), 3, "0"))
    place = [degrees(F.col("lat"), 2), side(F.col("lat"), "N", "S"), degrees(F.col("lon"), 3), side(F.col("lon"), "E", "W")]
    rmc = F.concat_ws(",", F.lit("GPRMC"), clock, F.lit("A"), *place, F.lit("10.0"), F.lit("90.0"), F.date_format(when, "ddMMyy"))
    gga = F.concat_ws(",", F.lit("GPGGA"), clock, *place, F.lit("1"), trimmed(F.col("sat"), 0), trimmed(F.col("hdop"), 1), F.coalesce(trimmed(F.col("ele"), 3), F.lit("")), F.lit("M"))
    gsv = F.lit("GPGSV,1,1,11")
    rows = P.drop_invalid(df).filter("time_ms is not null").select("track_id", "seq", F.posexplode(F.array(rmc, gsv, gga)).alias("k", "body"))
    lines = rows.select("track_id", "seq", "k", F.concat(F.lit("$"), "body", F.lit("*"), checksum(F.col("body"))).alias("value"))
    gathered(lines, "track_id").sortWithinPartitions("track_id", "seq", "k").select("track_id", "value").write.partitionBy("track_id").text(folder)
    got, _ = files.read_nmea(spark, f"{folder}/*")
    got = promote(got, "hdop", "sat", "sat_in_view", "speed_mps").withColumn("gga", F.col("sat").isNotNull())
    # Both sentences of a point are at one place and time.
    return got.groupBy("gga").agg(F.count("*").alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.sum("ele").alias("ele"), F.sum(F.col("time_ms") - 1704067200000).alias("t"), F.sum("hdop").alias("hdop"), F.sum("sat_in_view").alias("view"), F.round(F.sum("speed_mps"), 2).alias("speed"))


_add("nmea_read", _nmea, f"SELECT gga, count(*) AS n, sum(lat) AS lat, sum(lon) AS lon, sum(CASE WHEN gga THEN round(ele, 3) END) AS ele, sum(time_ms - 1704067200000) AS t, sum(CASE WHEN gga THEN hdop END) AS hdop, sum(CASE WHEN gga THEN 11.0 END) AS view, round(sum(CASE WHEN NOT gga THEN 5.14444 END), 2) AS speed FROM (SELECT *, unnest([true, false]) AS gga FROM points WHERE time_ms IS NOT NULL AND {sql_valid()}) GROUP BY gga", "lat lon ele t hdop view speed", 3)
# Kinematics behind a reader.
for _fmt, _options in (("csv", {"mapping": CSV}), ("gpx", {}), ("kml", {})):
    _add(f"{_fmt}_kinematics", lambda df, f=_fmt, o=_options: _fastest(P.drop_invalid(df.filter("time_ms is not null")), f, o), f"SELECT count(*) AS n, max(ground_speed_mps) AS top FROM ({_KIN_OF.format(sql_haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon'), f'SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY time_ms, seq) AS seq, time_ms, round(lat, 7) AS lat, round(lon, 7) AS lon FROM points WHERE time_ms IS NOT NULL AND {sql_valid()}', W_SQL)}) WHERE ground_speed_mps > 0", "top", 1)


def _fastest(df: DataFrame, fmt: str, options: dict) -> DataFrame:
    df = W.sort_by_time(df.withColumns({c: _round(c, 7) for c in ("lat", "lon")}))
    got = _through(df, fmt, **options)
    got = got.filter("source_segment is null or time_ms is not null")
    return K.kinematics(got).filter("ground_speed_mps > 0").agg(F.count("*").alias("n"), F.max("ground_speed_mps").alias("top"))


# Recordings: the events as ten-hertz records of fifty slots.
def _live_blocks(rows: DataFrame) -> DataFrame:
    """(block, live): what is live in each block, as the file holds it: six bytes a record, since the task that writes the file sorts them all."""
    first = F.greatest(F.lit(0), F.col("block") * 10 - 1)
    record = F.struct((F.col("seq") - first).cast("tinyint").alias("i"), F.col("slot").cast("tinyint").alias("k"), F.col("z").cast("float").alias("z"))
    return rows.groupBy("block").agg(F.collect_list(F.when(F.col("z").isNotNull(), record)).alias("live"))


def _recording(df: DataFrame) -> str:
    """Writes one recording of the demo tracks: track n is slot n + 1, a subframe for each seq; returns its folder.

    A block of ten subframes takes what is live in it along; in order they are built and streamed into the file.
    """
    import numpy as np

    spark, folder = df.sparkSession, work_folder(df.sparkSession)
    block = F.when(F.col("seq") < 9, 0).otherwise(F.expr("1 + (seq - 9) div 10"))
    rows = df.select(block.cast("bigint").alias("block"), F.substring("track_id", 2, 9).cast("int").alias("slot"), F.col("seq"), F.col("ele").alias("z"))

    def pack(b: int, i: np.ndarray, k: np.ndarray, z: np.ndarray) -> bytes:
        first = 0 if b == 0 else 9 + 10 * (b - 1)
        at = first + i
        frames = np.zeros(9 if b == 0 else 10, binary._FRAME)
        frames["sign"] = binary.SIGNATURE
        cs = (np.arange(first, first + len(frames)) * 10 + 8_639_000) % 8_640_000  # a second and less before midnight, so that the day changes
        frames["clock"] = np.column_stack([cs // 360_000, cs // 6000 % 60, cs // 100 % 60, cs % 100])
        frames["derived"] = np.ascontiguousarray(frames["clock"]).view(">u4").ravel() ^ np.uint32(binary.CLOCK_XOR)
        frames["mark"] = b"\xff\0\0\0"
        frames["slots"]["state"], frames["slots"]["slot"] = 1, np.arange(1, binary.SLOTS + 1)
        frames["slots"]["state"][i, k] = 0
        frames["slots"]["x"][i, k], frames["slots"]["y"][i, k], frames["slots"]["z"][i, k] = at * 0.5, k * 10.0, z
        words = np.frombuffer(frames.tobytes(), ">u4").reshape(len(frames), -1)[:, binary.SUBHEAD // 4 : (binary.SUBHEAD + binary.SLOTS * binary.RECORD) // 4].astype(np.uint32)
        frames["sum"] = (np.bitwise_xor.reduce(words, axis=1) ^ np.uint32(binary.CHECKSUM_SEED)).astype(">u4")
        return bytes(binary.HEAD) * (b > 0) + frames.tobytes()

    def build(batches):
        for batch in batches:
            for a in range(0, len(batch), 100):  # 4.5 MB of blocks at a time
                some = batch.iloc[a : a + 100]
                data = [None if r.head is not None else pack(r.block, np.asarray(r.i, int), np.asarray(r.k, int), np.asarray(r.z, np.float32)) for r in some.itertuples()]
                yield some[["track_id", "head", "points", "n"]].assign(data=data)

    head = bytearray(binary.HEAD + binary.CONFIG)
    head[:4] = b"\0\0\1\0"
    head[48:57] = b"31 DEC 23"
    for s in range(binary.SLOTS):
        at = binary.ROSTER_AT + s * binary.ROSTER
        head[at + 2], head[at + 28 : at + 31] = s + 1, b"C%02d" % s
    blocks = _live_blocks(rows)
    blocks = blocks.select(F.lit("R").alias("track_id"), "block", F.lit(None).cast("binary").alias("head"), F.lit(None).cast("bigint").alias("points"), F.lit(1).cast("bigint").alias("n"), F.col("live.i").alias("i"), F.col("live.k").alias("k"), F.col("live.z").alias("z"))
    first = rows.agg((F.max("block") + 1).alias("points")).select(F.lit("R").alias("track_id"), F.lit(-1).cast("bigint").alias("block"), F.lit(bytes(head)).alias("head"), "points")
    out = gathered(blocks.unionByName(first, allowMissingColumns=True), "track_id").sortWithinPartitions("track_id", "block")
    ranges.write_packed(out.mapInPandas(build, "track_id string, head binary, points bigint, n bigint, data binary"), folder, "msnp5")
    return folder


def _with_recording(run):
    """Runs on the folder of a recording."""
    return lambda df: run(df.sparkSession, _recording(df))


_LIVE = "SELECT substr(track_id, 2)::INT + 1 AS slot, seq, ele FROM points WHERE ele IS NOT NULL"
_add("p5_samples", _with_recording(lambda spark, b: binary.read_p5(spark, b).select("slot", F.col("subframe").alias("seq"), "time_ms", "x", "y")), f"SELECT slot, seq, 1703980800000 + 86390000 + seq * 100.0 AS time_ms, seq * 0.5 AS x, (slot - 1) * 10.0 AS y FROM ({_LIVE})", "time_ms x y", 3)
_add("p5_coverage", _with_recording(lambda spark, b: binary.p5_slot_coverage(spark, b).select("slot", "first_subframe", "last_subframe", "live", F.size("missing").alias("runs"), F.aggregate("shares", F.lit(0.0), lambda a, x: a + x).alias("share"))), f"""
  WITH live AS (SELECT *, lag(seq) OVER (PARTITION BY slot ORDER BY seq) AS was FROM ({_LIVE})), total AS (SELECT 9 + 10 * greatest(0, ceil((max(seq) + 1 - 9) / 10.0))::BIGINT AS total FROM points),
  sized AS (SELECT i, count(*) AS size FROM (SELECT (s * 240 // total) AS i FROM total, range(0, total) r(s)) GROUP BY i),
  shared AS (SELECT slot, sum(n / size) AS share FROM (SELECT slot, seq * 240 // total AS i, count(*) AS n FROM live, total GROUP BY ALL) JOIN sized USING (i) GROUP BY slot)
  SELECT slot, min(seq) AS first_subframe, max(seq) AS last_subframe, count(*) AS live, least(200, count(*) FILTER (WHERE seq - was > 1))::INT AS runs, any_value(share) AS share FROM live JOIN shared USING (slot) GROUP BY slot""", "share", 4)
_add("p5_validation", _with_recording(lambda spark, b: binary.p5_validation(spark, b).select("subframes", "records", "live", "bad_signatures", "bad_trailers", "bad_checksums", "bad_slots", "bad_states", "clock_anomalies", "derived_clock_mismatches")), f"SELECT total AS subframes, total * 50 AS records, n AS live, 0::BIGINT AS bad_signatures, 0::BIGINT AS bad_trailers, 0::BIGINT AS bad_checksums, 0::BIGINT AS bad_slots, 0::BIGINT AS bad_states, 0::BIGINT AS clock_anomalies, 0::BIGINT AS derived_clock_mismatches FROM (SELECT 9 + 10 * greatest(0, ceil((max(seq) + 1 - 9) / 10.0))::BIGINT AS total FROM points), (SELECT count(*) AS n FROM ({_LIVE}))")
_add("p5_roster", _with_recording(lambda spark, b: binary.p5_roster(spark, b).select("slot", "callsign")), "SELECT s::INT AS slot, 'C' || lpad((s - 1)::VARCHAR, 2, '0') AS callsign FROM range(1, 51) r(s)")
_add("p5_georeference", _with_recording(lambda spark, b: _metres(binary.p5_georeference(binary.read_p5(spark, b)))), f"SELECT slot, seq, (seq - s0) * 0.5 * 30.48 AS east, (slot - k0) * 10.0 * 30.48 AS north, ele::FLOAT::DOUBLE - e0::FLOAT::DOUBLE AS up FROM ({_LIVE}), (SELECT seq AS s0, slot AS k0, ele AS e0 FROM ({_LIVE}) ORDER BY seq, slot LIMIT 1)", "east north up", 3)
_add("p5_by_ending", _with_recording(lambda spark, b: formats.read_tracks(spark, f"{b}/*.msnp5")[0].groupBy("track_id", "source_segment").agg(F.count("*").alias("n"), F.min("time_ms").alias("earliest"), F.max("source_record").alias("last"))), f"SELECT 'R-' || slot AS track_id, 'C' || lpad((slot - 1)::VARCHAR, 2, '0') AS source_segment, count(*) AS n, min(1703980800000 + 86390000 + seq * 100.0) AS earliest, max(seq) + 1 AS last FROM ({_LIVE}) GROUP BY slot", "earliest")


def _metres(df: DataFrame) -> DataFrame:
    """How far east, north and above the anchor each point is."""
    from .functions.geo import enu

    geo = binary.GEOREFERENCE
    e, n, u = enu(F.col("lat"), F.col("lon"), F.col("ele"), F.lit(geo["lat"]), F.lit(geo["lon"]), F.lit(geo["height"]))
    return df.select(F.col("ext_num")["p5_slot"].cast("int").alias("slot"), (F.col("source_record") - 1).alias("seq"), e.alias("east"), n.alias("north"), u.alias("up"))


# Inventory and columns.
def _inventory(df: DataFrame) -> DataFrame:
    folder = work_folder(df.sparkSession)
    df = P.drop_invalid(df)
    sinks.write_csv(df, f"{folder}/csv")
    sinks.write_gpx(df, f"{folder}/gpx")
    sinks.write_geojson(df, f"{folder}/geojson")
    sinks.write_kml(df, f"{folder}/kml")
    sinks.write_eag(df, f"{folder}/eag")
    return inventory.source_inventory(df.sparkSession, f"{folder}/*/*").groupBy("declared", "sniffed", "over_budget").agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("different"))


_add("source_inventory", _inventory, """SELECT declared, sniffed, false AS over_budget, n, n AS different FROM (SELECT count(DISTINCT track_id) AS n FROM points), (VALUES ('csv', 'csv'), ('csv', 'gpx'), ('csv', 'geojson'), ('csv', 'kml'), ('eag', 'eag')) v(declared, sniffed)""")
_TEXTS = lambda df: df.select(F.col("lat").cast("decimal(20,6)").cast("string").alias("GPS Latitude"), F.col("lon").cast("decimal(20,6)").cast("string").alias("lng"), F.col("ele").cast("decimal(20,3)").cast("string").alias("alt_ft"), F.date_format(F.timestamp_millis(F.col("time_ms").cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"), F.col("track_id").alias("label"), (F.col("seq") % 2).cast("string").alias("flag"))
_add(
    "csv_column_profile",
    lambda df: inventory.csv_column_profile(_TEXTS(df)).select("column", "non_empty", "numeric", "datetime", "boolean", "type", F.col("candidates")[0]["field"].alias("best"), F.col("candidates")[0]["score"].alias("score"), F.concat_ws(",", "patterns").alias("marks")),
    f"""SELECT "column", non_empty, numeric, datetime, boolean, type, best, score, marks FROM (SELECT count(*) AS n, count(ele) AS e, count(time_ms) AS t, avg({sql_valid()}::INT) AS ok FROM points), LATERAL (VALUES
      ('GPS Latitude', 1.0, 1.0, 0.0, 0.0, 'latitude', 'latitude', least(1.0, 0.455 + 0.8 * ok), 'header:latitude,value:decimal'), ('lng', 1.0, 1.0, 0.0, 0.0, 'longitude', 'longitude', 1.0, 'header:longitude,value:decimal'), ('alt_ft', e / n, 1.0, 0.0, 0.0, 'elevation', 'elevation', least(1.0, 0.455 + 0.6), 'header:elevation,value:decimal'),
      ('utc', t / n, 0.0, 1.0, 0.0, 'datetime', 'timestamp', 1.0, 'header:timestamp,value:date'), ('label', 1.0, 0.0, 0.0, 0.0, 'text', 'name', 1.0, 'header:name'), ('flag', 1.0, 1.0, 0.0, 1.0, 'latitude', 'latitude', 0.8, 'value:integer,value:flag')) v("column", non_empty, numeric, datetime, boolean, type, best, score, marks)""",
    "non_empty numeric datetime boolean score",
    4,
)
_add("suggest_mapping", lambda df: inventory.suggest_mapping(inventory.csv_column_profile(_TEXTS(df))).filter("field <> 'description'").select("field", "column", "feet"), """SELECT * FROM (VALUES ('latitude', 'GPS Latitude', false), ('longitude', 'lng', false), ('elevation', 'alt_ft', true), ('timestamp', 'utc', false), ('name', 'label', false)) v(field, "column", feet)""")
_add("swap_hint", lambda df: inventory.swap_hint(_TEXTS(df.withColumn("lon", F.when(F.col("seq") % 3 > 0, F.col("lon")).otherwise(F.col("lon") + 60))), "lng", "GPS Latitude"), f"SELECT count(*) FILTER (WHERE lat BETWEEN -180 AND 180 AND lon BETWEEN -90 AND 90) AS valid, count(*) FILTER (WHERE {sql_valid()}) AS swapped, true AS suggest FROM (SELECT lat, CASE WHEN seq % 3 > 0 THEN lon ELSE lon + 60 END AS lon FROM points)")
_add("make_dataset", lambda df: inventory.make_dataset(df, "eag")[0].select("track_id", "source_format", "crs", "altitude_ref", "time_ref", "points"), "SELECT track_id, 'eag' AS source_format, 'EPSG:4326' AS crs, 'HAE' AS altitude_ref, 'UTC' AS time_ref, count(*) AS points FROM points GROUP BY track_id")
_mapped = lambda df: conform(demote(df, "hdop", "sat"))
_add("collect_channels", lambda df: collect_channels(_mapped(df)), "SELECT track_id, c AS channel, 'number' AS data_type, CASE c WHEN 'hdop' THEN 'DOP' ELSE 'sats' END AS unit, NULL::VARCHAR AS semantic_type, 'linear' AS interpolation FROM (SELECT DISTINCT track_id FROM points), (VALUES ('hdop'), ('sat')) v(c)")
_add("channel_stats_maps", lambda df: A.channel_stats(_mapped(df).withColumn("ext_str", F.create_map(F.lit("note"), F.concat(F.lit(" "), F.col("seq").cast("string")))), None), "SELECT track_id, channel, count(v) AS count, count(v) AS n, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_samp(v) AS stddev, CASE channel WHEN 'hdop' THEN 'DOP' WHEN 'sat' THEN 'sats' END AS unit FROM (SELECT track_id, unnest(['hdop', 'sat', 'note']) AS channel, unnest([hdop, sat, seq::DOUBLE]) AS v FROM points) GROUP BY track_id, channel", "min max mean stddev")
_add("channel_value", lambda df: _mapped(df).select("track_id", "seq", channel_value("hdop").alias("hdop"), channel_value("elevation").alias("elevation"), channel_value("none").alias("none")), "SELECT track_id, seq, hdop, ele AS elevation, NULL::DOUBLE AS none FROM points", "hdop elevation")
_add("preset_channels", lambda df: S.preset_channels(collect_channels(_mapped(df)), "fix-quality"), "SELECT track_id, c AS channel, p AS place FROM (SELECT DISTINCT track_id FROM points), (VALUES ('hdop', 1), ('sat', 4)) v(c, p)")
# "synthetic_tracks", lambda df: inventory.synthetic_tracks(df.sparkSession, 3, 500).groupBy("track_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
_add("readouts", lambda df: df.select("track_id", "seq", readout(F.col("ele"), "altitude").alias("a"), to_feet(F.col("ele")).alias("ft"), to_nautical_miles(F.col("ele")).alias("nm"), to_knots(F.col("ele")).alias("kn"), duration(F.col("ele") * 1000).alias("d")).filter("ft >= 0"), "SELECT track_id, seq, format('{:,}', round_even(ele, 0)::BIGINT) || ' m' AS a, ele / 0.3048 AS ft, ele / 1852 AS nm, ele * 3600 / 1852 AS kn, lpad((floor(ele + 0.5)::BIGINT // 3600)::VARCHAR, 2, '0') || ':' || lpad((floor(ele + 0.5)::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((floor(ele + 0.5)::BIGINT % 60)::VARCHAR, 2, '0') AS d FROM points WHERE ele >= 0", "ft nm kn", 5)

# Repair.
_rising = lambda df: W.dejitter(df.filter("time_ms is not null"), "drop")
_RISING = "SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS i FROM (SELECT *, max(time_ms) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM points WHERE time_ms IS NOT NULL) WHERE top IS NULL OR time_ms > top"
_add("profile_violations", lambda df: O.profile_violations(_rising(df), "ground"), f"""
  SELECT track_id, seq, CASE WHEN v > 100 THEN 'ground speed' WHEN u > 20 THEN 'vertical speed' WHEN a > 15 THEN 'acceleration' ELSE 'turn rate' END AS "limit", CASE WHEN v > 100 THEN v WHEN u > 20 THEN u WHEN a > 15 THEN a ELSE t END AS value, CASE WHEN v > 100 THEN 100.0 WHEN u > 20 THEN 20.0 WHEN a > 15 THEN 15.0 ELSE 90.0 END AS bound FROM (
    SELECT *, abs(v - lag(v) OVER w) / dt AS a, abs(fmod(h - lag(h) OVER w + 540, 360) - 180) / dt AS t FROM (SELECT *, d / dt AS v, abs(ele - pe) / dt AS u, CASE WHEN d <> 0 THEN {sql_bearing("pla", "plo", "lat", "lon")} END AS h FROM (
      SELECT *, {sql_haversine("pla", "plo", "lat", "lon")} AS d FROM (SELECT track_id, seq, lat, lon, ele, (time_ms - lag(time_ms) OVER w) / 1000 AS dt, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo, lag(ele) OVER w AS pe FROM ({_RISING}) {W_SQL}) WHERE dt > 0)) {W_SQL})
  WHERE v > 100 OR u > 20 OR a > 15 OR t > 90 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY seq) = 1""", "value bound", 3)
_add("fill_gaps", lambda df: O.fill_gaps(_rising(df), 20000.0, 5000.0, profile="unconstrained").filter(F.array_contains("flags", "interpolated")).select("track_id", "time_ms", "lat", "lon", "ele", "hdop"), f"""
  SELECT track_id, t AS time_ms, plat + (lat - plat) * f AS lat, plon + (lon - plon) * f AS lon, pele + (ele - pele) * f AS ele, phdop + (hdop - phdop) * f AS hdop FROM (SELECT *, (t - pt) / (time_ms - pt) AS f FROM (SELECT *, pt + k * 5000 AS t FROM (SELECT *, unnest(range(1, ceil((time_ms - pt) / 5000)::BIGINT)) AS k FROM (
    SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ele) OVER w AS pele, lag(hdop) OVER w AS phdop, lag(time_ms) OVER w AS pt FROM ({_RISING}) {W_SQL}) WHERE time_ms - pt > 20000)))""", "time_ms lat lon ele hdop", 5)
def _limited(slope: str, ahead: str, secant: str) -> str:
    """Both slopes of a leg as a list."""
    a, b = f"greatest(0, {slope} / {secant})", f"greatest(0, {ahead} / {secant})"
    scale = f"least(1, coalesce(3 / nullif(sqrt({a} ** 2 + {b} ** 2), 0), 1)) * {secant}"
    return f"CASE WHEN {secant} = 0 THEN [0.0::DOUBLE, 0.0::DOUBLE] ELSE [{a} * {scale}, {b} * {scale}] END"


def _fit(column: str) -> list[str]:
    """Levels of SQL that fit a column: knots y0 to y3 at x0 to x3, of which the first or the last can be missing, at time t."""
    y = lambda i: f"{column}{i}"
    secant = lambda i: f"({y(i + 1)} - {y(i)}) / (x{i + 1} - x{i})"
    mean = lambda p, q: f"CASE WHEN {p} * {q} > 0 THEN ({p} + {q}) / 2 ELSE 0 END"
    c = column
    u = f"((t - x1) / (x2 - x1))"
    return [
        f"SELECT *, {secant(0)} AS {c}s0, {secant(1)} AS {c}s1, {secant(2)} AS {c}s2 FROM ({{}})",
        f"SELECT *, coalesce({mean(f'{c}s0', f'{c}s1')}, 0) AS {c}m1, coalesce({mean(f'{c}s1', f'{c}s2')}, 0) AS {c}m2 FROM ({{}})",
        f"SELECT * REPLACE (CASE WHEN x0 IS NULL THEN {c}s1 ELSE {c}m1 END AS {c}m1, CASE WHEN x3 IS NULL THEN {c}s1 ELSE {c}m2 END AS {c}m2) FROM ({{}})",
        f"SELECT *, CASE WHEN x0 IS NULL THEN {c}m1 ELSE ({_limited(f'{c}s0', f'{c}m1', f'{c}s0')})[2] END AS {c}l FROM ({{}})",
        f"SELECT *, CASE WHEN x0 IS NULL AND x3 IS NULL THEN [{c}s1, {c}s1] ELSE {_limited(f'{c}l', f'{c}m2', f'{c}s1')} END AS {c}n FROM ({{}})",
        f"SELECT * REPLACE (CASE WHEN x3 IS NULL THEN {c}n ELSE [{c}n[1], ({_limited(f'{c}n[2]', f'{c}s2', f'{c}s2')})[1]] END AS {c}n) FROM ({{}})",
        f"SELECT *, {y(1)} + {u} * {u} * (3 - 2 * {u}) * ({y(2)} - {y(1)}) + (x2 - x1) * {u} * (1 - {u}) * ((1 - {u}) * {c}n[1] - {u} * {c}n[2]) AS {c}_at FROM ({{}})",
    ]


_KNOTS = f"""SELECT *, unnest(range(1, ceil((x2 - x1) / 5000)::BIGINT)) AS k FROM (
  SELECT track_id, seq, lag(seq) OVER w AS start_seq, {', '.join(f'lag({c}, {n}) OVER w AS {d}{1 - n + 1}' for c, d in (('time_ms', 'x'), ('lat', 'lat'), ('lon', 'lon'), ('ele', 'ele'), ('rate', 'rate')) for n in (2, 1))}, {', '.join(f'{c} AS {d}2, lead({c}) OVER w AS {d}3' for c, d in (('time_ms', 'x'), ('lat', 'lat'), ('lon', 'lon'), ('ele', 'ele'), ('rate', 'rate')))}
  FROM (SELECT *, hdop * 2 AS rate FROM ({_RISING})) {W_SQL}) WHERE x2 - x1 > 15000"""
_FITS = f"SELECT *, x1 + k * 5000 AS t FROM ({_KNOTS})"
for _column in ("lat", "lon", "ele", "rate"):
    for _level in _fit(_column):
        _FITS = _level.format(_FITS)
_with_rate = lambda df: demote(_rising(df).withColumn("rate", F.col("hdop") * 2).drop("hdop", "sat"), "rate")
_add("gap_fills", lambda df: O.gap_fills(_with_rate(df), 15000.0, 5000.0, context=2, profile=O.Profile(*[float("inf")] * 4)).select("track_id", "start_seq", "end_seq", F.explode("points").alias("p")).select("track_id", "start_seq", "end_seq", "p.time_ms", "p.lat", "p.lon", "p.ele", F.col("p.ext_num")["rate"].alias("rate")), f"SELECT track_id, start_seq, seq AS end_seq, t AS time_ms, lat_at AS lat, lon_at AS lon, CASE WHEN (ele0 IS NOT NULL OR x0 IS NULL) AND ele1 IS NOT NULL AND ele2 IS NOT NULL AND (ele3 IS NOT NULL OR x3 IS NULL) THEN ele_at END AS ele, rate_at AS rate FROM ({_FITS})", "time_ms lat lon ele rate", 5)
_add("gap_fill_reasons", lambda df: O.gap_fills(_rising(df), 15000.0, 5000.0, profile="aircraft").select("track_id", "start_seq", "end_seq", "reason", F.size("points").alias("n")))
_add("drop_outliers_reconstruct", lambda df: _base(O.drop_outliers(_rising(df), "unconstrained")))
_add("notional_gaps", lambda df: R.notional_gaps(df, 20000.0).select("track_id", "start_seq", "end_seq", "duration_ms", "inserted", "sample_ms"), f"SELECT track_id, seq - 1 AS start_seq, seq AS end_seq, time_ms - pt AS duration_ms, (floor((time_ms - pt) / med) - 1)::BIGINT AS inserted, med AS sample_ms FROM (SELECT *, coalesce(quantile_cont(CASE WHEN time_ms - pt > 0 AND time_ms - pt <= 20000 THEN time_ms - pt END, 0.5) OVER (PARTITION BY track_id), 20000) AS med FROM ({_PREV})) WHERE time_ms - pt > 20000 AND floor((time_ms - pt) / med) > 1", "duration_ms sample_ms", 3)
_add("dejitter_epsilon", lambda df: W.dejitter(df.withColumn("time_ms", F.floor(F.col("time_ms") / 4000) * 4000.0), epsilon_ms=5.0).select("track_id", "seq", "time_ms", "flags"), """WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS i, floor(time_ms / 4000) * 4000 AS t FROM points WHERE time_ms IS NOT NULL),
  g AS (SELECT track_id, seq, i, t, t AS out FROM p WHERE i = 1 UNION ALL SELECT p.track_id, p.seq, p.i, p.t, CASE WHEN p.t > g.out THEN p.t ELSE g.out + 5 END FROM g JOIN p ON p.track_id = g.track_id AND p.i = g.i + 1)
  SELECT track_id, seq, out AS time_ms, CASE WHEN out <> t THEN 'time_dejittered' ELSE '' END AS flags FROM g UNION ALL SELECT track_id, seq, NULL, '' FROM points WHERE time_ms IS NULL""", "time_ms", 3, recursive=True)

# Comparison.
_add("along_cross_track", lambda df: X.along_cross_track(_pair(df)[0], _rel(df)), f"""
  WITH {_SIDES}, o AS (SELECT *, lead({{'a': lat, 'o': lon, 'h': coalesce(ele, 0)}}) OVER (PARTITION BY pair ORDER BY seq) AS nx, lag({{'a': lat, 'o': lon, 'h': coalesce(ele, 0)}}) OVER (PARTITION BY pair ORDER BY seq) AS pv FROM (SELECT p.*, p.track_id || '-' || nxt AS pair FROM points p JOIN ids USING (track_id) WHERE {sql_valid()})),
  e AS (SELECT *, CASE WHEN nx IS NULL THEN -1 ELSE 1 END AS sg, coalesce(nx, pv) AS q FROM o),
  d AS (SELECT pair, seq, lat, lon, sg, {_ecef("q.a", "q.o", "q.h")[0]} - {_ecef("lat", "lon", "coalesce(ele, 0)")[0]} AS dx, {_ecef("q.a", "q.o", "q.h")[1]} - {_ecef("lat", "lon", "coalesce(ele, 0)")[1]} AS dy, {_ecef("q.a", "q.o", "q.h")[2]} - {_ecef("lat", "lon", "coalesce(ele, 0)")[2]} AS dz FROM e WHERE q IS NOT NULL),
  u AS (SELECT pair, seq, sg * (-sin(radians(lon)) * dx + cos(radians(lon)) * dy) AS te, sg * (-sin(radians(lat)) * cos(radians(lon)) * dx - sin(radians(lat)) * sin(radians(lon)) * dy + cos(radians(lat)) * dz) AS tn FROM d)
  SELECT x.pair, ref_seq, tgt_seq, (te * east_m + tn * north_m) / sqrt(te * te + tn * tn) AS along_m, (te * north_m - tn * east_m) / sqrt(te * te + tn * tn) AS cross_m FROM ({_REL}) x JOIN u ON u.pair = x.pair AND u.seq = x.ref_seq WHERE sqrt(te * te + tn * tn) >= 1e-9""", "along_m cross_m", 3)
_add("pairwise_series", lambda df: X.pairwise_series(*_pair(df), n=20).select(F.col("track_id").alias("pair"), "at_ms", "horizontal_m", "slant_m", "altitude_separation_m", "closure_mps"))
_add("compare_interpolated", lambda df: X.compare(*_pair(df), mode="interpolated", max_bracket_ms=15000).select("pair", "ref_seq", "tgt_seq", "derived"), f"WITH {_SIDES} SELECT pair, ref_seq, a.seq AS tgt_seq, true AS derived FROM ({_BRACKET})")
_add("comparison_rows", lambda df: sinks.comparison_rows(X.compare(*_pair(df), tolerance_ms=3000))[0].select("pair", "reference_index", "derived", "slant_range_m"), f"WITH {_SIDES} SELECT pair, ref_seq AS reference_index, 'observed' AS derived, slant_m AS slant_range_m FROM ({_REL})", "slant_range_m", 3)


def _datasets(df: DataFrame) -> DataFrame:
    """Datasets of the demo tracks with references that differ."""
    n = F.substring("track_id", 2, 9).cast("int")
    return df.select("track_id").distinct().select("track_id", F.when(n == 4, None).otherwise("EPSG:4326").alias("crs"), F.when(n % 3 == 0, "HAE").when(n == 8, "MSL").when(n == 5, "UNKNOWN").otherwise("HAE").alias("altitude_ref"), F.lit("UTC").alias("time_ref"))


def _by_three(df: DataFrame) -> DataFrame:
    n = F.substring("track_id", 2, 9).cast("int")
    return df.select("track_id").distinct().select("track_id", F.concat(F.lit("E"), F.floor(n / 3).cast("string")).alias("entity"))


_REFS = "SELECT *, substr(track_id, 2)::INT AS n FROM (SELECT DISTINCT track_id FROM points)"
_add("compatibility", lambda df: X.compatibility(_datasets(df).select(F.lit("T0").alias("left"), F.col("track_id").alias("right")).filter("right <> 'T0'"), _datasets(df)).select("left", "right", "level"), f"SELECT 'T0' AS \"left\", track_id AS \"right\", CASE n WHEN 8 THEN 'blocked' WHEN 5 THEN 'warning' ELSE 'compatible' END AS level FROM ({_REFS}) WHERE n <> 0")
_add("fusion_compatibility", lambda df: X.fusion_compatibility(_by_three(df), _datasets(df), df).select("entity", "level"), f"SELECT 'E' || n // 3 AS entity, CASE WHEN bool_or(n IN (4, 8)) THEN 'blocked' WHEN bool_or(n = 5) THEN 'warning' ELSE 'compatible' END AS level FROM ({_REFS}) GROUP BY n // 3")

# Views and reports.
_add("plan_projection", lambda df: S.plan_projection(df), f"SELECT track_id, seq, s * 111320 * greatest(cos(radians(la)), 1e-6) AS east_m, (lat - la) * 111320 AS north_m FROM (SELECT *, sum(st) OVER w AS s, first_value(lat) OVER w AS la FROM (SELECT *, coalesce(fmod(lon - lag(lon) OVER w + 540, 360) - 180, 0) AS st FROM points {W_SQL}) {W_SQL})", "east_m north_m", 3)
_add("plan_frame", lambda df: S.plan_frame(S.plan_projection(P.drop_invalid(df))).select("track_id", "scale_bar_m"), f"SELECT track_id, CASE WHEN t < p THEN p WHEN t < 2 * p THEN 2 * p WHEN t < 5 * p THEN 5 * p ELSE 10 * p END AS scale_bar_m FROM (SELECT *, pow(10, floor(log10(t))) AS p FROM (SELECT track_id, greatest(max(e) - min(e), max(n) - min(n), 1) / 4 AS t FROM (SELECT track_id, (lon - first_value(lon) OVER w) * 111320 * cos(radians(first_value(lat) OVER w)) AS e, lat * 111320 AS n FROM points WHERE {sql_valid()} {W_SQL}) GROUP BY track_id))", "scale_bar_m", 3)
_add("playback_lookup", lambda df: S.playback_lookup(_rising(df), df.select("track_id").distinct().select("track_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k")).select("track_id", (F.col("k") / 20).alias("fraction"))).select("track_id", "fraction", "seq"), f"""
  SELECT q.track_id, fraction, (SELECT arg_min(seq, (abs(time_ms - target), time_ms)) FROM ({_RISING}) r WHERE r.track_id = q.track_id) AS seq FROM (SELECT track_id, k / 20.0::DOUBLE AS fraction, a + (b - a) * (k / 20.0::DOUBLE) AS target FROM (SELECT track_id, min(time_ms) AS a, max(time_ms) AS b, unnest(range(0, 21)) AS k FROM points WHERE time_ms IS NOT NULL GROUP BY track_id)) q""", "fraction", 4)
_shaped = lambda df: df.withColumn("source_feature", F.floor(F.col("seq") / 40).cast("int"))
_add("shape_groups", lambda df: S.shape_groups(_shaped(df).withColumns({c: F.when(F.col("seq") % 40 == 39, F.lag(c, 39).over(K.by_seq())).otherwise(F.col(c)) for c in ("lat", "lon")})).select("track_id", "shape", "start_seq", "end_seq", "points", "closed"), "SELECT track_id, seq // 40 + 1 AS shape, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS points, count(*) = 40 AS closed FROM points GROUP BY track_id, seq // 40")
_add("analysis_report", lambda df: analysis_report(df, sections=("metrics", "events")).filter("metric in ('points', 'valid', 'with_time', 'gap', 'invalid-coordinate')"), f"SELECT 'metrics' AS section, track_id, unnest(['points', 'valid', 'with_time']) AS metric, unnest([points, valid, with_time])::VARCHAR AS value FROM ({_STATS}) UNION ALL SELECT 'events', track_id, kind, count(*)::VARCHAR FROM ({_EVENTS}) WHERE kind IN ('gap', 'invalid-coordinate') GROUP BY track_id, kind")
_add("derivation", lambda df: run_derivation(df, "standard-kinematics").select("track_id", "seq", "ground_speed_mps"), f"SELECT track_id, seq, ground_speed_mps FROM ({_KIN3})", "ground_speed_mps", 3)
_add("index_to_time_range", lambda df: P.index_to_time_range(df, 400, 100), "SELECT track_id, min(time_ms) AS start_ms, max(time_ms) AS end_ms FROM points WHERE seq BETWEEN 100 AND 400 GROUP BY track_id HAVING count(time_ms) > 0", "start_ms end_ms", 3)
_add("events_overlapping_time", lambda df: W.events_overlapping_time(W.quality_events(df), 1704068000000, 1704068100000).select("track_id", "kind", "start_seq"), f"SELECT track_id, kind, start_seq FROM ({_EVENTS}) WHERE start_time <= 1704068100000 AND end_time >= 1704068000000")
_add("changed_count", lambda df: P.changed_count(df, P.round_precision(df, 2, 0)), "SELECT track_id, count(*) FILTER (WHERE round(lat, 2) <> lat OR round(lon, 2) <> lon OR (ele IS NOT NULL AND round(ele, 0) <> ele)) AS changed FROM points GROUP BY track_id")
_add("archive", lambda df: _archived(df), "SELECT 'datasets' AS \"table\", count(DISTINCT track_id) AS n FROM points UNION ALL SELECT 'points', count(*) FROM points")


def _manifest(df: DataFrame) -> DataFrame:
    """A workspace saved twice: the manifest tells the second version's rows, and digests that its tables have."""
    folder = work_folder(df.sparkSession)
    workspace.save_workspace({"points": df, "datasets": _datasets(df)}, folder)
    workspace.save_workspace({"points": df.filter("seq % 2 = 0"), "datasets": _datasets(df)}, folder)
    tables = workspace.load_workspace(df.sparkSession, folder, ["points", "datasets"])
    found = tables["points"].groupBy("track_id").agg(F.count("*").alias("kept"))
    manifest = workspace.workspace_manifest(df.sparkSession, folder).filter("table = 'points'").first()
    return found.withColumn("rows", F.lit(manifest["rows"]))


_add("workspace_manifest", _manifest, "SELECT track_id, count(*) AS kept, sum(count(*)) OVER ()::BIGINT AS rows FROM points WHERE seq % 2 = 0 GROUP BY track_id")


def _archived(df: DataFrame) -> DataFrame:
    folder = work_folder(df.sparkSession)
    sinks.save_workspace({"points": df, "datasets": _datasets(df)}, folder)
    return sinks.archive_summary(sinks.load_workspace(df.sparkSession, folder, ["points", "datasets"]))
