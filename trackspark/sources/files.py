"""Track files of text: readers that scan a folder, each (points, audit).

points are of the common schema, a track for each file, seq in file order. audit is (track_id, reason, n).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import geodetic, is_valid
from ..plans.folders import held
from ..schema import conform, number_map, text_maps
from .text import FOOT_M, KNOT_MPS, NMEA_TIME, checksum, nmea_clock, nmea_day, nmea_degrees, parse_coordinate, parse_iso, parse_number, parse_time, plain_number, unescape_xml

DAY_MS = 86_400_000


def _named(df: DataFrame) -> DataFrame:
    """Adds track_id (what a folder track_id=... tells, else the file name), and _at and _id, by which a file's rows are in order."""
    meta = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")).withColumn("_id", F.monotonically_increasing_id())
    folder, name = F.regexp_extract("_file", r"/track_id=([^/]+)/", 1), F.regexp_extract("_file", r"([^/]+?)(\.[^./]*)?$", 1)
    return meta.withColumn("track_id", F.url_decode(F.replace(F.when(folder != "", folder).otherwise(name), F.lit("+"), F.lit("%2B"))))


def _in_order(named: DataFrame) -> DataFrame:
    """Rows of _named with seq (place in the file); a file's parts are ordered by where they begin.

    What is read from a row's text comes before: it is then done where the row is scanned, not in the one task that has
    all rows of a file.
    """
    w = Window.partitionBy("_file").orderBy("_at", "_id")
    return named.withColumn("seq", (F.row_number().over(w) - 1).cast("bigint")).drop("_at", "_id", "_file")


def _again(df: DataFrame, *order: str) -> DataFrame:
    """seq counted anew without gaps, and source_record where the row came from."""
    w = Window.partitionBy("track_id").orderBy(*(order or ("seq",)))
    return df.withColumn("source_record", F.col("seq")).withColumn("seq", (F.row_number().over(w) - 1).cast("bigint"))


def _audit(df: DataFrame, reason) -> DataFrame:
    return df.select("track_id", reason.alias("reason")).filter("reason is not null").groupBy("track_id", "reason").agg(F.count("*").alias("n"))


def read_csv_track(spark: SparkSession, path: str, mapping: dict[str, str], sep: str = ",", ele_unit: str = "m", time_format: str = "auto", anchor_ms: float | None = None, columns: list[str] | None = None, start_row: int = 2, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(points, audit) of delimited files.

    mapping: field (lat, lon, ele, time, name, desc) to column. Rows without a readable coordinate are rejected and
    counted; unreadable times are null and counted. Other columns become channels, of numbers or of text, blanks left
    out. The first row names the columns, or columns does, and rows count from start_row (1: the first). multi_line
    allows newlines inside quotes, and then a file isn't split.
    """
    given = columns is not None
    raw = spark.read.option("header", not given).option("sep", sep).option("multiLine", multi_line)
    raw = raw.schema(", ".join(f"`{c}` string" for c in columns)).csv(path) if given else raw.csv(path)
    names = columns if given else raw.columns
    col = lambda f: F.col(f"`{mapping[f]}`") if f in mapping else F.lit(None).cast("string")
    rest = [c for c in names if c not in mapping.values()]
    num, text = text_maps(F.array(*map(F.lit, rest)).cast("array<string>"), F.array(*(F.col(f"`{c}`") for c in rest)).cast("array<string>"), parse_number)
    scale = FOOT_M if ele_unit == "ft" else 1.0
    rows = _named(raw).select(
        "track_id", "_file", "_at", "_id", parse_coordinate(col("lat")).alias("lat"), parse_coordinate(col("lon")).alias("lon"), (parse_number(col("ele")) * scale).alias("ele"),
        parse_time(col("time"), time_format, anchor_ms).alias("time_ms"), (F.trim(col("time")) != "").alias("_timed"), col("name").alias("name"), col("desc").alias("desc"), num.alias("ext_num"), text.alias("ext_str"),
    )
    rows = _in_order(rows).filter(F.col("seq") >= start_row - (1 if given else 2))
    bad = F.col("lat").isNull() | F.col("lon").isNull()
    audit = _audit(rows, F.when(bad, "bad-coordinate").when(F.col("time_ms").isNull() & F.col("_timed"), "bad-time"))
    return conform(_again(rows.filter(~bad).drop("_timed"))), audit


def read_nmea(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, audit) of GGA, RMC and GLL sentences.

    What other sentences tell holds from then on: the date of RMC and ZDA for all times, speed and course of VTG for
    GGA and GLL, precision of GSA (its horizontal one only where GGA has none) and satellites in view of GSV. Sentences
    with a wrong checksum are counted and change nothing.
    """
    lines = _named(spark.read.text(path)).withColumn("line", F.trim("value"))
    body, given = F.regexp_extract("line", r"^\$([^*]*)", 1), F.upper(F.regexp_extract("line", r"\*\s*([0-9A-Fa-f]{2})", 1))
    sentence = F.startswith(F.col("line"), F.lit("$"))
    lines = lines.withColumns({"good": F.when(sentence, (given == "") | (given == checksum(body))), "f": F.when(sentence, F.split(body, ","))}).drop("value", "line")
    audit = _audit(lines, F.when(~F.col("good"), "bad-checksum"))
    f = lambda i: F.get("f", F.lit(i))
    kind = F.substring(f(0), 3, 9)
    lines = lines.withColumn("kind", F.when(F.col("good") & kind.isin("GGA", "RMC", "GLL", "VTG", "ZDA", "GSA", "GSV"), kind))
    is_ = lambda k: F.col("kind") == k
    gga, rmc = is_("GGA"), is_("RMC")
    # Numbers of all fields, and of parts of time and date, are read by two expressions: the code of one for each is too long to be compiled.
    at = lambda g, r, l: F.when(gga, f(g)).when(rmc, f(r)).when(is_("GLL"), f(l))
    clock, date = at(1, 1, 5), F.when(rmc, f(9))
    parts = [*(F.substring(clock, a, n) for a, n in NMEA_TIME), *(F.substring(date, a, 2) for a in (1, 3, 5))]
    lines = lines.select(
        "track_id", "_file", "_at", "_id", "kind", at(3, 4, 2).alias("north"), at(5, 6, 4).alias("east"), (F.length(clock) >= 6).alias("timed"),
        F.transform(F.when(F.col("kind").isNotNull(), F.col("f")), plain_number).alias("n"), F.transform(F.when(gga | rmc | is_("GLL"), F.array(*parts)), plain_number).alias("t"),
    )
    n = lambda i: F.get("n", F.lit(i))
    t = lambda i: F.get("t", F.lit(i))
    number = lambda g, r, l: F.when(gga, n(g)).when(rmc, n(r)).when(is_("GLL"), n(l))
    above = lambda i: F.when(n(i) > 0, n(i))
    found = {
        "day": F.when(rmc, nmea_day(t(5) + 2000, t(4), t(3))).when(is_("ZDA"), nmea_day(n(4), n(3), n(2))),
        "vtg": F.when(is_("VTG") & n(1).isNotNull() & n(5).isNotNull(), F.struct(n(1).alias("heading"), (n(5) * KNOT_MPS).alias("speed"))),
        "gsa": F.when(is_("GSA") & F.coalesce(above(15), above(16), above(17)).isNotNull(), F.struct(above(15).alias("pdop"), above(16).alias("hdop"), above(17).alias("vdop"))),
        "view": F.when(is_("GSV") & (n(3) >= 0) & (n(3) == F.floor(n(3))), n(3)),
    }
    of = lambda g: F.when(gga, n(g))
    own = {
        "lat": nmea_degrees(number(2, 3, 1), F.col("north")), "lon": nmea_degrees(number(4, 5, 3), F.col("east")), "clock": F.when(F.col("timed"), nmea_clock(t(0), t(1), t(2))), "ele": of(9), "sat": of(7), "hdop": of(8), "fix_quality": of(6),
        "speed": F.when(rmc, n(7) * KNOT_MPS), "heading": F.when(rmc, n(8)),
    }
    rows = _in_order(lines.select("track_id", "_file", "_at", "_id", "kind", *(x.alias(k) for k, x in (found | own).items()))).filter("kind is not null")
    upto = Window.partitionBy("track_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.last(k, ignorenulls=True).over(upto) for k in found}).filter("kind in ('GGA', 'RMC', 'GLL')")
    other = lambda x: F.when(~rmc, x)
    channels = {
        "speed_mps": F.when(rmc, F.col("speed")).otherwise(F.col("vtg.speed")), "heading_deg": F.when(rmc, F.col("heading")).otherwise(F.col("vtg.heading")),
        "sat": F.col("sat"), "hdop": F.when(gga, F.coalesce("hdop", "gsa.hdop")), "fix_quality": F.col("fix_quality"),
        "pdop": other(F.col("gsa.pdop")), "vdop": other(F.col("gsa.vdop")), "sat_in_view": other(F.col("view")),
    }
    rows = rows.filter("lat is not null and lon is not null").withColumns({"time_ms": F.col("day").cast("double") * DAY_MS + F.col("clock"), "ext_num": number_map(channels)})
    return conform(_again(rows.select("track_id", "seq", "lat", "lon", "ele", "time_ms", "ext_num"))), audit


#: Elements of a point that are channels.
GPX_CHANNELS = ("sat", "hdop", "vdop", "pdop", "fix", "geoidheight", "magvar")


def read_gpx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, audit) of GPX files: track points, route points of files without a usable track point, then waypoints.

    desc falls back to cmt. Fixed elements and all leaves of extensions are channels. Points without a readable
    coordinate are left out and counted.
    """
    schema = ", ".join(f"{c} string" for c in ("_lat", "_lon", "ele", "time", "name", "desc", "cmt", *GPX_CHANNELS, "extensions"))
    rows = None
    for rank, tag in enumerate(("trkpt", "rtept", "wpt")):
        part = _named(spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)).withColumn("_rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumns({"lat": parse_number(F.col("_lat")), "lon": parse_number(F.col("_lon"))}).withColumn("_ok", F.col("lat").isNotNull() & F.col("lon").isNotNull())
    w = Window.partitionBy("_file")
    rows = rows.withColumn("_track", F.max(((F.col("_rank") == 0) & F.col("_ok")).cast("int")).over(w)).filter("_rank <> 1 or _track = 0")
    rows = rows.withColumn("seq", (F.row_number().over(w.orderBy("_rank", "_at", "_id")) - 1).cast("bigint"))
    leaf = r"<(?:[\w.-]+:)?([\w.-]+)(?:\s[^<>]*)?>([^<>]+)</"
    own = F.array(*(F.col(c) for c in GPX_CHANNELS))
    leaves = lambda i: F.coalesce(F.regexp_extract_all("extensions", F.lit(leaf), F.lit(i)), F.array().cast("array<string>"))
    num, text = text_maps(F.concat(F.array(*map(F.lit, GPX_CHANNELS)), leaves(1)), F.concat(own, F.transform(leaves(2), unescape_xml)), parse_number)
    audit = _audit(rows, F.when(~F.col("_ok"), "bad-coordinate"))
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    out = rows.filter("_ok").select("track_id", "seq", "lat", "lon", parse_number(F.col("ele")).alias("ele"), parse_iso(F.col("time")).alias("time_ms"), filled("name").alias("name"), F.coalesce(filled("desc"), filled("cmt")).alias("desc"), num.alias("ext_num"), text.alias("ext_str"))
    return conform(_again(out)), audit


#: Where a GeoJSON text is cut: a string that stands alone, so no cut is inside a string.
_CUT = '"Feature"'
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)
_FEATURE_DEPTH = 2  # within the collection's object and its list


def _depths(text: str, depth: int):
    """(place, depth before, depth after) of each bracket outside strings."""
    for mark in _MARKS.finditer(text):
        if mark[0] in "{[":
            yield mark.start(), depth, depth + 1, mark[0]
            depth += 1
        elif mark[0] in "}]":
            yield mark.start(), depth, depth - 1, mark[0]
            depth -= 1


def _geojson_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(track_id, feature, x) of the objects in the lists of collections, in order and as text; and (track_id, value) of files that are none, or are broken.

    A part of a text tells how much deeper it ends than it begins, and how many objects begin at each depth. Sums over the
    parts before tell where a part begins, and so which pieces of it belong to which object; pieces are then put together.
    """
    parts = _named(spark.read.text(path, lineSep=_CUT)).select("track_id", "_file", "_at", "_id", "value")

    def measure(batches):
        for batch in batches:
            deeper, begun = [], []
            for text in batch.column("value").to_pylist():
                counts: dict[int, int] = {}
                depth = 0
                for _, before, depth, mark in _depths(text, 0):
                    if mark == "{":
                        counts[before] = counts.get(before, 0) + 1
                deeper.append(depth)
                begun.append(list(counts.items()))
            new = [pa.array(deeper, pa.int64()), pa.array(begun, pa.map_(pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "deeper", "begun"])

    schema = "track_id string, _file string, _at bigint, _id bigint, value string"
    rows = parts.mapInArrow(measure, f"{schema}, deeper bigint, begun map<bigint,bigint>")
    order = Window.partitionBy("_file").orderBy("_at", "_id")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_file")
    # Windows over a file's parts see numbers only; the texts stay where they are until those are joined to them.
    told = rows.select("_file", "_at", "_id", "deeper", "begun", F.col("value").rlike(r'"type"\s*:\s*"FeatureCollection"').alias("told"))
    told = told.withColumns({"depth": F.coalesce(F.sum("deeper").over(before), F.lit(0)), "last": F.lead("_id").over(order).isNull(), "sound": (F.sum("deeper").over(whole) == 0) & F.bool_or("told").over(whole)})
    told = told.withColumn("here", F.coalesce(F.col("begun")[F.lit(_FEATURE_DEPTH) - F.col("depth")], F.lit(0)))
    told = told.select("_file", "_at", "_id", "depth", "last", "sound", (F.coalesce(F.sum("here").over(before), F.lit(0)) - 1).alias("feature"))
    rows = parts.join(told, ["_file", "_at", "_id"]).select("track_id", "_file", "_at", "_id", "value", "depth", "last", "sound", "feature")

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {"row": [], "feature": [], "text": []}
            for row, r in enumerate(batch.select(["value", "depth", "feature", "last"]).to_pylist()):
                text, feature = r["value"] + ("" if r["last"] else _CUT), r["feature"]
                start = 0 if r["depth"] > _FEATURE_DEPTH else None
                for place, was, now, mark in _depths(r["value"], r["depth"]):
                    if mark == "{" and was == _FEATURE_DEPTH:
                        start, feature = place, feature + 1
                    elif now == _FEATURE_DEPTH and was == _FEATURE_DEPTH + 1 and start is not None:
                        for name, x in (("row", row), ("feature", feature), ("text", text[start : place + 1])):
                            out[name].append(x)
                        start = None
                if start is not None:
                    for name, x in (("row", row), ("feature", feature), ("text", text[start:])):
                        out[name].append(x)
            own = batch.select(["track_id", "_file", "_at", "_id"]).take(pa.array(out["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out["feature"], pa.int64()), pa.array(out["text"], pa.string())], ["track_id", "_file", "_at", "_id", "feature", "text"])

    pieces = rows.filter("sound").mapInArrow(cut, "track_id string, _file string, _at bigint, _id bigint, feature bigint, text string")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_id", c.alias("v")))), lambda x: x["v"]), "")
    features = pieces.groupBy("track_id", "_file", "feature").agg(joined(F.col("text")).alias("x")).drop("_file")
    others = rows.filter("not sound").groupBy("track_id", "_file").agg(joined(F.concat("value", F.when(F.col("last"), "").otherwise(_CUT))).alias("value")).drop("_file")
    return features, others


def read_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, audit) of files that are a FeatureCollection, a Feature or a bare geometry.

    A collection of any size is dealt to many tasks, feature by feature; other files are read whole. Points, lines, their
    collections and polygons are flattened to positions; of properties, time (also timestamp, t, datetime), name and desc
    are fields, other numbers and texts channels. Other geometries are counted, as are files whose brackets don't match.
    """
    features, text = _geojson_features(spark, path)
    root = text.withColumn("r", F.from_json("value", "type string, features array<string>, geometry string, properties string, coordinates string"))
    bad = F.col("r").isNull() | F.coalesce(F.col("r.type"), F.lit("")).isin("", "FeatureCollection")
    one = F.when(F.col("r.type") == "Feature", F.array("value")).when(F.col("r.coordinates").isNotNull(), F.array(F.to_json(F.struct(F.struct("r.type", "r.coordinates").alias("g")))))
    features = features.unionByName(root.select("track_id", F.posexplode(one).alias("feature", "x")))
    rows = features.withColumn("x", F.from_json("x", "geometry string, properties map<string,variant>, g struct<type:string,coordinates:string>"))
    geometry = F.coalesce(F.from_json("x.geometry", "type string, coordinates string"), F.col("x.g"))
    rows = rows.withColumn("g", geometry).filter("g.type is not null")
    c = F.col("g.coordinates")
    flat = F.when(F.col("g.type") == "Point", F.array(F.from_json(c, "array<double>"))).when(F.col("g.type").isin("MultiPoint", "LineString"), F.from_json(c, "array<array<double>>")).when(F.col("g.type").isin("MultiLineString", "Polygon"), F.flatten(F.filter(F.from_json(c, "array<array<array<double>>>"), lambda x: x.isNotNull())))
    known = F.col("g.type").isin("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon")
    audit = _audit(root, F.when(bad, "not-geojson")).unionByName(_audit(rows, F.when(~known, F.concat(F.lit("unsupported-geometry "), "g.type")).when(flat.isNull(), "bad-coordinates")))
    prop = F.coalesce("x.properties", F.from_json(F.lit("{}"), "map<string,variant>"))
    kind = lambda v: F.schema_of_variant(v)
    scalar = lambda v: ~kind(v).rlike("^(OBJECT|ARRAY|VOID|BOOLEAN)")
    string = lambda k: F.when(kind(prop[k]) == "STRING", prop[k].cast("string"))
    value = lambda k: F.when(scalar(prop[k]), prop[k].cast("string"))
    fields = ["time", "timestamp", "t", "datetime", "name", "desc"]
    rest = F.map_filter(prop, lambda k, v: ~k.isin(*fields) & scalar(v))
    number = F.map_filter(rest, lambda _, v: kind(v) != "STRING")
    words = F.map_filter(rest, lambda _, v: kind(v) == "STRING")
    # Properties are read once for a feature; a position takes along what they tell, not the text of the whole feature.
    told = {
        "time_ms": parse_time(F.coalesce(*map(value, fields[:4]))), "name": string("name"), "desc": string("desc"),
        "ext_num": F.transform_values(number, lambda _, v: v.cast("double")), "ext_str": F.transform_values(words, lambda _, v: v.cast("string")),
    }
    rows = rows.select("track_id", "feature", *(x.alias(c) for c, x in told.items()), flat.alias("flat"))
    rows = rows.select("track_id", "feature", *told, F.posexplode("flat").alias("place", "p")).filter("size(p) >= 2 and p[0] is not null and p[1] is not null")
    rows = rows.withColumn("seq", (F.row_number().over(Window.partitionBy("track_id").orderBy("feature", "place")) - 1).cast("bigint"))
    out = rows.select("track_id", "seq", F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"), F.get("p", F.lit(2)).alias("ele"), *told)
    return conform(_again(out)), audit


#: Lines that hold nothing but points of KML: whole times, whole positions of tracks, tuples of a coordinate list.
_KML_LINES = {"w": r"^\s*(?:<(?:\w+:)?when>[^<>]*</(?:\w+:)?when>\s*)+$", "c": r"^\s*(?:<(?:\w+:)?coord>[^<>]*</(?:\w+:)?coord>\s*)+$", "t": r"^[-+.,\deE\s]*\d[-+.,\deE\s]*$"}
#: What stands in the text for a run of such lines: no character of XML.
_RUN, _END = "\x02", "\x03"


def _kml_lines(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, _file, _at, _id, value, kind, run, first): lines; those of nothing but points with their kind and the run that they are in.

    Windows over a file's lines tell the runs; no row is longer than a line.
    """
    lines = _named(spark.read.text(path, lineSep="\n"))
    like = lambda k: F.when(F.col("value").rlike(_KML_LINES[k]), k)
    tag = F.col("value").rlike("[<>]")
    lines = lines.withColumn("kind", F.when(~tag, like("t")).when(F.contains("value", F.lit("when>")), like("w")).when(F.contains("value", F.lit("coord>")), like("c")))
    # Numbers alone are tuples only where the last tag before opens a coordinate list.
    opens = F.when(F.contains("value", F.lit("coordinates")), F.col("value").rlike(r"<(?:\w+:)?coordinates[^<>]*>[^<>]*$")).otherwise(False)
    lines = lines.select("track_id", "_file", "_at", "_id", "value", "kind", F.when(tag, opens).alias("open"))
    order = Window.partitionBy("_file").orderBy("_at", "_id")
    lines = lines.withColumn("open", F.last("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    lines = lines.withColumn("kind", F.when((F.col("kind") != "t") | F.col("open"), F.col("kind"))).drop("open")
    lines = lines.withColumn("first", F.col("kind").isNotNull() & ~F.col("kind").eqNullSafe(F.lag("kind").over(order)))
    run = F.sum(F.col("first").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return held(lines.withColumn("run", run))


def _kml_items() -> Column:
    """The times, positions or tuples of a line of points."""
    every = lambda tag: F.regexp_extract_all("value", F.lit(f"<(?:\\w+:)?{tag}>(.*?)</"), F.lit(1))
    return F.when(F.col("kind") == "w", every("when")).when(F.col("kind") == "c", every("coord")).otherwise(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "))


def _kml_parts(lines: DataFrame) -> DataFrame:
    """(track_id, _file, part, value): the text cut where a placemark's tag ends, with a mark in place of each run of points."""
    mark = F.concat(F.lit(_RUN), "kind", F.col("run").cast("string"), F.lit(_END))
    text = lines.filter("kind is null or first").select("track_id", "_file", "_at", "_id", F.split(F.concat(F.when(F.col("kind").isNull(), F.col("value")).otherwise(mark), F.lit("\n")), "Placemark>").alias("pieces"))
    before = Window.partitionBy("_file").orderBy("_at", "_id").rowsBetween(Window.unboundedPreceding, -1)
    text = text.withColumn("part", F.coalesce(F.sum(F.size("pieces") - 1).over(before), F.lit(0)))
    text = text.select("track_id", "_file", "_at", "_id", "part", F.posexplode("pieces").alias("i", "piece")).withColumn("part", F.col("part") + F.col("i"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_id", "piece"))), lambda x: x["piece"]), "")
    return text.groupBy("track_id", "_file", "part").agg(joined.alias("value"))


def read_kml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, audit) of the tracks (when and coord in pairs) and then the coordinate lists of KML files.

    A file of any size is dealt to many tasks: it is read by lines, and lines of nothing but points stay rows of their own,
    however many a geometry has; a list on one line is read whole. The rest is split where a placemark's tag ends, so that
    a row is a placemark, or what lies between two. Each geometry counts as source_feature; the name of its placemark is
    source_segment, and the point's name where the geometry is one tuple. Geometries outside placemarks come last.
    Unreadable tuples are left out and counted, as are tracks of unequal lists.
    """
    lines = _kml_lines(spark, path)
    parts = _kml_parts(lines)
    every = lambda c, pattern, i: F.regexp_extract_all(c, F.lit(f"(?s){pattern}"), F.lit(i))
    # A part that ends at a closing tag holds a placemark: from its opening tag on, if that has attributes, else the whole part.
    inside = F.col("value").rlike(r"</(?:\w+:)?$")
    opened = r"(?s)^(.*)<(?:\w+:)?Placemark\s[^>]*>"
    outer = F.when(inside, F.regexp_extract("value", opened, 1)).otherwise(F.col("value"))
    own = F.regexp_replace("value", opened, "")
    blocks = F.filter(F.array(F.struct(F.when(inside, own).alias("block"), F.lit(0).alias("outside")), F.struct(outer.alias("block"), F.lit(1).alias("outside"))), lambda x: x["block"].contains("<"))
    rows = parts.select("track_id", "_file", "part", F.explode(blocks).alias("b")).select("track_id", "_file", F.struct("b.outside", "_file", "part").alias("mark"), "b.block", F.when(F.col("b.outside") == 0, F.nullif(F.trim(unescape_xml(F.regexp_extract("b.block", r"(?s)<(?:\w+:)?name[^>]*>(.*?)</", 1))), F.lit(""))).alias("label"))
    tracks = rows.select("track_id", "_file", "mark", "label", F.lit(0).alias("kind"), F.posexplode(every("block", r"<(?:\w+:)?Track\b.*?</(?:\w+:)?Track>", 0)).alias("n", "geometry"))
    lists = rows.select("track_id", "_file", "mark", "label", F.lit(1).alias("kind"), F.posexplode(every("block", r"<(?:\w+:)?coordinates[^>]*>(.*?)</", 1)).alias("n", "geometry"))
    order = Window.partitionBy("track_id").orderBy("kind", "mark", "n")
    rows = tracks.unionByName(lists).withColumn("source_feature", (F.row_number().over(order) - 1).cast("int"))
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    element = lambda tag, k: every("geometry", f"<(?:\\w+:)?{tag}>.*?</|{_RUN}{k}\\d+{_END}", 0)
    track = F.col("kind") == 0
    tuples = F.filter(F.split(flat("geometry"), " "), lambda x: x != "")
    key = ["track_id", "source_feature", "kind", "label"]
    tokens = rows.select(*key, "_file", F.lit("position").alias("of"), F.posexplode(F.when(track, element("coord", "c")).otherwise(tuples)).alias("k", "token"))
    tokens = tokens.unionByName(rows.filter(track).select(*key, "_file", F.lit("time").alias("of"), F.posexplode(element("when", "w")).alias("k", "token")))
    run = F.startswith("token", F.lit(_RUN))
    text = F.when(track, F.regexp_extract("token", r"(?s)>(.*)</", 1)).otherwise(F.col("token"))
    zero = F.lit(0).cast("bigint")
    items = tokens.filter(~run).select(*key, "of", "k", zero.alias("_at"), zero.alias("_id"), F.lit(0).alias("j"), text.alias("item"))
    of_runs = tokens.filter(run).select(*key, "of", "k", F.col("_file").alias("_of"), F.regexp_extract("token", r"\d+", 0).cast("bigint").alias("_run"))
    of_runs = lines.filter("kind is not null").select("_file", "_at", "_id", "run", _kml_items().alias("items")).join(of_runs, (F.col("_file") == F.col("_of")) & (F.col("run") == F.col("_run")))
    items = items.unionByName(of_runs.select(*key, "of", "k", "_at", "_id", F.posexplode("items").alias("j", "item")))
    own = Window.partitionBy("track_id", "source_feature", "of")
    items = items.withColumns({"place": F.row_number().over(own.orderBy("k", "_at", "_id", "j")) - 1, "many": F.count("*").over(own)}).select(*key, "of", "place", "many", flat("item").alias("item"))
    # A point takes its own time along, not the list of all times.
    times = items.filter("of = 'time'").select(F.col("track_id").alias("_of"), F.col("source_feature").alias("_feature"), F.col("place").alias("_place"), F.col("item").alias("when"))
    points = items.filter("of = 'position'").withColumn("p", F.when(track, F.split("item", " ")).otherwise(F.split("item", ",")))
    points = points.join(times, (F.col("track_id") == F.col("_of")) & (F.col("source_feature") == F.col("_feature")) & (F.col("place") == F.col("_place")), "left")
    number = lambda i: parse_number(F.get("p", F.lit(i)))
    points = held(points.select(*key, "place", "many", number(1).alias("lat"), number(0).alias("lon"), number(2).alias("ele"), parse_iso(F.col("when")).alias("time_ms")))  # callers count them first
    bad = F.col("lat").isNull() | F.col("lon").isNull()
    sizes = items.filter(track).groupBy("track_id", "source_feature").agg(F.count_if(F.col("of") == "time").alias("times"), F.count_if(F.col("of") == "position").alias("positions"))
    uneven = (F.col("times") > 0) & (F.col("times") != F.col("positions"))
    audit = _audit(points, F.when(bad, "bad-coordinate")).unionByName(_audit(sizes, F.when(uneven, "times-paired-by-index")))
    points = points.withColumn("seq", (F.row_number().over(Window.partitionBy("track_id").orderBy("source_feature", "place")) - 1).cast("bigint"))
    segment = F.coalesce("label", F.when(track, "gx:Track"))
    out = points.filter(~bad).select("track_id", "seq", "lat", "lon", "ele", "time_ms", F.when(~track & (F.col("many") == 1), F.col("label")).alias("name"), segment.alias("source_segment"), "source_feature")
    return conform(_again(out)), audit


_MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def read_eag(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, audit) of tab-separated range files: a header of 7 fields, rows of 11 with earth-centred metres.

    The date is in the file name, YYYYMMDD or DDMMMYY; each time the counter falls a day has passed. Rows of another
    number of fields, of another version, exercise or mission than the header, or without a position are counted.
    """
    raw = _in_order(_named(spark.read.text(path))).withColumn("line", F.trim(F.regexp_replace("value", r"\r$", "")))
    whole = Window.partitionBy("track_id").orderBy("seq")
    raw = raw.withColumn("f", F.split("line", "\t")).withColumn("head", F.first("f").over(whole)).filter("seq > 0 and line <> ''")
    f = lambda i: F.get("f", F.lit(i))
    n = lambda i: plain_number(f(i))
    lat, lon, height = geodetic(n(4), n(5), n(6))
    rows = raw.withColumns({"lat": lat, "lon": lon, "ele": height})
    differs = (F.size("head") == 7) & ~F.arrays_zip(F.slice("f", 2, 3)).eqNullSafe(F.arrays_zip(F.slice("head", 2, 3)))
    placed = n(4).isNotNull() & n(5).isNotNull() & n(6).isNotNull() & is_valid(F.col("lat"), F.col("lon"))
    reason = F.when(F.size("f") != 11, "wrong-field-count").when(differs, "header-mismatch").when(~placed, "bad-position")
    rows = rows.withColumn("reason", reason)
    audit = _audit(rows, F.col("reason"))
    name = F.col("track_id")
    eight, short = F.regexp_extract(name, r"(\d{8})", 1), F.regexp_extract(F.upper(name), r"(\d{2})(" + "|".join(_MONTHS) + r")(\d{2})", 0)
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.substring(short, 3, 3))
    days = lambda y, m, d: F.when(m.between(1, 12) & d.between(1, 31), F.unix_date(F.make_date(y.cast("int"), F.greatest(F.least(m, F.lit(12)), F.lit(1)).cast("int"), F.lit(1))) + d.cast("int") - 1)
    cut = lambda text, a, k: F.substring(text, a, k).try_cast("double")
    day = F.coalesce(days(cut(eight, 1, 4), cut(eight, 5, 2), cut(eight, 7, 2)), days(cut(short, 6, 2) + 2000, month, cut(short, 1, 2)))
    clock = r"(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,2}))?"
    h, m, s = (F.regexp_extract(f(10), clock, i).try_cast("double") for i in (1, 2, 3))
    cs = F.rpad(F.regexp_extract(f(10), clock, 4), 2, "0").try_cast("double")
    rows = rows.filter("reason is null").withColumn("ms", F.when(day.isNotNull() & n(0).isNotNull() & (h <= 23) & (m <= 59) & (s <= 59), h * 3_600_000 + m * 60_000 + s * 1000 + F.coalesce(cs, F.lit(0.0)) * 10))
    counter = F.when(F.col("ms").isNotNull() & (n(0) >= 0), n(0))
    rows = rows.withColumn("count", counter).withColumn("fell", (F.col("count") < F.last("count", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    rows = rows.withColumn("time_ms", (day + F.coalesce(F.sum("fell").over(whole), F.lit(0))).cast("double") * DAY_MS + F.col("ms"))
    out = rows.select("track_id", "seq", "lat", "lon", "ele", "time_ms", number_map({"eag_field7": n(7), "eag_field8": n(8), "heading_deg": n(9)}).alias("ext_num"))
    return conform(_again(out)), audit
