"""Writers of track files. A point is a row of text, a track a folder, so that no track is collected; and tables kept together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import ecef, is_valid
from ..plans.scan import gathered
from ..schema import collect_channels, conform, demote
from .text import escape_xml, gpx_time, iso_time, trimmed
from .workspace import WORKSPACE, load_workspace, save_workspace  # noqa: F401

CHANNEL_MAPS = ("ext_num", "ext_str", "ext_bool")
DAY_MS = 86_400_000


def _full(df: DataFrame) -> DataFrame:
    """The common schema; columns that it doesn't know become channels."""
    known = set(conform(df.limit(0)).columns[:16])
    own = [c for c, kind in df.dtypes if c not in known and kind in ("double", "float", "int", "bigint")]
    return demote(df, *own) if own else conform(df)


def channel_names(df: DataFrame) -> list[str]:
    """All channels, by the first point that has them, then by name: as many as there are names, however many points."""
    keys = F.concat(*(F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in CHANNEL_MAPS))
    rows = df.select("seq", F.explode(keys).alias("c")).groupBy("c").agg(F.min("seq").alias("s")).orderBy("s", "c")
    return [r["c"] for r in rows.collect()]


def _channel(c: str) -> Column:
    return F.coalesce(F.col("ext_num")[c].cast("string"), F.col("ext_str")[c], F.col("ext_bool")[c].cast("string"))


def write_csv(df: DataFrame, path: str, channels: list[str] | None = None) -> None:
    """lat, lon, elevation_m, time_iso, name, description and channels, in order; coordinates that aren't finite are blank."""
    df = _full(df)
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    names = channel_names(df) if channels is None else channels
    out = df.select("track_id", "seq", fine("lat").alias("lat"), fine("lon").alias("lon"), F.col("ele").alias("elevation_m"), iso_time(F.col("time_ms")).alias("time_iso"), "name", F.col("desc").alias("description"), *(_channel(c).alias(c) for c in names))
    gathered(out, "track_id").sortWithinPartitions("track_id", "seq").drop("seq").write.partitionBy("track_id").option("header", True).option("lineSep", "\r\n").csv(path, mode="overwrite")


def write_visible_rows(df: DataFrame, path: str, channels: list[str] | None = None, order: list | None = None) -> None:
    """The rows as they are filtered, in order (by track and seq if none is given), as one table of text."""
    df = _full(df)
    names = channel_names(df) if channels is None else channels
    out = df.orderBy(*(order or ["track_id", "seq"])).select("track_id", F.col("seq").alias("index"), "lat", "lon", "ele", iso_time(F.col("time_ms")).alias("time"), "name", *(_channel(c).alias(c) for c in names))
    out.write.option("header", True).csv(path, mode="overwrite")


def _tag(name: str, x: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>")), F.lit(""))


def _text_files(parts: DataFrame, path: str) -> None:
    """parts: track_id, part, t, seq, value. Lines in that order, a folder for each track."""
    gathered(parts, "track_id").sortWithinPartitions("track_id", "part", "t", "seq").select("track_id", "value").write.partitionBy("track_id").mode("overwrite").text(path)


def _edge(tracks: DataFrame, part: int, value: Column) -> DataFrame:
    return tracks.select("track_id", F.lit(part).alias("part"), F.lit(0.0).alias("t"), F.lit(0).cast("bigint").alias("seq"), value.alias("value"))


def _channel_tags() -> Column:
    pairs = F.concat(*(F.transform(F.map_entries(F.coalesce(m, F.create_map().cast(f"map<string,{k}>"))), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value"))) for m, k in zip(CHANNEL_MAPS, ("double", "string", "boolean"), strict=True)))
    rest = F.filter(pairs, lambda p: ~p["key"].isin("sat", "hdop", "vdop", "pdop") & p["key"].rlike(r"^[A-Za-z_][\w.-]*$"))
    tags = F.array_join(F.transform(rest, lambda p: F.concat(F.lit("<"), p["key"], F.lit(">"), escape_xml(p["value"]), F.lit("</"), p["key"], F.lit(">"))), "")
    other = F.size(F.filter(F.map_keys("ext_num"), lambda k: ~k.isin("sat", "hdop", "vdop", "pdop"))) + F.size("ext_str") + F.size("ext_bool")
    return F.when(other == 0, "").when(tags != "", F.concat(F.lit("<extensions>"), tags, F.lit("</extensions>"))).otherwise("")


def write_gpx(df: DataFrame, path: str, digits: int = 7, by_time: bool = True) -> DataFrame:
    """GPX 1.1 of valid points, by time unless told otherwise, untimed last. Returns (track_id, points, missing, out_of_range)."""
    df = _full(df)
    ok = is_valid(F.col("lat"), F.col("lon"))
    point = F.concat(
        F.lit('<trkpt lat="'), trimmed(F.col("lat"), digits), F.lit('" lon="'), trimmed(F.col("lon"), digits), F.lit('">'),
        _tag("ele", trimmed(F.col("ele"), 3)), _tag("time", gpx_time(F.col("time_ms"))), _tag("name", escape_xml(F.col("name"))), _tag("desc", escape_xml(F.col("desc"))),
        *(_tag(c, trimmed(F.col("ext_num")[c], 6)) for c in ("sat", "hdop", "vdop", "pdop")), _channel_tags(), F.lit("</trkpt>"),
    )
    t = F.coalesce("time_ms", F.lit(float("inf"))) if by_time else F.lit(0.0)
    body = df.filter(ok).select("track_id", F.lit(1).alias("part"), t.alias("t"), "seq", point.alias("value"))
    absent = F.col("lat").isNull() | F.col("lon").isNull() | F.isnan("lat") | F.isnan("lon")
    edge = {f"{n}{c}": f(F.when(ok, F.col(c))) for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")}
    tracks = df.groupBy("track_id").agg(F.count_if(ok).alias("points"), F.count_if(absent).alias("missing"), F.count_if(~ok & ~absent).alias("out_of_range"), F.min(F.when(ok, F.col("time_ms"))).alias("_first"), *(x.alias(n) for n, x in edge.items()))
    bounds = F.concat(F.lit("<bounds"), *(F.concat(F.lit(f' {n}="'), trimmed(F.col(n), digits), F.lit('"')) for n in ("minlat", "minlon", "maxlat", "maxlon")), F.lit("/>"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="trackspark" xmlns="http://www.topografix.com/GPX/1/1">\n<metadata>'), _tag("time", gpx_time(F.col("_first"))), F.coalesce(bounds, F.lit("")), F.lit("</metadata>\n<trk>"), _tag("name", escape_xml(F.col("track_id"))), F.lit("<trkseg>"))
    _text_files(body.unionByName(_edge(tracks, 0, head)).unionByName(_edge(tracks, 2, F.lit("</trkseg></trk></gpx>"))), path)
    return tracks.select("track_id", "points", "missing", "out_of_range")


def _position(sep: str, ele: Column) -> Column:
    return F.concat(trimmed(F.col("lon"), 7), F.lit(sep), trimmed(F.col("lat"), 7), ele)


def write_geojson(df: DataFrame, path: str) -> None:
    """A FeatureCollection of a line of the valid points and a point for each that has a name, positions to 7 decimals."""
    rows = _full(df).filter(is_valid(F.col("lat"), F.col("lon")))
    w = Window.partitionBy("track_id").orderBy("seq")
    place = F.concat(F.lit("["), _position(",", F.coalesce(F.concat(F.lit(","), trimmed(F.col("ele"), 3)), F.lit(""))), F.lit("]"))
    line = rows.select("track_id", F.lit(1).alias("part"), F.lit(0.0).alias("t"), "seq", F.concat(F.when(F.row_number().over(w) == 1, "").otherwise(","), place).alias("value"))
    named = rows.filter("name <> ''")
    properties = F.to_json(F.struct("name", "desc", iso_time(F.col("time_ms")).alias("time")))
    marks = named.select("track_id", F.lit(3).alias("part"), F.lit(0.0).alias("t"), "seq", F.concat(F.lit(',{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"Point","coordinates":'), place, F.lit("}}")).alias("value"))
    tracks = rows.groupBy("track_id").agg(F.count("*").alias("n"))
    head = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), F.to_json(F.struct(F.col("track_id").alias("name"))), F.lit(',"geometry":{"type":"LineString","coordinates":['))
    _text_files(line.unionByName(marks).unionByName(_edge(tracks, 0, head)).unionByName(_edge(tracks, 2, F.lit("]}}"))).unionByName(_edge(tracks, 4, F.lit("]}"))), path)


def write_kml(df: DataFrame, path: str) -> None:
    """A line of the valid points (no height: 0), and a track of those with a time."""
    rows = _full(df).filter(is_valid(F.col("lat"), F.col("lon")))
    height = trimmed(F.coalesce("ele", F.lit(0.0)), 3)
    line = lambda part, value, some: some.select("track_id", F.lit(part).alias("part"), F.lit(0.0).alias("t"), "seq", value.alias("value"))
    timed = rows.filter("time_ms is not null")
    tracks = rows.groupBy("track_id").agg(F.count("time_ms").alias("timed"))
    name = _tag("name", escape_xml(F.col("track_id")))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>'), name, F.lit("<Placemark>"), name, F.lit("<LineString><altitudeMode>absolute</altitudeMode><coordinates>"))
    middle = F.concat(F.lit("</coordinates></LineString></Placemark>"), F.when(F.col("timed") > 0, F.concat(F.lit("<Placemark>"), name, F.lit("<gx:Track><altitudeMode>absolute</altitudeMode>"))).otherwise(""))
    parts = line(1, _position(",", F.concat(F.lit(","), height)), rows)
    parts = parts.unionByName(line(3, _tag("when", iso_time(F.col("time_ms"))), timed)).unionByName(line(4, _tag("gx:coord", _position(" ", F.concat(F.lit(" "), height))), timed))
    foot = F.concat(F.when(F.col("timed") > 0, "</gx:Track></Placemark>").otherwise(""), F.lit("</Document></kml>"))
    _text_files(parts.unionByName(_edge(tracks, 0, head)).unionByName(_edge(tracks, 2, middle)).unionByName(_edge(tracks, 5, foot)), path)


def write_eag(df: DataFrame, path: str, platform: str = "A", exercise: str = "0", mission: str = "0", field4: str = "25") -> DataFrame:
    """Tab-separated range files: earth-centred whole metres, milliseconds of the day. Returns (track_id, points, missing, invalid)."""
    df = _full(df)
    ok = is_valid(F.col("lat"), F.col("lon"))
    extra = [F.coalesce(F.col("ext_num")[c], F.lit(0.0)) for c in ("eag_field7", "eag_field8", "heading_deg")]
    fine = ~F.isnan(extra[0] + extra[1] + extra[2]) & (F.abs(extra[0] + extra[1] + extra[2]) < float("inf"))
    whole = lambda x: F.floor(x + 0.5).cast("string")
    t = F.coalesce("time_ms", F.lit(0.0))
    ms = F.when(F.col("time_ms").isNotNull(), t - F.floor(t / DAY_MS) * DAY_MS).otherwise(0.0)
    clock = F.concat(F.date_format(F.timestamp_millis(F.floor(t).cast("bigint")), "HH:mm:ss."), F.lpad(F.floor(F.floor(t) % 1000 / 10).cast("string"), 2, "0"))
    one = lambda x: F.format_string("%.1f", x)
    row = F.concat_ws("\t", trimmed(ms, 3), F.lit("1"), F.lit(exercise), F.lit(mission), *map(whole, ecef(F.col("lat"), F.col("lon"), F.coalesce("ele", F.lit(0.0)))), F.concat(F.lit(" "), one(extra[0])), F.concat(F.lit("  "), one(extra[1])), F.concat(F.lit(" "), one(extra[2])), clock)
    tracks = df.groupBy("track_id").agg(F.count_if(ok & fine).alias("points"), F.count_if(~ok).alias("missing"), F.count_if(ok & ~fine).alias("invalid"))
    head = F.concat_ws("\t", F.lit(platform), F.lit("1"), F.lit(exercise), F.lit(mission), F.lit(field4), F.lit("1"), F.col("track_id"))
    body = df.filter(ok & fine).select("track_id", F.lit(1).alias("part"), F.lit(0.0).alias("t"), "seq", row.alias("value"))
    _text_files(body.unionByName(_edge(tracks, 0, head)), path)
    return tracks


def comparison_rows(samples: DataFrame, drift: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The tables of a comparison: a row for each sample, told observed or interpolated, and a row of the clock's drift for each pair."""
    derived = F.col("derived") if "derived" in samples.columns else F.lit(False)
    rows = samples.select("pair", F.col("ref_seq").alias("reference_index"), F.col("tgt_seq").alias("target_index"), F.when(derived, "interpolated").otherwise("observed").alias("derived"), F.col("delta_ms").alias("delta_time_ms"), F.col("slant_m").alias("slant_range_m"), F.col("horizontal_m").alias("horizontal_range_m"), "bearing_deg", F.col("up_m").alias("relative_up_m"), F.col("closure_mps").alias("closure_rate_mps"))
    if drift is None:
        return rows, None
    return rows, drift.select("pair", F.col("offset_ms").alias("estimated_clock_offset_ms"), (F.col("drift_ms_per_s") * 1000).alias("estimated_clock_drift_ppm"), F.col("epoch_ms").alias("clock_drift_reference_epoch_ms"), F.col("n").alias("clock_drift_sample_count"))


def write_comparison(samples: DataFrame, path: str, drift: DataFrame | None = None) -> None:
    rows, line = comparison_rows(samples, drift)
    gathered(rows, "pair").sortWithinPartitions("pair", "reference_index").write.partitionBy("pair").option("header", True).csv(f"{path}/samples", mode="overwrite")
    if line is not None:
        line.write.option("header", True).csv(f"{path}/drift", mode="overwrite")


def write_fusion(decisions: DataFrame, report: DataFrame, path: str) -> None:
    """Decisions as delimited text, sources skipped joined by bars, and the report as JSON."""
    out = decisions.withColumn("skipped", F.concat_ws("|", "skipped"))
    gathered(out, "entity").sortWithinPartitions("entity", "group_id").write.option("header", True).csv(f"{path}/decisions", mode="overwrite")
    report.write.json(f"{path}/report", mode="overwrite")


def archive_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n): how many datasets and points there are."""
    one = lambda name, n: tables[name].agg(n.alias("n")).select(F.lit(name).alias("table"), "n")
    return one("datasets", F.countDistinct("track_id")).unionByName(one("points", F.count("*")))


def channels_table(df: DataFrame) -> DataFrame:
    return collect_channels(_full(df))
