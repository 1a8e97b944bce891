"""The points table that readers make and operators keep, and its channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a point, in order. Channels by name are in the maps; promote makes columns of them.
POINTS = {
    "track_id": "string", "seq": "bigint", "lat": "double", "lon": "double", "ele": "double", "time_ms": "double",
    "name": "string", "desc": "string", "source_record": "bigint", "source_segment": "string", "source_feature": "int",
    "flags": "array<string>", "stale": "array<string>",
    "ext_num": "map<string,double>", "ext_str": "map<string,string>", "ext_bool": "map<string,boolean>",
}
FORMATS = ("csv", "gpx", "geojson", "kml", "nmea", "gpb", "eag", "p5")


def conform(df: DataFrame) -> DataFrame:
    """The columns of POINTS in order, then others; missing ones are null, lists and maps empty."""

    def column(name: str, kind: str) -> Column:
        empty = F.array() if kind.startswith("array") else F.create_map() if kind.startswith("map") else F.lit(None)
        if name not in df.columns:
            return empty.cast(kind).alias(name)
        own = F.col(name).cast(kind)
        return (F.coalesce(own, empty.cast(kind)) if kind[0] in "am" and kind != "bigint" else own).alias(name)

    return df.select(*(column(n, k) for n, k in POINTS.items()), *(c for c in df.columns if c not in POINTS))


def channel_value(channel: str) -> Column:
    """A channel as a finite number: of the maps, text of a number as well; elevation is the height."""
    if channel in ("elevation", "ele"):
        x = F.col("ele")
    else:
        from .sources.text import plain_number

        x = F.coalesce(F.col("ext_num")[channel], plain_number(F.col("ext_str")[channel]))
    return F.when(F.abs(x) < float("inf"), x)


def promote(df: DataFrame, *channels: str) -> DataFrame:
    """Adds channels of the maps as columns of their names; columns that are there already stay."""
    return df.withColumns({c: channel_value(c) for c in channels if c not in df.columns})


def demote(df: DataFrame, *channels: str) -> DataFrame:
    """The inverse: columns into ext_num."""
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in channels))
    new = F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))
    old = F.col("ext_num") if "ext_num" in df.columns else F.create_map().cast("map<string,double>")
    return conform(df.withColumn("ext_num", F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*channels)), new)).drop(*channels))


def number_map(pairs: dict[str, Column]) -> Column:
    """A map of the numbers that aren't null."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in pairs.items()))
    return F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))


def text_maps(keys: Column, texts: Column, number) -> tuple[Column, Column]:
    """Maps of the texts that number() reads, and of the others that aren't blank, from arrays of keys and texts; of equal keys the last counts."""
    pairs = F.arrays_zip(keys.alias("key"), texts.alias("value"))
    pairs = F.filter(pairs, lambda p: F.trim(p["value"]) != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    num = F.filter(last, lambda p: number(p["value"]).isNotNull())
    other = F.filter(last, lambda p: number(p["value"]).isNull())
    return (
        F.map_from_entries(F.transform(num, lambda p: F.struct(p["key"].alias("key"), number(p["value"]).alias("value")))),
        F.map_from_entries(F.transform(other, lambda p: F.struct(p["key"].alias("key"), F.trim(p["value"]).alias("value")))),
    )


def collect_channels(df: DataFrame) -> DataFrame:
    """(track_id, channel, data_type, unit, semantic_type, interpolation): one row for each channel of each track."""
    typed = [("ext_num", "number"), ("ext_str", "string"), ("ext_bool", "boolean")]
    told = lambda m, t: F.transform(F.coalesce(F.map_keys(m), F.array().cast("array<string>")), lambda k: F.struct(k.alias("channel"), F.lit(t).alias("data_type")))
    keys = F.concat(*(told(m, t) for m, t in typed))
    rows = df.select("track_id", "seq", F.explode(keys).alias("x")).groupBy("track_id", "x.channel").agg(F.min_by("x.data_type", "seq").alias("data_type"))
    return rows.withColumns({"unit": unit_of("channel"), "semantic_type": semantic_of("channel"), "interpolation": F.when(F.col("data_type") == "number", "linear").otherwise("none")})


def unit_of(channel: str) -> Column:
    c = F.col(channel)
    return F.when(c.endswith("_mps"), "m/s").when(c.endswith("_deg"), "°").when(c.endswith("_m"), "m").when(c.isin("hdop", "vdop", "pdop"), "DOP").when(c == "sat", "sats")


def semantic_of(channel: str) -> Column:
    return F.when(F.col(channel).rlike("(?i)^(heading|course|track)(_|$)"), "heading").when(F.col(channel).rlike("(?i)^bearing(_|$)"), "bearing").when(F.col(channel).rlike("speed"), "speed")
