"""Tracks derived from the events table: one point for each event, twelve tracks, with invalid, untimed and flat points.

Only exact arithmetic, so that the SQL twin gives the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def by_seq():
    """The window that every ordered operator shares: one exchange and one sort serve them all."""
    return Window.partitionBy("track_id").orderBy("seq")


def earlier():
    return by_seq().rowsBetween(Window.unboundedPreceding, -1)


def whole_track():
    return Window.partitionBy("track_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, seq, lat, lon, ele, time_ms, hdop, sat, flags)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    e = e.withColumn("track_id", F.concat(F.lit("T"), (F.col("user_id") % 12).cast("string")))
    order = Window.partitionBy("track_id").orderBy("ts", "event_id")
    e = e.withColumn("seq", (F.row_number().over(order) - 1).cast("bigint"))
    ms = F.expr("unix_millis(to_utc_timestamp(cast(ts as timestamp), current_timezone()))")
    id, seq = F.col("event_id"), F.col("seq")
    return e.withColumn("ms", ms).select(
        "track_id",
        "seq",
        F.when(id % 97 == 0, F.lit(95.0)).otherwise(F.lit(34.0) + (seq % 400) * F.lit(0.0005) + ((id * 7919) % 100) / F.lit(1000000.0)).alias("lat"),
        (F.lit(-118.0) + (seq % 700) * F.lit(0.0007)).alias("lon"),
        F.when(F.col("event_type") != "signup", F.col("value") * 10).alias("ele"),
        F.when(id % 89 != 0, F.expr("cast(1704067200000 + ((ms - 1704067200000) div 600) as double)")).alias("time_ms"),
        ((id % 60) / F.lit(10.0)).alias("hdop"),
        (F.lit(3) + id % 10).cast("double").alias("sat"),
        F.array().cast("array<string>").alias("flags"),
    )


#: The same in DuckDB, as the first common table expressions of a query.
POINTS_SQL = """
WITH e AS (
  SELECT *, 'T' || (user_id % 12) AS track_id, epoch_us(ts) // 1000 AS ms,
         row_number() OVER (PARTITION BY 'T' || (user_id % 12) ORDER BY ts, event_id) - 1 AS seq
  FROM events
), points AS (
  SELECT track_id, seq,
         CASE WHEN event_id % 97 = 0 THEN 95.0::DOUBLE
              ELSE 34.0::DOUBLE + (seq % 400) * 0.0005::DOUBLE + ((event_id * 7919) % 100) / 1000000.0::DOUBLE END AS lat,
         -118.0::DOUBLE + (seq % 700) * 0.0007::DOUBLE AS lon,
         CASE WHEN event_type <> 'signup' THEN value * 10 END AS ele,
         CASE WHEN event_id % 89 <> 0 THEN (1704067200000 + ((ms - 1704067200000) // 600))::DOUBLE END AS time_ms,
         (event_id % 60) / 10.0::DOUBLE AS hdop, (3 + event_id % 10)::DOUBLE AS sat
  FROM e
)"""


def sql_valid(lat: str = "lat", lon: str = "lon") -> str:
    return f"({lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180)"


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(CASE WHEN {a} IS NOT NULL AND {c} IS NOT NULL THEN 2 * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))) END)"


def sql_bearing(a: str, b: str, c: str, d: str) -> str:
    return f"fmod(degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360, 360)"
