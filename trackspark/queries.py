"""Queries of the track operators over the demo tracks, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .demo_tracks import POINTS_SQL, points, sql_bearing, sql_haversine, sql_valid
from .functions.geo import round_up
from .operators import aggregate as A
from .operators import align as J
from .operators import compare as X
from .operators import edit as P
from .operators import fusion as U
from .operators import health as H
from .operators import kinematics as K
from .operators import ordered as W
from .operators import builtin  # noqa: F401  registers the operations
from .operators import outliers as O
from .operators import resample as R
from .operators import series as S
from .plans.folders import work_folder
from .plans.recipes import Record, replay
from .schema import demote

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
W_SQL = "WINDOW w AS (PARTITION BY track_id ORDER BY seq)"
#: Milliseconds since 1970: rounded to 3 decimals, since more exceed a double.
TIMES = {"time_ms", "start_time", "end_time", "ref_time", "tgt_time", "at_ms", "earliest", "latest", "anchor"}


def _rounded(c: str, digits: int):
    """Rounded just off the half, where many exact decimals lie and engines differ in the last bit."""
    return F.floor(F.col(c) * 10.0**digits + 0.5003) / 10.0**digits


def _round(c: str, digits: int):
    """Rounded half away from zero as a double, as in SQL; Spark's own round takes the decimal that is printed."""
    return F.signum(c) * F.floor(F.abs(c) * 10.0**digits + 0.5) / 10.0**digits


def _tidy(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, flags as text, other arrays and structs dropped."""
    out = df.select(*(c for c, kind in df.dtypes if not kind.startswith(("struct", "map")) and (kind == "array<string>" or not kind.startswith("array"))))
    return out.select(*(_rounded(c, min(digits, 3) if c in TIMES else digits).alias(c) if kind == "double" else F.concat_ws(",", c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in out.dtypes))


def _with(sql: str, recursive: bool) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else sql


def _add(name: str, run, sql: str | None = None, doubles: str = "", digits: int = 6, with_points: bool = True, recursive: bool = False) -> None:
    def query(spark, sf_dir: str) -> DataFrame:
        return _tidy(run(points(spark, sf_dir)), digits)

    QUERIES[name] = query
    if sql is not None:
        rounding = ", ".join(f"floor({c} * 1e{min(digits, 3) if c in TIMES else digits} + 0.5003) / 1e{min(digits, 3) if c in TIMES else digits} AS {c}" for c in doubles.split())
        ORACLE_SQL[name] = f"{_with(POINTS_SQL, recursive) if with_points else ''} SELECT * {f'REPLACE ({rounding})' if rounding else ''} FROM ({sql})"


BASE = "track_id, seq, lat, lon, ele, time_ms"
BASE_D = "lat lon ele time_ms"


def _base(df: DataFrame) -> DataFrame:
    return df.select(*BASE.split(", "))


def _placed(df: DataFrame) -> DataFrame:
    """Adds the place of each row in a sorted table: how many rows earlier parts have, and how many go before in its own.

    The sorted rows are written, as a second sort would be cut elsewhere.
    """
    folder = work_folder(df.sparkSession)
    df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(folder)
    parts = df.sparkSession.read.parquet(folder)
    sizes = parts.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.partitionBy(F.lit(1)).orderBy("_p")) - F.col("count")).alias("_b"))  # a row for each part
    return parts.join(F.broadcast(before), "_p").select(*BASE.split(", "), (F.col("_b") + F.col("_i")).alias("place"))


# Projections, filters and edits.
_add("points", _base, f"SELECT {BASE} FROM points", BASE_D)
_add("swap_lat_lon", lambda df: _base(P.swap_lat_lon(df)), "SELECT track_id, seq, lon AS lat, lat AS lon, ele, time_ms FROM points", BASE_D)
_add("drop_invalid", lambda df: _base(P.drop_invalid(df)), f"SELECT {BASE} FROM points WHERE {sql_valid()}", BASE_D)
_add("shift_time", lambda df: _base(P.shift_time(df, 2.5)), "SELECT track_id, seq, lat, lon, ele, time_ms + 2500 AS time_ms FROM points", BASE_D)
_add("offset_elevation", lambda df: _base(P.offset_elevation(df, 12.5)), "SELECT track_id, seq, lat, lon, ele + 12.5 AS ele, time_ms FROM points", BASE_D)
_add("clip_time_range", lambda df: _base(P.clip_time_range(df, 1704068000000, 1704069000000)), f"SELECT {BASE} FROM points WHERE time_ms IS NULL OR time_ms BETWEEN 1704068000000 AND 1704069000000", BASE_D)
_add("round_precision", lambda df: _base(P.round_precision(df, 3, 1, rng=(100, 500))), "SELECT track_id, seq, CASE WHEN seq BETWEEN 100 AND 500 THEN round(lat, 3) ELSE lat END AS lat, CASE WHEN seq BETWEEN 100 AND 500 THEN round(lon, 3) ELSE lon END AS lon, CASE WHEN seq BETWEEN 100 AND 500 THEN round(ele, 1) ELSE ele END AS ele, time_ms FROM points", BASE_D)
_add(
    "edit_points",
    lambda df: P.edit_points(df, df.filter("seq % 50 = 7").select("track_id", "seq", (F.col("lat") + 0.25).alias("lat"), F.lit(1.0).alias("hdop"))).select(*BASE.split(", "), "hdop", "flags", F.size("stale").alias("n_stale")),
    "SELECT track_id, seq, CASE WHEN seq % 50 = 7 THEN lat + 0.25 ELSE lat END AS lat, lon, ele, time_ms, CASE WHEN seq % 50 = 7 THEN 1.0 ELSE hdop END AS hdop, CASE WHEN seq % 50 = 7 THEN 'manual_edit' ELSE '' END AS flags, CASE WHEN seq % 50 IN (7, 8) THEN 8 ELSE 0 END::INT AS n_stale FROM points",
    BASE_D + " hdop",
)
_add("delete_points", lambda df: _base(P.delete_points(df, df.filter("seq % 3 = 0"))), f"SELECT {BASE} FROM points WHERE seq % 3 <> 0", BASE_D)
_add("apply_to_range", lambda df: _base(P.apply_to_range(df, 300, 40, lambda x: P.offset_elevation(x, 5))), "SELECT track_id, seq, lat, lon, CASE WHEN seq BETWEEN 40 AND 300 THEN ele + 5 ELSE ele END AS ele, time_ms FROM points", BASE_D)
_add("time_to_index_range", lambda df: P.time_to_index_range(df, 1704069000000, 1704068000000), "SELECT track_id, min(seq) AS start_seq, max(seq) AS end_seq FROM points WHERE time_ms BETWEEN 1704068000000 AND 1704069000000 GROUP BY track_id")
_add("nearest_by_time", lambda df: P.nearest_by_time(df, 1704068500000), "SELECT track_id, arg_min(seq, (abs(time_ms - 1704068500000), seq)) AS seq FROM points WHERE time_ms IS NOT NULL GROUP BY track_id")
_add("table_search", lambda df: P.table_search(df, "T00:1").select("track_id", "seq"), "SELECT track_id, seq FROM points WHERE contains(lower(strftime(make_timestamp(time_ms::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S')), 't00:1')")
_add("table_sort", lambda df: _placed(P.table_sort(df, "ele", True)), f"SELECT {BASE}, row_number() OVER (ORDER BY ele DESC NULLS LAST, track_id, seq) - 1 AS place FROM points", BASE_D)
_add("add_flag", lambda df: P.add_flag(df, "high_dop", F.col("hdop") > 4).select("track_id", "seq", "flags"), "SELECT track_id, seq, CASE WHEN hdop > 4 THEN 'high_dop' ELSE '' END AS flags FROM points")

# Motion.
_PREV = f"""SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ele) OVER w AS pele, lag(time_ms) OVER w AS pt, seq = 0 AS is_first FROM points {W_SQL}"""
_KIN = f"""
  SELECT *, floor(head * 1000 + 0.5) / 1000 AS heading FROM (
    SELECT *, CASE WHEN NOT is_first THEN {sql_haversine("plat", "plon", "lat", "lon")} END AS leg, (time_ms - pt) / 1000 AS dt,
           CASE WHEN NOT is_first THEN {sql_bearing("plat", "plon", "lat", "lon")} END AS head FROM ({_PREV}))"""
_KIN2 = f"""
  SELECT *, CASE WHEN dt > 0 THEN leg / dt END AS speed FROM ({_KIN})"""
_KIN3 = f"""
  SELECT track_id, seq, lat, lon, ele, time_ms, floor(coalesce(sum(leg) OVER w, 0) * 1000 + 0.5) / 1000 AS distance_m, heading AS heading_deg,
    CASE WHEN dt > 0 THEN floor(dt * 1e6 + 0.5) / 1e6 END AS sample_interval_s,
    CASE WHEN dt > 0 THEN floor(1 / dt * 1e6 + 0.5) / 1e6 END AS sample_frequency_hz,
    CASE WHEN dt > 0 THEN floor(speed * 1e6 + 0.5) / 1e6 END AS ground_speed_mps,
    CASE WHEN dt > 0 THEN floor((ele - pele) / dt * 1e6 + 0.5) / 1e6 END AS vertical_speed_mps,
    CASE WHEN dt > 0 THEN floor((speed - last_value(speed IGNORE NULLS) OVER p) / dt * 1e6 + 0.5) / 1e6 END AS horizontal_accel_mps2,
    CASE WHEN dt > 0 THEN floor((fmod(heading - last_value(CASE WHEN dt > 0 THEN heading END IGNORE NULLS) OVER p + 540, 360) - 180) / dt * 1e6 + 0.5) / 1e6 END AS turn_rate_dps,
    CASE WHEN is_first THEN '' WHEN dt IS NULL THEN 'missing_timestamp' WHEN dt = 0 THEN 'duplicate_timestamp' WHEN dt < 0 THEN 'non_monotonic_timestamp' ELSE '' END AS flags
  FROM ({_KIN2}) WINDOW w AS (PARTITION BY track_id ORDER BY seq), p AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_MOTION = ["distance_m", "heading_deg", "sample_interval_s", "sample_frequency_hz", "ground_speed_mps", "vertical_speed_mps"]
_add(
    "kinematics",
    lambda df: K.kinematics(df).select("track_id", "seq", *_MOTION, F.col("horizontal_accel_mps2"), F.col("turn_rate_dps"), "flags"),
    f"SELECT track_id, seq, {', '.join(_MOTION)}, horizontal_accel_mps2, turn_rate_dps, flags FROM ({_KIN3})",
    " ".join([*_MOTION, "horizontal_accel_mps2", "turn_rate_dps"]),
    3,
)
_add("ensure_kinematics", lambda df: K.ensure_kinematics(K.ensure_kinematics(df)).select("track_id", "seq", "ground_speed_mps"), f"SELECT track_id, seq, ground_speed_mps FROM ({_KIN3})", "ground_speed_mps", 3)
_add("point_speeds", lambda df: K.point_speeds(df).select("track_id", "seq", "speed_mps"), f"SELECT track_id, seq, speed AS speed_mps FROM ({_KIN2})", "speed_mps", 5)
_add(
    "legs",
    lambda df: K.legs(df).select("track_id", "seq", "prev_distance_m", "prev_speed_mps", "prev_bearing_deg", "next_distance_m", "next_delta_ele_m", "next_dt_s"),
    f"""SELECT track_id, seq, leg AS prev_distance_m, speed AS prev_speed_mps, head AS prev_bearing_deg, lead(leg) OVER w AS next_distance_m, lead(ele) OVER w - ele AS next_delta_ele_m, (lead(time_ms) OVER w - time_ms) / 1000 AS next_dt_s FROM ({_KIN2}) {W_SQL}""",
    "prev_distance_m prev_speed_mps prev_bearing_deg next_distance_m next_delta_ele_m next_dt_s",
    4,
)
_add(
    "unwrap_angle",
    lambda df: K.unwrap_angle(df.withColumn("a", (F.col("seq") * 37 % 360).cast("double")), "a", "u").select("track_id", "seq", "u"),
    f"SELECT track_id, seq, first_value(a) OVER w + sum(s) OVER w AS u FROM (SELECT track_id, seq, a, coalesce(fmod(a - lag(a) OVER w + 540, 360) - 180, 0) AS s FROM (SELECT track_id, seq, (seq * 37 % 360)::DOUBLE AS a FROM points) {W_SQL}) {W_SQL}",
    "u",
)
_add("median_sample_interval", K.median_sample_interval, f"SELECT track_id, quantile_cont(dt, 0.5) AS median_interval_s FROM ({_KIN}) WHERE dt > 0 GROUP BY track_id", "median_interval_s")
def _move(v: float) -> str:
    return f"""SELECT track_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <= b THEN a ELSE coalesce(c, 0) END AS start_seq, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <= b THEN b ELSE coalesce(d, n) END AS end_seq FROM (
      SELECT track_id, min(seq) FILTER (WHERE f0 + f1 + f2 = 3) AS a, max(seq) FILTER (WHERE f0 + b1 + b2 = 3) AS b, min(seq) FILTER (WHERE far AND seq > 0) - 1 AS c, max(seq) FILTER (WHERE far AND seq > 0) AS d, max(seq) AS n, count(time_ms) AS timed FROM (
        SELECT *, lead(f0, 1, 0) OVER w AS f1, lead(f0, 2, 0) OVER w AS f2, lag(f0, 1, 0) OVER w AS b1, lag(f0, 2, 0) OVER w AS b2, {sql_haversine("la", "lo", "lat", "lon")} >= 50 AS far FROM (
          SELECT *, coalesce(speed >= {v}, false)::INT AS f0, first_value(lat) OVER w AS la, first_value(lon) OVER w AS lo FROM ({_KIN2}) {W_SQL}) {W_SQL}) GROUP BY track_id) WHERE timed > 0"""


_add("movement_window", lambda df: K.movement_window(df, 8.0), _move(8.0))
_KIND = "CASE WHEN sample_interval_s > 10 THEN 'gap' WHEN ground_speed_mps <= 1 THEN 'stationary' WHEN vertical_speed_mps IS NULL AND ground_speed_mps IS NULL THEN 'unknown' WHEN vertical_speed_mps IS NULL THEN 'level' WHEN vertical_speed_mps >= 1 THEN 'climb' WHEN vertical_speed_mps <= -1 THEN 'descent' ELSE 'level' END"
_add(
    "segment_track",
    lambda df: K.segment_track(K.kinematics(df)).select("track_id", "segment", "kind", "start_seq", "end_seq", "point_count", "start_time", "duration_s", "mean_ground_speed_mps"),
    f"""SELECT track_id, run AS segment, any_value(kind) AS kind, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS point_count, arg_min_null(time_ms, seq) AS start_time,
          greatest(0, (arg_max_null(time_ms, seq) - arg_min_null(time_ms, seq)) / 1000) + 0 * (arg_max_null(time_ms, seq) + arg_min_null(time_ms, seq)) AS duration_s, avg(ground_speed_mps) AS mean_ground_speed_mps FROM (
      SELECT *, sum(c2) OVER w AS run FROM (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER w)::INT AS c2 FROM (
        SELECT r.* EXCLUDE (kind, run), CASE WHEN n >= 2 OR old = 'gap' THEN old WHEN pk IS NULL THEN coalesce(nk, old) WHEN nk IS NULL OR pn >= nn THEN pk ELSE nk END AS kind FROM (
          SELECT *, sum(c) OVER w AS run FROM (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER w)::INT AS c FROM (SELECT *, {_KIND} AS kind FROM ({_KIN3})) {W_SQL}) {W_SQL}) r
        JOIN (SELECT *, lag(old) OVER v AS pk, lag(n) OVER v AS pn, lead(old) OVER v AS nk, lead(n) OVER v AS nn FROM (
          SELECT track_id, run, any_value(kind) AS old, count(*) AS n FROM (
            SELECT *, sum(c) OVER w AS run FROM (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER w)::INT AS c FROM (SELECT *, {_KIND} AS kind FROM ({_KIN3})) {W_SQL}) {W_SQL}) GROUP BY track_id, run)
          WINDOW v AS (PARTITION BY track_id ORDER BY run)) s USING (track_id, run)) {W_SQL}) {W_SQL}) GROUP BY track_id, run""",
    "start_time duration_s mean_ground_speed_mps",
    3,
)

# The same tracks cut into chunks of so many points: other windows, one result.
CUT = 250
_add("kinematics_in_chunks", lambda df: K.kinematics(df, chunk=CUT).select("track_id", "seq", *_MOTION, "horizontal_accel_mps2", "turn_rate_dps", "flags"), ORACLE_SQL["kinematics"], digits=3, with_points=False)
_add("segment_track_in_chunks", lambda df: K.segment_track(K.kinematics(df, chunk=CUT), chunk=CUT).select("track_id", "segment", "kind", "start_seq", "end_seq", "point_count", "start_time", "duration_s", "mean_ground_speed_mps"), ORACLE_SQL["segment_track"], digits=3, with_points=False)

# Ordered filters.
_add("sort_by_time", lambda df: _base(W.sort_by_time(df)), "SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY time_ms NULLS LAST, seq) - 1 AS seq, lat, lon, ele, time_ms FROM points", BASE_D)
_add(
    "smooth",
    lambda df: _base(W.smooth(df, 5)),
    """SELECT track_id, seq, degrees(atan2(z, sqrt(x * x + y * y))) AS lat, degrees(atan2(y, x)) AS lon, CASE WHEN ele IS NOT NULL THEN e END AS ele, time_ms FROM (
      SELECT *, avg(cos(radians(lat)) * cos(radians(lon))) OVER w AS x, avg(cos(radians(lat)) * sin(radians(lon))) OVER w AS y, avg(sin(radians(lat))) OVER w AS z, avg(ele) OVER w AS e FROM points
      WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))""",
    BASE_D,
)
_add("median_filter", lambda df: W.median_filter(df, 7).select("track_id", "seq", "ele"), "SELECT track_id, seq, CASE WHEN ele IS NOT NULL THEN quantile_cont(ele, 0.5) OVER w END AS ele FROM points WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)", "ele")
_add(
    "hampel",
    lambda df: W.hampel(df).select("track_id", "seq", "ele", "flags"),
    """SELECT track_id, seq, CASE WHEN hit THEN m ELSE ele END AS ele, CASE WHEN hit THEN 'hampel_corrected' ELSE '' END AS flags FROM (
      SELECT *, coalesce(total >= 5 AND len(v) >= 5 AND ele IS NOT NULL AND CASE WHEN d = 0 THEN ele <> m ELSE abs(ele - m) / (1.4826 * d) > 3 END, false) AS hit FROM (
        SELECT *, list_median(list_transform(v, lambda x: abs(x - m))) AS d FROM (SELECT *, list_median(v) AS m FROM (
          SELECT *, list_filter(list(ele) OVER w, lambda x: x IS NOT NULL) AS v, count(ele) OVER (PARTITION BY track_id) AS total FROM points WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)))))""",
    "ele",
)
_add("decimate", lambda df: _base(W.decimate(df, 7)), f"SELECT {BASE} FROM (SELECT *, max(seq) OVER (PARTITION BY track_id) AS n FROM points) WHERE seq % 7 = 0 OR seq = n", BASE_D)
_add("dedupe", lambda df: _base(W.dedupe(df.withColumns({"lat": _round("lat", 2), "lon": _round("lon", 2)}))), f"SELECT {BASE} FROM (SELECT * REPLACE (round(lat, 2) AS lat, round(lon, 2) AS lon) FROM points) {W_SQL} QUALIFY lag(lat) OVER w IS NULL OR lag(lat) OVER w <> lat OR lag(lon) OVER w <> lon", BASE_D)
_add(
    "dedupe_tolerance",
    lambda df: _base(W.dedupe(df, 200.0)),
    f"""WITH RECURSIVE g AS (SELECT track_id, seq, lat AS la, lon AS lo, true AS kept FROM points WHERE seq = 0 UNION ALL
      SELECT track_id, seq, CASE WHEN near THEN la ELSE lat END, CASE WHEN near THEN lo ELSE lon END, NOT near FROM (SELECT p.track_id, p.seq, p.lat, p.lon, g.la, g.lo, {sql_haversine("g.la", "g.lo", "p.lat", "p.lon")} <= 200 AS near FROM g JOIN points p ON p.track_id = g.track_id AND p.seq = g.seq + 1))
      SELECT {BASE} FROM points JOIN (SELECT track_id, seq FROM g WHERE kept) USING (track_id, seq)""",
    BASE_D,
    recursive=True,
)
_add(
    "ema",
    lambda df: W.ema(df, 0.3).select("track_id", "seq", "ele", "flags"),
    """WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS i FROM points WHERE ele IS NOT NULL),
      g AS (SELECT track_id, seq, i, ele AS out FROM p WHERE i = 1 UNION ALL SELECT p.track_id, p.seq, p.i, 0.3 * p.ele + (1 - 0.3) * g.out FROM g JOIN p ON p.track_id = g.track_id AND p.i = g.i + 1)
      SELECT track_id, seq, out AS ele, CASE WHEN abs(out - ele) > 1e-9 THEN 'ema_smoothed' ELSE '' END AS flags FROM points LEFT JOIN (SELECT track_id, seq, out FROM g) USING (track_id, seq)""",
    "ele",
    recursive=True,
)
#: Stretches and what parts them, level by level.
_SIMPLE = """
  WITH RECURSIVE plane AS (SELECT track_id, seq, radians(lon) * 6371008.8 * cos(avg(radians(lat)) OVER (PARTITION BY track_id)) AS x, radians(lat) * 6371008.8 AS y FROM points),
  seg AS (
    SELECT track_id, min(seq) AS a, max(seq) AS b FROM plane GROUP BY track_id
    UNION ALL
    SELECT track_id, unnest([a, m]) AS a, unnest([m, b]) AS b FROM (
      SELECT track_id, a, b, -f.s AS m FROM (
        SELECT track_id, a, b, max(struct_pack(d := sqrt((px - u * dx) ** 2 + (py - u * dy) ** 2), s := -seq)) AS f FROM (
          SELECT *, coalesce(least(1, greatest(0, (px * dx + py * dy) / nullif(dx * dx + dy * dy, 0))), 0) AS u FROM (
            SELECT s.track_id, s.a, s.b, p.seq, p.x - pa.x AS px, p.y - pa.y AS py, pb.x - pa.x AS dx, pb.y - pa.y AS dy
            FROM seg s JOIN plane pa ON pa.track_id = s.track_id AND pa.seq = s.a JOIN plane pb ON pb.track_id = s.track_id AND pb.seq = s.b JOIN plane p ON p.track_id = s.track_id AND p.seq > s.a AND p.seq < s.b))
        GROUP BY track_id, a, b) WHERE f.d > 50)
  )
  SELECT p.track_id, p.seq, p.lat, p.lon, p.ele, p.time_ms FROM points p JOIN (SELECT DISTINCT track_id, unnest([a, b]) AS seq FROM seg) USING (track_id, seq)"""
_add("simplify", lambda df: _base(W.simplify(df, 50.0)), _SIMPLE, BASE_D)
_add("simplify_by_rounds", lambda df: _base(W.simplify(df, 50.0, 40)), _SIMPLE, BASE_D)
_add("dejitter_nudge", lambda df: W.dejitter(df.withColumn("time_ms", F.floor(F.col("time_ms") / 4000) * 4000.0)).select("track_id", "seq", "time_ms", "flags"), """SELECT track_id, seq, CASE WHEN time_ms IS NOT NULL THEN max(time_ms - i) OVER w + i END AS time_ms, CASE WHEN max(time_ms - i) OVER w + i > time_ms THEN 'time_dejittered' ELSE '' END AS flags FROM (SELECT track_id, seq, floor(time_ms / 4000) * 4000 AS time_ms, row_number() OVER (PARTITION BY track_id, time_ms IS NULL ORDER BY seq) - 1 AS i FROM points) WINDOW w AS (PARTITION BY track_id, time_ms IS NULL ORDER BY seq)""", "time_ms")
_add("dejitter_drop", lambda df: W.dejitter(df.withColumn("time_ms", F.floor(F.col("time_ms") / 4000) * 4000.0), "drop").select("track_id", "seq", "time_ms"), """SELECT track_id, seq, time_ms FROM (SELECT *, max(time_ms) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT track_id, seq, floor(time_ms / 4000) * 4000 AS time_ms FROM points)) WHERE time_ms IS NULL OR top IS NULL OR time_ms > top""", "time_ms")
_add("dejitter_average", lambda df: W.dejitter(df.withColumn("time_ms", F.floor(F.col("time_ms") / 4000) * 4000.0), "average").select("track_id", "seq", "time_ms", "lat", "ele"), """
  SELECT track_id, min(seq) AS seq, arg_min(time_ms, seq) AS time_ms, sum(lat * wt) / sum(wt) AS lat, sum(ele * wt) / sum(wt) FILTER (WHERE ele IS NOT NULL) AS ele FROM (
    SELECT *, pow(2.0, CASE WHEN k = 0 THEN 1 - n ELSE k - n END) AS wt FROM (SELECT *, row_number() OVER (PARTITION BY track_id, g ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY track_id, g) AS n FROM (
      SELECT *, sum((top IS NULL OR time_ms > top)::INT) OVER (PARTITION BY track_id ORDER BY seq) AS g FROM (SELECT *, max(time_ms) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT track_id, seq, lat, ele, floor(time_ms / 4000) * 4000 AS time_ms FROM points WHERE time_ms IS NOT NULL))))) GROUP BY track_id, g
  UNION ALL SELECT track_id, seq, time_ms, lat, ele FROM points WHERE time_ms IS NULL""", "time_ms lat ele", 5)
_EVENTS = f"""
  SELECT track_id, x.kind AS kind, x.severity AS severity, x.a AS start_seq, x.b AS end_seq, x.t0 AS start_time, x.t1 AS end_time, x.m AS measure FROM (SELECT track_id, unnest([
    CASE WHEN NOT ok THEN {{'kind': 'invalid-coordinate', 'severity': 'error', 'a': seq, 'b': seq, 't0': time_ms, 't1': time_ms, 'm': NULL::DOUBLE}} END,
    CASE WHEN ok AND d = 0 THEN {{'kind': 'duplicate-timestamp', 'severity': 'warning', 'a': seq, 'b': seq, 't0': time_ms, 't1': time_ms, 'm': time_ms}} END,
    CASE WHEN ok AND d > 5000 THEN {{'kind': 'gap', 'severity': 'warning', 'a': seq - 1, 'b': seq, 't0': pt, 't1': time_ms, 'm': d}} END,
    CASE WHEN ok AND was AND d BETWEEN 0 AND 5000 AND far > 10000 THEN {{'kind': 'coordinate-jump', 'severity': 'error', 'a': seq - 1, 'b': seq, 't0': pt, 't1': time_ms, 'm': far}} END,
    CASE WHEN (up > 0) <> (down > 0) AND abs(up) > 100 AND abs(down) > 100 AND abs(nele - pele) < 100 THEN {{'kind': 'elevation-spike', 'severity': 'warning', 'a': seq, 'b': seq, 't0': time_ms, 't1': time_ms, 'm': abs(up)}} END]) AS x FROM (
      SELECT *, time_ms - pt AS d, {sql_valid()} AS ok, coalesce({sql_valid("plat", "plon")}, false) AS was, {sql_haversine("plat", "plon", "lat", "lon")} AS far, ele - pele AS up, lead(ele) OVER w - ele AS down, lead(ele) OVER w AS nele FROM ({_PREV}) {W_SQL})) WHERE x IS NOT NULL
  UNION ALL
  SELECT track_id, 'elevation-flatline', 'info', min(seq), max(seq), arg_min_null(time_ms, seq), arg_max_null(time_ms, seq), count(*)::DOUBLE FROM (
    SELECT *, sum(c) OVER w AS run FROM (SELECT *, (ele IS NULL OR ele IS DISTINCT FROM lag(ele) OVER w)::INT AS c FROM points {W_SQL}) {W_SQL}) WHERE ele IS NOT NULL GROUP BY track_id, run HAVING count(*) >= 5"""
_add("quality_events", W.quality_events, _EVENTS, "start_time end_time measure", 4)
_add("quality_events_in_chunks", lambda df: W.quality_events(df, chunk=CUT), ORACLE_SQL["quality_events"], digits=4, with_points=False)
_add("events_overlapping", lambda df: W.events_overlapping(W.quality_events(df), 200, 100).select("track_id", "kind", "start_seq", "end_seq"), f"SELECT track_id, kind, start_seq, end_seq FROM ({_EVENTS}) WHERE start_seq <= 200 AND end_seq >= 100")
_add("event_source_points", lambda df: W.event_source_points(W.quality_events(df)), f"SELECT DISTINCT track_id, unnest(range(start_seq, end_seq + 1)) AS seq FROM ({_EVENTS})")
_add("event_counts", lambda df: A.event_counts(W.quality_events(df)), f"SELECT track_id, kind, count(*) AS n FROM ({_EVENTS}) GROUP BY track_id, kind")
_HALF = """PARTITION BY track_id ORDER BY seq ROWS BETWEEN"""
_FLOOR = f"""SELECT track_id, greatest(0.0, coalesce((sqrt(pow(cx - bx, 2) + pow(cy - yb, 2)) + sqrt(pow(cx - fx, 2) + pow(cy - fy, 2)) - sqrt(pow(bx - fx, 2) + pow(yb - fy, 2))) / 2, 0)) AS floor_m FROM (
  SELECT track_id, x[6] AS cx, y[6] AS cy, list_median(x[1:5]) AS bx, list_median(y[1:5]) AS yb, list_median(x[7:11]) AS fx, list_median(y[7:11]) AS fy FROM (
    SELECT track_id, list_transform(range(1, 12), lambda i: v * dt * list_sum(list_transform(range(1, i + 1), lambda k: cos(k * radians(turn * dt))))) AS x, list_transform(range(1, 12), lambda i: v * dt * list_sum(list_transform(range(1, i + 1), lambda k: sin(k * radians(turn * dt))))) AS y FROM (
      SELECT track_id, 30.0::DOUBLE AS turn, least(max(speed) FILTER (WHERE speed > 0), 680) AS v, quantile_cont(dt, 0.5) FILTER (WHERE dt > 0) AS dt FROM ({_KIN2}) GROUP BY track_id)))"""
_med = lambda c: f"quantile_cont({c}, 0.5) OVER p AS a_{c}, quantile_cont({c}, 0.5) OVER q AS b_{c}"
_OUT = f"""
  SELECT track_id, seq, CASE WHEN s1 > 0 AND s1 >= coalesce(s2, 0) AND s1 >= coalesce(s3, 0) THEN 'position' WHEN s2 > 0 AND s2 >= coalesce(s3, 0) THEN 'elevation' WHEN s3 > 0 THEN 'speed' ELSE 'position' END AS channel, greatest(s1, coalesce(s2, 0), coalesce(s3, 0)) AS score FROM (
    SELECT track_id, seq, position / greatest(1.4826 * quantile_cont(abs(position - mp), 0.5) OVER t, 1, floor_m) AS s1, abs(elevation) / greatest(1.4826 * quantile_cont(abs(elevation - me), 0.5) OVER t, 1, coalesce(step, 0)) AS s2, abs(velocity) / greatest(1.4826 * quantile_cont(abs(velocity - mv), 0.5) OVER t, 0.5) AS s3 FROM (
      SELECT *, quantile_cont(position, 0.5) OVER t AS mp, quantile_cont(elevation, 0.5) OVER t AS me, quantile_cont(velocity, 0.5) OVER t AS mv FROM (
        SELECT track_id, seq, step, greatest(0, ({sql_haversine("lat", "lon", "a_lat", "a_lon")} + {sql_haversine("lat", "lon", "b_lat", "b_lon")} - {sql_haversine("a_lat", "a_lon", "b_lat", "b_lon")}) / 2) AS position, ele - (a_ele + b_ele) / 2 AS elevation, speed - (a_speed + b_speed) / 2 AS velocity FROM (
          SELECT *, count(*) OVER p AS na, count(*) OVER q AS nb, {_med("lat")}, {_med("lon")}, {_med("ele")}, {_med("speed")} FROM (
            SELECT *, quantile_cont(CASE WHEN rise > 0 THEN rise END, 0.5) OVER (PARTITION BY track_id) AS step FROM (SELECT *, ele - lag(ele) OVER (PARTITION BY track_id ORDER BY ele) AS rise FROM ({_KIN2}) WHERE ele IS NOT NULL UNION ALL SELECT *, NULL FROM ({_KIN2}) WHERE ele IS NULL))
          WINDOW p AS ({_HALF} 5 PRECEDING AND 1 PRECEDING), q AS ({_HALF} 1 FOLLOWING AND 5 FOLLOWING)) WHERE na = 5 AND nb = 5)
      WINDOW t AS (PARTITION BY track_id)) JOIN ({_FLOOR}) USING (track_id) WINDOW t AS (PARTITION BY track_id))"""
_floored = lambda df: O.turn_floor(df, 30.0, 5, 680.0)
_add("turn_floor", _floored, _FLOOR, "floor_m", 4)
_add("detect_outliers", lambda df: O.detect_outliers(df, floors=_floored(df)), f"SELECT *, score > 3 AS outlier FROM ({_OUT})", "score", 4)
_add("drop_outliers", lambda df: _base(O.drop_outliers(df, reconstruct=False)), f"SELECT {BASE} FROM points WHERE (track_id, seq) NOT IN (SELECT (track_id, seq) FROM ({_OUT}) WHERE score > 3)", BASE_D)
_IN = _OUT.split(" AS score FROM (", 1)[1].rsplit(")", 1)[0]
_add("elevation_outliers", lambda df: O.detect_outliers(df, threshold=6.0, channels=("elevation",)).select("track_id", "seq", "outlier"), f"SELECT track_id, seq, coalesce(s2, 0) > 6 AS outlier FROM ({_IN})")

# Statistics.
_add("bounds", A.bounds, f"SELECT track_id, min(lat) FILTER (WHERE {sql_valid()}) AS min_lat, min(lon) FILTER (WHERE {sql_valid()}) AS min_lon, max(lat) FILTER (WHERE {sql_valid()}) AS max_lat, max(lon) FILTER (WHERE {sql_valid()}) AS max_lon FROM points GROUP BY track_id", "min_lat min_lon max_lat max_lon")
_STATS = f"""
  SELECT *, CASE WHEN duration_ms > 0 AND with_time > 1 THEN (with_time - 1) / (duration_ms / 1000) END AS sample_rate_hz FROM (
    SELECT track_id, count(*) AS points, count(*) FILTER (WHERE ok) AS valid, count(ele) AS with_ele, count(time_ms) AS with_time, coalesce(sum(d), 0) AS distance_m, arg_max(time_ms, seq) - arg_min(time_ms, seq) AS duration_ms,
      min(ele) AS ele_min, max(ele) AS ele_max, sum(greatest(rise, 0)) FILTER (WHERE rise IS NOT NULL) AS gain_m, sum(greatest(-rise, 0)) FILTER (WHERE rise IS NOT NULL) AS loss_m,
      min(d / dt) FILTER (WHERE dt > 0) AS speed_min, max(d / dt) FILTER (WHERE dt > 0) AS speed_max, avg(d / dt) FILTER (WHERE dt > 0) AS speed_mean, coalesce(bool_and(time_ms >= t), true) AS monotonic, count(*) FILTER (WHERE d = 0) AS duplicate_coords,
      0::BIGINT AS with_name, count(*) FILTER (WHERE NOT ok) AS invalid, min(lat) FILTER (WHERE ok) AS min_lat, min(lon) FILTER (WHERE ok) AS min_lon, max(lat) FILTER (WHERE ok) AS max_lat, max(lon) FILTER (WHERE ok) AS max_lon, arg_min(time_ms, seq) AS start_time, arg_max(time_ms, seq) AS end_time FROM (
      SELECT *, CASE WHEN ok THEN {sql_haversine("p.lat", "p.lon", "q.lat", "q.lon")} END AS d, (time_ms - p.t) / 1000 AS dt, ele - e AS rise FROM (
        SELECT *, {{'lat': lat, 'lon': lon}} AS q, {sql_valid()} AS ok, last_value(CASE WHEN {sql_valid()} THEN {{'lat': lat, 'lon': lon, 't': time_ms}} END IGNORE NULLS) OVER w AS p, last_value(ele IGNORE NULLS) OVER w AS e, last_value(time_ms IGNORE NULLS) OVER w AS t FROM points
        WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) GROUP BY track_id)"""
_STATS_D = "min_lat min_lon max_lat max_lon start_time end_time distance_m duration_ms ele_min ele_max gain_m loss_m speed_min speed_max speed_mean sample_rate_hz"
_add("track_stats", A.track_stats, _STATS, _STATS_D, 4)
_add("track_stats_in_chunks", lambda df: A.track_stats(df, CUT), ORACLE_SQL["track_stats"], digits=4, with_points=False)
_add("channel_stats", A.channel_stats, "SELECT track_id, channel, count(v) AS count, count(v) AS n, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_samp(v) AS stddev, CASE channel WHEN 'hdop' THEN 'DOP' WHEN 'sat' THEN 'sats' END AS unit FROM (SELECT track_id, unnest(['hdop', 'sat', 'ele']) AS channel, unnest([hdop, sat, ele]) AS v FROM points) GROUP BY track_id, channel", "min max mean stddev")
_add("range_statistics", lambda df: A.range_statistics(df, 100, 400), f"SELECT track_id, count(*) AS points, coalesce(sum(d), 0) AS distance_m, arg_max_null(time_ms, seq) - arg_min_null(time_ms, seq) AS duration_ms, count(hdop) AS count_hdop, min(hdop) AS min_hdop, max(hdop) AS max_hdop, avg(hdop) AS mean_hdop, count(ele) AS count_ele, min(ele) AS min_ele, max(ele) AS max_ele, avg(ele) AS mean_ele FROM (SELECT *, {sql_haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM points WHERE seq BETWEEN 100 AND 400 {W_SQL}) GROUP BY track_id", "distance_m duration_ms min_hdop max_hdop mean_hdop min_ele max_ele mean_ele", 4)
_add("distribution_stats", lambda df: A.distribution_stats(df, "ele"), "SELECT track_id, count(*) AS n, min(ele) AS min, quantile_cont(ele, 0.5) AS median, quantile_cont(ele, 0.95) AS p95, max(ele) AS max, avg(ele) AS mean, coalesce(stddev_samp(ele), 0) AS stddev FROM points WHERE ele IS NOT NULL GROUP BY track_id", "min median p95 max mean stddev")
_add("histogram", lambda df: A.histogram(df, "ele"), "SELECT track_id, bin, a + bin * w AS low, a + (bin + 1) * w AS high, count(*) AS n FROM (SELECT *, least(19, floor((v - a) / w)::INT) AS bin FROM (SELECT *, CASE WHEN a = b THEN 1 ELSE (b - a) / 20 END AS w FROM (SELECT track_id, ele AS v, min(ele) OVER t AS a, max(ele) OVER t AS b FROM points WHERE ele IS NOT NULL WINDOW t AS (PARTITION BY track_id)))) GROUP BY track_id, bin, a, w", "low high")
_add(
    "spatial_bins",
    lambda df: A.spatial_bins(P.drop_invalid(df), 500.0),
    f"""SELECT track_id, r AS row, c AS col, count(*) AS n, r * 500 / 111320.0::DOUBLE AS south, (r + 1) * 500 / 111320.0::DOUBLE AS north, fmod(c * any_value(w) + 540, 360) - 180 AS west, fmod((c + 1) * any_value(w) + 540, 360) - 180 AS east FROM (
      SELECT track_id, w, floor(lat / (500 / 111320.0::DOUBLE))::BIGINT AS r, floor(u / w)::BIGINT AS c FROM (SELECT *, first_value(lon) OVER w + sum(s) OVER w AS u, 500 / 111320.0::DOUBLE / cos(radians(m)) AS w FROM (
        SELECT *, coalesce(fmod(lon - lag(lon) OVER w + 540, 360) - 180, 0) AS s, avg(lat) OVER (PARTITION BY track_id) AS m FROM points WHERE {sql_valid()} {W_SQL}) {W_SQL})) GROUP BY track_id, r, c""",
    "south north west east",
)
_add("flag_counts", lambda df: A.flag_counts(K.kinematics(df)), f"SELECT track_id, flags AS flag, count(*) AS n FROM ({_KIN3}) WHERE flags <> '' GROUP BY track_id, flags")
_add("time_extent", A.time_extent, "SELECT min(time_ms) AS earliest, max(time_ms) AS latest FROM points", "earliest latest")
_add("fingerprint", A.fingerprint)
_SIDE = lambda src, n: f"SELECT track_id, points AS points_{n}, distance_m AS distance_{n}, duration_ms AS duration_{n}, [min_lat, min_lon, max_lat, max_lon] AS b_{n} FROM ({_STATS.replace('FROM points', 'FROM ' + src)})"
_HALVED = "(SELECT p.* FROM points p JOIN (SELECT track_id, max(seq) AS last FROM points GROUP BY track_id) USING (track_id) WHERE seq % 2 = 0 OR seq = last)"
_N_EVENTS = lambda src, n: f"SELECT track_id, count(*) AS events_{n} FROM ({_EVENTS.replace('FROM points', 'FROM ' + src).replace('seq - 1', 'pseq').replace('SELECT *, lag(lat)', 'SELECT *, lag(seq) OVER w AS pseq, lag(lat)')}) GROUP BY track_id"
_add(
    "operation_preview",
    lambda df: A.operation_preview(df, W.decimate(df, 2), (100, 400)),
    f"""SELECT a.track_id, points_before, distance_before, duration_before, coalesce(events_before, 0) AS events_before, in_range_before, points_after, distance_after, duration_after, coalesce(events_after, 0) AS events_after, in_range_after, b_before IS DISTINCT FROM b_after AS bounds_changed, points_after < points_before AS destructive
      FROM ({_SIDE("points", "before")}) a JOIN ({_SIDE(_HALVED, "after")}) b USING (track_id) LEFT JOIN ({_N_EVENTS("points", "before")}) c USING (track_id) LEFT JOIN ({_N_EVENTS(_HALVED, "after")}) d USING (track_id)
      JOIN (SELECT track_id, count(*) FILTER (WHERE seq BETWEEN 100 AND 400) AS in_range_before, count(*) FILTER (WHERE seq BETWEEN 100 AND 400 AND (seq % 2 = 0 OR seq = last)) AS in_range_after FROM (SELECT *, max(seq) OVER (PARTITION BY track_id) AS last FROM points) GROUP BY track_id) e USING (track_id)""",
    "distance_before distance_after duration_before duration_after",
    3,
)
_add("stride_sample", lambda df: A.stride_sample(df, 100).select("track_id", "seq"), "SELECT track_id, seq FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM points) WHERE seq % greatest(1, ceil((n - 1) / 99.0))::BIGINT = 0 OR seq = n - 1")
_add("minmax_downsample", lambda df: A.minmax_downsample(df, "ele", 50), """
  SELECT DISTINCT track_id, seq, ele FROM (SELECT track_id, unnest([lo.seq, hi.seq]) AS seq, unnest([lo.ele, hi.ele]) AS ele FROM (
    SELECT track_id, arg_min({'seq': seq, 'ele': ele}, (ele, seq)) AS lo, arg_max({'seq': seq, 'ele': ele}, (ele, -seq)) AS hi FROM (
      SELECT *, CASE WHEN n <= 50 OR i IN (0, n - 1) THEN -1 - i ELSE (SELECT max(b) FROM range(24) g(b) WHERE floor(b * ((n - 2) / 24.0)) <= i - 1) END AS bucket FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM points WHERE ele IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY seq))) GROUP BY track_id, bucket))""", "ele")
_add("plan_stride", lambda df: S.plan_stride(df, 100).select("track_id", "seq"), "SELECT track_id, seq FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM points) WHERE seq % greatest(1, ceil(n / 100.0))::BIGINT = 0 OR seq = n - 1")
_wide = lambda df: df.withColumn("lon", F.when(F.col("seq") % 500 >= 450, F.col("lon") - 200).otherwise(F.col("lon")))  # noqa: E731  so that some legs cross the date line, and some points are invalid
_add("path_segments", lambda df: A.path_segments(_wide(df), 20000).select("track_id", "seq", "segment"), f"""
  SELECT track_id, seq, segment FROM (SELECT *, count(*) OVER (PARTITION BY track_id, segment) AS m FROM (SELECT *, sum((cut OR coalesce(abs(lon - plon2) > 180, false))::INT) OVER w AS segment FROM (SELECT *, lag(lon) OVER w AS plon2 FROM (
    SELECT *, coalesce(time_ms - pt > 20000 OR ({sql_valid("plat", "plon")} AND time_ms - pt BETWEEN 0 AND 5000 AND {sql_haversine("plat", "plon", "lat", "lon")} > 10000), false) AS cut FROM ({_PREV.replace("FROM points", "FROM (SELECT * REPLACE (CASE WHEN seq % 500 >= 450 THEN lon - 200 ELSE lon END AS lon) FROM points)")})) WHERE {sql_valid()} {W_SQL}) {W_SQL})) WHERE m > 1""")

# Alignment: each track against the next, the last against the first; the key of a pair has both names.
def _ring(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs, keyed by pair."""
    df, one = P.drop_invalid(df), Window.partitionBy(F.lit(1)).orderBy("track_id")
    ids = df.select("track_id").distinct()  # a row for each track
    ids = ids.select("track_id", F.coalesce(F.lead("track_id").over(one), F.min("track_id").over(Window.partitionBy(F.lit(1)))).alias("next"))
    pairs = ids.withColumn("pair", F.concat_ws("-", "track_id", "next"))
    side = lambda c: df.join(pairs.select(F.col(c).alias("track_id"), "pair"), "track_id").drop("track_id").withColumnRenamed("pair", "track_id")
    return side("track_id"), side("next")


_pair = _ring
_SIDES = f"""ids AS (SELECT track_id, coalesce(lead(track_id) OVER (ORDER BY track_id), min(track_id) OVER ()) AS nxt FROM (SELECT DISTINCT track_id FROM points WHERE {sql_valid()})),
  r AS (SELECT p.*, p.track_id || '-' || nxt AS pair FROM points p JOIN ids USING (track_id) WHERE time_ms IS NOT NULL AND {sql_valid()}),
  t AS (SELECT p.*, i.track_id || '-' || nxt AS pair FROM points p JOIN ids i ON p.track_id = i.nxt WHERE time_ms IS NOT NULL AND {sql_valid()})"""
_NEAR = """SELECT pair, seq AS ref_seq, x.seq AS tgt_seq, time_ms AS ref_time, x.t AS tgt_time, x.t - time_ms AS delta_ms, lat, lon, ele, x.lat AS tlat, x.lon AS tlon, x.ele AS tele FROM (
  SELECT r.*, (SELECT arg_min({'seq': t.seq, 't': t.time_ms, 'lat': t.lat, 'lon': t.lon, 'ele': t.ele}, (abs(t.time_ms - r.time_ms), t.time_ms, CASE WHEN t.time_ms < r.time_ms THEN -t.seq ELSE t.seq END)) FROM t WHERE t.pair = r.pair) AS x FROM r) WHERE abs(x.t - time_ms) <= 3000"""
_ALIGN = "pair, ref_seq, tgt_seq, ref_time, tgt_time, delta_ms"


def _aligned(name: str, run, sql: str, doubles: str = "", digits: int = 6) -> None:
    """A query over whole pairs, and one over pairs cut into spans of about 50 rows."""
    for one, chunk in ((name, None), (f"{name}_all", 50)):
        _add(one, lambda df, chunk=chunk: run(df, chunk), f"WITH {_SIDES} {sql}", doubles, digits)


_aligned("align_nearest", lambda df, chunk: J.align_nearest(*_pair(df), 3000, chunk=chunk), f"SELECT {_ALIGN} FROM ({_NEAR})", "ref_time tgt_time delta_ms")
_BRACKET = """SELECT pair, seq AS ref_seq, time_ms AS ref_time, a, b, CASE WHEN b.t = a.t THEN 0 ELSE (time_ms - a.t) / (b.t - a.t) END AS fraction FROM (SELECT r.*,
  coalesce((SELECT arg_max({'seq': seq, 't': time_ms}, (time_ms, seq)) FROM t WHERE t.pair = r.pair AND t.time_ms < r.time_ms), (SELECT arg_min({'seq': seq, 't': time_ms}, (time_ms, seq)) FROM t WHERE t.pair = r.pair AND t.time_ms = r.time_ms)) AS a,
  (SELECT arg_min({'seq': seq, 't': time_ms}, (time_ms, seq)) FROM t WHERE t.pair = r.pair AND t.time_ms >= r.time_ms) AS b FROM r) WHERE a IS NOT NULL AND b IS NOT NULL AND b.t - a.t <= 15000"""
_aligned("align_interpolated", lambda df, chunk: J.align_interpolated(*_pair(df), 15000, chunk=chunk).select("pair", "ref_seq", "ref_time", "tgt_seq", "tgt_after_seq", "fraction"), f"SELECT pair, ref_seq, ref_time, a.seq AS tgt_seq, b.seq AS tgt_after_seq, fraction FROM ({_BRACKET})", "ref_time fraction")
_N = "(6378137.0::DOUBLE / sqrt(1 - e2 * pow(sin(radians({0})), 2)))"
_E2 = "(1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE)"


def _ecef(lat: str, lon: str, h: str) -> tuple[str, str, str]:
    n = _N.format(lat).replace("e2", f"({_E2})")
    return f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))", f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))", f"(({n} * (1 - {_E2}) + {h}) * sin(radians({lat})))"


_T, _O = _ecef("tlat", "tlon", "coalesce(tele, 0)"), _ecef("lat", "lon", "coalesce(ele, 0)")
_REL = f"""SELECT *, fmod(degrees(atan2(east_m, north_m)) + 360, 360) AS bearing_deg, sqrt(pow(horizontal_m, 2) + pow(up_m, 2)) AS slant_m FROM (SELECT *, sqrt(pow(east_m, 2) + pow(north_m, 2)) AS horizontal_m FROM (
  SELECT *, -sin(radians(lon)) * dx + cos(radians(lon)) * dy AS east_m, -sin(radians(lat)) * cos(radians(lon)) * dx - sin(radians(lat)) * sin(radians(lon)) * dy + cos(radians(lat)) * dz AS north_m, cos(radians(lat)) * cos(radians(lon)) * dx + cos(radians(lat)) * sin(radians(lon)) * dy + sin(radians(lat)) * dz AS up_m, tele - ele AS altitude_separation_m
  FROM (SELECT *, {_T[0]} - {_O[0]} AS dx, {_T[1]} - {_O[1]} AS dy, {_T[2]} - {_O[2]} AS dz FROM ({_NEAR}))))"""
_rel = lambda df, chunk=None: J.relative_position(J.align_nearest(*_pair(df), 3000, chunk=chunk))
_aligned("relative_position", lambda df, chunk: _rel(df, chunk).select("pair", "ref_seq", "east_m", "north_m", "up_m", "horizontal_m", "slant_m", "bearing_deg", "altitude_separation_m", "closure_mps"), f"SELECT pair, ref_seq, east_m, north_m, up_m, horizontal_m, slant_m, bearing_deg, altitude_separation_m, CASE WHEN ref_time > lag(ref_time) OVER w THEN (lag(slant_m) OVER w - slant_m) / ((ref_time - lag(ref_time) OVER w) / 1000) END AS closure_mps FROM ({_REL}) WINDOW w AS (PARTITION BY pair ORDER BY ref_seq)", "east_m north_m up_m horizontal_m slant_m bearing_deg altitude_separation_m closure_mps", 4)
_aligned("clock_drift", lambda df, chunk: J.clock_drift(J.align_nearest(*_pair(df), 3000, chunk=chunk)), f"SELECT pair, count(*) AS n, regr_intercept(y, x) AS offset_ms, regr_slope(y, x) AS drift_ms_per_s FROM (SELECT pair, (ref_time - arg_min(ref_time, ref_seq) OVER (PARTITION BY pair)) / 1000 AS x, tgt_time - ref_time AS y FROM ({_NEAR})) GROUP BY pair", "offset_ms drift_ms_per_s", 4)
_aligned("closest_approach", lambda df, chunk: J.closest_approach(_rel(df, chunk)).select("pair", "ref_seq", "tgt_seq", "slant_m"), f"SELECT pair, ref_seq, tgt_seq, slant_m FROM ({_REL}) QUALIFY row_number() OVER (PARTITION BY pair ORDER BY slant_m, ref_seq) = 1", "slant_m", 4)
_aligned("comparison_range_stats", lambda df, chunk: X.comparison_range_stats(_rel(df, chunk)), f"SELECT pair, count(*) AS n, min(slant_m) AS min_slant, max(slant_m) AS max_slant, avg(slant_m) AS mean_slant, avg(horizontal_m) AS mean_horizontal, avg(closure) AS mean_closure FROM (SELECT *, CASE WHEN ref_time > lag(ref_time) OVER w THEN (lag(slant_m) OVER w - slant_m) / ((ref_time - lag(ref_time) OVER w) / 1000) END AS closure FROM ({_REL}) WINDOW w AS (PARTITION BY pair ORDER BY ref_seq)) GROUP BY pair", "min_slant max_slant mean_slant mean_horizontal mean_closure", 3)
_add("track_diff", lambda df: J.track_diff(df, P.shift_time(P.delete_points(df, df.filter("seq % 10 = 0")), 1)), "SELECT track_id, count(*) AS n_before, count(*) FILTER (WHERE seq % 10 <> 0) AS n_after, count(*) FILTER (WHERE seq % 10 <> 0 AND time_ms IS NOT NULL) AS n_modified, max(CASE WHEN seq % 10 <> 0 AND time_ms IS NOT NULL THEN 1000.0::DOUBLE END) AS max_time_shift_ms FROM points GROUP BY track_id", "max_time_shift_ms")
_renumbered = lambda df: df.withColumn("seq", F.row_number().over(Window.partitionBy("track_id").orderBy("seq")) - 1)
_add("track_diff_ordered", lambda df: J.track_diff_ordered(df, _renumbered(P.delete_points(df, df.filter("seq % 10 = 0")))), f"SELECT track_id, 'subsequence' AS alignment, count(*) AS n_before, count(*) FILTER (WHERE seq % 10 > 0) AS n_after, count(*) FILTER (WHERE seq % 10 > 0) AS unchanged, 0::BIGINT AS modified, 0::BIGINT AS added, count(*) FILTER (WHERE seq % 10 = 0) AS removed, true AS position, true AS elevation, true AS time, false AS channels, 0.0::DOUBLE AS max_position_shift_m, 0.0::DOUBLE AS max_elevation_shift_m, 0.0::DOUBLE AS max_time_shift_ms FROM points GROUP BY track_id")
_edited = lambda df: df.withColumns({"ele": F.when(F.col("seq") % 7 == 0, F.col("ele") + 1).otherwise(F.col("ele")), "hdop": F.when(F.col("track_id") == "T3", F.col("hdop") + 1).otherwise(F.col("hdop"))})
_add("track_diff_indexed", lambda df: J.track_diff_ordered(demote(df, "hdop"), demote(_edited(df), "hdop")), f"SELECT track_id, 'index' AS alignment, count(*) AS n_before, count(*) AS n_after, count(*) - count(*) FILTER (WHERE seq % 7 = 0 AND ele IS NOT NULL) AS unchanged, count(*) FILTER (WHERE seq % 7 = 0 AND ele IS NOT NULL) AS modified, 0::BIGINT AS added, 0::BIGINT AS removed, false AS position, true AS elevation, false AS time, track_id = 'T3' AS channels, 0.0::DOUBLE AS max_position_shift_m, 1.0::DOUBLE AS max_elevation_shift_m, 0.0::DOUBLE AS max_time_shift_ms FROM points GROUP BY track_id", "max_elevation_shift_m")
for _name, _chunk in (("position_at_time", None), ("position_at_time_all", 50)):
    _add(
        _name,
        lambda df, chunk=_chunk: J.position_at_time(P.drop_invalid(df), df.filter("time_ms is not null").select("track_id", (F.col("time_ms") + 100).alias("at_ms")), 20000.0, chunk),
        f"""SELECT track_id, at_ms, CASE WHEN b.t = at_ms THEN b.lat ELSE a.lat + (b.lat - a.lat) * ((at_ms - a.t) / (b.t - a.t)) END AS lat, CASE WHEN b.t = at_ms THEN b.lon ELSE a.lon + (b.lon - a.lon) * ((at_ms - a.t) / (b.t - a.t)) END AS lon, CASE WHEN b.t = at_ms THEN b.ele ELSE a.ele + (b.ele - a.ele) * ((at_ms - a.t) / (b.t - a.t)) END AS ele, b.t <> at_ms AS derived FROM (
          SELECT q.track_id, q.at_ms, (SELECT arg_max({{'t': p.time_ms, 'lat': p.lat, 'lon': p.lon, 'ele': p.ele}}, (p.time_ms, p.seq)) FROM points p WHERE p.track_id = q.track_id AND {sql_valid("p.lat", "p.lon")} AND p.time_ms < q.at_ms) AS a, (SELECT arg_min({{'t': p.time_ms, 'lat': p.lat, 'lon': p.lon, 'ele': p.ele}}, (p.time_ms, p.seq)) FROM points p WHERE p.track_id = q.track_id AND {sql_valid("p.lat", "p.lon")} AND p.time_ms >= q.at_ms) AS b
          FROM (SELECT track_id, time_ms + 100 AS at_ms FROM points WHERE time_ms IS NOT NULL) q) WHERE b IS NOT NULL AND (b.t = at_ms OR (a IS NOT NULL AND b.t - a.t <= 20000))""",
        "at_ms lat lon ele",
    )

# Grids, gaps and fusion.
_add(
    "resample_fixed_rate",
    lambda df: R.resample_fixed_rate(df, 0.5, duplicates="first").select("track_id", "seq", "time_ms", "lat", "ele", "flags"),
    """SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS seq, t AS time_ms, CASE WHEN t = b.t THEN b.lat ELSE a.lat + (b.lat - a.lat) * ((t - a.t) / (b.t - a.t)) END AS lat, CASE WHEN t = b.t THEN b.ele WHEN a.ele IS NULL OR b.ele IS NULL THEN coalesce(a.ele, b.ele) ELSE a.ele + (b.ele - a.ele) * ((t - a.t) / (b.t - a.t)) END AS ele, CASE WHEN t = b.t THEN '' ELSE 'interpolated' END AS flags FROM (
      SELECT g.track_id, g.t, s.a, s.b FROM (
        SELECT track_id, least(t1, t0 + k * 2000) AS t FROM (SELECT track_id, t0, t1, unnest(range(0, floor((t1 - t0) / 2000)::BIGINT + 1)) AS k FROM (SELECT track_id, min(time_ms) AS t0, max(time_ms) AS t1 FROM points GROUP BY track_id)) UNION SELECT track_id, max(time_ms) FROM points GROUP BY track_id) g
      JOIN (SELECT track_id, lag(p) OVER v AS a, p AS b FROM (SELECT track_id, time_ms, {'t': time_ms, 'lat': lat, 'ele': ele} AS p FROM points WHERE time_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY track_id, time_ms ORDER BY seq) = 1) WINDOW v AS (PARTITION BY track_id ORDER BY time_ms)) s
      ON g.track_id = s.track_id AND g.t <= s.b.t AND (s.a IS NULL AND g.t = s.b.t OR g.t > s.a.t))""",
    "time_ms lat ele",
    5,
)
_add(
    "notional_fill",
    lambda df: R.notional_fill(df, 20000.0, 5000.0).filter(F.array_contains("flags", "notional")).select("track_id", "time_ms", "lat", "ele"),
    f"""SELECT track_id, floor(pt + (time_ms - pt) * (k / (n + 1)) + 0.5) AS time_ms, plat + (lat - plat) * (k / (n + 1)) AS lat, pele + (ele - pele) * (k / (n + 1)) AS ele FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM (SELECT *, (floor((time_ms - pt) / 5000) - 1)::BIGINT AS n FROM ({_PREV}) WHERE time_ms - pt > 20000))""",
    "time_ms lat ele",
    5,
)
_add("resample_by_distance", lambda df: R.resample_by_distance(df, 5000.0).filter("distance_m % 5000 = 0").groupBy("track_id").agg(F.count("*").alias("n"), F.max("distance_m").alias("last_m")), f"SELECT track_id, floor(d / 5000.0)::BIGINT + 1 AS n, floor(d / 5000) * 5000 AS last_m FROM (SELECT track_id, sum(coalesce(leg, 0)) AS d FROM (SELECT track_id, {sql_haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS leg FROM points WHERE {sql_valid()} {W_SQL}) GROUP BY track_id)", "last_m")
_add("resample_by_distance_points", lambda df: R.resample_by_distance(df, 5000.0))


def _all_sources(df: DataFrame) -> DataFrame:
    """All tracks, in threes: T0 to T2 are of entity E0, and so on."""
    number = F.substring("track_id", 2, 10).cast("int")
    return df.select("track_id").distinct().select("track_id", F.concat(F.lit("E"), F.floor(number / 3).cast("string")).alias("entity"), (number % 3 + 1).alias("priority"))


_groups = lambda df, chunk=None: U.group_by_time(U.fusion_candidates(df, _all_sources(df)), 1500, chunk)
_CAND = f"SELECT 'E' || (n // 3) AS entity, track_id AS source, (n % 3 + 1)::INT AS priority, seq, time_ms, hdop, sat, lat FROM (SELECT *, substr(track_id, 2)::INT AS n FROM points WHERE time_ms IS NOT NULL AND {sql_valid()})"
for _name in ("fusion_candidates", "fusion_candidates_all"):
    _add(_name, lambda df: U.fusion_candidates(df, _all_sources(df)).select("entity", "source", "priority", "seq", "time_ms"), f"SELECT entity, source, priority, seq, time_ms FROM ({_CAND})", "time_ms")
_GROUPED = f"""c AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY time_ms, source, seq) AS o FROM ({_CAND})),
  g AS (SELECT entity, o, time_ms AS anchor, 0::BIGINT AS group_id FROM c WHERE o = 1 UNION ALL SELECT c.entity, c.o, CASE WHEN c.time_ms - g.anchor > 1500 THEN c.time_ms ELSE g.anchor END, g.group_id + (c.time_ms - g.anchor > 1500)::INT FROM g JOIN c ON c.entity = g.entity AND c.o = g.o + 1),
  s AS (SELECT c.*, g.group_id, avg(time_ms) OVER (PARTITION BY c.entity, g.group_id) AS mean FROM c JOIN g USING (entity, o)),
  d AS (SELECT *, priority * 100 + greatest(0, least(10, 10 - hdop)) + least(sat, 12) * 0.5 - abs(time_ms - mean) / 1000 AS score FROM s),
  k AS (SELECT *, row_number() OVER (PARTITION BY entity, group_id ORDER BY score DESC, source, time_ms, seq) AS rank FROM d),
  w AS (SELECT entity, group_id, any_value(mean) AS group_time_ms, max(source) FILTER (WHERE rank = 1) AS chosen, count(*) AS n, CASE WHEN count(*) = 1 THEN 1.0 ELSE greatest(0.5, least(1.0, 0.5 + (max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2)) / 100)) END AS confidence FROM k GROUP BY entity, group_id),
  f AS (SELECT w.*, x.seq, x.time_ms FROM w JOIN (SELECT *, row_number() OVER (PARTITION BY entity, group_id, source ORDER BY time_ms, source, seq) AS i FROM k) x ON x.entity = w.entity AND x.group_id = w.group_id AND x.source = w.chosen AND x.i = 1)"""


def _fused(name: str, run, sql: str, doubles: str, digits: int = 6) -> None:
    _add(name, run, sql, doubles, digits, recursive=True)
    ORACLE_SQL[name] = ORACLE_SQL[name].replace("SELECT * ", f", {_GROUPED} SELECT * ", 1)


_decided = lambda df: U.auto_combine(_groups(df))
_fused("fusion_groups", lambda df: _groups(df).groupBy("entity", "group_id").agg(F.count("*").alias("n"), F.min("time_ms").alias("anchor"), F.avg("time_ms").alias("mean_ms")), "SELECT entity, group_id, count(*) AS n, min(time_ms) AS anchor, avg(time_ms) AS mean_ms FROM s GROUP BY entity, group_id", "anchor mean_ms")
_fused("fusion_groups_in_islands", lambda df: _groups(df, 100).groupBy("entity", "group_id").agg(F.count("*").alias("n"), F.min("time_ms").alias("anchor"), F.avg("time_ms").alias("mean_ms")), "SELECT entity, group_id, count(*) AS n, min(time_ms) AS anchor, avg(time_ms) AS mean_ms FROM s GROUP BY entity, group_id", "anchor mean_ms")
_fused("fusion_decisions", lambda df: _decided(df).select("entity", "group_id", "group_time_ms", "chosen", "seq", "time_ms", "n", "confidence", F.size("skipped").alias("n_skipped")), "SELECT entity, group_id, group_time_ms, chosen, seq, time_ms, n, confidence, (n - 1)::INT AS n_skipped FROM f", "group_time_ms time_ms confidence", 4)
_fused("fusion_report", lambda df: U.fusion_report(_decided(df), _all_sources(df)), """SELECT entity, source, coalesce(chosen, 0) AS chosen, total - coalesce(chosen, 0) AS skipped, groups, mean_confidence FROM (SELECT entity, source, count(*) AS total FROM c GROUP BY entity, source)
  LEFT JOIN (SELECT entity, chosen AS source, count(*) AS chosen FROM f GROUP BY entity, chosen) USING (entity, source) JOIN (SELECT entity, count(*) AS groups, avg(confidence) AS mean_confidence FROM f GROUP BY entity) USING (entity)""", "mean_confidence", 4)
_add("check_fusion", lambda df: U.check_fusion(_decided(df), _all_sources(df), 1500.0), "SELECT NULL::VARCHAR AS entity, NULL::BIGINT AS group_id, NULL::VARCHAR AS problem WHERE false", with_points=False)
_fused("fusion_overrides", lambda df: U.auto_combine(_groups(df), None, [("E0", "T1", 0.0, 4e12), ("E2", "T8", 1.704068e12, 1.7040682e12)]).select("entity", "group_id", "chosen", "confidence"), """SELECT w.entity, w.group_id, coalesce(o.source, chosen) AS chosen, CASE WHEN o.source IS NULL THEN confidence ELSE 1.0 END AS confidence FROM w LEFT JOIN (SELECT DISTINCT k.entity, k.group_id, k.source FROM k JOIN w USING (entity, group_id) WHERE entity = 'E0' AND source = 'T1' OR entity = 'E2' AND source = 'T8' AND group_time_ms BETWEEN 1.704068e12 AND 1.7040682e12) o ON o.entity = w.entity AND o.group_id = w.group_id""", "confidence", 4)
_broken = lambda df: _decided(df).withColumns({"confidence": F.when(F.col("group_id") % 50 == 7, 2.0).otherwise(F.col("confidence")), "reason": F.when(F.col("group_id") % 50 == 9, " ").otherwise(F.col("reason")), "chosen": F.when(F.col("group_id") % 50 == 11, "nobody").otherwise(F.col("chosen"))})
_fused("check_fusion_of_broken_ones", lambda df: U.check_fusion(_broken(df), _all_sources(df), 1500.0), "SELECT entity, group_id, CASE group_id % 50 WHEN 7 THEN 'a confidence outside 0 to 1' WHEN 9 THEN 'no reason' ELSE 'an unknown source' END AS problem FROM w WHERE group_id % 50 IN (7, 9, 11)", "")
_fused("fused_points", lambda df: U.fused_points(_decided(df)).select("track_id", "seq", "time_ms", F.col("source_segment").alias("source")), "SELECT entity AS track_id, row_number() OVER (PARTITION BY entity ORDER BY group_time_ms, group_id) - 1 AS seq, time_ms, chosen AS source FROM f", "time_ms")
_add("round_up", lambda df: df.select("track_id", "seq", round_up(F.col("ele") - 100, 0).alias("r")), "SELECT track_id, seq, floor(ele - 100 + 0.5) AS r FROM points", "r")

# Health.
_CHECKS = {
    "health_schema": (H.schema_check, f"SELECT track_id, 'schema-parse' AS \"check\", 0 AS weight, true AS applicable, m >= 0.5 AS passed, m AS measure FROM (SELECT track_id, avg({sql_valid()}::INT) AS m FROM points GROUP BY track_id)"),
    "health_time_order": (H.time_check, """SELECT track_id, 'time-order-span' AS "check", 20 AS weight, n >= 2 AS applicable, back = 0 AND span BETWEEN 600000 AND 43200000 AS passed, span AS measure FROM (
      SELECT track_id, count(*) AS n, sum(back) AS back, arg_max(time_ms, seq) - arg_min(time_ms, seq) AS span FROM (SELECT *, coalesce(time_ms < lag(time_ms) OVER (PARTITION BY track_id ORDER BY seq), false)::INT AS back FROM points WHERE time_ms IS NOT NULL) GROUP BY track_id)"""),
    "health_gps_fix": (H.fix_check, "SELECT track_id, 'gps-fix-quality' AS \"check\", 0 AS weight, true AS applicable, avg((hdop > 5 OR sat < 4)::INT) <= 0.1 AS passed, avg((hdop > 5 OR sat < 4)::INT) AS measure FROM points GROUP BY track_id"),
    "health_outliers": (H.outlier_check, f"SELECT track_id, 'outlier' AS \"check\", 20 AS weight, true AS applicable, avg((score > 3)::INT) <= 0.05 AS passed, avg((score > 3)::INT) AS measure FROM ({_OUT.replace('least(max(speed) FILTER (WHERE speed > 0), 680)', 'max(speed) FILTER (WHERE speed > 0)')}) GROUP BY track_id"),
    "health_speed": (H.speed_check, f"SELECT track_id, 'speed-envelope' AS \"check\", 10 AS weight, m IS NOT NULL AS applicable, CASE WHEN m IS NOT NULL THEN m <= 0.02 END AS passed, m AS measure FROM (SELECT track_id, avg(CASE WHEN i BETWEEN greatest(start_seq, floor(n * 0.2)) AND end_seq AND speed IS NOT NULL THEN (speed < 5.144 OR speed > 680.7)::INT END) AS m FROM (SELECT track_id, speed, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM ({_KIN2})) JOIN ({_move(5.144)}) USING (track_id) GROUP BY track_id)"),
    "health_altitude": (H.altitude_check, """SELECT track_id, 'altitude-profile' AS "check", 30 AS weight, cover >= 0.8 AS applicable, CASE WHEN cover >= 0.8 THEN coalesce(fr > 0 AND fr < n * 0.9 AND til < n - 1 AND held >= total * 0.1 AND abs(b - a) <= greatest(100, 0.15 * greatest(0, top - 304.8)), false) END AS passed, len::DOUBLE AS measure FROM (
      SELECT e.*, r.len, r.fr, r.til, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN t1 - t0 ELSE n END AS total, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL AND s0 IS NOT NULL AND s1 IS NOT NULL THEN s1 - s0 ELSE len END AS held FROM (
        SELECT track_id, any_value(cover) AS cover, any_value(n) AS n, max(ele) AS top, median(ele) FILTER (WHERE i < 5) AS a, median(ele) FILTER (WHERE i >= n - 5) AS b, arg_min_null(time_ms, i) AS t0, arg_max_null(time_ms, i) AS t1 FROM (
          SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM (SELECT *, avg((ele IS NOT NULL)::INT) OVER (PARTITION BY track_id) AS cover FROM points) WHERE ele IS NOT NULL) GROUP BY track_id) e
      LEFT JOIN (SELECT track_id, count(*) AS len, min(i) AS fr, max(i) AS til, arg_min_null(time_ms, i) AS s0, arg_max_null(time_ms, i) AS s1 FROM (
        SELECT *, i - row_number() OVER (PARTITION BY track_id ORDER BY i) AS run FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS i FROM points WHERE ele IS NOT NULL) WHERE ele >= 304.8)
        GROUP BY track_id, run QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY len DESC, fr) = 1) r USING (track_id))"""),
    "health_stagnant": (H.stagnant_check, f"""SELECT track_id, 'stagnant' AS "check", 20 AS weight, m IS NOT NULL AS applicable, m <= 180000 AS passed, m AS measure FROM (SELECT track_id, max(dwell) AS m FROM (
      WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS k FROM (SELECT p.*, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS i FROM points p) JOIN ({_move(5.144)}) USING (track_id) WHERE i BETWEEN start_seq AND end_seq),
      g AS (SELECT track_id, k, CASE WHEN time_ms IS NOT NULL THEN {{'a': lat, 'o': lon, 't': time_ms}} END AS anchor, 0.0::DOUBLE AS dwell FROM q WHERE k = 0 UNION ALL
        SELECT track_id, k, CASE WHEN near THEN anchor WHEN time_ms IS NOT NULL THEN {{'a': lat, 'o': lon, 't': time_ms}} END, CASE WHEN near THEN coalesce(time_ms - anchor.t, 0) ELSE 0 END FROM (SELECT q.track_id, q.k, q.lat, q.lon, q.time_ms, g.anchor, coalesce({sql_haversine("g.anchor.a", "g.anchor.o", "q.lat", "q.lon")} <= 402.34, false) AS near FROM g JOIN q ON q.track_id = g.track_id AND q.k = g.k + 1))
      SELECT * FROM g) GROUP BY track_id)"""),
}
for _name, (_run, _sql) in _CHECKS.items():
    _add(_name, _run, _sql, "measure", recursive=True)
_ALL = " UNION ALL ".join(f"SELECT track_id, \"check\", weight, applicable, passed, measure FROM ({x})" for _, x in _CHECKS.values())
_add("health_checks", H.health_checks, _ALL, "measure", recursive=True)
_add("track_health", H.track_health, f"""SELECT track_id, CASE WHEN NOT blocked AND total > 0 THEN floor(100.0 * coalesce(earned, 0) / total + 0.5)::INT END AS score, blocked FROM (
  SELECT track_id, sum(weight) FILTER (WHERE applicable AND weight > 0) AS total, sum(weight) FILTER (WHERE applicable AND weight > 0 AND passed) AS earned, bool_or("check" = 'schema-parse' AND NOT passed) AS blocked FROM ({_ALL}) GROUP BY track_id)""", recursive=True)

_OUTLIERS = _OUT.replace("least(max(speed) FILTER (WHERE speed > 0), 680)", "max(speed) FILTER (WHERE speed > 0)")
_add("health_flags", lambda df: H.health_flags(df).filter(F.col("check").isin("schema-parse", "time-order-span", "gps-fix-quality", "outlier")).select("track_id", "check", "start_seq", "end_seq"), f"""
  SELECT track_id, "check", seq AS start_seq, seq AS end_seq FROM (
    SELECT track_id, seq, 'schema-parse' AS "check" FROM points WHERE NOT {sql_valid()}
    UNION ALL SELECT track_id, seq, 'time-order-span' FROM (SELECT *, time_ms < lag(time_ms) OVER w AS back FROM points WHERE time_ms IS NOT NULL {W_SQL}) WHERE back
    UNION ALL SELECT track_id, seq, 'gps-fix-quality' FROM points WHERE hdop > 5 OR sat < 4
    UNION ALL SELECT track_id, seq, 'outlier' FROM ({_OUTLIERS}) WHERE score > 3)""")

# Views and recipes.
_add("chart_series", lambda df: S.chart_series(df, "ele", domain=(1704068000000, 1704069000000)), "SELECT track_id, seq, x, y FROM (SELECT *, lag(i, 1, false) OVER w OR lead(i, 1, false) OVER w OR i AS keep FROM (SELECT track_id, seq, time_ms AS x, ele AS y, time_ms BETWEEN 1704068000000 AND 1704069000000 AS i FROM points WHERE time_ms IS NOT NULL AND ele IS NOT NULL) WINDOW w AS (PARTITION BY track_id ORDER BY seq)) WHERE keep", "x y", 3)
_add("x_domain", lambda df: S.x_domain(df, "ele"), "SELECT track_id, min(ele) AS low, CASE WHEN min(ele) = max(ele) THEN max(ele) + 1 ELSE max(ele) END AS high FROM points GROUP BY track_id", "low high")
_add("uniform_sample", lambda df: S.uniform_sample(df, 50).select("track_id", "seq"), "SELECT DISTINCT track_id, floor(k * (n - 1) / 49.0 + 0.5)::BIGINT AS seq FROM (SELECT track_id, count(*) AS n, unnest(range(0, 50)) AS k FROM points GROUP BY track_id)")
_add("neighbourhood", lambda df: S.neighbourhood(df, df.filter("seq % 100 = 50").select("track_id", "seq"), 3).select("track_id", "center", "seq"), "SELECT p.track_id, c.seq AS center, p.seq FROM points p JOIN points c ON p.track_id = c.track_id AND c.seq % 100 = 50 AND p.seq BETWEEN c.seq - 3 AND c.seq + 3")
_add("quality_strip", lambda df: S.quality_strip(df, W.quality_events(df), 100), f"SELECT p.track_id, floor(p.seq * least(100, p.n) / p.n)::BIGINT AS bucket, coalesce(max(h.r), 0) AS severity FROM (SELECT track_id, seq, count(*) OVER (PARTITION BY track_id) AS n FROM points) p LEFT JOIN (SELECT track_id, unnest(range(start_seq, end_seq + 1)) AS seq, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS r FROM ({_EVENTS})) h ON p.track_id = h.track_id AND p.seq = h.seq GROUP BY ALL")
_add("disclosure_counts", lambda df: S.disclosure_counts(P.add_flag(R.notional_fill(df, 20000.0, 5000.0), "manual_edit", F.col("ele") > 900)), f"SELECT track_id, sum(notional) AS notional, sum(edited) AS edited FROM (SELECT track_id, 0 AS notional, coalesce(ele > 900, false)::INT AS edited FROM points UNION ALL SELECT track_id, 1, coalesce(pele + (ele - pele) * (k / (n + 1)) > 900, false)::INT FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM (SELECT *, (floor((time_ms - pt) / 5000) - 1)::BIGINT AS n FROM ({_PREV}) WHERE time_ms - pt > 20000))) GROUP BY track_id")
_add("chart_capability", S.chart_capability, "SELECT track_id, count(time_ms) > 0 AS timed, (count(ele) > 0)::INT + (count(hdop) > 0)::INT + (count(sat) > 0)::INT AS numeric, (count(ele) > 0)::INT + (count(hdop) > 0)::INT + (count(sat) > 0)::INT >= 2 AS scatter, count(time_ms) > 0 AND count(ele) + count(hdop) + count(sat) > 0 AS area, 'timeSeries' AS best FROM points GROUP BY track_id")
_ENU_T, _ENU_O = _ecef("lat", "lon", "coalesce(ele, oh)"), _ecef("ola", "olo", "oh")
_add(
    "trajectory_enu",
    S.trajectory_enu,
    f"""SELECT track_id, seq, -sin(radians(olo)) * dx + cos(radians(olo)) * dy AS east_m, -sin(radians(ola)) * cos(radians(olo)) * dx - sin(radians(ola)) * sin(radians(olo)) * dy + cos(radians(ola)) * dz AS north_m, cos(radians(ola)) * cos(radians(olo)) * dx + cos(radians(ola)) * sin(radians(olo)) * dy + sin(radians(ola)) * dz AS up_m FROM (
      SELECT *, {_ENU_T[0]} - {_ENU_O[0]} AS dx, {_ENU_T[1]} - {_ENU_O[1]} AS dy, {_ENU_T[2]} - {_ENU_O[2]} AS dz FROM (SELECT *, first_value(lat) OVER w AS ola, first_value(lon) OVER w AS olo, first_value(coalesce(ele, 0)) OVER w AS oh FROM points WHERE {sql_valid()} {W_SQL}))""",
    "east_m north_m up_m",
    4,
)
_RECIPE = [Record("drop-invalid", 1, {}), Record("shift-time", 1, {"seconds": 1.5}), Record("decimate", 1, {"factor": 5})]
_add("recipe_replay", lambda df: replay(df, _RECIPE).select("track_id", "seq", "time_ms"), f"SELECT track_id, seq, time_ms + 1500 AS time_ms FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM points WHERE {sql_valid()}) WHERE i % 5 = 0 OR i = n - 1", "time_ms")
