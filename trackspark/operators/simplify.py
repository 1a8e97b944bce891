"""Douglas-Peucker: of a stretch between two kept points the farthest point stays, if it is far enough, and parts it.

Stretches of up to LOCAL points are finished where they meet, in one task. Longer ones are parted in rounds: one aggregate
finds the farthest point of every open stretch of every track, and their points learn which part they are in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M
from ..plans.folders import work_folder

#: Points of a stretch that one task finishes.
LOCAL = 1 << 18


def kept_of(x: np.ndarray, y: np.ndarray, epsilon_m: float) -> np.ndarray:
    """Whether each point of a stretch stays; its ends do."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        size = dx * dx + dy * dy
        u = np.clip((px * dx + py * dy) / size, 0, 1) if size else np.zeros(b - a - 1)
        d = np.hypot(px - u * dx, py - u * dy)
        i = int(d.argmax())
        if d[i] > max(0.0, epsilon_m):
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def _plane(lat: Column, lon: Column, middle: Column) -> tuple[Column, Column]:
    """Metres east and north on a plane that fits at the middle latitude (radians)."""
    return F.radians(lon) * EARTH_RADIUS_M * F.cos(middle), F.radians(lat) * EARTH_RADIUS_M


def _off(a: str, b: str) -> Column:
    """How far a point is from the line between two others; NaN where one has no place."""
    px, py, dx, dy = F.col("x") - F.col(f"{a}.x"), F.col("y") - F.col(f"{a}.y"), F.col(f"{b}.x") - F.col(f"{a}.x"), F.col(f"{b}.y") - F.col(f"{a}.y")
    size = dx * dx + dy * dy
    along = (px * dx + py * dy) / F.nullif(size, F.lit(0.0))
    u = F.when(F.isnan(along), along).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), along)), F.lit(0.0)))
    return F.hypot(px - u * dx, py - u * dy)


def _stored(df: DataFrame) -> DataFrame:
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _whole(df: DataFrame, epsilon_m: float) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        if len(rows) < 3:
            return rows
        lat, lon = np.radians(rows["lat"].to_numpy(float)), np.radians(rows["lon"].to_numpy(float))
        return rows[kept_of(lon * EARTH_RADIUS_M * np.cos(lat.mean()), lat * EARTH_RADIUS_M, epsilon_m)]

    return df.groupBy("track_id").applyInPandas(run, df.schema)


def simplify(df: DataFrame, epsilon_m: float, local: int | None = None) -> DataFrame:
    """Douglas-Peucker in local metres. Ends stay; fewer than 3 points stay; of equally far points the first parts.

    A track with a point without a place keeps its ends. Tracks of more than local points are parted in rounds, as many
    as parts lie within each other until none is longer; seq is unique in those.
    """
    local = local or LOCAL
    place = F.coalesce(F.radians("lat"), F.lit(float("nan")))
    sizes = _stored(df.groupBy("track_id").agg(F.count("*").alias("n"), F.avg(place).alias("middle")))
    long = sizes.filter(F.col("n") > local)
    if long.isEmpty():
        return _whole(df, epsilon_m)
    names = sizes.filter(F.col("n") > local).select(F.col("track_id").alias("of"), "middle")
    match = F.col("track_id").eqNullSafe(F.col("of"))
    x, y = _plane(F.coalesce("lat", F.lit(float("nan"))), F.coalesce("lon", F.lit(float("nan"))), F.col("middle"))
    points = df.select("track_id", "seq", "lat", "lon").join(names, match).select("track_id", "seq", x.alias("x"), y.alias("y"))
    here = F.struct("seq", "x", "y")
    ends = points.groupBy(F.col("track_id").alias("of")).agg(F.min_by(here, "seq").alias("a"), F.max_by(here, "seq").alias("b"))
    inner = points.join(ends, match).filter((F.col("seq") > F.col("a.seq")) & (F.col("seq") < F.col("b.seq"))).drop("of")
    kept = [ends.select(F.col("of").alias("track_id"), F.explode(F.array("a.seq", "b.seq")).alias("seq"))]
    ready, inner = [], _stored(inner)
    while True:
        d = F.col("d")
        far = inner.withColumn("d", _off("a", "b")).groupBy(F.col("track_id").alias("of"), F.col("a.seq").alias("from")).agg(F.count("*").alias("n"), F.max_by(F.struct("d", here.alias("m")), F.struct("d", -F.col("seq"))).alias("f"))
        far = _stored(far.select("of", "from", "n", "f.d", "f.m"))
        parts = inner.join(far.withColumn("parts", (d > max(0.0, epsilon_m)) & ~F.isnan(d)), match & (F.col("a.seq") == F.col("from")))
        ready.append(parts.filter(F.col("n") <= local).select(*inner.columns))
        open_ = far.filter((F.col("n") > local) & (d > max(0.0, epsilon_m)) & ~F.isnan(d))
        if open_.isEmpty():
            break
        kept.append(open_.select(F.col("of").alias("track_id"), F.col("m.seq").alias("seq")))
        on = parts.filter((F.col("n") > local) & F.col("parts") & (F.col("seq") != F.col("m.seq")))
        left = F.col("seq") < F.col("m.seq")
        inner = _stored(on.select("track_id", "seq", "x", "y", F.when(left, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(left, F.col("m")).otherwise(F.col("b")).alias("b")))

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        a, b = rows["a"].iloc[0], rows["b"].iloc[0]
        xs, ys = (np.concatenate([[a[c]], rows[c].to_numpy(float), [b[c]]]) for c in ("x", "y"))
        return rows.loc[kept_of(xs, ys, epsilon_m)[1:-1], ["track_id", "seq"]]

    rest = ready[0]
    for more in ready[1:]:
        rest = rest.union(more)
    done = rest.groupBy("track_id", F.col("a.seq")).applyInPandas(finish, df.select("track_id", "seq").schema)
    for more in kept:
        done = done.union(more)
    stay = done.select(F.col("track_id").alias("of"), F.col("seq").alias("place"))
    short = df.join(names.select("of"), match, "left_anti")
    return df.join(stay, match & (F.col("seq") == F.col("place")), "left_semi").union(_whole(short, epsilon_m))
