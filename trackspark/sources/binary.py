"""Binary containers: packed points (GPB) and range recordings (P5).

Files are read by ranges of records and decoded in numpy, so that one of any size is many tasks; they can also be given as
rows (track_id, content).
"""

from __future__ import annotations

import re
import struct
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import enu_to_geodetic
from ..plans.scan import gathered
from ..schema import conform, number_map
from .files import _MONTHS, DAY_MS
from .ranges import LAYOUTS, Layout, read_records, write_packed
from .sinks import _full, channel_names

#: Fixed values of the packed container.
GPB_MAGIC, GPB_TIME, GPB_ELE = b"GPB1", 1, 2


def encode_gpb(df: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """(track_id, content): one packed container for each track, which is held in memory. What a point lacks is written as 0."""
    df = _full(df)
    names = channel_names(df) if channels is None else channels
    rows = df.select("track_id", "seq", "lat", "lon", "ele", "time_ms", *(F.coalesce(F.col("ext_num")[c], F.col("ext_str")[c].try_cast("double")).alias(f"c{i}") for i, c in enumerate(names)))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        timed, high = bool(rows["time_ms"].notna().any()), bool(rows["ele"].notna().any())
        fields = [("lat", "<f8"), ("lon", "<f8"), *[("ele", "<f4")] * high, *[("time_ms", "<f8")] * timed, *((f"c{i}", "<f4") for i in range(len(names)))]
        out = np.zeros(len(rows), fields)
        for name, _ in fields:
            out[name] = rows[name].to_numpy(float) if name in ("lat", "lon") else np.nan_to_num(rows[name].to_numpy(float))
        name = str(rows["track_id"].iloc[0]).encode()
        head = [GPB_MAGIC, struct.pack("<BBH", 1, GPB_TIME * timed + GPB_ELE * high, len(name)), name, struct.pack("<H", len(names))]
        head += [struct.pack("<B", len(c.encode())) + c.encode() for c in names]
        return pd.DataFrame({"track_id": rows["track_id"].iloc[:1], "content": [b"".join([*head, struct.pack("<I", len(rows)), out.tobytes()])]})

    return rows.groupBy("track_id").applyInPandas(pack, "track_id string, content binary")


def _gpb_fields(flags: int, channels: int) -> np.dtype:
    return np.dtype([("lat", "<f8"), ("lon", "<f8"), *[("ele", "<f4")] * bool(flags & GPB_ELE), *[("time_ms", "<f8")] * bool(flags & GPB_TIME), *((f"c{i}", "<f4") for i in range(channels))])


class _Short(ValueError):
    pass


def _gpb_head(raw: bytes) -> tuple[list[str], np.dtype, int, int]:
    """(channels, record, count, bytes of the head) of a container's first bytes; ValueError where it is none or cut short."""
    if raw[:4] != GPB_MAGIC:
        raise ValueError("no GPB1 at the start")
    try:
        version, flags, n = struct.unpack_from("<BBH", raw, 4)
        at, channels = 8 + n, []
        (many,) = struct.unpack_from("<H", raw, at)
        at += 2
        for _ in range(many):
            size = raw[at]
            channels.append(raw[at + 1 : at + 1 + size].decode())
            at += 1 + size
        (points,) = struct.unpack_from("<I", raw, at)
    except (struct.error, IndexError):
        raise _Short("cut short in the header") from None
    if version != 1:
        raise ValueError(f"version {version}")
    return channels, _gpb_fields(flags, many), points, at + 4


def _gpb_layout(at, size: int) -> Layout:
    n = 1 << 12
    while True:
        try:
            _, kind, points, first = _gpb_head(at(0, n))
            break
        except _Short:
            if n >= size:
                raise
            n *= 8  # names can be long
    if size < first + points * kind.itemsize:
        raise ValueError("cut short in the points")
    return Layout(first, kind.itemsize, points)


LAYOUTS["gpb"] = _gpb_layout
_GPB_ROWS = "track_id string, seq bigint, lat double, lon double, ele double, time_ms double, ext_num map<string,double>, reason string"


def _gpb_points(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                track = unquote(re.sub(r"\.[^./]*$", "", row["file"].rsplit("/", 1)[-1]))
                if row["reason"] is not None:
                    yield pa.RecordBatch.from_pydict({"track_id": [track], "seq": pa.nulls(1, pa.int64()), **{c: pa.nulls(1, pa.float64()) for c in ("lat", "lon", "ele", "time_ms")}, "ext_num": pa.nulls(1, pa.map_(pa.string(), pa.float64())), "reason": [row["reason"]]})
                    continue
                if not row["data"]:
                    continue
                channels, kind, _, _ = _gpb_head(row["head"])
                data = np.frombuffer(row["data"], kind)
                n = len(data)
                column = lambda c, data=data, n=n: pa.array(data[c].astype(float)) if c in data.dtype.names else pa.nulls(n, pa.float64())
                values = np.column_stack([data[f"c{i}"].astype(float) for i in range(len(channels))]).ravel() if channels else np.zeros(0)
                maps = pa.MapArray.from_arrays(np.arange(0, (n + 1) * len(channels), len(channels) or 1, np.int32)[: n + 1] if channels else np.zeros(n + 1, np.int32), pa.array(channels * n, pa.string()), pa.array(values))
                yield pa.RecordBatch.from_pydict({"track_id": pa.array([track] * n), "seq": pa.array(np.arange(row["number"], row["number"] + n)), **{c: column(c) for c in ("lat", "lon", "ele", "time_ms")}, "ext_num": maps, "reason": pa.nulls(n, pa.string())})

    rows = records.mapInArrow(unpack, _GPB_ROWS)
    audit = rows.filter("reason is not null").groupBy("track_id", "reason").agg(F.count("*").alias("n"))
    return conform(rows.filter("reason is null").drop("reason")), audit


def decode_gpb(blobs: DataFrame, at_a_time: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(points, audit) of (track_id, content) rows; what isn't a container is counted with the reason."""

    def cut(batches):
        for batch in batches:
            for track, content in zip(batch["track_id"], batch["content"], strict=True):
                raw = bytes(content)
                row = {"file": track, "head": b"", "number": 0, "data": b"", "reason": None}
                try:
                    plan = _gpb_layout(lambda a, n, raw=raw: raw[a : a + n], len(raw))
                except ValueError as error:
                    yield pd.DataFrame([row | {"reason": str(error)}])
                    continue
                for k in range(0, plan.count, at_a_time):
                    yield pd.DataFrame([row | {"head": raw[: plan.first], "number": k, "data": raw[plan.first + k * plan.stride : plan.first + min(plan.count, k + at_a_time) * plan.stride]}])

    return _gpb_points(blobs.select("track_id", "content").mapInPandas(cut, "file string, head binary, number bigint, data binary, reason string"))


def read_gpb(spark: SparkSession, path: str, split: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(points, audit) of packed containers; each split bytes of a file are a task. track_id is the file's name without its ending."""
    return _gpb_points(read_records(spark, path, "gpb", split=split, rows=50_000))


def write_gpb(df: DataFrame, path: str, channels: list[str] | None = None, mode: str = "overwrite") -> None:
    """A packed container for each track, track_id.gpb, streamed in the order of seq. What a point lacks is written as 0.

    Files are seen when all of them are whole. A track is one file, so one task writes it, a batch at a time.
    """
    df = _full(df)
    names = channel_names(df) if channels is None else channels
    if any(len(c.encode()) > 255 for c in names):
        raise ValueError("a channel's name has 255 bytes at most")
    values = [F.coalesce(F.col("ext_num")[c], F.col("ext_str")[c].try_cast("double")).alias(f"c{i}") for i, c in enumerate(names)]
    track = F.coalesce("track_id", F.lit("")).alias("track_id")
    points = df.select(track, F.lit(None).cast("bigint").alias("points"), F.lit(0).alias("flags"), "seq", "lat", "lon", "ele", "time_ms", *values)
    heads = df.groupBy(track).agg(F.count("*").alias("points"), (F.when(F.bool_or(F.col("time_ms").isNotNull()), GPB_TIME).otherwise(0) + F.when(F.bool_or(F.col("ele").isNotNull()), GPB_ELE).otherwise(0)).alias("flags"))
    # A head goes before its points; for them all it is the only row of the track with a number of points.
    rows = points.unionByName(heads, allowMissingColumns=True).withColumn("is_point", F.col("points").isNull())
    rows = gathered(rows, "track_id").sortWithinPartitions("track_id", "is_point", "seq")

    def pack(batches):
        name, kind = None, None
        out_schema = pa.schema([("track_id", pa.string()), ("head", pa.binary()), ("points", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            tracks = batch.column("track_id").to_pylist()
            heads = np.flatnonzero(batch.column("points").is_valid().to_numpy(zero_copy_only=False))
            out = []
            for a, b in zip([0, *(heads + 1).tolist()], [*heads.tolist(), batch.num_rows], strict=True):
                if a < b:
                    some = np.zeros(b - a, kind)
                    for c in kind.names:
                        value = batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False).astype(float)
                        some[c] = value if c in ("lat", "lon") else np.nan_to_num(value)
                    out.append({"track_id": name, "n": b - a, "data": some.tobytes()})
                if b < batch.num_rows:
                    name, flags, many = tracks[b], batch.column("flags")[b].as_py(), batch.column("points")[b].as_py()
                    kind, title = _gpb_fields(flags, len(names)), name.encode()
                    head = [GPB_MAGIC, struct.pack("<BBH", 1, flags, len(title)), title, struct.pack("<H", len(names)), *(struct.pack("<B", len(c.encode())) + c.encode() for c in names), struct.pack("<I", many)]
                    out.append({"track_id": name, "head": b"".join(head), "points": many})
            yield pa.RecordBatch.from_pylist(out, out_schema)

    write_packed(rows.mapInArrow(pack, "track_id string, head binary, points bigint, n bigint, data binary"), path, "gpb", mode)


#: Fixed values of the recording: bytes of its parts, and what marks them.
BLOCK0, BLOCK, HEAD, CONFIG, SUBFRAME, SUBHEAD, RECORD, SLOTS, TRAILER = 56772, 44932, 12, 16332, 4492, 20, 88, 50, 72
ROSTER_AT, ROSTER = 0x110, 80
SIGNATURE = bytes([0x00, 0x00, 0x04, 0x52, 0x04, 0x01, 0x00, 0x03])
CHECKSUM_SEED, CLOCK_XOR, STEP_MS = 0x0332044E, 0x04010003, 100
_SLOT = np.dtype([("state", ">u2"), ("_a", "V5"), ("slot", "u1"), ("x", ">f4"), ("y", ">f4"), ("z", ">f4"), ("a", ">f4"), ("b", ">f4"), ("c", ">f4"), ("ints", ">i2", 8), ("_b", "V40")])
_FRAME = np.dtype([("sign", "V8"), ("clock", "u1", 4), ("derived", ">u4"), ("_a", "V4"), ("slots", _SLOT, SLOTS), ("sum", ">u4"), ("mark", "V4"), ("_b", "V64")])


def is_p5(content: Column) -> Column:
    """Whether bytes are a recording: its first word, the mark of its first subframe, and its length."""
    size = F.octet_length(content)
    return (size >= BLOCK0) & (F.hex(F.substring(content, 1, 4)) == "00000100") & (F.hex(F.substring(content, HEAD + CONFIG + 1, 8)) == SIGNATURE.hex().upper()) & (F.pmod(size - BLOCK0, F.lit(BLOCK)) == 0)


def _mission_day(content: Column) -> Column:
    """Days since 1970 of the date in a recording's head: day, month by name, year; else month/day/year."""
    text = lambda a, n: F.regexp_extract(F.substring(content, a, n).cast("string"), r"^([^\x00]*)", 1)
    long, short = F.upper(F.trim(text(49, 16))), F.trim(text(33, 8))
    form, day = r"^(\d{1,2})\s+([A-Z]{3})\s+(\d{2})$", r"^(\d{2})/(\d{2})/(\d{2})$"
    part = lambda t, f, i: F.regexp_extract(t, f, i)
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), part(long, form, 2)).cast("int")
    first = lambda y, m: F.unix_date(F.make_date(y + 2000, F.greatest(F.lit(1), F.least(F.lit(12), m)), F.lit(1)))
    n = lambda t, f, i: part(t, f, i).try_cast("int")
    return F.coalesce(F.when(month > 0, first(n(long, form, 3), month) + n(long, form, 1) - 1), first(n(short, day, 3), n(short, day, 1)) + n(short, day, 2) - 1)


def _p5_layout(at, size: int) -> Layout:
    """Blocks. The first is longer than others: of it the end that is as long as they counts, in which one subframe is none."""
    head = at(0, HEAD + CONFIG + len(SIGNATURE))
    if size < BLOCK0 or head[:4] != b"\0\0\1\0" or head[HEAD + CONFIG :] != SIGNATURE or (size - BLOCK0) % BLOCK:
        raise ValueError("no recording")
    return Layout(BLOCK0 - BLOCK, BLOCK, 1 + (size - BLOCK0) // BLOCK)


LAYOUTS["p5"] = _p5_layout
#: Bytes of a recording's head that have its date and roster.
P5_HEAD = ROSTER_AT + ROSTER * SLOTS
_NAME = r"([^/]+?)(\.[^./]*)?$"


def _p5_heads(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(recording, size, head) of each recording."""
    if not isinstance(path, str):
        return path.filter(is_p5(F.col("content"))).select(F.col("track_id").alias("recording"), F.octet_length("content").cast("bigint").alias("size"), F.substring("content", 1, P5_HEAD).alias("head"))
    rows = read_records(spark, path, "p5", head=P5_HEAD, rows=0).filter("reason is null")
    return rows.select(F.regexp_extract("file", _NAME, 1).alias("recording"), "size", "head")


def p5_frames(spark: SparkSession, path: str | DataFrame, blocks: int = 64, split: int = 64 << 20) -> DataFrame:
    """(recording, mission_day, first, head, bytes): stretches of whole blocks of recordings, so many each; first: number of the first subframe."""
    if isinstance(path, str):
        rows = read_records(spark, path, "p5", head=P5_HEAD, split=split, rows=blocks).filter("reason is null")
        return rows.select(F.regexp_extract("file", _NAME, 1).alias("recording"), _mission_day(F.col("head")).alias("mission_day"), F.greatest(F.lit(0), F.col("number") * 10 - 1).alias("first"), (F.col("number") == 0).alias("head"), F.col("data").alias("bytes"))
    files = path.select(F.col("track_id").alias("recording"), "content").filter(is_p5(F.col("content")))
    many = F.expr(f"(octet_length(content) - {BLOCK0}) div {BLOCK}").cast("int") + 1
    rows = files.select("recording", _mission_day(F.col("content")).alias("mission_day"), "content", many.alias("many"), F.explode(F.sequence(F.lit(0), many - 1, F.lit(blocks))).alias("from"))
    begin = F.lit(BLOCK0 - BLOCK) + F.col("from") * BLOCK
    size = F.least(F.lit(blocks), F.col("many") - F.col("from")) * BLOCK
    cut = rows.select("recording", "mission_day", F.greatest(F.lit(0), F.col("from") * 10 - 1).cast("bigint").alias("first"), (F.col("from") == 0).alias("head"), F.substring("content", (begin + 1).cast("int"), size.cast("int")).alias("bytes"))
    return cut.repartition("recording", "first")


def _subframes(head: bool, raw: bytes) -> np.ndarray:
    parts = [raw[at + HEAD + SUBFRAME * (head and at == 0) : at + BLOCK] for at in range(0, len(raw), BLOCK)]
    return np.frombuffer(b"".join(parts), _FRAME)  # joined as bytes: numpy would change their order


def _clock(frames: np.ndarray) -> np.ndarray:
    h, m, s, cs = frames["clock"].T.astype(np.int64)
    return ((h * 60 + m) * 60 + s) * 1000 + cs * 10


def _falls(clock: np.ndarray) -> np.ndarray:
    """How often a stretch's clock has fallen by more than half a day up to each subframe."""
    return np.concatenate([[0], np.cumsum(np.diff(clock) < -DAY_MS // 2)])[: len(clock)]


def read_p5(spark: SparkSession, path: str, slots: list[int] | None = None, decimation: int = 1) -> DataFrame:
    """(recording, slot, subframe, time_of_day_ms, time_ms, x, y, z, field_a, field_b, field_c, int_2) of the live records of recordings.

    Every decimation-th subframe counts, of the wanted slots or all. When the clock falls by more than half a day, a day
    has passed; over a whole recording that is a window over its stretches, a row each.
    """
    schema = "recording string, mission_day int, stretch bigint, fell bigint, subframe bigint, clock bigint, slot int, x double, y double, z double, field_a double, field_b double, field_c double, int_2 double"

    def decode(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                frames = _subframes(r.head, bytes(r.bytes))
                clock, number = _clock(frames), r.first + np.arange(len(frames))
                live = (frames["slots"]["state"] == 0) & (number % max(1, decimation) == 0)[:, None]
                if slots is not None:
                    live &= np.isin(frames["slots"]["slot"], slots)
                i, k = np.nonzero(live)
                rows = frames["slots"][i, k]
                out = {"recording": r.recording, "mission_day": r.mission_day, "stretch": r.first, "fell": _falls(clock)[i], "subframe": number[i], "clock": clock[i], "slot": rows["slot"].astype(int)}
                yield pd.DataFrame(out | {n: rows[c].astype(float) for n, c in (("x", "x"), ("y", "y"), ("z", "z"), ("field_a", "a"), ("field_b", "b"), ("field_c", "c"))} | {"int_2": rows["ints"][:, 2].astype(float)})

    def ends(batches):
        for batch in batches:
            found = [(r, _clock(_subframes(r.head, bytes(r.bytes)))) for r in batch.itertuples(index=False)]
            yield pd.DataFrame([(r.recording, r.first, int(c[0]), int(c[-1]), int(_falls(c)[-1])) for r, c in found if len(c)], columns=["_of", "_at", "_from", "_to", "_fell"])

    rows = p5_frames(spark, path).mapInPandas(decode, schema)
    w = Window.partitionBy("_of").orderBy("_at")
    seam = F.coalesce((F.col("_from") < F.lag("_to").over(w) - DAY_MS // 2).cast("bigint"), F.lit(0))
    days = p5_frames(spark, path).mapInPandas(ends, "_of string, _at bigint, _from bigint, _to bigint, _fell bigint").withColumn("_seam", seam)
    days = days.select("_of", "_at", (F.sum(F.col("_fell") + F.col("_seam")).over(w) - F.col("_fell")).alias("_before"))
    rows = rows.join(days, (F.col("recording") == F.col("_of")) & (F.col("stretch") == F.col("_at"))).withColumn("_days", F.col("_before") + F.col("fell"))
    time = (F.col("mission_day") + F.col("_days")) * float(DAY_MS) + F.col("clock")
    return rows.select("recording", "slot", "subframe", F.col("clock").cast("double").alias("time_of_day_ms"), time.alias("time_ms"), "x", "y", "z", "field_a", "field_b", "field_c", "int_2")


def p5_roster(spark: SparkSession, path: str) -> DataFrame:
    """(recording, slot, type_code, aircraft_id, unit, callsign) of the roster in a recording's head."""
    rows = _p5_heads(spark, path).select("recording", F.col("head").alias("content"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("i"))
    at = F.col("i") * ROSTER + ROSTER_AT
    text = lambda a, n: F.trim(F.regexp_extract(F.substring("content", at + a + 1, F.lit(n)).cast("string"), r"^([^\x00]*)", 1))
    byte = lambda a: F.conv(F.hex(F.substring("content", at + a + 1, F.lit(1))), 16, 10).cast("int")
    return rows.select("recording", byte(2).alias("slot"), byte(3).alias("type_code"), text(12, 8).alias("aircraft_id"), text(20, 8).alias("unit"), text(28, 20).alias("callsign"))


#: Where a recording's frame lies, since it doesn't tell: assumed values that a user can replace.
GEOREFERENCE = {"lat": 39.4166, "lon": -118.7005, "height": 1199.0, "horizontal_m": 30.48, "vertical_m": 1.0, "x_east": True, "origin": "first-sample"}


def p5_georeference(samples: DataFrame, roster: DataFrame | None = None, **geo) -> DataFrame:
    """Points of samples, a track for each recording and slot, flagged p5_assumed_georeference; references stay unknown.

    origin first-sample: the first live sample of the whole recording lies on the anchor; range-center: the frame's
    zero does. Units scale the frame to metres east, north and up.
    """
    geo = GEOREFERENCE | geo
    if set(geo) != set(GEOREFERENCE) or geo["origin"] not in ("first-sample", "range-center") or not (geo["horizontal_m"] > 0 and geo["vertical_m"] > 0 and abs(geo["lat"]) <= 90 and abs(geo["lon"]) <= 180):
        raise ValueError("a georeference has " + ", ".join(GEOREFERENCE) + ", scales above 0 and an anchor on earth")
    first = samples.groupBy("recording").agg(F.min_by(F.struct("x", "y", "z"), F.struct("subframe", "slot")).alias("_o"))
    rows = samples.join(first, "recording")
    zero = geo["origin"] == "range-center"
    off = lambda c, scale: (F.col(c) - (F.lit(0.0) if zero else F.col(f"_o.{c}"))) * scale
    dx, dy, up = off("x", geo["horizontal_m"]), off("y", geo["horizontal_m"]), off("z", geo["vertical_m"])
    east, north = (dx, dy) if geo["x_east"] else (dy, dx)
    lat, lon, ele = enu_to_geodetic(east, north, up, F.lit(float(geo["lat"])), F.lit(float(geo["lon"])), F.lit(float(geo["height"])))
    channels = number_map({"p5_slot": F.col("slot"), "p5_x": F.col("x"), "p5_y": F.col("y"), "p5_z": F.col("z"), "p5_field_a": F.col("field_a"), "p5_field_b": F.col("field_b"), "p5_field_c": F.col("field_c"), "p5_int_2": F.col("int_2")})
    w = Window.partitionBy("recording", "slot").orderBy("subframe")
    out = rows.select(
        F.concat_ws("-", "recording", F.col("slot").cast("string")).alias("track_id"), (F.row_number().over(w) - 1).cast("bigint").alias("seq"), lat.alias("lat"), lon.alias("lon"), ele.alias("ele"), "time_ms",
        (F.col("subframe") + 1).alias("source_record"), F.concat(F.lit("Slot "), F.col("slot").cast("string")).alias("source_segment"), "recording", "slot", F.array(F.lit("p5_assumed_georeference")).alias("flags"), channels.alias("ext_num"),
    )
    if roster is not None:
        names = roster.select("recording", "slot", F.nullif(F.trim(F.concat_ws(" ", "callsign", "aircraft_id")), F.lit("")).alias("_who")).dropDuplicates(["recording", "slot"])
        out = out.join(names, ["recording", "slot"], "left").withColumn("source_segment", F.coalesce("_who", "source_segment")).drop("_who")
    return conform(out.drop("recording", "slot"))


def read_p5_tracks(spark: SparkSession, path: str, slots: list[int] | None = None, decimation: int = 1, **geo) -> tuple[DataFrame, DataFrame]:
    """(points, audit): recordings as tracks, with the roster's names; files that are none are counted."""
    points = p5_georeference(read_p5(spark, path, slots, decimation), p5_roster(spark, path), **geo)
    bad = read_records(spark, path, "p5", rows=0).filter("reason is not null")
    return points, bad.groupBy(F.regexp_extract("file", _NAME, 1).alias("track_id"), "reason").agg(F.count("*").alias("n"))


def p5_slot_coverage(spark: SparkSession, path: str, buckets: int = 240, gaps: int = 200) -> DataFrame:
    """(recording, slot, first_subframe, last_subframe, live, shares, missing) of each slot that is ever live, in order.

    shares: the live part of each of so many equal stretches of subframes; missing: runs without a record between the
    first and the last live one, the first of them.
    """
    live = read_p5(spark, path).select("recording", "slot", "subframe")
    totals = _p5_heads(spark, path).select("recording", (F.expr(f"(size - {BLOCK0}) div {BLOCK}") * 10 + 9).alias("total"))
    rows = live.join(totals, "recording")
    at = F.least(F.lit(buckets - 1), F.expr(f"(subframe * {buckets}) div total").cast("int"))
    w = Window.partitionBy("recording", "slot").orderBy("subframe")
    rows = rows.withColumns({"bucket": at, "_was": F.lag("subframe").over(w)})
    g = rows.groupBy("recording", "slot", "total").agg(F.min("subframe").alias("first_subframe"), F.max("subframe").alias("last_subframe"), F.count("*").alias("live"), F.sort_array(F.collect_list(F.when(F.col("subframe") - F.col("_was") > 1, F.struct((F.col("_was") + 1).alias("from"), (F.col("subframe") - 1).alias("to"))))).alias("missing"))
    n = rows.groupBy("recording", "slot", "bucket").agg(F.count("*").alias("n")).groupBy("recording", "slot").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("n"))
    # Subframes of bucket i: those s with (s * buckets) div total = i.
    low = lambda i: F.ceil(i * F.col("total") / buckets)
    share = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.when(low(i + 1) > low(i), F.coalesce(F.col("n")[i], F.lit(0)) / (low(i + 1) - low(i))).otherwise(0.0))
    return g.join(n, ["recording", "slot"]).select("recording", "slot", "first_subframe", "last_subframe", "live", share.alias("shares"), F.slice("missing", 1, gaps).alias("missing")).orderBy("recording", "slot")


def p5_validation(spark: SparkSession, path: str) -> DataFrame:
    """(recording, subframes, records, live, bad_signatures, bad_trailers, bad_checksums, bad_slots, bad_states, clock_anomalies, derived_clock_mismatches)."""
    names = ["subframes", "records", "live", "bad_signatures", "bad_trailers", "bad_checksums", "bad_slots", "bad_states", "clock_anomalies", "derived_clock_mismatches"]

    def check(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                raw = _subframes(r.head, bytes(r.bytes))
                words = np.frombuffer(raw.tobytes(), ">u4").reshape(len(raw), -1).astype(np.uint32)  # all words of each subframe
                first, last = SUBHEAD // 4, (SUBHEAD + SLOTS * RECORD) // 4
                clock = _clock(raw)
                state = raw["slots"]["state"]
                sign = raw["sign"].tobytes()
                found = [
                    len(raw), state.size, (state == 0).sum(), sum(sign[8 * i : 8 * i + 8] != SIGNATURE for i in range(len(raw))), sum(bytes(m) != b"\xff\0\0\0" for m in raw["mark"]),
                    (np.bitwise_xor.reduce(words[:, first:last], axis=1) ^ np.uint32(CHECKSUM_SEED) != words[:, last]).sum(), (raw["slots"]["slot"] != np.arange(1, SLOTS + 1)).sum(), (state > 2).sum(),
                    (np.diff(clock) % DAY_MS != STEP_MS).sum(), (words[:, 2] ^ np.uint32(CLOCK_XOR) != words[:, 3]).sum(),
                ]
                yield pd.DataFrame([[r.recording, r.first, int(clock[0]), int(clock[-1]), *map(int, found)]])

    schema = "recording string, first bigint, from bigint, to bigint, " + ", ".join(f"{n} bigint" for n in names)
    rows = p5_frames(spark, path).mapInPandas(check, schema)
    w = Window.partitionBy("recording").orderBy("first")
    seam = (F.pmod(F.col("from") - F.lag("to").over(w), F.lit(DAY_MS)) != STEP_MS).cast("bigint")
    rows = rows.withColumn("clock_anomalies", F.col("clock_anomalies") + F.coalesce(seam, F.lit(0)))
    return rows.groupBy("recording").agg(*(F.sum(n).alias(n) for n in names))
