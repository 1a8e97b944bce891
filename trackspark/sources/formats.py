"""Formats by the ending of a file: readers and writers that can be added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary, files, sinks
from .inventory import ENDINGS

READERS: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {}
WRITERS: dict[str, Callable[..., object]] = {}
_ENDINGS: dict[str, str] = {}


def register_format(name: str, endings: list[str], read: Callable | None = None, write: Callable | None = None) -> None:
    """Adds a format: read(spark, path) -> (points, audit), write(df, path). All of it is taken, or, where a name or an ending is known, nothing."""
    if name in READERS or name in WRITERS or (taken := [e for e in endings if e in _ENDINGS]):
        raise ValueError(f"format {name} is registered already" if name in READERS or name in WRITERS else f"{', '.join(taken)} is another format's")
    if read is None and write is None:
        raise ValueError("a format reads or writes")
    if read is not None:
        READERS[name] = read
    if write is not None:
        WRITERS[name] = write
    _ENDINGS.update({e: name for e in endings})


def read_tracks(spark: SparkSession, path: str, fmt: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(points, audit) by the format, or by the path's ending."""
    name = fmt or _ENDINGS.get(path.rstrip("/*").rsplit(".", 1)[-1].lower())
    if name not in READERS:
        raise ValueError(f"no reader for {fmt or path}")
    return READERS[name](spark, path, **options)


def write_tracks(df: DataFrame, path: str, fmt: str, **options):
    if fmt not in WRITERS:
        raise ValueError(f"no writer for {fmt}")
    return WRITERS[fmt](df, path, **options)


for _name, _read, _write in (
    ("csv", files.read_csv_track, sinks.write_csv), ("gpx", files.read_gpx, sinks.write_gpx), ("geojson", files.read_geojson, sinks.write_geojson), ("kml", files.read_kml, sinks.write_kml),
    ("nmea", files.read_nmea, None), ("eag", files.read_eag, sinks.write_eag), ("gpb", binary.read_gpb, binary.write_gpb), ("p5", binary.read_p5_tracks, None),
):
    register_format(_name, ENDINGS[_name], _read, _write)
