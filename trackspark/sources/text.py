"""Values in text, as columns: numbers, coordinates, times, units and file fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOT_MPS = 0.514444
#: Metres of a foot and of a nautical mile.
FOOT_M, NAUTICAL_MILE_M = 0.3048, 1852.0
DAY_MS = 86_400_000
#: How a time is written: by itself, or one of these.
TIME_FORMATS = ("auto", "iso", "epoch_seconds", "epoch_milliseconds", "epoch_microseconds", "excel_serial", "irig_doy")


def plain_number(text: Column) -> Column:
    """A number in plain or scientific digits; null for all else, and so for 3d, NaN or Infinity, which a cast would take."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def parse_number(text: Column) -> Column:
    """One comma and no dot is a decimal comma; else commas group. Null where it isn't a number."""
    t = F.trim(text)
    decimal = (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) == 1) & ~F.contains(t, F.lit("."))
    return plain_number(F.when(decimal, F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit(""))))


def parse_coordinate(text: Column) -> Column:
    """Decimal degrees, or degrees, minutes and seconds with a hemisphere."""
    t = F.upper(F.trim(text))
    dms = r"^([+-]?\d+(?:\.\d+)?)[°D\s]+(\d+(?:\.\d+)?)['M\s]*(?:(\d+(?:\.\d+)?)[\"\s]*)?([NSEW])?$"
    part = lambda i: F.regexp_extract(t, dms, i)
    size = F.abs(part(1).try_cast("double")) + F.coalesce(part(2).try_cast("double"), F.lit(0.0)) / 60 + F.coalesce(part(3).try_cast("double"), F.lit(0.0)) / 3600
    sign = F.when(part(4).isin("S", "W") | F.startswith(t, F.lit("-")), -1.0).otherwise(1.0)
    return F.coalesce(parse_number(text), F.when(t.rlike(dms), sign * size))


def parse_iso(text: Column) -> Column:
    """Milliseconds since 1970 of an ISO time; UTC where it tells no zone."""
    t = F.trim(text)
    zone = t.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    utc = F.when(zone, t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(r"^\d{4}-\d{2}"), F.unix_micros(F.try_to_timestamp(F.when(F.length(t) <= 10, t).otherwise(utc))) / 1000)


def parse_range_time(text: Column, anchor_ms: float | None = None) -> Column:
    """Milliseconds since 1970 of [DDD:]HH:MM:SS[.f]: in the anchor's UTC year, or on its UTC day if no day is told. Null without an anchor."""
    if anchor_ms is None:
        return F.lit(None).cast("double")
    t = F.trim(text)
    form = r"^(?:(\d{1,3}):)?(\d{1,2}):(\d{1,2}):(\d{1,2}(?:[.,]\d+)?)$"
    part = lambda i: F.replace(F.regexp_extract(t, form, i), F.lit(","), F.lit(".")).try_cast("double")
    day, h, m, s = (part(i) for i in (1, 2, 3, 4))
    anchor = F.timestamp_millis(F.lit(int(anchor_ms)))
    start = F.when(day.isNotNull(), F.unix_date(F.make_date(F.year(anchor), F.lit(1), F.lit(1))) + day - 1).otherwise(F.unix_date(F.to_date(anchor)).cast("double"))
    good = t.rlike(form) & (day.isNull() | day.between(1, 366)) & (h <= 23) & (m <= 59) & (s < 61)
    return F.when(good, start * DAY_MS + h * 3_600_000 + m * 60_000 + F.floor(s * 1000 + 0.5))


def parse_time(text: Column, form: str = "auto", anchor_ms: float | None = None) -> Column:
    """Milliseconds since 1970. auto: of a number by its size (micro-, milli- or seconds, or spreadsheet days), of range time given an anchor, or of ISO text."""
    if form not in TIME_FORMATS:
        raise ValueError(f"a time format is one of {', '.join(TIME_FORMATS)}")
    if form == "iso":
        return parse_iso(text)
    if form == "irig_doy":
        return parse_range_time(text, anchor_ms)
    if form != "auto":
        n = plain_number(F.replace(F.trim(text), F.lit(","), F.lit(".")))
        return {"epoch_seconds": n * 1000, "epoch_milliseconds": n, "epoch_microseconds": n / 1000, "excel_serial": (n - 25569) * DAY_MS}[form]
    n = F.when(F.trim(text).rlike(r"^-?\d+(\.\d+)?$"), F.trim(text).try_cast("double"))
    size = F.abs(n)
    number = F.when(size >= 1e14, n / 1000).when(size >= 1e11, n).when(size >= 1e9, n * 1000).when((n > 20000) & (n < 80000), (n - 25569) * DAY_MS)
    return F.coalesce(number, F.when(n.isNull(), F.coalesce(parse_range_time(text, anchor_ms), parse_iso(text))))


def iso_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(F.floor(ms).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def gpx_time(ms: Column) -> Column:
    """ISO, without a fraction that is zero."""
    whole = F.date_format(F.timestamp_millis(F.floor(ms).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.floor(ms) % 1000 == 0, whole).otherwise(iso_time(ms))


def trimmed(x: Column, digits: int) -> Column:
    """A number in plain digits, that many behind the point at most, without closing zeros."""
    # A decimal is much faster than a format; the format serves what is too large for it.
    fixed = F.coalesce(x.try_cast(f"decimal(18,{digits})").cast("string"), F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x)))
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit(".")) if digits else fixed


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape_xml(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def duration(ms: Column) -> Column:
    """hh:mm:ss of a time span, to whole seconds."""
    s = F.floor(ms / 1000 + 0.5)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", F.when(F.length(F.floor(s / 3600).cast("string")) > 2, F.floor(s / 3600).cast("string")).otherwise(two(F.floor(s / 3600))), two(F.floor(s % 3600 / 60)), two(s % 60))


def to_feet(m: Column) -> Column:
    return m / FOOT_M


def to_nautical_miles(m: Column) -> Column:
    return m / NAUTICAL_MILE_M


def to_knots(mps: Column) -> Column:
    return mps * 3600 / NAUTICAL_MILE_M


def readout(x: Column, kind: str, nautical: bool = False, digits: int | None = None) -> Column:
    """distance (larger unit from one whole of it), altitude or speed as text with its unit; digits: at most so many behind the point."""
    if kind == "distance":
        big, unit, small, name = (x / NAUTICAL_MILE_M, "NM", to_feet(x), "ft") if nautical else (x / 1000, "km", x, "m")
        return F.when(F.abs(big) >= 1, F.concat(F.format_number(big, 2), F.lit(f" {unit}"))).otherwise(F.concat(F.format_number(small, 1), F.lit(f" {name}")))
    if kind not in ("altitude", "speed"):
        raise ValueError("kind is distance, altitude or speed")
    value, unit = ((to_feet(x), "ft") if nautical else (x, "m")) if kind == "altitude" else ((to_knots(x), "kn") if nautical else (x, "m/s"))
    n = (0 if kind == "altitude" else 1) if digits is None else digits
    text = F.format_number(value, n)
    return F.concat(F.regexp_replace(text, r"\.?0+$", "") if n else text, F.lit(f" {unit}"))


def nmea_coordinate(text: Column, hemisphere: Column) -> Column:
    """ddmm.mmmm and a hemisphere to degrees."""
    return nmea_degrees(plain_number(text), hemisphere)


def nmea_degrees(n: Column, hemisphere: Column) -> Column:
    """The number ddmm.mmmm and a hemisphere to degrees."""
    degrees = F.floor(n / 100)
    return (degrees + (n - degrees * 100) / 60) * F.when(hemisphere.isin("S", "W"), -1.0).otherwise(1.0)


def nmea_time(text: Column) -> Column:
    """Milliseconds of the day of hhmmss[.f]."""
    return F.when(F.length(text) >= 6, nmea_clock(*(plain_number(F.substring(text, a, n)) for a, n in NMEA_TIME)))


#: Where hours, minutes and seconds are in a time: first character, and how many.
NMEA_TIME = ((1, 2), (3, 2), (5, 20))


def nmea_clock(h: Column, m: Column, s: Column) -> Column:
    """Milliseconds of the day of three numbers."""
    return h * 3_600_000 + m * 60_000 + F.floor(s) * 1000 + F.floor(s % 1 * 1000)


def nmea_day(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date that a receiver can mean."""
    good = (y >= 1980) & m.between(1, 12) & d.between(1, 31)
    return F.when(good, F.unix_date(F.make_date(y.cast("int"), m.cast("int"), F.lit(1))) + d.cast("int") - 1)


def checksum(body: Column) -> Column:
    """XOR of the characters of a sentence body, as two hex digits. An empty piece of the split counts as 0."""
    return F.lpad(F.hex(F.aggregate(F.split(body, ""), F.lit(0), lambda a, c: a.bitwiseXOR(F.ascii(c)))), 2, "0")
