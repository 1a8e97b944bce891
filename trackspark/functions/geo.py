"""Geodesy as columns. Angles in degrees, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the geodetic system: mean radius, and the WGS 84 ellipsoid.
EARTH_RADIUS_M = 6371008.8
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
WGS84_B = WGS84_A * (1 - WGS84_F)
WGS84_EP2 = (WGS84_A**2 - WGS84_B**2) / WGS84_B**2


def is_valid(lat: Column, lon: Column) -> Column:
    """Finite and in range; null and NaN are not."""
    return F.coalesce(~F.isnan(lat) & lat.between(-90, 90) & ~F.isnan(lon) & lon.between(-180, 180), F.lit(False))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    north, east = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east
    return 2 * EARTH_RADIUS_M * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))  # least() would make null 1


def modulo(x: Column, n: float) -> Column:
    """The remainder that isn't negative."""
    return x - n * F.floor(x / n)


def shortest_delta(a: Column, b: Column) -> Column:
    """From a to b the short way round; the remainder keeps the dividend's sign."""
    return (b - a + 540) % 360 - 180


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing, 0 to 360."""
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return (F.degrees(F.atan2(F.sin(turn) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn))) + 360) % 360


def ecef(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    a, o = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(a) * F.sin(a))
    return (n + height) * F.cos(a) * F.cos(o), (n + height) * F.cos(a) * F.sin(o), (n * (1 - WGS84_E2) + height) * F.sin(a)


def geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height by one closed-form step from an angle that allows for height: a micrometre off at any height."""
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * WGS84_B * (1 + WGS84_EP2 * WGS84_B / F.sqrt(p * p + z * z)), p * WGS84_A)
    s, c = F.sin(theta), F.cos(theta)
    lat = F.atan2(z + WGS84_EP2 * WGS84_B * s * s * s, p - WGS84_E2 * WGS84_A * c * c * c)
    pole = p < 1e-9
    return (
        F.when(pole, F.when(z >= 0, 90.0).otherwise(-90.0)).otherwise(F.degrees(lat)),
        F.when(pole, 0.0).otherwise(wrap180(F.degrees(F.atan2(y, x)))),
        F.when(pole, F.abs(z) - WGS84_B).otherwise(p * F.cos(lat) + z * F.sin(lat) - WGS84_A * F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))),
    )


def enu(lat: Column, lon: Column, height: Column, lat0: Column, lon0: Column, height0: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a point about an origin."""
    dx, dy, dz = (u - v for u, v in zip(ecef(lat, lon, height), ecef(lat0, lon0, height0), strict=True))
    sa, ca, so, co = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    return -so * dx + co * dy, -sa * co * dx - sa * so * dy + ca * dz, ca * co * dx + ca * so * dy + sa * dz


def wrap180(x: Column) -> Column:
    return (x + 540) % 360 - 180


def round_up(x: Column, digits: int) -> Column:
    """Rounds halves toward positive infinity."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def lerp_lon(a: Column, b: Column, t: Column) -> Column:
    """The short way round, wrapped to -180..180."""
    return wrap180(a + shortest_delta(a, b) * t)


def enu_to_geodetic(east: Column, north: Column, up: Column, lat0: Column, lon0: Column, height0: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height of a point east, north and up of an origin."""
    sa, ca, so, co = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    x, y, z = ecef(lat0, lon0, height0)
    out = ca * up - sa * north  # away from the earth's axis
    return geodetic(x + co * out - so * east, y + so * out + co * east, z + ca * north + sa * up)
