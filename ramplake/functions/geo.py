"""Distances, bearings, angles, coordinate text and wind vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ramplake.config import EARTH_RADIUS_M
from ramplake.functions.clip import at_least


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = (p2 - p1) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(p1) * F.cos(p2) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(at_least(1 - a, 0.0)))


def bearing_rad(lat1, lon1, lat2, lon2) -> Column:
    p1, p2, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return F.atan2(F.sin(dlon) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon))


def circular_diff_deg(a: Column, b: Column) -> Column:
    """Absolute wrapped difference, in degrees, of two angles in radians."""
    return F.abs(F.degrees(F.atan2(F.sin(a - b), F.cos(a - b))))


def wind_uv(speed_kmh: Column, direction_deg: Column) -> tuple[Column, Column]:
    """Components in m/s of a wind that blows *from* the given direction."""
    speed, angle = speed_kmh / 3.6, F.radians(direction_deg)
    return -speed * F.sin(angle), -speed * F.cos(angle)


def speed_dir(u: Column, v: Column) -> dict[str, Column]:
    """A vector without length has no direction: its sine and cosine are NaN."""
    angle, still = F.atan2(v, u), (u == 0) & (v == 0)
    part = lambda value: F.when(still, F.lit(float("nan"))).otherwise(value)
    return {"speed": F.hypot(u, v), "dir_rad": angle, "dir_sin": part(F.sin(angle)), "dir_cos": part(F.cos(angle))}


def parse_degrees(text: Column) -> Column:
    """Decimal degrees from one to three numbers (degrees, minutes, seconds); a minus on the degrees negates all."""
    # fixed value: the degree, minute and second marks of the source files
    marks = "[°o'\"′″’”,\\s]+"
    words = F.filter(F.split(F.trim(text), marks), lambda w: w != "")
    number = lambda i: F.try_element_at(words, F.lit(i)).try_cast("double")
    broken = F.exists(F.slice(words, 1, 3), lambda w: w.try_cast("double").isNull())
    rest = F.coalesce(number(2), F.lit(0.0)) / 60 + F.coalesce(number(3), F.lit(0.0)) / 3600
    degrees = F.abs(number(1)) + rest
    return F.when(F.size(words) == 1, number(1)).when(
        (F.size(words) > 1) & ~broken, F.when(number(1) < 0, -degrees).otherwise(degrees))


def parse_elevation(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "m$", "").try_cast("double")
