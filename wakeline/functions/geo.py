"""Geodesic and track arithmetic as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
EARTH_KM_ROUND = 6371.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    # greatest and least skip nulls, so a missing coordinate has to be kept missing.
    return F.when(a.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))


def haversine_rad(lat1, lon1, lat2, lon2) -> Column:
    """Central angle in radians between points in degrees; missing if a coordinate is."""
    return 2 * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    return haversine_rad(lat1, lon1, lat2, lon2) * radius


def haversine_atan2_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM_ROUND) -> Column:
    a = _half_chord(lat1, lon1, lat2, lon2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def lon_360(lon) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(_col(lon), F.lit(360.0))


def lon_180(lon) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_col(lon) + 180.0, F.lit(360.0)) - 180.0


def lon_from_360(lon) -> Column:
    """Longitude in (-180, 180] from one in [0, 360): 180 stays."""
    return F.when(_col(lon) > 180, _col(lon) - 360.0).otherwise(_col(lon))


def heading_change(now, before) -> Column:
    """Absolute turn in degrees, at most 180 for headings in [0, 360)."""
    d = _col(now) - _col(before)
    d = F.when(d > 180, d - 360).otherwise(d)
    return F.abs(F.when(d < -180, d + 360).otherwise(d))


def per_second(delta, seconds, short: float = 1.0) -> Column:
    """Change per second where more than ``short`` seconds passed, else the change itself."""
    return F.when(_col(seconds) > short, F.try_divide(_col(delta), _col(seconds))).otherwise(_col(delta))


def near_port_flag(distance_km) -> Column:
    d = _col(distance_km)
    return F.when(d < 1, 1.0).when(d <= 5, 0.5).when(d > 5, 0.0)


def cell(value, side_deg: float) -> Column:
    return F.floor(_col(value) / F.lit(max(float(side_deg), 1e-6)))


def seconds_between(later, earlier) -> Column:
    """Seconds between two timestamps without time zone, as a double."""
    micros = [F.unix_micros(_col(x).cast("timestamp")) for x in (later, earlier)]
    return (micros[0] - micros[1]) / 1e6


def eta_clock(now, seconds) -> Column:
    """The time ``seconds``, rounded to whole ones, after ``now``."""
    return F.timestamp_micros(F.unix_micros(_col(now).cast("timestamp")) + (F.bround(_col(seconds)) * 1_000_000).cast("long"))
