"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in km between two points in degrees; NULL when a coordinate is NULL."""
    a_lat, b_lat = F.radians(lat1.cast("double")), F.radians(lat2.cast("double"))
    half_dlat = (b_lat - a_lat) / 2
    half_dlon = (F.radians(lon2.cast("double")) - F.radians(lon1.cast("double"))) / 2
    h = (
        F.sin(half_dlat) * F.sin(half_dlat)
        + F.cos(a_lat) * F.cos(b_lat) * F.sin(half_dlon) * F.sin(half_dlon)
    )
    # Rounding may push h a hair over 1 for antipodes, where asin is NaN. Not ``least``,
    # which would turn a missing coordinate into half the globe.
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))
