"""Distances, labels and grid cells on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius of the database search and of the client-side helper.
SPHERE_M = 6370986.0
CLIENT_SPHERE_M = 6371000.0


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                   radius_m: float = SPHERE_M) -> Column:
    """Great-circle distance in metres by the haversine form."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * radius_m) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def sphere_xyz(lat: Column, lon: Column, radius_m: float = SPHERE_M) -> list[Column]:
    """The point in space, in metres. Cells built on it have no poles and no date line."""
    phi, lam = F.radians(lat), F.radians(lon)
    return [radius_m * F.cos(phi) * F.cos(lam), radius_m * F.cos(phi) * F.sin(lam),
            radius_m * F.sin(phi)]


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def distance_label(metres: Column) -> Column:
    """``850m`` below one kilometre, ``1.2km`` above; null and zero give ``''``."""
    whole = metres.cast("bigint")
    exact = F.when(metres == whole, whole.cast("string")).otherwise(metres.cast("string"))
    return (F.when(metres.isNull() | (metres == 0), "")
            .when(metres < 1000, F.concat(exact, F.lit("m")))
            .otherwise(F.concat(F.format_string("%.1f", (metres / 1000).cast("double")), F.lit("km"))))


def region_label(lat: Column, lon: Column) -> Column:
    """Capital box, country box, or unknown."""
    return (F.when(lat.between(37.4, 37.7) & lon.between(126.8, 127.2), "서울특별시")
            .when(lat.between(35, 39) & lon.between(126, 130), "대한민국")
            .otherwise("위치 확인 불가"))


def facility_tier(kind: Column) -> Column:
    """Sort key of the hospital type: tertiary, general, other hospital, rest."""
    return (F.when(kind.contains("상급종합"), 1)
            .when(kind.contains("종합병원"), 2)
            .when(kind.contains("병원"), 3)
            .otherwise(4))
