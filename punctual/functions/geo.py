"""Distances and viewport tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6378.137  # fixed value


def haversine_term(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The haversine of the central angle between two points in degrees; grows strictly with the distance."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon


def term_to_metres(term: Column) -> Column:
    return 2 * F.atan2(F.sqrt(term), F.sqrt(1 - term)) * (EARTH_RADIUS_KM * 1000.0)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return term_to_metres(haversine_term(lat1, lon1, lat2, lon2))


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """The point on the unit sphere, as three columns ``ux, uy, uz``."""
    phi, theta = F.radians(lat), F.radians(lon)
    return [
        (F.cos(phi) * F.cos(theta)).alias("ux"),
        (F.cos(phi) * F.sin(theta)).alias("uy"),
        F.sin(phi).alias("uz"),
    ]


def chord_terms(sites: Column, ux: Column, uy: Column, uz: Column) -> Column:
    """Haversine terms between a point and an array of sites, all given as unit vectors.

    A quarter of the squared chord is the haversine of the angle. With the vectors at hand it takes no
    trigonometry per pair; its rounding error is far below a millimetre on the ground.
    """

    def term(s: Column) -> Column:
        dx, dy, dz = s["ux"] - ux, s["uy"] - uy, s["uz"] - uz
        return (dx * dx + dy * dy + dz * dz) / 4

    return F.transform(sites, term)


def in_viewport(
    lat: Column,
    lng: Column,
    prev_lat: Column,
    prev_lng: Column,
    south: float,
    west: float,
    north: float,
    east: float,
    complement_wrap: bool = False,
) -> Column:
    """True if the point or the one before lies inside the box (open borders).

    Latitude and longitude are each tested over the two points. A box that crosses the antimeridian
    (``east < west``) takes longitudes beyond west or before east; ``complement_wrap`` restores the historical
    test ``east < lng < west`` for such a box.
    """

    def lng_inside(x: Column) -> Column:
        if east > west:
            return (x > west) & (x < east)
        if east == west:
            return F.lit(False)
        return (x > east) & (x < west) if complement_wrap else (x > west) | (x < east)

    def lat_inside(x: Column) -> Column:
        return (x > south) & (x < north)

    return (lat_inside(lat) | lat_inside(prev_lat)) & (lng_inside(lng) | lng_inside(prev_lng))
