"""Geographic coordinates as Column math: great circle, UTM choice, transverse Mercator."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Mean earth radius, metres per degree, ellipsoid and projection parameters.
EARTH_RADIUS_M = 6371009.0
METRES_PER_DEGREE_LAT = 111132.0
METRES_PER_DEGREE_LON = 111412.0
SEMI_MAJOR_AXIS = 6378137.0
WGS84_FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0
EPSG_2180 = 2180
EPSG_2180_SCALE = 0.9993
EPSG_2180_CENTRAL_MERIDIAN = 19.0
EPSG_2180_FALSE_NORTHING = -5300000.0

_N = WGS84_FLATTENING / (2 - WGS84_FLATTENING)
RECTIFYING_RADIUS = SEMI_MAJOR_AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger series to the fourth power of the third flattening.
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
ECCENTRICITY_LIKE = 2 * math.sqrt(_N) / (1 + _N)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def edge_length(length_tag: Column, geometry: Column) -> Column:
    """The length tag, else the great circle between the two ends, else 0."""
    first, last = F.get(geometry, F.lit(0)), F.get(geometry, F.size(geometry) - 1)
    return F.coalesce(length_tag, great_circle(first["y"], first["x"], last["y"], last["x"]), F.lit(0.0))


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.ceil((lon + 180.0) / 6.0).cast("int")
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone


def _zone_parameters(epsg: Column):
    """Central meridian (radians), scale, false easting, false northing of a projected CRS."""
    national = epsg == EPSG_2180
    meridian = F.when(national, F.lit(EPSG_2180_CENTRAL_MERIDIAN)).otherwise((epsg % 100) * 6.0 - 183.0)
    scale = F.when(national, F.lit(EPSG_2180_SCALE)).otherwise(F.lit(UTM_SCALE))
    northing = (
        F.when(national, F.lit(EPSG_2180_FALSE_NORTHING))
        .when(epsg >= 32700, F.lit(UTM_FALSE_NORTHING_SOUTH))
        .otherwise(F.lit(0.0))
    )
    return F.radians(meridian), scale, F.lit(UTM_FALSE_EASTING), northing


def _sum(terms):
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def to_projected(lon: Column, lat: Column, epsg: Column) -> Column:
    """Degrees to metres: STRUCT<x, y> in a UTM zone or in EPSG:2180."""
    meridian, scale, easting, northing = _zone_parameters(epsg)
    sine, delta = F.sin(F.radians(lat)), F.radians(lon) - meridian
    t = F.sinh(F.atanh(sine) - ECCENTRICITY_LIKE * F.atanh(ECCENTRICITY_LIKE * sine))
    xi = F.atan2(t, F.cos(delta))
    eta = F.atanh(F.sin(delta) / F.sqrt(1 + t * t))
    x = eta + _sum([a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)])
    y = xi + _sum([a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)])
    return F.struct(
        (easting + scale * RECTIFYING_RADIUS * x).alias("x"), (northing + scale * RECTIFYING_RADIUS * y).alias("y")
    )


def to_geographic(x: Column, y: Column, epsg: Column) -> Column:
    """Metres to degrees: STRUCT<x = longitude, y = latitude>."""
    meridian, scale, easting, northing = _zone_parameters(epsg)
    xi = (y - northing) / (scale * RECTIFYING_RADIUS)
    eta = (x - easting) / (scale * RECTIFYING_RADIUS)
    xi0 = xi - _sum([b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(BETA)])
    eta0 = eta - _sum([b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(BETA)])
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi + _sum([d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(DELTA)])
    lon = meridian + F.atan2(F.sinh(eta0), F.cos(xi0))
    return F.struct(F.degrees(lon).alias("x"), F.degrees(lat).alias("y"))


def degrees_of(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes of positions in metres, as ``to_geographic`` gives them, for whole tiles."""
    national = epsg == EPSG_2180
    meridian = math.radians(EPSG_2180_CENTRAL_MERIDIAN if national else (epsg % 100) * 6.0 - 183.0)
    size = (EPSG_2180_SCALE if national else UTM_SCALE) * RECTIFYING_RADIUS
    northing = EPSG_2180_FALSE_NORTHING if national else UTM_FALSE_NORTHING_SOUTH if epsg >= 32700 else 0.0
    xi, eta = (y - northing) / size, (x - UTM_FALSE_EASTING) / size
    xi0 = xi - _sum([b * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, b in enumerate(BETA)])
    eta0 = eta - _sum([b * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, b in enumerate(BETA)])
    chi = np.arcsin(np.sin(xi0) / np.cosh(eta0))
    lat = chi + _sum([d * np.sin(2 * (j + 1) * chi) for j, d in enumerate(DELTA)])
    return np.degrees(meridian + np.arctan2(np.sinh(eta0), np.cos(xi0))), np.degrees(lat)


def is_metric(x: Column) -> Column:
    """Whether an origin is in metres rather than degrees (used when no EPSG code is given)."""
    return ~x.between(-180.0, 180.0)


def local_to_degrees(row: Column, col: Column, lat0: Column, lon0: Column, density: Column) -> Column:
    """Raster position to STRUCT<x = lon, y = lat> on the local equirectangular plane."""
    per_lon = METRES_PER_DEGREE_LON * F.cos(F.radians(lat0))
    return F.struct(
        (lon0 + col * density / per_lon).alias("x"), (lat0 - row * density / METRES_PER_DEGREE_LAT).alias("y")
    )


def degrees_to_local(lon: Column, lat: Column, lon_ref: Column, lat_ref: Column) -> Column:
    """Offset in metres of a point from a reference point, both in degrees."""
    per_lon = METRES_PER_DEGREE_LON * F.cos(F.radians(lat_ref))
    return F.struct(
        ((lon - lon_ref) * per_lon).alias("x"), ((lat - lat_ref) * METRES_PER_DEGREE_LAT).alias("y")
    )
