"""Distances, the one metric projection used (UTM 25 south), and ring geometry as column math."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0088  # fixed value: mean earth radius

# Fixed values of the GRS80 ellipsoid and of UTM zone 25 south.
_A = 6378137.0
_F = 1 / 298.257222101
_E2 = _F * (2 - _F)
_EP2 = _E2 / (1 - _E2)
_K0 = 0.9996
_LON0 = math.radians(-33.0)
_EAST0, _NORTH0 = 500000.0, 10000000.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2.0) + F.cos(a) * F.cos(b) * F.pow(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2.0
    )
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def cell_id(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f_%.4f", lat, lon)


def _meridian_arc(phi: Column) -> Column:
    e2, e4, e6 = _E2, _E2**2, _E2**3
    return F.lit(_A) * (
        F.lit(1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - F.lit(3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + F.lit(15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - F.lit(35 * e6 / 3072) * F.sin(6 * phi)
    )


def to_utm(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres by the transverse Mercator series."""
    phi = F.radians(lat)
    n = F.lit(_A) / F.sqrt(1 - F.lit(_E2) * F.pow(F.sin(phi), 2.0))
    t = F.pow(F.tan(phi), 2.0)
    c = F.lit(_EP2) * F.pow(F.cos(phi), 2.0)
    a = (F.radians(lon) - F.lit(_LON0)) * F.cos(phi)
    x = F.lit(_K0) * n * (
        a
        + (1 - t + c) * F.pow(a, 3.0) / 6
        + (5 - 18 * t + t * t + 72 * c - 58 * _EP2) * F.pow(a, 5.0) / 120
    ) + F.lit(_EAST0)
    y = F.lit(_K0) * (
        _meridian_arc(phi)
        + n * F.tan(phi) * (
            a * a / 2
            + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4.0) / 24
            + (61 - 58 * t + t * t + 600 * c - 330 * _EP2) * F.pow(a, 6.0) / 720
        )
    ) + F.lit(_NORTH0)
    return F.struct(x.alias("x"), y.alias("y"))


def from_utm(x: Column, y: Column) -> Column:
    """struct(lon, lat): the inverse series."""
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    mu = (y - _NORTH0) / F.lit(_K0 * _A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    phi = (
        mu
        + F.lit(3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + F.lit(21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + F.lit(151 * e1**3 / 96) * F.sin(6 * mu)
    )
    s2 = F.pow(F.sin(phi), 2.0)
    n = F.lit(_A) / F.sqrt(1 - F.lit(_E2) * s2)
    r = F.lit(_A * (1 - _E2)) / F.pow(1 - F.lit(_E2) * s2, 1.5)
    t = F.pow(F.tan(phi), 2.0)
    c = F.lit(_EP2) * F.pow(F.cos(phi), 2.0)
    d = (x - _EAST0) / (n * F.lit(_K0))
    lat = phi - (n * F.tan(phi) / r) * (
        d * d / 2
        - (5 + 3 * t + 10 * c - 4 * c * c - 9 * _EP2) * F.pow(d, 4.0) / 24
        + (61 + 90 * t + 298 * c + 45 * t * t - 252 * _EP2 - 3 * c * c) * F.pow(d, 6.0) / 720
    )
    lon = F.lit(_LON0) + (
        d
        - (1 + 2 * t + c) * F.pow(d, 3.0) / 6
        + (5 - 2 * c + 28 * t - 3 * c * c + 8 * _EP2 + 24 * t * t) * F.pow(d, 5.0) / 120
    ) / F.cos(phi)
    return F.struct(F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))


def _edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring of struct(x, y)."""
    n = F.size(ring)
    return F.arrays_zip(
        F.slice(ring, F.lit(1), n - 1).alias("a"),
        F.slice(ring, F.lit(2), n - 1).alias("b"),
    )


def _fold(ring: Column, term) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda acc, e: acc + term(e["a"], e["b"]))


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def _shift(ring: Column) -> Column:
    """Move the ring to its first vertex: keeps the products small."""
    first = F.try_element_at(ring, F.lit(1))
    return F.transform(
        ring, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y"))
    )


def ring_signed_area(ring: Column) -> Column:
    return _fold(_shift(ring), lambda a, b: _cross(a, b)) / 2


def polygon_area(rings: Column) -> Column:
    """First ring minus holes, in the square of the ring's unit."""
    sizes = F.transform(rings, lambda r: F.abs(ring_signed_area(r)))
    total = F.aggregate(sizes, F.lit(0.0), lambda acc, v: acc + v)
    return 2 * F.try_element_at(sizes, F.lit(1)) - total


def polygon_centroid(rings: Column) -> Column:
    """Area-weighted centroid as struct(x, y); holes weigh negatively."""
    origin = F.try_element_at(F.try_element_at(rings, F.lit(1)), F.lit(1))

    def moments(r: Column, i: Column) -> Column:
        rel = F.transform(
            r, lambda p: F.struct((p["x"] - origin["x"]).alias("x"), (p["y"] - origin["y"]).alias("y"))
        )
        area = _fold(rel, lambda a, b: _cross(a, b)) / 2
        sign = F.when(area < 0, -1.0).otherwise(1.0) * F.when(i == 0, 1.0).otherwise(-1.0)
        mx = _fold(rel, lambda a, b: (a["x"] + b["x"]) * _cross(a, b)) / 6
        my = _fold(rel, lambda a, b: (a["y"] + b["y"]) * _cross(a, b)) / 6
        return F.struct((sign * area).alias("m"), (sign * mx).alias("mx"), (sign * my).alias("my"))

    parts = F.transform(rings, moments)
    add = lambda name: F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p[name])
    mass = add("m")
    return F.struct(
        (origin["x"] + add("mx") / mass).alias("x"), (origin["y"] + add("my") / mass).alias("y")
    )


def crossings(ring: Column, x: Column, y: Column) -> Column:
    """Number of ring edges a ray to +x crosses."""
    return F.aggregate(
        _edges(ring),
        F.lit(0),
        lambda acc, e: acc
        + F.when(
            ((e["a"]["y"] > y) != (e["b"]["y"] > y))
            & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
            1,
        ).otherwise(0),
    )


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd containment over all rings, so holes are outside."""
    total = F.aggregate(F.transform(rings, lambda r: crossings(r, x, y)), F.lit(0), lambda acc, v: acc + v)
    return total % 2 == 1


def scanline_point(rings: Column) -> Column:
    """Middle of the widest inside stretch on the mid-height line: always inside."""
    vertices = F.flatten(rings)
    ys = F.transform(vertices, lambda p: p["y"])
    # a quarter-step off the exact middle avoids running through a vertex row
    mid = F.array_min(ys) + (F.array_max(ys) - F.array_min(ys)) * F.lit(0.5000001)
    hits = F.array_sort(
        F.flatten(
            F.transform(
                rings,
                lambda r: F.transform(
                    F.filter(_edges(r), lambda e: (e["a"]["y"] > mid) != (e["b"]["y"] > mid)),
                    lambda e: e["a"]["x"]
                    + (mid - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]),
                ),
            )
        )
    )
    spans = F.transform(
        F.sequence(F.lit(1), F.size(hits) - 1, F.lit(2)),
        lambda i: F.struct(
            (F.element_at(hits, i + 1) - F.element_at(hits, i)).alias("width"),
            ((F.element_at(hits, i + 1) + F.element_at(hits, i)) / 2).alias("x"),
        ),
    )
    return F.struct(F.array_max(spans)["x"].alias("x"), mid.alias("y"))


def reproject(rings: Column, to_metric: bool = True) -> Column:
    """Every vertex from degrees to metres or back."""
    if to_metric:
        return F.transform(rings, lambda r: F.transform(r, lambda p: to_utm(p["x"], p["y"])))
    return F.transform(
        rings,
        lambda r: F.transform(
            r,
            lambda p: F.struct(from_utm(p["x"], p["y"])["lon"].alias("x"), from_utm(p["x"], p["y"])["lat"].alias("y")),
        ),
    )
