"""Distances, grid corners and polygon tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import EARTH_DIAMETER_KM, KM_PER_DEGREE


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.pow(F.sin((F.radians(lat1) - F.radians(lat2)) / 2), F.lit(2.0))
    half_lon = F.pow(F.sin((F.radians(lon1) - F.radians(lon2)) / 2), F.lit(2.0))
    chord = half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon
    return F.lit(EARTH_DIAMETER_KM) * F.asin(F.sqrt(chord))


def flat_km_squared(lat: Column, lon: Column, cell_lat: Column, cell_lon: Column) -> Column:
    """Squared distance on the local plane of ``(lat, lon)``."""
    dy = (cell_lat - lat) * KM_PER_DEGREE
    dx = (cell_lon - lon) * KM_PER_DEGREE * F.cos(F.radians(lat))
    return dy * dy + dx * dx


def bilinear_corners(lat: Column, lon: Column, lat0: float, lon0: float, step: float,
                     n_lat: int, n_lon: int) -> Column:
    """The four grid nodes around a point, as an array of ``(row, col, weight)``.

    The lower-left node is clipped so that all four exist, and a point outside the grid sits on its edge.
    """
    y, x = (lat - lat0) / step, (lon - lon0) / step
    row = F.least(F.greatest(F.floor(y), F.lit(0)), F.lit(n_lat - 2)).cast("int")
    col = F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(n_lon - 2)).cast("int")
    fy = F.least(F.greatest(y - row, F.lit(0.0)), F.lit(1.0))
    fx = F.least(F.greatest(x - col, F.lit(0.0)), F.lit(1.0))

    def corner(dr: int, dc: int) -> Column:
        weight = (fy if dr else 1 - fy) * (fx if dc else 1 - fx)
        return F.struct((row + dr).alias("row"), (col + dc).alias("col"), weight.alias("weight"))

    return F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))


def nearest_node(v: Column, origin: float, step: float) -> Column:
    """Index of the grid line nearest to ``v``; halves go to the even line."""
    return F.rint((v - origin) / step).cast("int")


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"),
        F.get(ring, (i + 1) % n)["x"].alias("x2"), F.get(ring, (i + 1) % n)["y"].alias("y2")))


def covers(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a ring of ``(x, y)``; the outline itself counts as inside."""
    edges = _edges(ring)
    crossings = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (
        x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]))
    return (F.size(crossings) % 2 == 1) | F.exists(edges, lambda e: _edge_distance_squared(e, x, y) == 0.0)


def _edge_distance_squared(e: Column, x: Column, y: Column) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    length2 = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / length2, F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    px, py = x - (e["x1"] + t * dx), y - (e["y1"] + t * dy)
    return px * px + py * py


def distance_to_ring(ring: Column, x: Column, y: Column) -> Column:
    """Distance to the outline, in coordinate units; zero inside."""
    nearest = F.array_min(F.transform(_edges(ring), lambda e: _edge_distance_squared(e, x, y)))
    return F.when(covers(ring, x, y), F.lit(0.0)).otherwise(F.sqrt(nearest))


def bounding_box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
