"""Geographic predicates and cell codes as expressions over latitude and longitude."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres; tolerance of a polygon's edges in degrees.
EARTH_RADIUS_M = 6_371_008.8
EDGE_TOLERANCE = 1e-10


def within_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive; a west beyond the east crosses the antimeridian."""
    across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return (lat >= south) & (lat <= north) & across


def distance_m(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Haversine."""
    dlat, dlon = F.radians(lat - lat0), F.radians(lon - lon0)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def radius_box(lat0: float, lon0: float, metres: float) -> tuple[float, float, float, float]:
    """(south, west, north, east) that holds the circle."""
    d = math.degrees(metres / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-9
    south, north = lat0 - d, lat0 + d
    if south <= -90 or north >= 90:
        return max(-90.0, south), -180.0, min(90.0, north), 180.0
    w = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat0)))))
    west, east = lon0 - w, lon0 + w
    if east - west >= 360:
        return south, -180.0, north, 180.0
    return south, (west + 540) % 360 - 180, north, (east + 540) % 360 - 180


def within_radius(lat: Column, lon: Column, lat0: float, lon0: float, metres: float) -> Column:
    """Inclusive. The box goes first: a scan can use it."""
    return within_box(lat, lon, *radius_box(lat0, lon0, metres)) & (distance_m(lat, lon, lat0, lon0) <= metres)


def _turn(d: float) -> float:
    return (d + 540) % 360 - 180


def within_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over (lat, lon) corners, edges included; an edge takes the shorter way round in longitude.

    One expression over the corners; longitudes are unrolled from the first corner.
    """
    xs = [ring[0][1]]
    for _, x in ring[1:]:
        xs.append(xs[-1] + _turn(x - xs[-1]))
    ys = [y for y, _ in ring]
    lo, hi = min(xs), max(xs)
    # the point's longitude in the ring's turn
    px = F.when(lon < lo - EDGE_TOLERANCE, lon + 360).when(lon > hi + EDGE_TOLERANCE, lon - 360).otherwise(lon)
    on, crossings = [], []
    for i in range(len(ring)):
        x1, y1, x2, y2 = xs[i], ys[i], xs[(i + 1) % len(xs)], ys[(i + 1) % len(ys)]
        cross = (px - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        t = EDGE_TOLERANCE
        on.append((F.abs(cross) <= t) & (px >= min(x1, x2) - t) & (px <= max(x1, x2) + t) & (lat >= min(y1, y2) - t) & (lat <= max(y1, y2) + t))
        if y1 != y2:
            at = (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1
            crossings.append((((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (px < at)).cast("int"))
    odd = F.pmod(reduce(lambda a, b: a + b, crossings, F.lit(0)), F.lit(2)) == 1
    box = (lat >= min(ys) - EDGE_TOLERANCE) & (lat <= max(ys) + EDGE_TOLERANCE)
    return box & (reduce(lambda a, b: a | b, on) | odd)


def geohash(lat: Column, lon: Column, bits: int) -> Column:
    """Interleaved bits of longitude and latitude as a long, longitude first; 8 to 48 bits in whole bytes."""
    if bits % 8 or not 8 <= bits <= 48:
        raise ValueError("8 to 48 bits in whole bytes")
    nx = ny = bits // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << nx)), F.lit((1 << nx) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * (1 << ny)), F.lit((1 << ny) - 1)).cast("long")
    out = F.lit(0).cast("long")
    for i in range(nx):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)), 2 * i + 1)).bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(F.lit(1)), 2 * i))
    return out


def cover(south: float, west: float, north: float, east: float, bits: int, most: int = 256) -> list[int] | None:
    """Cells that cover a box, or None where there would be more than ``most``: then the box alone prunes."""
    n = bits // 2
    spans = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    cell = lambda v, lo, size: min((1 << n) - 1, max(0, int((v - lo) / size * (1 << n))))
    ys = range(cell(south, -90, 180), cell(north, -90, 180) + 1)
    xs = [x for a, b in spans for x in range(cell(a, -180, 360), cell(b, -180, 360) + 1)]
    if len(xs) * len(ys) > most:
        return None
    weave = lambda x, y: sum(((x >> i & 1) << (2 * i + 1)) | ((y >> i & 1) << (2 * i)) for i in range(n))
    return sorted({weave(x, y) for x in xs for y in ys})
