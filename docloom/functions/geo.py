"""Geospatial columns: points, haversine distance, containment, geohashes. Coordinates are (lng, lat) in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Metres, and the geohash alphabet.
EARTH_RADIUS = 6_371_000.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def point_of(col: Column, kind: T.DataType) -> tuple[Column, Column]:
    """(lng, lat) of an array, a GeoJSON point or a struct with named coordinates."""
    if isinstance(kind, T.ArrayType):
        return F.try_element_at(col, F.lit(1)).cast("double"), F.try_element_at(col, F.lit(2)).cast("double")
    if isinstance(kind, T.StructType):
        names = kind.names
        flat = [next((col.getField(n) for n in group if n in names), None) for group in (("lng", "lon", "longitude"), ("lat", "latitude"))]
        pair = point_of(col.getField("coordinates"), kind["coordinates"].dataType) if "coordinates" in names else None
        if all(c is not None for c in flat):
            lng, lat = (c.cast("double") for c in flat)
            return (F.coalesce(lng, pair[0]), F.coalesce(lat, pair[1])) if pair else (lng, lat)
        if pair:
            return pair
    nothing = F.lit(None).cast("double")
    return nothing, nothing


def literal_point(value) -> tuple[float, float]:
    if isinstance(value, dict):
        if "coordinates" in value:
            return literal_point(value["coordinates"])
        lng = next(value[k] for k in ("lng", "lon", "longitude") if k in value)
        return float(lng), float(value["lat"] if "lat" in value else value["latitude"])
    return float(value[0]), float(value[1])


def distance(a, b) -> Column:
    """Great-circle metres; null where a coordinate is."""
    (lng1, lat1), (lng2, lat2) = ((F.lit(x) if isinstance(x, float) else x for x in p) for p in (a, b))
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    h = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng2 - lng1)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_box(p, low, high) -> Column:
    (lng, lat), (x1, y1), (x2, y2) = p, literal_point(low), literal_point(high)
    return lng.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2))


def in_ring(p, ring: list) -> Column:
    """Even-odd rule on the edges that are not level."""
    lng, lat = p
    points = [literal_point(q) for q in ring]
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if y1 != y2:
            hit = (F.lit(y1) > lat) != (F.lit(y2) > lat)
            crossings = crossings + F.when(hit & (lng < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1), 1).otherwise(0)
    xs, ys = [x for x, _ in points], [y for _, y in points]
    # the ring's box first: it can be pushed down
    return lng.between(min(xs), max(xs)) & lat.between(min(ys), max(ys)) & (crossings % 2 == 1)


def around(p, center: tuple[float, float], radius: float) -> Column:
    """A box that holds all points within ``radius`` metres: plain comparisons that come before any trigonometry."""
    (lng, lat), angle = center, radius / EARTH_RADIUS * 1.0001 + 1e-9
    dlat = math.degrees(angle)
    near = p[1].between(lat - dlat, lat + dlat)
    if lat - dlat <= -90 or lat + dlat >= 90:  # a pole is inside: any longitude
        return near
    dlng = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat)))))
    west, east = lng - dlng, lng + dlng
    if west < -180 or east > 180:  # over the date line, and longitudes may be given either way
        return near
    return near & p[0].between(west, east) if -180 <= lng <= 180 else near


def in_circle(p, center, radius: float) -> Column:
    at = literal_point(center)
    return around(p, at, radius) & (distance(p, at) <= radius)


def within(p, spec: dict) -> Column:
    """Box, circle (metres), polygon's outer ring, or a point itself."""
    shape = spec.get("$geometry", spec)
    if "$box" in shape:
        return in_box(p, *shape["$box"])
    if "box" in shape:
        return in_box(p, *shape["box"])
    for key in ("$center", "$centerSphere", "center"):
        if key in shape:
            c = shape[key]
            if "$radius" in shape or "radius" in shape:
                return in_circle(p, c, float(shape.get("$radius", shape.get("radius"))))
            return in_circle(p, c[0], float(c[1]) * (EARTH_RADIUS if key == "$centerSphere" else 1))
    if "$polygon" in shape:
        return in_ring(p, shape["$polygon"])
    kind = shape.get("type")
    if kind == "Polygon":
        return in_ring(p, shape["coordinates"][0])
    if kind == "Circle":
        return in_circle(p, shape.get("center", shape.get("coordinates")), float(shape["radius"]))
    if kind == "Point":
        lng, lat = literal_point(shape)
        return (p[0] == lng) & (p[1] == lat)
    raise ValueError(f"no shape in {sorted(shape)}")


def geohash(lng: Column, lat: Column, precision: int = 12) -> Column:
    """Base-32 geohash: bits of longitude and latitude in turn, longitude first."""
    bits = 5 * precision
    cells = []
    for value, low, span, n in ((lng, -180.0, 360.0, (bits + 1) // 2), (lat, -90.0, 180.0, bits // 2)):
        cell = F.floor((value - low) / span * float(2**n))
        cells.append((F.greatest(F.lit(0), F.least(cell, F.lit(2**n - 1))).cast("bigint"), n))
    out = []
    for c in range(precision):
        digit = F.lit(0).cast("bigint")
        for b in range(5 * c, 5 * c + 5):
            cell, n = cells[b % 2]
            digit = digit * 2 + F.shiftright(cell, n - 1 - b // 2).bitwiseAND(F.lit(1))
        out.append(F.substring(F.lit(BASE32), digit.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def geohash_bounds(code: str) -> tuple[float, float, float, float]:
    """(lng low, lat low, lng high, lat high) of a geohash cell."""
    low, high = [-180.0, -90.0], [180.0, 90.0]
    bits = "".join(f"{BASE32.index(c):05b}" for c in code)
    for i, bit in enumerate(bits):
        middle = (low[i % 2] + high[i % 2]) / 2
        (low if bit == "1" else high)[i % 2] = middle
    return low[0], low[1], high[0], high[1]


def geohash_neighbours(code: str) -> list[str]:
    """The up to eight cells around one, of the same precision."""
    x1, y1, x2, y2 = geohash_bounds(code)
    cells = set()
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            lng, lat = (x1 + x2) / 2 + dx * (x2 - x1), (y1 + y2) / 2 + dy * (y2 - y1)
            if -90 <= lat <= 90:
                cells.add(encode((lng + 180) % 360 - 180, lat, len(code)))
    return sorted(cells - {code})


def encode(lng: float, lat: float, precision: int = 12) -> str:
    box, value, out = [[-180.0, 180.0], [-90.0, 90.0]], (lng, lat), 0
    for i in range(5 * precision):
        side = box[i % 2]
        middle = (side[0] + side[1]) / 2
        bit = value[i % 2] >= middle
        side[0 if bit else 1] = middle
        out = out * 2 + bit
    return "".join(BASE32[out >> 5 * (precision - 1 - k) & 31] for k in range(precision))
