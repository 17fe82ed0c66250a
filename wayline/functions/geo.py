"""Geometry on longitude and latitude as Column expressions; all of them stay inside whole-stage codegen.

Arguments are Columns or column names, degrees unless said otherwise. Longitude and latitude are always
separate, named arguments, as the order in pairs differs between data sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: radii in metres, the ellipsoid's squared eccentricity, the box of the shifted coordinate system
MEAN_RADIUS, EQUATOR_RADIUS = 6371000.0, 6378137.0
GCJ_ECCENTRICITY = 0.00669342162296594323
CHINA = {"west": 72.004, "east": 137.8347, "south": 0.8293, "north": 55.8271}
DIRECTIONS = ("North", "Northeast", "East", "Southeast", "South", "Southwest", "West", "Northwest")

Value = Column | str | float


def col(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def haversine(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    """Metres on a sphere. Differences are taken of radians: of degrees, they would be off by up to 3e-10 of a short step from the SQL's."""
    lat1, lon1, lat2, lon2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * (half_lon * half_lon)
    return F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a))) * (2 * MEAN_RADIUS)


def bearing(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    """Initial bearing, 0 to 360, north 0, clockwise."""
    lat1, lon1, lat2, lon2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    east = F.sin(lon2 - lon1) * F.cos(lat2)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return (F.degrees(F.atan2(east, north)) + 360) % 360


def bearing_direction(angle: Value) -> Column:
    """The name of the nearest of eight directions."""
    place = F.floor((col(angle) + 22.5) / 45).cast("int") % 8
    return F.element_at(F.array(*map(F.lit, DIRECTIONS)), place + 1)


def bearing_gap(a: Value, b: Value) -> Column:
    """The angle between two bearings, 0 to 180."""
    gap = F.abs(col(a) - col(b))
    return F.least(gap, 360 - gap)


def speed(metres: Value, seconds: Value) -> Column:
    """0 where no time passes; negative where time runs backwards."""
    return F.when(col(seconds) == 0, 0.0).otherwise(F.try_divide(col(metres), col(seconds)))


def vector_angle(x1: Value, y1: Value, x2: Value, y2: Value, degenerate: float = 180.0) -> Column:
    """Angle between two planar vectors, 0 to 180; ``degenerate`` where one has no length."""
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    lengths = F.sqrt(x1 * x1 + y1 * y1) * F.sqrt(x2 * x2 + y2 * y2)
    return F.when(lengths == 0, degenerate).otherwise(F.degrees(F.acos(clamp(F.try_divide(x1 * x2 + y1 * y2, lengths), -1.0, 1.0))))


def heading_change(lon1: Value, lat1: Value, lon2: Value, lat2: Value, lon3: Value, lat3: Value) -> Column:
    """Turn at the middle of three points: 0 on a straight line, and where two points coincide."""
    lon1, lat1, lon2, lat2, lon3, lat3 = map(col, (lon1, lat1, lon2, lat2, lon3, lat3))
    return vector_angle(lon2 - lon1, lat2 - lat1, lon3 - lon2, lat3 - lat2, 0.0)


def turn_angle(x1: Value, y1: Value, x2: Value, y2: Value) -> Column:
    """Signed turn from one direction to the next, negative to the right; NULL where one has no length."""
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    angle = F.nullif(vector_angle(x1, y1, x2, y2, -1.0), F.lit(-1.0))
    return F.when(x1 * y2 - y1 * x2 < 0, -angle).otherwise(angle)


def edge_turn_angle(geometry1: Value, geometry2: Value) -> Column:
    """Turn from the last piece of one road to the first of the next; NULL unless both are lines."""
    g1, g2 = col(geometry1), col(geometry2)
    a, b = F.try_element_at(g1, F.lit(-2)), F.try_element_at(g1, F.lit(-1))
    c, d = F.try_element_at(g2, F.lit(1)), F.try_element_at(g2, F.lit(2))
    return turn_angle(b["lon"] - a["lon"], b["lat"] - a["lat"], d["lon"] - c["lon"], d["lat"] - c["lat"])


def turn_type(angle: Value, strict: bool = True) -> Column:
    """Class of a signed turn. ``strict`` ignores the sign, so that no turn is a right turn; else the sign counts."""
    size = F.abs(col(angle))
    side = F.lit("left_turn") if strict else F.when(col(angle) > 0, "left_turn").otherwise("right_turn")
    return F.when(size.isNull(), "unknown").when(size < 30, "straight").when(size < 120, side).otherwise("u_turn")


def along(px: Value, py: Value, x1: Value, y1: Value, x2: Value, y2: Value) -> Column:
    """Where the foot of the perpendicular from p stands on a piece of line: 0 at its start, 1 at its end, clamped."""
    px, py, x1, y1, x2, y2 = map(col, (px, py, x1, y1, x2, y2))
    length2 = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    return F.coalesce(clamp(F.try_divide((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1), length2), 0.0, 1.0), F.lit(0.0))


def point_segment_distance(lat: Value, lon: Value, lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    """Metres from a point to a piece of line; the foot is found in plain degrees."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    t = along(lon, lat, lon1, lat1, lon2, lat2)
    return haversine(lat, lon, lat1 + t * (lat2 - lat1), lon1 + t * (lon2 - lon1))


def planar_point_segment_distance(px: Value, py: Value, x1: Value, y1: Value, x2: Value, y2: Value) -> Column:
    px, py, x1, y1, x2, y2 = map(col, (px, py, x1, y1, x2, y2))
    t = along(px, py, x1, y1, x2, y2)
    dx, dy = px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1))
    return F.sqrt(dx * dx + dy * dy)


def destination(lat: Value, lon: Value, angle: Column, metres: float | Column) -> tuple[Column, Column]:
    """(lon, lat) after ``metres`` along a bearing given in radians."""
    lat1, lon1, reach = F.radians(col(lat)), F.radians(col(lon)), metres / EQUATOR_RADIUS
    sine, cosine = (F.sin(reach), F.cos(reach)) if isinstance(reach, Column) else (math.sin(reach), math.cos(reach))
    lat2 = F.asin(F.sin(lat1) * cosine + F.cos(lat1) * sine * F.cos(angle))
    lon2 = lon1 + F.atan2(F.sin(angle) * sine * F.cos(lat1), cosine - F.sin(lat1) * F.sin(lat2))
    return F.degrees(lon2), F.degrees(lat2)


def extend_line(lon: Value, lat: Value, to_lon: Value, to_lat: Value, metres: float | Column = 100.0) -> tuple[Column, Column]:
    """(lon, lat) ``metres`` from a start towards another point, the direction taken in plain degrees; the start if both coincide."""
    dx, dy = col(to_lon) - col(lon), col(to_lat) - col(lat)
    still = (dx == 0) & (dy == 0)
    lon2, lat2 = destination(lat, lon, F.atan2(dx, dy), metres)
    return F.when(still, col(lon)).otherwise(lon2), F.when(still, col(lat)).otherwise(lat2)


def arrow_points(lat: Value, lon: Value, angle: Value, size: float | Column = 20.0) -> Column:
    """Tip, left and right wing of an arrow head: an array of (lat, lon)."""
    wings = [destination(lat, lon, F.radians(col(angle)) + math.radians(side), size) for side in (150, -150)]
    return F.array(*(F.named_struct(F.lit("lat"), y, F.lit("lon"), x) for x, y in [(col(lon), col(lat)), *wings]))


def midpoint(lon1: Value, lat1: Value, lon2: Value, lat2: Value) -> tuple[Column, Column]:
    return (col(lon1) + col(lon2)) / 2, (col(lat1) + col(lat2)) / 2


def position_on_line(lon1: Value, lat1: Value, lon2: Value, lat2: Value, share: Value) -> tuple[Column, Column]:
    """(lat, lon) at a share of the way."""
    lon1, lat1, lon2, lat2, share = map(col, (lon1, lat1, lon2, lat2, share))
    return lat1 + (lat2 - lat1) * share, lon1 + (lon2 - lon1) * share


def out_of_china(lat: Value, lon: Value) -> Column:
    return ~(col(lon).between(CHINA["west"], CHINA["east"]) & col(lat).between(CHINA["south"], CHINA["north"]))


def wave(x: Column, *terms: tuple[float, float]) -> Column:
    """Sum of amplitude * sin(frequency * pi * x)."""
    return sum((F.sin(x * (math.pi * f)) * a for a, f in terms), F.lit(0.0))


def gcj_offset(lat: Value, lon: Value) -> tuple[Column, Column]:
    """(dlat, dlon) in degrees by which GCJ-02 is off WGS-84 at a point."""
    lat, lon = col(lat), col(lon)
    x, y = lon - 105.0, lat - 35.0
    root = F.sqrt(F.abs(x))
    shared = wave(x, (20.0, 6.0), (20.0, 2.0))
    north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root + (shared + wave(y, (20.0, 1.0), (40.0, 1 / 3), (160.0, 1 / 12), (320.0, 1 / 30))) * (2 / 3)
    east = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root + (shared + wave(x, (20.0, 1.0), (40.0, 1 / 3), (150.0, 1 / 12), (300.0, 1 / 30))) * (2 / 3)
    sine = F.sin(F.radians(lat))
    bulge = 1 - GCJ_ECCENTRICITY * sine * sine
    meridian = EQUATOR_RADIUS * (1 - GCJ_ECCENTRICITY) / (bulge * F.sqrt(bulge))
    parallel = EQUATOR_RADIUS / F.sqrt(bulge) * F.cos(F.radians(lat))
    return F.degrees(north / meridian), F.degrees(east / parallel)


def shifted(lat: Value, lon: Value, sign: int) -> tuple[Column, Column]:
    away = out_of_china(lat, lon)
    dlat, dlon = gcj_offset(lat, lon)
    return F.when(away, col(lat)).otherwise(col(lat) + sign * dlat), F.when(away, col(lon)).otherwise(col(lon) + sign * dlon)


def gcj_to_wgs(lat: Value, lon: Value) -> tuple[Column, Column]:
    """(lat, lon): one step of correction; points outside China stay."""
    return shifted(lat, lon, -1)


def wgs_to_gcj(lat: Value, lon: Value) -> tuple[Column, Column]:
    return shifted(lat, lon, 1)


def line_midpoint(geometry: Value) -> Column:
    """(lon, lat) at half of a line's planar length. The line is an array of (lon, lat)."""
    g = col(geometry)
    pieces = F.transform(F.sequence(F.lit(1), F.size(g) - 1), lambda i: F.struct(F.element_at(g, i).alias("a"), F.element_at(g, i + 1).alias("b")))
    length = lambda s: F.sqrt(F.pow(s["b"]["lon"] - s["a"]["lon"], F.lit(2.0)) + F.pow(s["b"]["lat"] - s["a"]["lat"], F.lit(2.0)))
    half = F.aggregate(pieces, F.lit(0.0), lambda acc, s: acc + length(s)) / 2

    def step(acc: Column, s: Column) -> Column:
        n = length(s)
        share = F.coalesce(F.try_divide(acc["left"], n), F.lit(0.0))
        here = F.struct((s["a"]["lon"] + (s["b"]["lon"] - s["a"]["lon"]) * share).alias("lon"), (s["a"]["lat"] + (s["b"]["lat"] - s["a"]["lat"]) * share).alias("lat"))
        found = acc["found"] | (acc["left"] <= n)
        return F.struct((acc["left"] - n).alias("left"), found.alias("found"), F.when(acc["found"] | ~found, acc["at"]).otherwise(here).alias("at"))

    start = F.struct(half.alias("left"), F.lit(False).alias("found"), F.element_at(g, 1).alias("at"))
    return F.when(F.size(g) < 2, F.try_element_at(g, F.lit(1))).otherwise(F.aggregate(pieces, start, step)["at"])


def style_tier(diagonal: Value) -> Column:
    """Marker radius, opacity and line width of a rendered map, by the diagonal of its bounds in metres."""
    # fixed values
    tiers = ((500.0, 6.0, 0.8, 2.5), (1000.0, 5.8, 0.8, 2.0), (1500.0, 5.0, 0.7, 1.8), (2000.0, 4.5, 0.7, 1.5), (math.inf, 4.0, 0.6, 1.2))
    chosen = None
    for most, radius, opacity, width in tiers:
        tier = F.named_struct(F.lit("radius"), F.lit(radius), F.lit("opacity"), F.lit(opacity), F.lit("width"), F.lit(width))
        test = col(diagonal) <= most
        chosen = F.when(test, tier) if chosen is None else chosen.when(test, tier)
    return chosen
