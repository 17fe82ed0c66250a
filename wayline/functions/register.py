"""The geometry as SQL functions, and segmentation by road as a table function, for spark.sql."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from wayline.functions import geo
from wayline.functions.geodesic import geodesic
from wayline.operators.segmentation import UPPER, WEIGHTS, Costs, best_cuts, merge_small, road_starts

# bodies in SQL, so that Catalyst inlines them
FUNCTIONS = {
    "haversine_metres(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": """2 * 6371000D * atan2(
        sqrt(power(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin((radians(lon2) - radians(lon1)) / 2), 2)),
        sqrt(greatest(0D, 1 - (power(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin((radians(lon2) - radians(lon1)) / 2), 2)))))""",
    "bearing_degrees(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": """(degrees(atan2(
        sin(radians(lon2) - radians(lon1)) * cos(radians(lat2)),
        cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1)))) + 360) % 360""",
    "bearing_gap_degrees(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "least(abs(a - b), 360 - abs(a - b))",
    "bearing_name(degrees DOUBLE) RETURNS STRING": "element_at(array('North', 'Northeast', 'East', 'Southeast', 'South', 'Southwest', 'West', 'Northwest'), CAST(floor((degrees + 22.5D) / 45) AS INT) % 8 + 1)",
    "speed_of(metres DOUBLE, seconds DOUBLE) RETURNS DOUBLE": "CASE WHEN seconds = 0 THEN 0D ELSE metres / seconds END",
}
# functions of functions have no SQL text of their own, so this one is written out
LINE_MIDPOINT = """CASE WHEN size(line) < 2 THEN try_element_at(line, 1) ELSE aggregate(
    transform(sequence(1, size(line) - 1), i -> struct(line[i - 1] AS a, line[i] AS b, sqrt(pow(line[i].lon - line[i - 1].lon, 2D) + pow(line[i].lat - line[i - 1].lat, 2D)) AS n)),
    struct(aggregate(transform(sequence(1, size(line) - 1), i -> sqrt(pow(line[i].lon - line[i - 1].lon, 2D) + pow(line[i].lat - line[i - 1].lat, 2D))), 0D, (x, y) -> x + y) / 2 AS rest, false AS found, line[0] AS spot),
    (acc, s) -> struct(acc.rest - s.n AS rest, acc.found OR acc.rest <= s.n AS found,
      CASE WHEN acc.found OR acc.rest > s.n THEN acc.spot ELSE struct(s.a.lon + (s.b.lon - s.a.lon) * coalesce(try_divide(acc.rest, s.n), 0D) AS lon, s.a.lat + (s.b.lat - s.a.lat) * coalesce(try_divide(acc.rest, s.n), 0D) AS lat) END AS spot)).spot END"""


POINT, LINE = "DOUBLE", "ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>"
PAIR = "lat1 lon1 lat2 lon2"
# name: (what it is, its arguments, names of the parts of a result that has several)
GEOMETRY: dict[str, tuple] = {
    "vector_angle": (geo.vector_angle, "x1 y1 x2 y2", None),
    "heading_change": (geo.heading_change, "lon1 lat1 lon2 lat2 lon3 lat3", None),
    "turn_angle": (geo.turn_angle, "x1 y1 x2 y2", None),
    "edge_turn_angle": (geo.edge_turn_angle, "line1:line line2:line", None),
    "turn_type": (geo.turn_type, "angle", None),
    "point_segment_metres": (geo.point_segment_distance, f"lat lon {PAIR}", None),
    "point_segment_degrees": (geo.planar_point_segment_distance, "px py x1 y1 x2 y2", None),
    "extend_line": (geo.extend_line, "lon lat to_lon to_lat metres", ("lon", "lat")),
    "arrow_points": (geo.arrow_points, "lat lon angle size", None),
    "midpoint": (geo.midpoint, "lon1 lat1 lon2 lat2", ("lon", "lat")),
    "position_on_line": (geo.position_on_line, "lon1 lat1 lon2 lat2 share", ("lat", "lon")),
    "out_of_china": (geo.out_of_china, "lat lon", None),
    "gcj_to_wgs": (geo.gcj_to_wgs, "lat lon", ("lat", "lon")),
    "wgs_to_gcj": (geo.wgs_to_gcj, "lat lon", ("lat", "lon")),
    "style_tier": (geo.style_tier, "diagonal", None),
}


def as_sql(spark: SparkSession, name: str) -> str:
    """The statement that makes a geometry function from its Column expression, so that it is written once."""
    function, given, parts = GEOMETRY[name]
    typed = [(a.split(":")[0], LINE if a.endswith(":line") else POINT) for a in given.split()]
    frame = spark.range(1).select(*[F.lit(None).cast(kind).alias(a) for a, kind in typed])
    made = function(*[F.col(a) for a, _ in typed])
    made = made if parts is None else F.named_struct(*[x for k, c in zip(parts, made) for x in (F.lit(k), c)])
    body = frame.select(made.alias("x"))._jdf.queryExecution().analyzed().expressions().head().child().sql()
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} {kind}' for a, kind in typed)}) RETURN {body}"


def merged_by_road(lon: tuple, lat: tuple, road: tuple, angle: float = 30.0, reach: int = 5, least: int | None = 30) -> list[list[int]]:
    starts = road_starts(np.array(lon), np.array(lat), np.array(road), angle, reach)
    found = [list(range(a, b)) for a, b in zip(starts, [*starts[1:], len(lon)])]
    return found if least is None else merge_small(found, least)


class RoadSegments:
    """seq and segment of the points of one partition, which has devid, seq, lon, lat and road_id in the order of seq."""

    def __init__(self) -> None:
        self.points: list[tuple] = []

    def eval(self, row: Row) -> None:
        self.points.append((row["devid"], row["seq"], row["lon"], row["lat"], row["road_id"]))

    def terminate(self) -> Iterator[tuple]:
        if not self.points:
            return
        _, _, lon, lat, road = zip(*self.points)
        for segment, members in enumerate(merged_by_road(lon, lat, road)):
            for place in members:
                yield self.points[place][0], self.points[place][1], segment


class Segmented:
    """A table function of any table with devid, seq, lon, lat and road_id: its rows, all columns as they are, with seg and pos behind.

    Partitions by devid and orders by seq by itself; a call doesn't say how.
    """

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.options: tuple = ()

    @staticmethod
    def described(points: AnalyzeArgument) -> AnalyzeResult:
        if not points.isTable:
            raise ValueError("the first argument is a table")
        needed = {"devid", "seq", "lon", "lat", "road_id"} - set(points.dataType.fieldNames())
        if needed:
            raise ValueError(f"the table has no column {', '.join(sorted(needed))}")
        schema = StructType([*points.dataType.fields]).add("seg", LongType()).add("pos", LongType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("devid")], orderBy=[OrderingColumn("seq")])

    def columns(self, *names: str) -> list[tuple]:
        return [tuple(r[c] for r in self.rows) for c in names]

    def numbered(self, segments: list[list[int]]) -> Iterator[tuple]:
        for seg, members in enumerate(segments):
            for pos, place in enumerate(members):
                yield (*self.rows[place], seg, pos)


class SegmentsByRoad(Segmented):
    @staticmethod
    def analyze(points: AnalyzeArgument, angle: AnalyzeArgument | None = None, reach: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        return Segmented.described(points)

    def eval(self, points: Row, angle: float = 30.0, reach: int = 5, least: int | None = 30) -> None:
        self.rows.append(points)
        self.options = (float(angle), reach, least)

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield from self.numbered(merged_by_road(*self.columns("lon", "lat", "road_id"), *self.options))


class SegmentsByCost(Segmented):
    """Also reads t; a trajectory of one point has no segment."""

    @staticmethod
    def analyze(points: AnalyzeArgument, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        return Segmented.described(points)

    def eval(self, points: Row, least: int = 10) -> None:
        self.rows.append(points)
        self.options = (least,)

    def terminate(self) -> Iterator[tuple]:
        if len(self.rows) > 1:
            starts = best_cuts(Costs(*map(np.array, self.columns("lon", "lat", "t", "road_id")), WEIGHTS, UPPER), *self.options)
            yield from self.numbered([list(range(a, b)) for a, b in zip(starts, [*starts[1:], len(self.rows)])])


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: ``SELECT haversine_metres(...)``, the other geometry by its names in ``GEOMETRY``,
    ``SELECT * FROM road_segments(TABLE(points) PARTITION BY devid ORDER BY seq)``, and, for a devid of any type and with all the
    table's columns, ``SELECT * FROM segments_by_road(TABLE(points), least => 30)`` (no merging where least is NULL) and
    ``segments_by_cost(TABLE(points), least => 10)``. A partition's points must fit a task."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name in GEOMETRY:
        spark.sql(as_sql(spark, name))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION line_midpoint(line {LINE}) RETURN {LINE_MIDPOINT}")
    spark.udf.register("geodesic_metres", geodesic)
    spark.udtf.register("road_segments", F.udtf(RoadSegments, returnType="devid bigint, seq bigint, segment bigint"))
    spark.udtf.register("segments_by_road", F.udtf(SegmentsByRoad))
    spark.udtf.register("segments_by_cost", F.udtf(SegmentsByCost))
