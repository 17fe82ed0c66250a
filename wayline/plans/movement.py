"""Queries on points and steps: scans, projections, geometry, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayline.functions import geo
from wayline.functions.geodesic import geodesic
from wayline.operators import near, stats, steps
from wayline.registry import ORACLE, query, table
from wayline.sources import roads, trajectories

from . import sql
from .sql import with_


def points_of(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.from_events(table(spark, d, "events"))


def steps_of(spark: SparkSession, d: str) -> DataFrame:
    return steps.steps(points_of(spark, d))


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    return roads.edges_of(points_of(spark, d))


def r(x: F.Column | str, digits: int, name: str | None = None) -> F.Column:
    return F.round(x, digits).alias(name or (x if isinstance(x, str) else "x"))


LINE, FLAT = ("lat", "lon", "lat2", "lon2"), ("lon", "lat", "lon2", "lat2")


@query(with_("points", body="SELECT devid, seq, lon, lat, t, road_id FROM points"))
def trajectory_scan(spark: SparkSession, d: str) -> DataFrame:
    return points_of(spark, d)


@query(with_("points", body="SELECT devid, seq, lat AS lon, lon AS lat FROM points"))
def swap_lat_lng(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.explode_points(trajectories.swap(trajectories.nest(points_of(spark, d)))).select("devid", "seq", "lon", "lat")


@query(with_("points", body="SELECT devid, seq, lon, lat FROM points WHERE seq < 40"))
def traj_truncate_head(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.head(points_of(spark, d), 40).select("devid", "seq", "lon", "lat")


@query(with_("backs", body="SELECT devid, seq, lon, lat FROM backs WHERE back <= 20"))
def traj_tail(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.tail(points_of(spark, d), 20).select("devid", "seq", "lon", "lat")


@query(with_("backs", body="SELECT DISTINCT devid, n FROM backs WHERE n >= 65"))
def traj_min_length(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.long_enough(points_of(spark, d), 65).groupBy("devid").agg(F.count("*").alias("n"))


@query(with_("boxes", body="SELECT devid, round(min_lon, 6) AS min_lon, round(max_lon, 6) AS max_lon, round(min_lat, 6) AS min_lat, round(max_lat, 6) AS max_lat FROM boxes"))
def traj_bounds(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.bounds(points_of(spark, d)).select("devid", *[r(c, 6) for c in ("min_lon", "max_lon", "min_lat", "max_lat")])


@query(with_("points", body="SELECT devid, seq, lon BETWEEN 104.06 AND 104.07 AND lat BETWEEN 30.65 AND 30.66 AS inside FROM points"))
def point_in_bounds(spark: SparkSession, d: str) -> DataFrame:
    return points_of(spark, d).select("devid", "seq", (F.col("lon").between(104.06, 104.07) & F.col("lat").between(30.65, 30.66)).alias("inside"))


@query(with_("edges", "boxes", body="""SELECT devid, fid FROM edges JOIN boxes ON ((lon1 BETWEEN min_lon AND max_lon AND lat1 BETWEEN min_lat AND max_lat) OR (lon2 BETWEEN min_lon AND max_lon AND lat2 BETWEEN min_lat AND max_lat))"""))
def line_in_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Edges with a vertex in the bounds of every trajectory."""
    return lines_in_bounds(spark, d, points_of(spark, d))


@query(ORACLE["line_in_bounds"])
def line_in_bounds_all(spark: SparkSession, d: str) -> DataFrame:
    """The same under its earlier name, tested against brute force."""
    return lines_in_bounds(spark, d, points_of(spark, d))


def lines_in_bounds(spark: SparkSession, d: str, points: DataFrame) -> DataFrame:
    lines = edges_of(spark, d).select(F.col("fid").alias("id"), "geometry")
    return near.lines_in_view(trajectories.bounds(points), lines).withColumnRenamed("id", "fid")


@query("SELECT c_custkey, NOT (c_custkey % 180 BETWEEN 72.004 AND 137.8347 AND c_custkey % 90 BETWEEN 0.8293 AND 55.8271) AS away FROM customer")
def out_of_china(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", geo.out_of_china((key % 90).cast("double"), (key % 180).cast("double")).alias("away"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def incremental_pending(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order that counts as done; every customer has some order."""
    done = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return trajectories.pending(table(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query(with_("pairs", body=f"SELECT devid, seq FROM (SELECT *, {sql.bearing(*LINE)} AS b FROM pairs WHERE t2 IS NOT NULL) WHERE round(least(abs(b - 100), 360 - abs(b - 100)), 4) <= 120"))
def bearing_diff_filter(spark: SparkSession, d: str) -> DataFrame:
    gap = geo.bearing_gap(geo.bearing(*LINE), F.lit(100.0))
    return steps_of(spark, d).where(F.round(gap, 4) <= 120).select("devid", "seq")


@query(with_("points", body=f"SELECT p.devid, bool_or(round({sql.haversine('lat', 'lon', '30.66', '104.07')}, 4) < 2000) AS close FROM points p GROUP BY devid"))
def near_trajectory_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether a fixed label position is within 2 km of any point; 30 m in a map's own use."""
    return points_of(spark, d).groupBy("devid").agg(F.bool_or(F.round(geo.haversine("lat", "lon", 30.66, 104.07), 4) < 2000).alias("close"))


@query(with_("edges", body=f"SELECT fid, CAST(0 AS INT) AS piece, round((lon1 + lon2) / 2, 6) AS lon, round((lat1 + lat2) / 2, 6) AS lat, round(({sql.bearing('lat1', 'lon1', 'lat2', 'lon2')} + 270) % 360, 4) AS rotation FROM edges WHERE round({sql.haversine('lat1', 'lon1', 'lat2', 'lon2')}, 4) >= 30"))
def road_arrow_plan(spark: SparkSession, d: str) -> DataFrame:
    return near.arrow_plan(edges_of(spark, d)).select("fid", "piece", r("lon", 6), r("lat", 6), r("rotation", 4))


@query(with_("steps", body="SELECT devid, seq, round(dist, 4) AS metres FROM steps"))
def haversine_distance(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(spark, d).select("devid", "seq", r("dist", 4, "metres"))


@query()
def geodesic_distance(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(spark, d).select("devid", "seq", r(geodesic(*LINE), 4, "metres"))


@query(with_("pairs", body=f"SELECT devid, seq, round({sql.bearing(*LINE)}, 4) AS bearing FROM pairs WHERE t2 IS NOT NULL"))
def bearing(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(spark, d).select("devid", "seq", r(geo.bearing(*LINE), 4, "bearing"))


@query(with_("pairs", body=f"SELECT devid, seq, {sql.direction(f'round({sql.bearing(*LINE)}, 4)')} AS direction FROM pairs WHERE t2 IS NOT NULL"))
def bearing_direction(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(spark, d).select("devid", "seq", geo.bearing_direction(F.round(geo.bearing(*LINE), 4)).alias("direction"))


@query(with_("steps", body="SELECT devid, seq, round(speed, 6) AS speed FROM steps"))
def point_speed(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(spark, d).select("devid", "seq", r("speed", 6))


TRIPLES = "SELECT devid, seq, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(lon, 2) OVER w AS lon3, lead(lat, 2) OVER w AS lat3 FROM points WINDOW w AS (PARTITION BY devid ORDER BY seq)"


@query(with_("points", triples=TRIPLES, body=f"SELECT devid, seq, round({sql.angle('lon2 - lon', 'lat2 - lat', 'lon3 - lon2', 'lat3 - lat2', '180.0')}, 3) AS angle FROM triples WHERE lon3 IS NOT NULL"))
def vector_angle(spark: SparkSession, d: str) -> DataFrame:
    rows = steps.heading_changes(points_of(spark, d))
    at = F.col
    return rows.select("devid", "seq", r(geo.vector_angle(at("lon2") - at("lon"), at("lat2") - at("lat"), at("lon3") - at("lon2"), at("lat3") - at("lat2")), 3, "angle"))


@query(with_("points", triples=TRIPLES, body=f"SELECT devid, seq, round({sql.angle('lon2 - lon', 'lat2 - lat', 'lon3 - lon2', 'lat3 - lat2', '0.0')}, 3) AS turn FROM triples WHERE lon3 IS NOT NULL"))
def turning_angle_points(spark: SparkSession, d: str) -> DataFrame:
    return steps.heading_changes(points_of(spark, d)).select("devid", "seq", r("turn", 3))


SPOT = ("30.66", "104.07")


@query(with_("pairs", body=f"SELECT devid, seq, round({sql.to_segment(*SPOT, *LINE)}, 4) AS metres FROM pairs WHERE t2 IS NOT NULL"))
def point_segment_distance(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(spark, d).select("devid", "seq", r(geo.point_segment_distance(30.66, 104.07, *LINE), 4, "metres"))


@query(with_("pairs", body=f"SELECT devid, round(min({sql.to_segment(*SPOT, *LINE)}), 4) AS metres FROM pairs WHERE t2 IS NOT NULL GROUP BY devid"))
def min_dist_point_to_traj(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(spark, d).groupBy("devid").agg(r(F.min(geo.point_segment_distance(30.66, 104.07, *LINE)), 4, "metres"))


@query(with_("points", body=f"SELECT devid, round(min({sql.to_segment('lat', 'lon', '30.65', '104.06', '30.66', '104.08')}), 4) AS metres FROM points GROUP BY devid"))
def min_dist_traj_to_segment(spark: SparkSession, d: str) -> DataFrame:
    return points_of(spark, d).groupBy("devid").agg(r(F.min(geo.point_segment_distance("lat", "lon", 30.65, 104.06, 30.66, 104.08)), 4, "metres"))


_T = sql.foot("104.07", "30.66", *FLAT)


@query(with_("pairs", body=f"SELECT devid, seq, round(sqrt(pow(104.07 - (lon + {_T} * (lon2 - lon)), 2) + pow(30.66 - (lat + {_T} * (lat2 - lat)), 2)), 7) AS degrees FROM pairs WHERE t2 IS NOT NULL"))
def planar_point_segment_distance(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(spark, d).select("devid", "seq", r(geo.planar_point_segment_distance(104.07, 30.66, *FLAT), 7, "degrees"))


_LON, _LAT = sql.destination("lat", "lon", "atan2(lon2 - lon, lat2 - lat)", 100.0)
_STILL = "lon = lon2 AND lat = lat2"


@query(with_("pairs", body=f"SELECT devid, seq, round(CASE WHEN {_STILL} THEN lon ELSE {_LON} END, 6) AS end_lon, round(CASE WHEN {_STILL} THEN lat ELSE {_LAT} END, 6) AS end_lat FROM pairs WHERE t2 IS NOT NULL"))
def extend_line(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = geo.extend_line(*FLAT)
    return steps_of(spark, d).select("devid", "seq", r(lon, 6, "end_lon"), r(lat, 6, "end_lat"))


_WINGS = [sql.destination("lat", "lon", f"(radians({sql.bearing(*LINE)}) + radians({side}))", 20.0) for side in ("150.0", "-150.0")]


@query(with_("pairs", body="SELECT devid, seq, " + ", ".join(f"round({x}, 6) AS lon_{k}, round({y}, 6) AS lat_{k}" for k, (x, y) in zip(("left", "right"), _WINGS)) + " FROM pairs WHERE t2 IS NOT NULL"))
def arrow_points(spark: SparkSession, d: str) -> DataFrame:
    rows = steps_of(spark, d).withColumn("arrow", geo.arrow_points("lat", "lon", geo.bearing(*LINE)))
    return rows.select("devid", "seq", *[r(F.col("arrow")[k][c], 6, f"{c}_{side}") for k, side in ((1, "left"), (2, "right")) for c in ("lon", "lat")])


@query(with_("pairs", body="SELECT devid, seq, round((lon + lon2) / 2, 7) AS mid_lon, round((lat + lat2) / 2, 7) AS mid_lat FROM pairs WHERE t2 IS NOT NULL"))
def midpoint(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = geo.midpoint(*FLAT)
    return steps_of(spark, d).select("devid", "seq", r(lon, 7, "mid_lon"), r(lat, 7, "mid_lat"))


@query(with_("pairs", body="SELECT devid, seq, round(lat + (lat2 - lat) * 0.3, 7) AS at_lat, round(lon + (lon2 - lon) * 0.3, 7) AS at_lon FROM pairs WHERE t2 IS NOT NULL"))
def position_on_line(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = geo.position_on_line(*FLAT, 0.3)
    return steps_of(spark, d).select("devid", "seq", r(lat, 7, "at_lat"), r(lon, 7, "at_lon"))


@query(with_("pairs", body="SELECT devid, seq, round(lon2 - lon, 7) AS dx, round(lat2 - lat, 7) AS dy FROM pairs WHERE t2 IS NOT NULL"))
def coord_vector(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(spark, d).select("devid", "seq", r(F.col("lon2") - F.col("lon"), 7, "dx"), r(F.col("lat2") - F.col("lat"), 7, "dy"))


@query(with_("edges", body="SELECT fid, round((lon1 + lon2) / 2, 6) AS lon, round((lat1 + lat2) / 2, 6) AS lat FROM edges"))
def line_midpoint(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(spark, d).withColumn("m", geo.line_midpoint("geometry")).select("fid", r("m.lon", 6, "lon"), r("m.lat", 6, "lat"))


_X, _Y = "(lon - 105.0)", "(lat - 35.0)"
_S = f"(20 * sin(6 * pi() * {_X}) + 20 * sin(2 * pi() * {_X}))"
_N = f"(-100.0 + 2.0 * {_X} + 3.0 * {_Y} + 0.2 * {_Y} * {_Y} + 0.1 * {_X} * {_Y} + 0.2 * sqrt(abs({_X})) + ({_S} + 20 * sin(pi() * {_Y}) + 40 * sin(pi() * {_Y} / 3) + 160 * sin(pi() * {_Y} / 12) + 320 * sin(pi() * {_Y} / 30)) * 2 / 3)"
_E = f"(300.0 + {_X} + 2.0 * {_Y} + 0.1 * {_X} * {_X} + 0.1 * {_X} * {_Y} + 0.1 * sqrt(abs({_X})) + ({_S} + 20 * sin(pi() * {_X}) + 40 * sin(pi() * {_X} / 3) + 150 * sin(pi() * {_X} / 12) + 300 * sin(pi() * {_X} / 30)) * 2 / 3)"
_M = "(1 - 0.00669342162296594323 * pow(sin(radians(lat)), 2))"
_DLAT = f"degrees({_N} / (6378137.0 * (1 - 0.00669342162296594323) / ({_M} * sqrt({_M}))))"
_DLON = f"degrees({_E} / (6378137.0 / sqrt({_M}) * cos(radians(lat))))"


@query(with_("points", body=f"SELECT devid, seq, round(lat - {_DLAT}, 7) AS wgs_lat, round(lon - {_DLON}, 7) AS wgs_lon FROM points"))
def gcj_to_wgs(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = geo.gcj_to_wgs("lat", "lon")
    return points_of(spark, d).select("devid", "seq", r(lat, 7, "wgs_lat"), r(lon, 7, "wgs_lon"))


@query(with_("points", body=f"SELECT devid, seq, round(lat + {_DLAT}, 7) AS gcj_lat, round(lon + {_DLON}, 7) AS gcj_lon FROM points"))
def wgs_to_gcj(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = geo.wgs_to_gcj("lat", "lon")
    return points_of(spark, d).select("devid", "seq", r(lat, 7, "gcj_lat"), r(lon, 7, "gcj_lon"))


_DIAGONAL = f"SELECT devid, round({sql.haversine('min(lat)', 'min(lon)', 'max(lat)', 'max(lon)')}, 4) AS diagonal FROM points GROUP BY devid"


@query(with_("points", spans=_DIAGONAL, body="""SELECT devid, diagonal, CASE WHEN diagonal <= 500 THEN 6.0 WHEN diagonal <= 1000 THEN 5.8 WHEN diagonal <= 1500 THEN 5.0 WHEN diagonal <= 2000 THEN 4.5 ELSE 4.0 END::DOUBLE AS radius,
    CASE WHEN diagonal <= 1000 THEN 0.8 WHEN diagonal <= 2000 THEN 0.7 ELSE 0.6 END::DOUBLE AS opacity, CASE WHEN diagonal <= 500 THEN 2.5 WHEN diagonal <= 1000 THEN 2.0 WHEN diagonal <= 1500 THEN 1.8 WHEN diagonal <= 2000 THEN 1.5 ELSE 1.2 END::DOUBLE AS width FROM spans"""))
def render_style_tier(spark: SparkSession, d: str) -> DataFrame:
    box = trajectories.bounds(points_of(spark, d), 0.0).withColumn("diagonal", F.round(geo.haversine("min_lat", "min_lon", "max_lat", "max_lon"), 4))
    return box.select("devid", "diagonal", geo.style_tier("diagonal").alias("s")).select("devid", "diagonal", "s.*")


@query("SELECT p_partkey, greatest(0, p_size * 20 - 200) AS x, greatest(0, p_size * 7 - 200) AS y, least(2000, CAST(p_partkey % 3000 AS INT) + 400) AS width, least(2000, CAST(p_partkey % 1700 AS INT) + 400) AS height FROM part")
def render_clip_rect(spark: SparkSession, d: str) -> DataFrame:
    from wayline.operators.catalog import clip_rectangle

    left, top = F.col("p_size") * 20, F.col("p_size") * 7
    box = clip_rectangle(left, top, left + (F.col("p_partkey") % 3000).cast("int"), top + (F.col("p_partkey") % 1700).cast("int"))
    return table(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


@query(with_("steps", body="SELECT devid, seq, round(dist, 4) AS dist, dt, round(speed, 6) AS speed FROM steps"))
def step_metrics(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(spark, d).select("devid", "seq", r("dist", 4), "dt", r("speed", 6))


@query(with_("steps", body="SELECT devid, seq, round(abs(speed - lag(speed) OVER (PARTITION BY devid ORDER BY seq)) / dt, 6) AS accel FROM steps WHERE dt > 0"))
def step_acceleration(spark: SparkSession, d: str) -> DataFrame:
    return steps.accelerations(steps_of(spark, d)).select("devid", "seq", r("accel", 6))


@query(with_("parts", body="SELECT devid, seg, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n FROM parts GROUP BY devid, seg"))
def equal_parts_segments(spark: SparkSession, d: str) -> DataFrame:
    parts = stats.equal_parts(points_of(spark, d)).withColumn("seg", F.col("seg").cast("bigint"))
    return parts.groupBy("devid", "seg").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count("*").alias("n"))


_ENDS = "SELECT devid, max(CASE WHEN back = 5 THEN lon END) AS lon, max(CASE WHEN back = 5 THEN lat END) AS lat, max(CASE WHEN back = 1 THEN lon END) AS lon2, max(CASE WHEN back = 1 THEN lat END) AS lat2 FROM backs WHERE n >= 5 GROUP BY devid"
_WAY = f"SELECT devid, round({sql.bearing(*LINE)}, 4) AS bearing FROM ends"


@query(with_("backs", ends=_ENDS, way=_WAY, body=f"SELECT devid, bearing, {sql.direction('bearing')} AS direction FROM way"))
def last_points_direction(spark: SparkSession, d: str) -> DataFrame:
    return steps.last_direction(points_of(spark, d)).select("devid", r("bearing", 4), "direction")


_TREND = "SELECT devid, round(max(CASE WHEN back = 2 THEN speed END) - max(CASE WHEN back = 5 THEN speed END), 6) AS change FROM (SELECT s.*, b.back FROM steps s JOIN backs b USING (devid, seq) WHERE b.n >= 5) GROUP BY devid"


@query(with_("steps", "backs", trend=_TREND, body="SELECT devid, change, CASE WHEN change > 0.1 THEN 'accelerating' WHEN change < -0.1 THEN 'decelerating' ELSE 'stable speed' END AS trend FROM trend"))
def speed_trend(spark: SparkSession, d: str) -> DataFrame:
    return steps.speed_trend(points_of(spark, d)).select("devid", r("change", 6), "trend")


@query(with_("backs", body="SELECT devid, max(CASE WHEN back = 5 THEN road_id END) AS road_k, max(CASE WHEN back = 1 THEN road_id END) AS label FROM backs GROUP BY devid"))
def mp_last_road(spark: SparkSession, d: str) -> DataFrame:
    return steps.kth_last_road(points_of(spark, d))


_RUNS = "SELECT *, sum(CASE WHEN road_id = before THEN 0 ELSE 1 END) OVER (PARTITION BY devid ORDER BY seq) - 1 AS run FROM (SELECT *, lag(road_id) OVER (PARTITION BY devid ORDER BY seq) AS before FROM points)"


@query(with_("points", runs=_RUNS, body="SELECT devid, CAST(run AS BIGINT) AS run, min(road_id) AS road_id, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n FROM runs GROUP BY devid, run"))
def road_runs(spark: SparkSession, d: str) -> DataFrame:
    return steps.road_runs(points_of(spark, d))


@query(with_("pairs", body="SELECT devid, CAST(count(*) FILTER (road_id <> road2) AS BIGINT) AS changes FROM pairs GROUP BY devid"))
def road_change_count(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(spark, d).groupBy("devid").agg(F.count_if(F.col("road_id") != F.col("road2")).alias("changes"))


@query(with_("backs", body="SELECT devid, seq, CAST(back AS BIGINT) AS back, 'line' AS layer FROM backs WHERE back BETWEEN 5 AND 20 UNION ALL SELECT devid, seq, CAST(back AS BIGINT), 'dot' FROM backs WHERE back BETWEEN 5 AND 10 AND n >= 10"))
def last_trajectory_layers(spark: SparkSession, d: str) -> DataFrame:
    return steps.last_layers(points_of(spark, d)).select("devid", "seq", F.col("back").cast("bigint").alias("back"), "layer")


@query(with_("backs", body="SELECT devid, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM backs WHERE back <= 8 GROUP BY devid"))
def last_center(spark: SparkSession, d: str) -> DataFrame:
    return steps.last_center(points_of(spark, d)).select("devid", r("lon", 6), r("lat", 6))


@query(with_("backs", body="SELECT devid, seq - n + 5 AS k, road_id FROM backs WHERE back <= 5"))
def last_roads(spark: SparkSession, d: str) -> DataFrame:
    """The last five road ids in order, k from 0."""
    order = W.partitionBy("devid").orderBy(F.desc("seq"))
    return points_of(spark, d).withColumn("back", F.row_number().over(order)).where("back <= 5").select("devid", (5 - F.col("back")).cast("bigint").alias("k"), "road_id")
