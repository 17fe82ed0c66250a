"""Trajectories as one row per point, and the nested form with one row per trajectory.

The canonical form is ``points(devid, seq, lon, lat, t, road_id)``: windows partition by devid and order by
seq, so a single shuffle by devid serves steps, segments and statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from wayline.functions import geo


def scan(spark: SparkSession, path: str, gcj: bool = False) -> DataFrame:
    """points from nested trajectories in Parquet: devid, o_geo, and tmp or tms, fmm_traj or opath.

    tmp goes before tms and fmm_traj before opath where both are there. ``gcj`` converts GCJ-02 coordinates.
    """
    raw = spark.read.parquet(path)
    first_of = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns])
    return explode_points(raw.select("devid", F.col("o_geo").alias("points"), first_of("tmp", "tms").alias("times"), first_of("fmm_traj", "opath").alias("road_ids")), gcj)


def explode_points(nested: DataFrame, gcj: bool = False) -> DataFrame:
    """points of (devid, points, times, road_ids); times and ids that are missing are NULL."""
    rows = nested.select("devid", F.posexplode("points").alias("seq", "p"), "times", "road_ids")
    lat, lon = geo.gcj_to_wgs(F.col("p.lat"), F.col("p.lon")) if gcj else (F.col("p.lat"), F.col("p.lon"))
    return rows.select("devid", F.col("seq").cast("bigint").alias("seq"), lon.alias("lon"), lat.alias("lat"), F.get("times", F.col("seq")).alias("t"), F.get("road_ids", F.col("seq")).alias("road_id"))


def nest(points: DataFrame, *keys: str) -> DataFrame:
    """devid, ``keys``, points, times, road_ids: arrays in the order of seq. One row must fit a trajectory."""
    each = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat", "t", "road_id")))
    got = points.groupBy("devid", *keys).agg(each.alias("each"))
    return got.select("devid", *keys, F.transform("each", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"), F.col("each.t").alias("times"), F.col("each.road_id").alias("road_ids"))


def consistent(nested: DataFrame) -> DataFrame:
    """Trajectories whose points, times and road ids are as many as one another."""
    return nested.where((F.size("points") == F.size("times")) & (F.size("points") == F.size("road_ids")))


def from_events(events: DataFrame) -> DataFrame:
    """points made from an event stream: every user walks a grid by small steps that the events fix.

    Coordinates are sums of whole micro-degrees, so every engine gets the same doubles.
    """
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    k = F.get_json_object("props", "$.k").cast("bigint")
    east = 104060000 + (F.col("user_id") % 10) * 3000 + F.sum(k * 10 - 495).over(order)
    north = 30650000 + (F.floor(F.col("user_id") / 10).cast("bigint") % 10) * 3000 + F.sum(F.floor(F.col("value") * 100).cast("bigint") % 1001 - 500).over(order)
    rows = events.select(F.col("user_id").alias("devid"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), east.alias("lon6"), north.alias("lat6"))
    cell = F.floor(F.col("lon6") / 1000.0).cast("bigint") * 100000 + F.floor(F.col("lat6") / 1000.0).cast("bigint")
    return rows.select("devid", "seq", (F.col("lon6").cast("double") / 1000000).alias("lon"), (F.col("lat6").cast("double") / 1000000).alias("lat"), "t", cell.alias("road_id"))


def head(points: DataFrame, n: int = 150) -> DataFrame:
    return points.where(F.col("seq") < n)


def tail(points: DataFrame, n: int = 20) -> DataFrame:
    """The last n points of every trajectory, all of a shorter one."""
    return points.withColumn("back", F.row_number().over(W.partitionBy("devid").orderBy(F.desc("seq")))).where(F.col("back") <= n).drop("back")


def long_enough(points: DataFrame, n: int = 150) -> DataFrame:
    """Points of the trajectories with at least n points."""
    return points.withColumn("n", F.count("*").over(W.partitionBy("devid"))).where(F.col("n") >= n).drop("n")


def swap(nested: DataFrame) -> DataFrame:
    """Points with first and second coordinate swapped, for sources that write latitude first."""
    return nested.withColumn("points", F.transform("points", lambda p: F.struct(p["lat"].alias("lon"), p["lon"].alias("lat"))))


def bounds(points: DataFrame, buffer: float = 0.01) -> DataFrame:
    """devid, min_lon, max_lon, min_lat, max_lat, widened by a buffer in degrees."""
    low, high = (lambda c: F.min(c) - buffer), (lambda c: F.max(c) + buffer)
    return points.groupBy("devid").agg(low("lon").alias("min_lon"), high("lon").alias("max_lon"), low("lat").alias("min_lat"), high("lat").alias("max_lat"))


def bounds_over(window: WindowSpec, buffer: float = 0.01) -> dict[str, Column]:
    """The same beside every point, in a window over its trajectory."""
    least = {"min_lon": F.min("lon"), "max_lon": F.max("lon"), "min_lat": F.min("lat"), "max_lat": F.max("lat")}
    return {k: c.over(window) + (buffer if k[:3] == "max" else -buffer) for k, c in least.items()}


def pending(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``work`` without a result yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
