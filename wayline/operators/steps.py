"""What lies between consecutive points: distance, time, speed, acceleration, direction, road runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayline.functions import geo

TREND_LABELS = {"mp": ("accelerating", "decelerating", "stable speed"), "tte": ("Speed up", "Slow down", "Steady speed")}


def steps(points: DataFrame, *keys: str) -> DataFrame:
    """Each point with the next of its trajectory (and of its ``keys``): lon2, lat2, t2, road2, dist, dt, speed.

    The last point has no step and is left out. speed is 0 where dt is 0.
    """
    order = W.partitionBy("devid", *keys).orderBy("seq")
    nexts = [F.lead(c).over(order).alias(n) for c, n in (("lon", "lon2"), ("lat", "lat2"), ("t", "t2"), ("road_id", "road2"), ("seq", "seq2"))]
    rows = points.select("*", *nexts).where("seq2 is not null").drop("seq2")
    rows = rows.withColumns({"dist": geo.haversine("lat", "lon", "lat2", "lon2"), "dt": F.col("t2") - F.col("t")})
    return rows.withColumn("speed", geo.speed("dist", "dt"))


def accelerations(stepped: DataFrame, *keys: str) -> DataFrame:
    """Steps that take time, each with accel: its change of speed against the one before, over its own time; NULL for the first."""
    order = W.partitionBy("devid", *keys).orderBy("seq")
    return stepped.where("dt > 0").withColumn("accel", F.abs(F.col("speed") - F.lag("speed").over(order)) / F.col("dt"))


def from_end(points: DataFrame, most: int) -> DataFrame:
    """The last ``most`` points of each trajectory, with back: 1 for the last one. Cut off early by the window's group limit."""
    back = F.row_number().over(W.partitionBy("devid").orderBy(F.desc("seq")))
    return points.withColumn("back", back).where(F.col("back") <= most)


def last_direction(points: DataFrame, k: int = 5) -> DataFrame:
    """devid, bearing, direction from the k-th last to the last point; shorter trajectories are left out."""
    ends = from_end(points, k).where(F.col("back").isin(1, k)).groupBy("devid").agg(
        F.count("*").alias("n"), *[F.max_by(c, F.when(F.col("back") == b, 1)).alias(f"{c}{b}") for b in (1, k) for c in ("lon", "lat")]
    )
    ends = ends.where("n = 2").withColumn("bearing", geo.bearing(f"lat{k}", f"lon{k}", "lat1", "lon1"))
    return ends.select("devid", "bearing", geo.bearing_direction("bearing").alias("direction"))


def speed_trend(points: DataFrame, k: int = 5, labels: tuple[str, str, str] = TREND_LABELS["mp"]) -> DataFrame:
    """devid, change, trend: last less first of the speeds among the last k points, against 0.1 m/s either way."""
    recent = steps(from_end(points, k), *())
    change = recent.groupBy("devid").agg(F.count("*").alias("n"), (F.max_by("speed", "seq") - F.min_by("speed", "seq")).alias("change")).where(F.col("n") == k - 1)
    up, down, flat = labels
    return change.select("devid", "change", F.when(F.col("change") > 0.1, up).when(F.col("change") < -0.1, down).otherwise(flat).alias("trend"))


def kth_last_road(points: DataFrame, k: int = 5) -> DataFrame:
    """devid, road_k (the k-th last road id, NULL if there are fewer points), label (the last)."""
    at = lambda b: F.max(F.when(F.col("back") == b, F.col("road_id")))
    return from_end(points, k).groupBy("devid").agg(at(k).alias("road_k"), at(1).alias("label"))


def last_layers(points: DataFrame) -> DataFrame:
    """Points drawn in the end view with their layer: the line (20th to 5th last), the dots (10th to 5th last; none if there are fewer than ten points)."""
    recent = from_end(points, 20).withColumn("n", F.count("*").over(W.partitionBy("devid")))
    layers = F.array_compact(F.array(F.when(F.col("back") >= 5, F.lit("line")), F.when((F.col("n") >= 10) & F.col("back").between(5, 10), F.lit("dot"))))
    return recent.select("devid", "seq", "back", "lon", "lat", F.explode(layers).alias("layer"))


def last_center(points: DataFrame, k: int = 8) -> DataFrame:
    return from_end(points, k).groupBy("devid").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def heading_changes(points: DataFrame) -> DataFrame:
    """Points that two more follow, with turn: the heading change at the next one."""
    order = W.partitionBy("devid").orderBy("seq")
    ahead = [F.lead(c, k).over(order).alias(f"{c}{k + 1}") for k in (1, 2) for c in ("lon", "lat")]
    return points.select("*", *ahead).where("lon3 is not null").withColumn("turn", geo.heading_change("lon", "lat", "lon2", "lat2", "lon3", "lat3"))


def road_runs(points: DataFrame) -> DataFrame:
    """devid, run, road_id, start_seq, end_seq, n: maximal runs of one road id."""
    order = W.partitionBy("devid").orderBy("seq")
    changed = F.when(F.col("road_id").eqNullSafe(F.lag("road_id").over(order)) & (F.lag("seq").over(order).isNotNull()), 0).otherwise(1)
    marked = points.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1)
    return marked.groupBy("devid", "run").agg(F.min("road_id").alias("road_id"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count("*").alias("n"))
