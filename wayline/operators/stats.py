"""Statistics of trajectories, segments and roads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayline.functions import geo

from .steps import accelerations, steps


def equal_parts(points: DataFrame, parts: int = 4) -> DataFrame:
    """Points with seg: the trajectory in equal parts, the first ones a point longer where it doesn't divide."""
    return points.withColumn("seg", F.ntile(parts).over(W.partitionBy("devid").orderBy("seq")) - 1)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(empty))


def segment_distance(segmented: DataFrame) -> DataFrame:
    """devid, seg, distance: metres along each segment, 0 for a single point."""
    order = W.partitionBy("devid", "seg").orderBy("seq")
    step = geo.haversine("lat", "lon", F.lead("lat").over(order), F.lead("lon").over(order))
    return segmented.select("devid", "seg", step.alias("dist")).groupBy("devid", "seg").agg(F.coalesce(F.sum("dist"), F.lit(0.0)).alias("distance"))


def segment_speed(segmented: DataFrame) -> DataFrame:
    """devid, seg, avg_speed over the steps that take time; 0 without any. Segments of a single point are left out."""
    return steps(segmented, "seg").groupBy("devid", "seg").agg(ratio(F.sum(F.when(F.col("dt") > 0, F.col("dist"))), F.sum(F.when(F.col("dt") > 0, F.col("dt")))).alias("avg_speed"))


def kinematics(segmented: DataFrame, distance: Column | None = None) -> DataFrame:
    """Per segment: start, end, minutes, total distance, average, largest and smallest speed, largest acceleration.

    Only steps that take time count. Segments of a single point have zeros and no times. ``distance``
    replaces the sphere's metres of a step, as by the ellipsoid's.
    """
    stepped = steps(segmented, "seg")
    if distance is not None:
        stepped = stepped.withColumn("dist", distance).withColumn("speed", geo.speed("dist", "dt"))
    moving = accelerations(stepped, "seg").groupBy("devid", "seg").agg(
        F.sum("dist").alias("total_distance"), F.sum("dt").alias("seconds"), F.max("speed").alias("max_speed"), F.min("speed").alias("min_speed"), F.max("accel").alias("max_acceleration")
    )
    size = segmented.groupBy("devid", "seg").agg(F.count("*").alias("n"), F.min_by("t", "seq").alias("t1"), F.max_by("t", "seq").alias("t2"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    many = F.col("n") >= 2
    return size.join(moving, ["devid", "seg"], "left").select(
        "devid", "seg", F.when(many, F.col("t1")).alias("start_t"), F.when(many, F.col("t2")).alias("end_t"), F.when(many, F.round((F.col("t2") - F.col("t1")) / 60, 2)).otherwise(0.0).alias("minutes"),
        zero("total_distance"), ratio(F.col("total_distance"), F.col("seconds")).alias("avg_speed"), zero("max_speed"), zero("min_speed"), zero("max_acceleration"),
    )


def road_speeds(points: DataFrame) -> DataFrame:
    """road_id, devid, t, speed, distance: a step that takes time is an observation of the road it starts on. Roads without any have one row of NULLs."""
    seen = steps(points).where("dt > 0").select("road_id", "devid", "t", "speed", F.col("dist").alias("distance"))
    silent = points.select("road_id").distinct().join(seen.select("road_id").distinct(), "road_id", "left_anti")
    return seen.unionByName(silent, allowMissingColumns=True)


def road_average(observed: DataFrame) -> DataFrame:
    return observed.groupBy("road_id").agg(F.avg("speed").alias("avg_speed"), F.count("speed").alias("n"))


EXACT = "decimal(37,20)"  # sums of speeds, so that differences of sums lose nothing; with 38 digits each addition would cut one off the scale
BUCKET = 86_400  # seconds


def sums_until(seconds: DataFrame, edges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``edges`` (road_id, x, high, ...) with n and s: count and sum of the observations (road_id, t, n, s) before x, and at x too if high.

    Prefix sums in two levels: buckets of time are summed up first and counted on within a road, then seconds within a bucket. A road
    with very many observations is no task's alone.
    """
    rest = [c for c in edges.columns if c not in ("road_id", "x", "high")]
    seen = seconds.select("road_id", F.col("t").cast("double").alias("x"), F.lit(1).alias("turn"), F.col("n").cast("long").alias("n"), F.col("s").cast(EXACT).alias("s"))
    asked = edges.select("road_id", F.col("x").cast("double").alias("x"), F.when(F.col("high"), 2).otherwise(0).alias("turn"), F.lit(0).cast("long").alias("n"), F.lit(0).cast(EXACT).alias("s"), *rest)
    both = seen.unionByName(asked, allowMissingColumns=True).withColumn("bucket", F.floor(F.col("x") / bucket))
    totals = both.groupBy("road_id", "bucket").agg(F.sum("n").alias("n"), F.sum("s").cast(EXACT).alias("s"))
    before = W.partitionBy("road_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("road_id", "bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast(EXACT if c == "s" else "long").alias(f"{c}_before") for c in ("n", "s")])
    within = W.partitionBy("road_id", "bucket").orderBy("x", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = both.select("road_id", "bucket", "x", "turn", *rest, F.sum("n").over(within).alias("n"), F.sum("s").over(within).cast(EXACT).alias("s")).where("turn <> 1")
    found = summed.join(base, ["road_id", "bucket"])
    return found.select("road_id", "x", (F.col("turn") == 2).alias("high"), *rest, (F.col("n") + F.col("n_before")).alias("n"), (F.col("s") + F.col("s_before")).cast(EXACT).alias("s"))


def adaptive_average(observed: DataFrame, asked: DataFrame, least: int = 50, windows: tuple[int, ...] = (2, 4, 6, 8, 10), bucket: int = BUCKET) -> DataFrame:
    """``asked`` (ask_id, road_id, moment) with speed: the mean over the narrowest window of seconds around ``moment`` that has ``least`` observations, else over all of the road.

    A window is the difference of two prefix sums of its road, so what a question costs doesn't depend on how wide windows are or how
    many observations they hold. Like questions are asked once. A column ``least`` of ``asked`` goes before the argument.
    """
    own = ["least"] if "least" in asked.columns else []
    per_second = observed.where("speed is not null").groupBy("road_id", "t").agg(F.sum("speed").alias("s"), F.count("*").alias("n"))
    once = asked.select("road_id", "moment", *own).where("road_id is not null and moment is not null").distinct()
    ends = [F.struct(F.lit(w).alias("w"), F.lit(high).alias("high"), (F.col("moment") + (w if high else -w)).cast("double").alias("x")) for w in windows for high in (False, True)]
    sums = sums_until(per_second, once.select("road_id", "moment", *own, F.explode(F.array(*ends)).alias("e")).select("road_id", "moment", *own, "e.*"), bucket)
    part = lambda c, w: F.sum(F.when(F.col("w") == w, F.when(F.col("high"), F.col(c)).otherwise(-F.col(c))))
    near = sums.groupBy("road_id", "moment", *own).agg(*[part("n", w).alias(f"n{w}") for w in windows], *[part("s", w).cast("double").alias(f"s{w}") for w in windows])
    whole = per_second.groupBy("road_id").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(EXACT)).cast("double").alias("s"))
    found = F.coalesce(*[F.when(F.col(f"n{w}") >= (F.col("least") if own else least), F.try_divide(f"s{w}", f"n{w}")) for w in windows], F.try_divide("s", "n"))
    answers = near.join(whole, "road_id", "left").select("road_id", "moment", *own, found.alias("speed"))
    return asked.join(answers, ["road_id", "moment", *own], "left")


def segment_maxspeed(segmented: DataFrame, limits: DataFrame) -> DataFrame:
    """devid, seg, max_speed: the largest positive limit among the segment's roads, NULL if none is known."""
    roads = segmented.select("devid", "seg", "road_id").distinct()
    return roads.join(limits, roads["road_id"] == limits["geo_id"], "left").groupBy("devid", "seg").agg(F.max(F.when(F.col("value") > 0, F.col("value"))).alias("max_speed"))


def dominant_road_type(segmented: DataFrame, types: DataFrame) -> DataFrame:
    """devid, seg, road_type: the type of most points, every one of them where types tie."""
    counts = segmented.join(types, segmented["road_id"] == types["geo_id"]).groupBy("devid", "seg", "value").count()
    top = F.rank().over(W.partitionBy("devid", "seg").orderBy(F.desc("count")))
    return counts.withColumn("place", top).where("place = 1").select("devid", "seg", F.col("value").alias("road_type"), "count")


def mode_candidates(kinetic: DataFrame, rules: DataFrame) -> DataFrame:
    """devid, seg, mode: transport modes whose largest speed and acceleration the segment keeps within."""
    return kinetic.join(F.broadcast(rules), (F.col("max_speed") <= F.col("speed_limit")) & (F.col("max_acceleration") <= F.col("accel_limit"))).select("devid", "seg", "mode")
