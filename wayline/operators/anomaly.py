"""Made-up anomalies: a span of some trajectories is shifted sideways and retimed.

Random choices are hashes of the trajectory's id, so that a rerun, and any other engine, makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.sources.roads import numbered

from .steps import steps

GRID, LEVEL = 0.0008, 3  # fixed values: degrees of a grid unit, units of a shift
PRIME, FACTOR, STEP = 2147483647, 48271, 69621
BUCKET = 1 << 19


def draw(key: Column, salt: int) -> Column:
    """A whole number below PRIME that the key and the salt fix."""
    return F.pmod(F.pmod(key, F.lit(PRIME)) * FACTOR + salt * STEP, F.lit(PRIME))


def selected(points: DataFrame, key: Column, ratio: float = 0.1) -> DataFrame:
    """devid, n of floor(ratio * count) trajectories without replacement: those first in the order of draw, then devid."""
    each = points.groupBy("devid").agg(F.count("*").alias("n"), F.first(key).alias("key"))
    placed = numbered(each.withColumn("drawn", draw(F.col("key"), 1)).withColumn("bucket", F.floor(F.col("drawn") / BUCKET)), "place", "bucket", "drawn", "devid")
    count = each.agg(F.floor(F.count("*") * F.lit(ratio)).alias("most"))  # one row
    return placed.join(F.broadcast(count), F.col("place") < F.col("most")).select("devid", "n", "key")


def spans(chosen: DataFrame, share: float = 0.1) -> DataFrame:
    """Adds first, after: the span [first, after) of points to shift, a ``share`` of them and at least two."""
    rows = chosen.withColumn("length", F.greatest(F.lit(2), F.floor(F.col("n") * share)))
    rows = rows.withColumn("first", 1 + draw(F.col("key"), 2) % (F.greatest(F.lit(2), F.col("n") - F.col("length") - 1) - 1))
    return rows.withColumn("after", F.least("n", F.col("first") + F.col("length"))).drop("length")


def directions() -> tuple[Column, Column, Column]:
    """(lon, lat) choices in grid units for spans that run north-south, east-west, and for single points."""
    pairs = lambda xs: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xs])
    sideways = [(1, 0), (-1, 0), (1, 0.3), (1, -0.3), (-1, 0.3), (-1, -0.3)]
    around = [(x, y) for x in (1, 0, -1) for y in (1, 0, -1) if x or y]
    return pairs(sideways), pairs([(y, x) for x, y in sideways]), pairs(around)


def shifts(points: DataFrame, spanned: DataFrame) -> DataFrame:
    """Adds dlon, dlat: the shift in degrees, mainly across the span's own direction."""
    inside = points.join(spanned, "devid").where((F.col("seq") >= F.col("first")) & (F.col("seq") < F.col("after")))
    ends = inside.groupBy("devid").agg(F.count("*").alias("m"), *[(F.max_by(c, "seq") - F.min_by(c, "seq")).alias(f"d_{c}") for c in ("lon", "lat")])
    upright, level, around = directions()
    at = lambda choices, n: F.element_at(choices, (draw(F.col("key"), 3) % n + 1).cast("int"))
    way = F.when(F.col("m") < 2, at(around, 8)).when(F.abs("d_lat") > F.abs("d_lon"), at(upright, 6)).otherwise(at(level, 6))
    rows = spanned.join(ends, "devid").withColumn("way", way)
    return rows.select("devid", "n", "first", "after", (F.col("way.x") * (GRID * LEVEL)).alias("dlon"), (F.col("way.y") * (GRID * LEVEL)).alias("dlat"))


def moved(points: DataFrame, shifted: DataFrame) -> DataFrame:
    """Points of the chosen trajectories with lon, lat shifted inside the span; the old ones stay as lon0, lat0."""
    within = (F.col("seq") >= F.col("first")) & (F.col("seq") < F.col("after"))
    rows = points.join(shifted, "devid").withColumnRenamed("lon", "lon0").withColumnRenamed("lat", "lat0")
    return rows.withColumns({"lon": F.col("lon0") + F.when(within, F.col("dlon")).otherwise(0.0), "lat": F.col("lat0") + F.when(within, F.col("dlat")).otherwise(0.0)})


def time_factor(rows: DataFrame) -> DataFrame:
    """devid, factor, t_first, t_last: the span's path after the shift over that before; 1 for a path under 0.1 m."""
    inside = rows.where((F.col("seq") >= F.col("first")) & (F.col("seq") < F.col("after")))
    bare = ["devid", "seq", "t", "road_id"]
    length = lambda lon, lat, name: steps(inside.select(*bare, F.col(lon).alias("lon"), F.col(lat).alias("lat"))).groupBy("devid").agg(F.sum("dist").alias(name))
    lengths = length("lon0", "lat0", "before_m").join(length("lon", "lat", "after_m"), "devid")
    times = inside.groupBy("devid").agg(F.min_by("t", "seq").alias("t_first"), F.max_by("t", "seq").alias("t_last"))
    factor = F.when(F.coalesce("before_m", F.lit(0.0)) < 0.1, 1.0).otherwise(F.try_divide("after_m", "before_m"))
    return times.join(lengths, "devid", "left").select("devid", factor.alias("factor"), "t_first", "t_last")


def retimed(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Adds t_new: inside the span time runs by the factor, what follows moves along."""
    rows = rows.join(factors, "devid")
    stretched = F.col("t_first") + (F.col("t") - F.col("t_first")) * F.col("factor")
    shift = (F.col("t_last") - F.col("t_first")) * (F.col("factor") - 1)
    new = F.when(F.col("seq") < F.col("first"), F.col("t").cast("double")).when(F.col("seq") < F.col("after"), stretched).otherwise(F.col("t") + shift)
    return rows.withColumn("t_new", new)


def anomalies(points: DataFrame, key: Column | None = None, ratio: float = 0.1, share: float = 0.1, keep_roads: bool = True) -> DataFrame:
    """The chosen trajectories only: devid, seq, lon, lat, t (retimed), anomalous and, if kept, road_id."""
    chosen = spans(selected(points, F.xxhash64("devid") if key is None else key, ratio), share)
    rows = moved(points, shifts(points, chosen))
    rows = retimed(rows, time_factor(rows))
    within = (F.col("seq") >= F.col("first")) & (F.col("seq") < F.col("after"))
    return rows.select("devid", "seq", "lon", "lat", F.col("t_new").alias("t"), within.alias("anomalous"), *["road_id"] * keep_roads)
