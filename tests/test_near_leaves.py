"""Nearness joins where points crowd into few cells: the same pairs as all pairs tested one by one, no heavy join key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators import near


@pytest.fixture(scope="module")
def crowded(spark):
    rng = np.random.default_rng(4)
    lon, lat = 104.06 + rng.uniform(0, 0.02, 900), 30.65 + rng.uniform(0, 0.02, 900)
    lon[:300], lat[:300] = 104.0605 + rng.uniform(0, 1e-4, 300), 30.6505 + rng.uniform(0, 1e-4, 300)  # a third in a corner of one cell
    lon[:60], lat[:60] = 104.0605, 30.6505  # some on one spot
    points = spark.createDataFrame([(k % 30, k // 30, float(x), float(y)) for k, (x, y) in enumerate(zip(lon, lat))], "devid long, seq long, lon double, lat double")
    x, y = 104.06 + rng.uniform(0, 0.02, 80), 30.65 + rng.uniform(0, 0.02, 80)
    x[:20], y[:20] = 104.0605 + rng.uniform(-1e-3, 1e-3, 20), 30.6505 + rng.uniform(-1e-3, 1e-3, 20)
    spots = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "id long, lon double, lat double")
    return points.cache(), spots.cache()


def rows(frame):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.collect())


@pytest.mark.parametrize("most", [10, 40, 10**6])
def test_spots_near(spark, crowded, most):
    points, spots = crowded
    every = points.crossJoin(spots.select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))).withColumn("dist", geo.haversine("y", "x", "lat", "lon"))
    assert rows(near.spots_near(points, spots, 60.0, most=most)) == rows(every.where("dist <= 60").groupBy("devid", "id").agg(F.min("dist").alias("dist")))


@pytest.mark.parametrize("most", [10, 10**6])
def test_edges_and_nodes_near(spark, crowded, most):
    points, spots = crowded
    ends = spots.select(F.col("id").alias("fid"), F.array(F.struct("lon", "lat"), F.struct((F.col("lon") + 0.001).alias("lon"), F.col("lat").alias("lat")), F.struct((F.col("lon") + 0.001).alias("lon"), (F.col("lat") + 0.002).alias("lat"))).alias("geometry"))
    pieces = near.pieces(ends)
    every = points.crossJoin(pieces).withColumn("dist", geo.point_segment_distance("lat", "lon", "lat1", "lon1", "lat2", "lon2")).where("dist < 111")
    wanted = rows(every.groupBy("devid", "fid").agg(F.min("dist").alias("dist")))
    assert rows(near.edges_near(points, ends, last=None, gap=None, most=most)) == wanted
    assert rows(near.edges_near(points, ends, last=5, gap=90.0, most=most)) == rows(near.edges_near(points, ends, last=5, gap=90.0, most=10**7))
    nodes = spots.withColumnRenamed("id", "osmid")
    assert rows(near.nodes_near(points, nodes, most=most)) == rows(near.nodes_near(points, nodes, most=10**7))
    view = spark.createDataFrame([(1, 104.06, 104.0606, 30.65, 30.6507), (2, 104.0, 104.1, 30.6, 30.7)], "devid long, min_lon double, max_lon double, min_lat double, max_lat double")
    inside = view.crossJoin(points.select(F.monotonically_increasing_id().alias("id"), "lon", "lat").cache()).where("lon between min_lon and max_lon and lat between min_lat and max_lat")
    assert near.spots_in_view(view, points.select(F.monotonically_increasing_id().alias("id"), "lon", "lat"), most=most).groupBy("devid").count().orderBy("devid").collect() == inside.groupBy("devid").count().orderBy("devid").collect()


def test_no_leaf_is_heavy(crowded):
    points, _ = crowded
    most, depth = 10, near.DEPTH
    fine = near.CELL / 2**depth
    leaf = near.leaves(points, "lon", "lat", near.CELL, most, depth)
    placed = points.withColumns({"fx": F.floor(F.col("lon") / fine), "fy": F.floor(F.col("lat") / fine)}).join(leaf, ["fx", "fy"])
    held = placed.groupBy("level", F.expr(f"shiftright(fx, {depth} - level)"), F.expr(f"shiftright(fy, {depth} - level)")).agg(F.count("*").alias("n"), F.max("shares").alias("shares")).collect()
    assert all(r["n"] <= most * r["shares"] for r in held) and any(r["shares"] > 1 for r in held) and any(0 < r["level"] < depth for r in held)
    assert near.leaves(points, "lon", "lat", near.CELL, 10**6, depth).count() == 0


@pytest.mark.parametrize("most", [10, 10**6])
def test_lines_in_view_once(spark, crowded, most):
    """A line with several vertices in a view is one row, and no shuffle comes after the join that makes the pairs."""
    _, spots = crowded
    lines = spots.select("id", F.array(*[F.struct((F.col("lon") + k * 3e-4).alias("lon"), (F.col("lat") - k * 2e-4).alias("lat")) for k in range(4)]).alias("geometry"))
    view = spark.createDataFrame([(1, 104.06, 104.0606, 30.65, 30.6507), (2, 104.0, 104.1, 30.6, 30.7), (3, 104.065, 104.0651, 30.65, 30.67)], "devid long, min_lon double, max_lon double, min_lat double, max_lat double")
    every = view.crossJoin(lines).where(near.in_bounds("geometry")).select("devid", "id")
    found = near.lines_in_view(view, lines, most=most)
    assert rows(found) == rows(every) and len(rows(every)) > 80
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith(("Aggregate", "Deduplicate"))
