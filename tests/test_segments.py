"""Segmentation with bounds and by runs against plain loops, and as table functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions.register import register
from wayline.operators import segmentation


def quadratic(costs, least):
    n = costs.n
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = 0.0
    for h in range(least, n + 1):
        d = np.arange(h - least + 1)
        totals = best[d] + costs.cost(d, np.full(len(d), h))
        back[h] = int(totals.argmin())
        best[h] = totals[back[h]]
    starts, at = [], n
    while at > 0:
        at = int(back[at]) if n >= least else 0
        starts.append(at)
    return starts[::-1]


def way(n, kind, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "random":
        return 104 + np.cumsum(rng.uniform(-1, 1, n)) / 500, 30 + np.cumsum(rng.uniform(-1, 1, n)) / 500, np.cumsum(rng.integers(0, 40, n)), rng.integers(1, 4, n)
    if kind == "onward":
        return 104 + np.cumsum(rng.uniform(0, 1, n)) / 50_000, 30 + np.cumsum(rng.uniform(0, 1, n)) / 50_000, np.arange(n) * 5, np.arange(n) // 50
    if kind == "to and fro":
        return 104 + np.cumsum(np.where(np.arange(n) % 2, 1, -1)) / 5000, np.full(n, 30.0), np.arange(n) * 5, np.ones(n, int)
    return 104 + np.cumsum(np.repeat(rng.uniform(0, 30, n // 20 + 1), 20)[:n]) / 1e5, np.full(n, 30.0), np.arange(n), np.arange(n) // 200


KINDS = ["random", "onward", "to and fro", "speeds"]
OTHER = ({"speed": 0.1, "road": 0.3, "length": 2.0, "angle": 0.01}, {"speed": 5.0, "road": 200.0, "length": 1.0, "angle": 1e5})


EVEN = ({"speed": 1.0, "road": 0.0, "length": 0.01, "angle": 0.0}, {"speed": 50.0, "road": 20.0, "length": 1.0, "angle": 1000.0})


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [2, 9, 10, 19, 20, 100, 333, 700])
def test_same_cuts_as_all_starts(kind, n):
    for weights, upper, least in ((segmentation.WEIGHTS, segmentation.UPPER, 10), (*OTHER, 7), (*EVEN, 10), ({**segmentation.WEIGHTS, "angle": -0.5}, segmentation.UPPER, 10)):
        costs = segmentation.Costs(*way(n, kind, n), weights, upper)
        assert segmentation.best_cuts(costs, least) == quadratic(costs, least)


def test_even_speeds_are_cut_apart():
    costs = segmentation.Costs(*way(700, "speeds", 1), *EVEN)
    starts = segmentation.best_cuts(costs)
    assert starts == quadratic(costs, 10) and len(starts) > 20


def test_starts_are_dropped_for_good():
    costs = segmentation.Costs(*way(20_000, "random"), segmentation.WEIGHTS, segmentation.UPPER)
    seen = []
    whole = segmentation.Starts.bounds

    def counted(self, ends):
        found = whole(self, ends)
        seen.append(len(self.blocks))
        return found

    segmentation.Starts.bounds = counted
    try:
        segmentation.best_cuts(costs)
    finally:
        segmentation.Starts.bounds = whole
    assert max(seen) < 20_000 / segmentation.Starts.SIZE / 4


def points_of(spark, trips):
    rows = [(key, k, float(a), float(b), int(t), int(r)) for key, (lon, lat, ts, road) in trips.items() for k, (a, b, t, r) in enumerate(zip(lon, lat, ts, road))]
    return spark.createDataFrame(rows, "devid string, seq long, lon double, lat double, t long, road_id long")


@pytest.fixture(scope="module")
def points(spark):
    trips = {f"{kind} {n}": way(n, kind, n) for kind in KINDS for n in (1, 2, 6, 11, 150)}
    trips["turns"] = (np.r_[np.arange(200) / 1e4, np.full(200, 0.02)], np.r_[np.zeros(200), np.arange(200) / 1e4], np.arange(400), np.arange(400) // 37)
    return points_of(spark, trips).repartition(3).cache()


@pytest.mark.parametrize("least", [None, 30])
def test_runs_give_the_segments_of_points(points, least):
    got = segmentation.by_road(points, least=least).toPandas()
    for key, rows in points.toPandas().sort_values("seq").groupby("devid"):
        starts = segmentation.road_starts(rows["lon"].to_numpy(), rows["lat"].to_numpy(), rows["road_id"].to_numpy())
        wanted = [list(range(a, b)) for a, b in zip(starts, [*starts[1:], len(rows)])]
        wanted = wanted if least is None else segmentation.merge_small(wanted, least)
        mine = got[got["devid"] == key].sort_values(["seg", "pos"])
        assert [g["seq"].tolist() for _, g in mine.groupby("seg")] == wanted
        assert [g["pos"].tolist() for _, g in mine.groupby("seg")] == [list(range(len(w))) for w in wanted]


def test_table_functions(spark, points):
    register(spark)
    points.withColumn("note", F.concat("devid", F.lit("!"))).createOrReplaceTempView("noted")
    by_road = spark.sql("SELECT * FROM segments_by_road(TABLE(noted))")
    assert by_road.columns == [*points.columns, "note", "seg", "pos"]
    key = ["devid", "seg", "pos", "seq"]
    assert sorted(map(tuple, by_road.select(key).collect())) == sorted(map(tuple, segmentation.by_road(points).select(key).collect()))
    assert by_road.where("note <> concat(devid, '!')").count() == 0
    whole = spark.sql("SELECT * FROM segments_by_road(TABLE(noted), least => NULL)")
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, segmentation.by_road(points, least=None).select(key).collect()))
    by_cost = spark.sql("SELECT * FROM segments_by_cost(TABLE(noted), least => 12)")
    assert sorted(map(tuple, by_cost.select(key).collect())) == sorted(map(tuple, segmentation.by_cost(points, 12).select(key).collect()))
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM segments_by_road(TABLE(SELECT 1 AS devid))").collect()
