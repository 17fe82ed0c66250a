"""Queries over all trajectories, by brute force."""

import os

import pytest

from wayline.operators import stats
from wayline.plans import movement, segments
from wayline.registry import QUERIES

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def test_lines_in_the_bounds_of_all_trajectories(spark):
    boxes = {}
    for p in movement.points_of(spark, DIR).collect():
        boxes.setdefault(p["devid"], []).append((p["lon"], p["lat"]))
    boxes = {k: (min(x for x, _ in v) - 0.01, max(x for x, _ in v) + 0.01, min(y for _, y in v) - 0.01, max(y for _, y in v) + 0.01) for k, v in boxes.items()}
    edges = [(e["fid"], [(p["lon"], p["lat"]) for p in e["geometry"]]) for e in movement.edges_of(spark, DIR).collect()]
    wanted = {(k, fid) for k, (a, b, c, d) in boxes.items() for fid, line in edges if any(a <= x <= b and c <= y <= d for x, y in line)}
    got = [(r["devid"], r["fid"]) for r in QUERIES["line_in_bounds_all"](spark, DIR).collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    assert max(k for k, _ in got) >= 20


def test_adaptive_speed_at_every_point(spark):
    points = movement.points_of(spark, DIR)
    seen = {}
    for o in stats.road_speeds(points).where("speed is not null").collect():
        seen.setdefault(o["road_id"], []).append((o["t"], o["speed"]))
    asked = [(p["devid"], p["road_id"], p["t"]) for p in points.collect()]
    wanted = {}
    for ask in asked:
        there = seen.get(ask[1], [])
        near = [[v for t, v in there if abs(t - ask[2]) <= w] for w in segments._WINDOWS]
        used = next((v for v in near if len(v) >= segments._LEAST), [v for _, v in there])
        wanted[ask] = sum(used) / len(used) if used else None
    got = QUERIES["adaptive_avg_speed_all"](spark, DIR).collect()
    assert sorted((r["ask_id"], r["road_id"], r["moment"]) for r in got) == sorted(asked)
    assert all(r["speed"] == pytest.approx(wanted[r["ask_id"], r["road_id"], r["moment"]], abs=2e-6) for r in got)
