"""Single functions against values worked out by hand."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geo, parse
from wayline.functions.geodesic import inverse


@pytest.fixture
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()["x"]


def test_haversine(value):
    assert value(geo.haversine(30.65, 104.06, 30.65, 104.06)) == 0
    assert value(geo.haversine(30.65, 104.06, 30.66, 104.07)) == pytest.approx(1466.7767, abs=1e-3)
    assert value(geo.haversine(0.0, 0.0, 0.0, 180.0)) == pytest.approx(math.pi * 6371000)


@pytest.mark.parametrize("angle,name", [(0, "North"), (22.4, "North"), (22.5, "Northeast"), (135.1, "Southeast"), (323.25, "Northwest"), (337.5, "North"), (359.9, "North")])
def test_direction(value, angle, name):
    assert value(geo.bearing_direction(F.lit(float(angle)))) == name


def test_angles(value):
    assert value(geo.vector_angle(1.0, 0.0, 0.0, 2.0)) == pytest.approx(90)
    assert value(geo.vector_angle(1.0, 0.0, 3.0, 0.0)) == pytest.approx(0, abs=1e-6)
    assert value(geo.vector_angle(0.0, 0.0, 3.0, 0.0)) == 180
    assert value(geo.heading_change(0.0, 0.0, 0.0, 0.0, 1.0, 0.0)) == 0
    assert value(geo.turn_angle(1.0, 0.0, 0.0, -1.0)) == pytest.approx(-90)
    assert value(geo.turn_angle(0.0, 0.0, 0.0, -1.0)) is None


@pytest.mark.parametrize("angle,strict,free", [(None, "unknown", "unknown"), (29.9, "straight", "straight"), (-30.0, "left_turn", "right_turn"), (119.9, "left_turn", "left_turn"), (-120.0, "u_turn", "u_turn")])
def test_turns(value, angle, strict, free):
    given = F.lit(angle).cast("double")
    assert value(geo.turn_type(given)) == strict
    assert value(geo.turn_type(given, strict=False)) == free


def test_point_to_segment(value):
    end = value(geo.haversine(0.0, 2.0, 0.0, 1.0))
    assert value(geo.point_segment_distance(0.0, 2.0, 0.0, 0.0, 0.0, 1.0)) == pytest.approx(end)
    assert value(geo.point_segment_distance(0.0, 2.0, 0.0, 1.0, 0.0, 1.0)) == pytest.approx(end)
    assert value(geo.point_segment_distance(0.5, 0.5, 0.0, 0.0, 0.0, 1.0)) == pytest.approx(value(geo.haversine(0.5, 0.5, 0.0, 0.5)))


def test_speed_without_time(value):
    assert value(geo.speed(5.0, 0.0)) == 0
    assert value(geo.speed(5.0, -2.0)) == -2.5


def test_coordinate_systems(value):
    there = value(F.struct(*geo.wgs_to_gcj(30.65, 104.06)))
    back = value(F.struct(*geo.gcj_to_wgs(there[0], there[1])))
    assert 0.001 < abs(there[1] - 104.06) < 0.01
    assert back[0] == pytest.approx(30.65, abs=1e-4) and back[1] == pytest.approx(104.06, abs=1e-4)
    assert tuple(value(F.struct(*geo.gcj_to_wgs(41.15, -8.6)))) == (41.15, -8.6)


def test_ellipsoid():
    a = np.array
    assert inverse(a([0.0]), a([0.0]), a([0.0]), a([1.0]))[0] == pytest.approx(111319.4908, abs=1e-3)
    assert inverse(a([30.0]), a([104.0]), a([30.0]), a([104.0]))[0] == 0
    assert inverse(a([0.0]), a([0.0]), a([0.5]), a([179.7]))[0] == pytest.approx(19.94e6, rel=0.01)


@pytest.mark.parametrize("text,expected", [
    ("<<<2016-11-24 08:32:33>>>", datetime(2016, 11, 24, 8, 32, 33)), ("<<<2016-11-24 08:32:33>>> <<<2016-11-24 09:00:00>>>", datetime(2016, 11, 24, 9)),
    ("<<2016-11-24 08:32:33>>", datetime(2016, 11, 24, 8, 32, 33)), ("<<<2016-13-24 08:32:33>>> <<2016-11-24 08:32:33>>", None), ("soon", None), (None, None),
])
def test_eta(value, text, expected):
    assert value(parse.eta(F.lit(text).cast("string"))) == expected


def test_answers(value):
    text = lambda t: F.lit(t)
    assert value(parse.top1(text("<<< 104997 >>>"))) == "104997"
    assert value(parse.top1(text("Top-1 prediction: 123"))) == "123"
    assert value(parse.top5(text("[[[72001, 72035,,103608]]]"))) == ["72001", "72035", "103608"]
    assert value(parse.top5(text("Top-5 candidates: [[1, 2, 3]]"))) == ["1", "2", "3"]
    assert value(parse.top5(text("none"))) is None
    assert value(parse.judgment(text("**Final Judgment:** Abnormal"))) == "abnormal"
    assert value(parse.judgment(text("FINAL JUDGMENT: normal"))) == "normal"
    assert value(parse.judgment(text("?"))) is None
    assert value(parse.mode(text("<<< train>>>"))) == " train"
    assert value(parse.folder_label(text("consolidated_anomaly_X"))) == "abnormal"
    assert value(parse.folder_label(text("consolidated_X"))) is None
    assert value(parse.segment_file_id(text("107.0_segment_0.png"))) == "107.0"
    assert value(parse.segment_file_id(text("._107_segment_0.png"))) is None


@pytest.mark.parametrize("seconds,text", [(59, "59s"), (60, "1m0s"), (3599, "59m59s"), (3600, "1h0m0s"), (3661.9, "1h1m1s")])
def test_duration(value, seconds, text):
    assert value(parse.duration(F.lit(float(seconds)))) == text


def test_fields(value):
    assert value(parse.nested_id_list(F.lit("1,2|3"))) == [[1, 2], [3]]
    assert [tuple(p) for p in value(parse.wkt_linestring(F.lit("LINESTRING (1 2, 3.5 4)")))] == [(1.0, 2.0), (3.5, 4.0)]
    assert value(parse.stamp(F.lit(1479946868))) == "2016-11-24 08:21:08"
    assert value(parse.clock(F.lit(1479946868), True)) == "2016-11-24 Thursday 08:21:08"
