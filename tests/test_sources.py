"""Files, road networks, sinks, messages of the other callers, and the SQL functions."""

import json

import pytest
from pyspark.sql import functions as F

from wayline.functions import geo, parse
from wayline.functions.register import register
from wayline.operators import catalog, evaluate, prompts, segmentation
from wayline.sources import files, roads, trajectories


def test_files(spark, tmp_path):
    for dataset, folder in (("Chengdu", "consolidated_a"), ("Xian", "consolidated_b")):
        place = tmp_path / dataset / "TTE" / "data" / folder
        place.mkdir(parents=True)
        (place / "o4-mini.txt").write_text("line one\nline two")
        (place / "poi_1.png").write_bytes(b"\x89PNG")
    listed = files.listing(spark, str(tmp_path), "*.png").collect()
    assert sorted((r["folder"], r["filename"], r["bytes"]) for r in listed) == [("consolidated_a", "poi_1.png", 4), ("consolidated_b", "poi_1.png", 4)]
    assert sorted((r["folder"], r["text"]) for r in files.texts(spark, str(tmp_path)).collect()) == [("consolidated_a", "line one\nline two"), ("consolidated_b", "line one\nline two")]
    assert {bytes(r["content"]) for r in files.images(spark, str(tmp_path)).collect()} == {b"\x89PNG"}
    placed = files.in_sources(files.listing(spark, str(tmp_path), "*.png"), str(tmp_path)).select("dataset", "source_path", "folder").collect()
    assert sorted(map(tuple, placed)) == [("Chengdu", "TTE/data", "consolidated_a"), ("Xian", "TTE/data", "consolidated_b")]
    source = catalog.SOURCES[0]
    found = catalog.trajectories(spark.createDataFrame([(source[0], source[1], f"{source[2]}x"), (source[0], source[1], "other")], "dataset string, source_path string, folder string"), spark)
    assert [r["id"] for r in found.collect()] == ["x"]


def test_network_files(spark, tmp_path):
    spark.createDataFrame([(1, 104.0, 30.0)], "osmid long, lon double, lat double").write.parquet(f"{tmp_path}/nodes")
    spark.createDataFrame([(0, 1, 2, None), (1, 1, 2, 5.0), (2, 2, 1, None)], "fid long, u long, v long, length double").write.parquet(f"{tmp_path}/edges")
    nodes, edges = roads.load_network(spark, f"{tmp_path}/nodes", f"{tmp_path}/edges")
    assert nodes.count() == 1 and sorted((r["u"], r["v"], r["fid"], r["length"]) for r in edges.collect()) == [(1, 2, 1, 5.0), (2, 1, 2, 0.0)]
    (tmp_path / "lights.json").write_text(json.dumps({"elements": [{"id": 7, "lat": 30.5, "lon": 104.5}]}))
    assert [tuple(r) for r in roads.read_lights(spark, f"{tmp_path}/lights.json").collect()] == [(7, 104.5, 30.5)]
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"properties": {"name": "x"}, "geometry": {"type": "Point", "coordinates": [104.5, 30.5]}}]}))
    got = roads.read_features(spark, f"{tmp_path}/f.json").first()
    assert got["properties"] == {"name": "x"} and got["type"] == "Point" and json.loads(got["coordinates"]) == [104.5, 30.5]


def test_sinks(spark, tmp_path):
    files.write_segments(spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0])], "devid long, seg long, points array<double>"), f"{tmp_path}/segments")
    assert sorted(r["id"] for r in spark.read.json(f"{tmp_path}/segments").collect()) == ["1_segment_0", "1_segment_1"]
    files.write_texts(spark.createDataFrame([(1, "TTE", "a"), (2, "AD", "b")], "devid long, task string, text string"), f"{tmp_path}/texts")
    assert spark.read.parquet(f"{tmp_path}/texts").where("task = 'AD'").first()["text"] == "b"
    files.write_truth(spark.createDataFrame([(1, "2016-11-24 08:32:33")], "devid long, arrival string").withColumn("arrival", F.col("arrival").cast("timestamp")), f"{tmp_path}/truth")
    assert spark.read.parquet(f"{tmp_path}/truth").first()["arrival"] == "2016-11-24 08:32:33"


def test_consistent(spark):
    rows = spark.createDataFrame([(1, [1], [1], [1]), (2, [1, 2], [1], [1, 2])], "devid long, points array<int>, times array<int>, road_ids array<int>")
    assert [r["devid"] for r in trajectories.consistent(rows).collect()] == [1]


def test_messages_with_all_pictures_or_end_views(spark):
    asked = spark.createDataFrame([(1, "judge"), (2, None)], "devid long, text string")
    pictures = spark.createDataFrame([(1, "b.png", "B"), (1, "a.png", "A"), (1, "last_trajectory_1.png", "L"), (3, "c.png", "C")], "devid long, filename string, picture string")
    made = lambda end: sorted((r["devid"], r["pos"], r["type"], r["content"]) for r in prompts.gallery(asked, pictures, end).collect())
    assert made(False) == [(1, 0, "text", "judge"), (1, 1, "image_url", "A"), (1, 2, "image_url", "B"), (2, 0, "text", "")]
    assert made(True) == [(1, 0, "text", "judge"), (1, 1, "image_url", "L"), (2, 0, "text", "")]


def test_repeated_truth_counts_once(spark):
    answers = spark.createDataFrame([(1, "<<<7>>>"), (2, "[[[]]] Top-5 candidates: [1, 2]")], "devid long, text string")
    truth = spark.createDataFrame([(1, "7"), (1, "8"), (2, "2")], "devid long, label string")
    got = sorted((r["devid"], r["label"], r["hit1"], r["hit5"]) for r in evaluate.next_road_hits(answers, truth).collect())
    assert got == [(1, "7", True, False), (2, "2", False, True)]
    trips = spark.createDataFrame([(1, "2016-11-24 08:00:00", "2016-11-24 08:10:00")] * 2, "devid long, start_ts string, end_ts string").select("devid", F.col("start_ts").cast("timestamp"), F.col("end_ts").cast("timestamp"))
    assert evaluate.arrival_errors(answers, trips).count() == 2


def test_empty_brackets_leave_the_written_list(spark):
    one = spark.range(1)
    assert one.select(parse.top5(F.lit("[[[]]] Top-5 candidates: [[1, 2, 3]]")).alias("x")).first()["x"] == ["1", "2", "3"]


def test_misclassified(spark):
    rows = spark.createDataFrame([(1, "car", "bus"), (2, "car", None), (3, "bus", "bus")], "devid long, truth string, prediction string")
    assert [r["devid"] for r in evaluate.misclassified(rows).collect()] == [1]


def test_sql_functions(spark):
    register(spark)
    lat1, lon1, lat2, lon2 = 30.65, 104.06, 30.66, 104.07
    row = spark.sql(f"SELECT haversine_metres({lat1}, {lon1}, {lat2}, {lon2}) AS d, bearing_degrees({lat1}, {lon1}, {lat2}, {lon2}) AS b, bearing_name(40.7) AS n, bearing_gap_degrees(350, 20) AS g, speed_of(5, 0) AS s").first()
    want = spark.range(1).select(geo.haversine(lat1, lon1, lat2, lon2).alias("d"), geo.bearing(F.lit(lat1), F.lit(lon1), F.lit(lat2), F.lit(lon2)).alias("b")).first()
    assert row["d"] == pytest.approx(want["d"]) and row["b"] == pytest.approx(want["b"]) and (row["n"], row["g"], row["s"]) == ("Northeast", 30.0, 0.0)
    points = spark.createDataFrame([(d, k, 104.0 + k / 1000, 30.0 + (k % 7) / 1000, 100, k // 35) for d in (1, 2) for k in range(120)], "devid long, seq long, lon double, lat double, t long, road_id long")
    points.createOrReplaceTempView("points")
    got = sorted(map(tuple, spark.sql("SELECT devid, seq, segment FROM road_segments(TABLE(points) PARTITION BY devid ORDER BY seq)").collect()))
    assert got == sorted((r["devid"], r["seq"], r["seg"]) for r in segmentation.by_road(points).collect())
