"""System prompts against what the messages and the parsers of answers know; geometry in SQL; whole-file sinks and sources."""

import glob
import json
import os
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wayline.functions import geo, parse, register
from wayline.operators import catalog, prompts, stats
from wayline.sources import features, network, roads

SLOTS = {"last_trajectory_view", "poi_full_image", "road_structure_full_image"}


def test_placeholders_are_those_of_the_messages():
    wording = prompts.OPENING + prompts.SEGMENT_HEAD % (1, 1, 2) + prompts.OVERALL.format("", "", "")
    emitted = {"TTE": set(re.findall("`([^`]+)`", wording + prompts.END_POINT)), "TMI": set(re.findall("`([^`]+)`", wording)), "Mobility Prediction": set(re.findall("`([^`]+)`", prompts.NEXT_ROAD)), "Anomaly Detection": set()}
    for p in catalog.read_system_prompts():
        assert set(p["placeholders"]) == emitted[p["task"]] and set(p["placeholders"]) - SLOTS <= {"image1", "image2"}
        assert set(re.findall("`([^`]+)`", p["text"])) <= emitted[p["task"]]


def test_every_task_of_a_dataset_has_a_prompt(spark):
    have = {(r["dataset"], r["task"]) for r in catalog.system_prompts(spark).collect()}
    assert have == {(c, t) for c, _, _, _, tasks in catalog.SOURCES for t in tasks}


def test_example_answers_are_understood(spark):
    said = {p["task"]: p["answer"] for p in catalog.read_system_prompts()}
    row = spark.range(1).select(
        parse.eta(F.lit(said["TTE"])).alias("eta"), parse.judgment(F.lit(said["Anomaly Detection"])).alias("judged"), parse.mode(F.lit(said["TMI"])).alias("mode"),
        parse.top1(F.lit(said["Mobility Prediction"])).alias("one"), parse.top5(F.lit(said["Mobility Prediction"])).alias("five"),
    ).first()
    assert row["eta"] is not None and row["judged"] == "abnormal" and row["mode"] == "train" and row["one"] == "104997" and len(row["five"]) == 5


def test_the_latest_version_counts(spark):
    given = [{"task": "TTE", "datasets": ["A", "B"], "version": v, "text": f"v{v}"} for v in (1, 3, 2)]
    assert {(r["dataset"], r["version"], r["system_prompt"]) for r in catalog.system_prompts(spark, given=given).collect()} == {("A", 3, "v3"), ("B", 3, "v3")}
    assert {r["system_prompt"] for r in catalog.system_prompts(spark, 2, given).collect()} == {"v2"}


def test_geometry_in_sql_is_the_columns(spark):
    register.register(spark)
    rng = random.Random(1)
    line = lambda: [(104 + rng.random(), 30 + rng.random()) for _ in range(rng.randint(0, 4))]
    rows = [(*[rng.choice([0.0, 1.0, rng.uniform(-50, 50)]) for _ in range(6)], line(), line()) for _ in range(40)] + [(None,) * 8]
    frame = spark.createDataFrame(rows, ", ".join(f"a{k} double" for k in range(6)) + ", g1 array<struct<lon: double, lat: double>>, g2 array<struct<lon: double, lat: double>>").cache()
    for name, (function, given, parts) in register.GEOMETRY.items():
        kinds = given.split()
        args = [f"g{k + 1}" if kind.endswith(":line") else f"a{k}" for k, kind in enumerate(kinds)]
        made = function(*map(F.col, args))
        made = made if parts is None else F.struct(*[c.alias(k) for k, c in zip(parts, made)])
        both = frame.select(made.alias("x"), F.expr(f"{name}({', '.join(args)})").alias("y")).collect()
        assert [str(r["x"]) for r in both] == [str(r["y"]) for r in both], name
    mid = frame.where("size(g1) > 0").select(geo.line_midpoint("g1").alias("x"), F.expr("line_midpoint(g1)").alias("y")).collect()
    assert all(r["x"] == pytest.approx(r["y"]) for r in mid)
    assert spark.sql("SELECT geodesic_metres(30D, 104D, 30D, 104.01D) AS d").first()["d"] == pytest.approx(964.9, abs=0.2)


NASTY = ['a,{"', 'x, {"type":"Feature","geometry":1}', "]", "}", "\\", '"', "é日本", "[{", "ends with ,{", "\n", ", { ", '{"id":1}', "", "{", '{"lat":1,"lon":2}']


def collection(n, seed):
    rng = random.Random(seed)
    shapes = [{"type": "LineString", "coordinates": [[104.5, 30.25], [104.75, 30.5]]}, {"type": "Point", "coordinates": [1.5, 2.5]}]
    made = [{"type": "Feature", "id": k, "properties": {rng.choice(NASTY) + str(j): rng.choice(NASTY) for j in range(rng.randint(0, 4))}, "geometry": rng.choice(shapes)} for k in range(n)]
    return {"type": "FeatureCollection", "crs": {"a": [{"z": 1}]}, "features": made, "bbox": [1, 2]}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("part_bytes", [64, 1000, 1 << 20])
def test_features_of_one_file_by_several_tasks(spark, tmp_path, indent, part_bytes):
    doc = collection(60, part_bytes)
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    kind = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    whole = spark.read.schema(kind).json(str(tmp_path / "f.json"), multiLine=True).select(F.explode("features").alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")
    got = features.read_features(spark, str(tmp_path / "f.json"), part_bytes)
    shown = lambda frame: sorted((sorted(r["properties"].items()), r["type"], r["coordinates"].replace(" ", "").replace("\n", "")) for r in frame.collect())
    assert shown(got) == shown(whole)
    size = os.path.getsize(tmp_path / "f.json")
    assert got.rdd.getNumPartitions() == -(-size // part_bytes)
    boxed = features.read_features(spark, str(tmp_path / "f.json"), part_bytes, boxes=True).where("min_lon > 100 and max_lat < 31")
    assert boxed.count() == sum(f["geometry"]["type"] == "LineString" for f in doc["features"])


def test_lights_of_one_file_by_several_tasks(spark, tmp_path):
    elements = [{"type": "node", "id": k, "lat": 30 + k / 100, "lon": 104 - k / 100, "tags": {"note": NASTY[k % len(NASTY)]}} for k in range(50)]
    (tmp_path / "l.json").write_text(json.dumps({"version": 0.6, "elements": elements}))
    for part_bytes in (50, 700, 1 << 20):
        got = sorted(tuple(r) for r in roads.read_lights(spark, str(tmp_path / "l.json"), part_bytes).collect())
        assert got == [(e["id"], e["lon"], e["lat"]) for e in elements]


def edges(spark, n):
    rows = [(k * 7919 % n, k % 5, [(104 + k / 1000, 30.5), (104.25, 30 + k / 1000)][: k % 3], {"lanes": [k % 4]}) for k in range(n)]
    return spark.createDataFrame(rows, "u bigint, v bigint, geometry array<struct<lon: double, lat: double>>, info struct<lanes: array<bigint>>").repartition(5)


def test_numbered_network(spark, tmp_path):
    path = str(tmp_path / "edges")
    for _ in range(2):
        network.write_network(edges(spark, 500), path, F.floor(F.col("u") / 64), "u", "v")
        got = spark.read.parquet(path).orderBy("fid").collect()
        assert [r["fid"] for r in got] == list(range(500)) and [r["u"] for r in got] == list(range(500))
        assert all(r["geometry"] is None or re.fullmatch(r"(LINESTRING|POINT) \([\d. ,]+\)", r["geometry"]) for r in got) and json.loads(got[3]["info"]).keys() == {"lanes"}
    assert glob.glob(f"{tmp_path}/edges.*") == []
    with pytest.raises(Exception, match="FileExists|edges"):
        network.write_network(edges(spark, 10), path, F.lit(0), "u", "v", overwrite=False)
    assert spark.read.parquet(path).count() == 500 and glob.glob(f"{tmp_path}/edges.*") == []


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "edges")
    network.write_network(edges(spark, 20), path, F.lit(0), "u", "v")
    broken = edges(spark, 500).withColumn("bad", F.when(F.col("u") == 499, F.raise_error(F.lit("no"))).otherwise(F.col("u")))
    with pytest.raises(Exception):
        network.write_network(broken, path, F.floor(F.col("u") / 64), "u", "v")
    assert [os.path.basename(p) for p in glob.glob(f"{tmp_path}/*")] == ["edges"] and pq.read_table(path).num_rows == 20


def test_prefix_sums_are_the_windows(spark):
    rng = random.Random(5)
    seen = [(rng.randint(1, 3), rng.randint(0, 4000) + (100_000 if k % 7 == 0 else 0), rng.uniform(0, 30)) for k in range(600)] + [(4, 5, 1.0)]
    asked = [(k, rng.randint(1, 5), rng.randint(-50, 4100)) for k in range(200)] + [(900, None, 5), (901, 1, None)]
    observed = spark.createDataFrame([(r, t, float(v)) for r, t, v in seen] + [(2, 5, None)], "road_id bigint, t bigint, speed double")
    for bucket in (10, 1000, 86_400):
        got = stats.adaptive_average(observed, spark.createDataFrame(asked, "ask_id bigint, road_id bigint, moment bigint"), 5, (20, 60, 200), bucket).collect()
        assert len(got) == len(asked)
        for r in got:
            there = [(t, v) for road, t, v in seen if road == r["road_id"]]
            used = next((n for w in (20, 60, 200) if r["moment"] is not None and len(n := [v for t, v in there if abs(t - r["moment"]) <= w]) >= 5), [v for _, v in there])
            if r["moment"] is None or not used:
                assert r["speed"] is None
            else:
                assert r["speed"] == pytest.approx(sum(used) / len(used), abs=1e-9)
