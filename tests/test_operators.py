"""Operators against plain loops, and invariants."""

import base64
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayline.operators import anomaly, evaluate, models, prompts, segmentation, stats, steps
from wayline.sources import roads, trajectories


def walk(n, seed=0, devid=1):
    rng = random.Random(seed)
    lon, lat, t, rows = 104.06, 30.65, 1_479_946_868, []
    for k in range(n):
        rows.append((devid, k, lon, lat, t, rng.randint(1, 3)))
        lon, lat, t = lon + rng.uniform(-1, 1) / 500, lat + rng.uniform(-1, 1) / 500, t + rng.randint(0, 40)
    return rows


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "devid bigint, seq bigint, lon double, lat double, t bigint, road_id bigint")


@pytest.mark.parametrize("n", [1, 3, 4, 5, 7, 150])
def test_equal_parts(frame, n):
    sizes = [r["count"] for r in stats.equal_parts(frame(walk(n))).groupBy("seg").count().orderBy("seg").collect()]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True) and len(sizes) == min(4, n)


@pytest.mark.parametrize("sizes,expected", [
    ([5], [5]), ([5, 5], []), ([29, 1], [30]), ([10, 40], [50]), ([40, 10], [50]), ([10, 10, 10], [30]), ([1] * 40, None), ([40, 5, 5, 50], [40, 60]),
])
def test_merge_sizes(sizes, expected):
    at, runs = 0, []
    for s in sizes:
        runs.append(list(range(at, at + s)))
        at += s
    merged = segmentation.merge_small(runs, 30)
    got = [len(s) for s in merged]
    if sizes == [1] * 40:
        assert sum(got) == 40
    else:
        assert got == expected
    assert not merged or len(sizes) == 1 or sorted(i for s in merged for i in s) == list(range(at))


def slow_cost(lon, lat, t, road, a, b):
    n = len(lon)

    def metres(i, j):
        p, q = np.radians(lat[i]), np.radians(lat[j])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon[j] - lon[i]) / 2) ** 2
        return 2 * 6371000 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    v = [metres(i, i + 1) / (t[i + 1] - t[i]) for i in range(a, min(b, n - 1)) if t[i + 1] > t[i]]
    speed = float(np.var(v)) if b - a >= 2 and len(v) >= 2 else 0.0
    changes = sum(road[i] != road[i + 1] for i in range(a, min(b, n - 1))) if b - a >= 2 else 0
    turns = 0.0
    if b - a >= 3:
        for i in range(a, min(b - 1, n - 2)):
            x1, y1, x2, y2 = lon[i + 1] - lon[i], lat[i + 1] - lat[i], lon[i + 2] - lon[i + 1], lat[i + 2] - lat[i + 1]
            size = np.hypot(x1, y1) * np.hypot(x2, y2)
            turns += abs(180 - (np.degrees(np.arccos(np.clip((x1 * x2 + y1 * y2) / size, -1, 1))) if size else 0.0))
    clip = lambda x: min(1.0, max(0.0, x))
    return clip(speed / 50) + clip(changes / 20) + 0.1 * clip(1 / (b - a + 1)) + 0.5 * clip(turns / 1000)


@pytest.mark.parametrize("n", [2, 9, 10, 20, 45])
def test_dynamic_programme(n):
    rows = pd.DataFrame(walk(n, n), columns=["devid", "seq", "lon", "lat", "t", "road_id"])
    arrays = [rows[c].to_numpy() for c in ("lon", "lat", "t", "road_id")]
    costs = segmentation.Costs(*arrays, segmentation.WEIGHTS, segmentation.UPPER)
    for a in range(0, n, 3):
        for b in range(a + 1, n + 1, 4):
            assert costs.cost(np.array([a]), np.array([b]))[0] == pytest.approx(slow_cost(*arrays, a, b), abs=1e-9)
    starts = segmentation.best_cuts(costs, 10)
    best = [0.0] + [np.inf] * n
    for h in range(10, n + 1):
        best[h] = min(best[d] + slow_cost(*arrays, d, h) for d in range(h - 9))
    if n >= 10:
        assert sum(slow_cost(*arrays, a, b) for a, b in zip(starts, [*starts[1:], n])) == pytest.approx(best[n], abs=1e-9)
    else:
        assert starts == [0]


def slow_by_road(rows, limit=30.0, m=5):
    segments, current = [], [0]
    for i in range(1, len(rows)):
        if rows[i][5] != rows[i - 1][5]:
            keep = False
            if len(current) >= m and i + m < len(rows):
                p, q, u, w = rows[current[max(0, len(current) - 1 - m)]], rows[current[-1]], rows[i], rows[i + m]
                keep = segmentation.angle_between(q[2] - p[2], q[3] - p[3], w[2] - u[2], w[3] - u[3]) < limit
            if not keep:
                segments.append(current)
                current = []
        current.append(i)
    return [*segments, current]


def test_by_road(frame):
    rows = walk(80, 3) + walk(1, 4, 2)
    got = segmentation.by_road(frame(rows), least=None).orderBy("devid", "seg", "pos").collect()
    for devid in (1, 2):
        mine = [[r["seq"] for r in got if r["devid"] == devid and r["seg"] == s] for s in range(1 + max(r["seg"] for r in got if r["devid"] == devid))]
        assert mine == slow_by_road([r for r in rows if r[0] == devid])


def test_continuity(frame):
    parts = stats.equal_parts(frame(walk(20))).withColumn("pos", F.col("seq"))
    full = segmentation.continuity(parts)
    assert full.count() == 23 and full.where("pos = -1").count() == 3


def test_retiming_keeps_order_and_others(frame):
    points = frame([r for d in range(20) for r in walk(60, d, d)])
    out = anomaly.anomalies(points).toPandas()
    assert out["devid"].nunique() == 2
    for _, g in out.groupby("devid"):
        g = g.sort_values("seq")
        assert (g["t"].diff().dropna() >= -1e-6).all() and g["anomalous"].sum() == 6


def test_numbered_is_dense(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("b"), F.col("id").alias("x"))
    got = roads.numbered(rows, "n", "b", "x").orderBy("b", "x").toPandas()
    assert got["n"].tolist() == list(range(1000))


def test_binary_metrics_without_positives(spark):
    rows = spark.createDataFrame([("normal", "normal"), ("normal", "abnormal"), (None, "normal"), ("normal", None)], "truth string, prediction string")
    table = evaluate.confusion(rows)
    assert table.first().asDict() == {"tp": 0, "fp": 1, "tn": 1, "fn": 0, "n": 2}
    m = evaluate.binary_metrics(table).first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0, 0, 0, 0.5)
    assert evaluate.pr_auc(table).first()["pr_auc"] is None


def test_pr_auc_is_the_curves_area(spark):
    rows = [("abnormal", "abnormal")] * 3 + [("abnormal", "normal")] * 2 + [("normal", "abnormal")] + [("normal", "normal")] * 4
    got = evaluate.pr_auc(evaluate.confusion(spark.createDataFrame(rows, "truth string, prediction string"))).first()
    recall, precision = [1.0, 0.6, 0.0], [0.5, 0.75, 1.0]
    area = sum((recall[k] - recall[k + 1]) * (precision[k] + precision[k + 1]) / 2 for k in range(2))
    assert got["pr_auc"] == pytest.approx(area) and got["average_precision"] == pytest.approx(0.6 * 0.75 + 0.4 * 0.5)


def test_mode_metrics_one_class(spark):
    got = evaluate.mode_metrics(spark.createDataFrame([("car", "car"), ("car", None)], "truth string, prediction string")).first()
    assert (got["n"], got["correct"], got["accuracy"], got["macro_f1"]) == (2, 1, 50.0, None)


def test_interleaved(spark):
    slots = spark.createDataFrame([(1, "image1", "**One:**", "u1"), (1, "image2", "**Two:**", None), (2, "image1", None, "u3")], "devid long, slot string, description string, picture string")
    texts = [(1, "a `image1` b `x` `image2`"), (2, "`image1` tail"), (3, None), (4, "no marks, one ` alone \n"), (1, " \n")]
    got = prompts.messages(spark.createDataFrame(texts, "devid long, text string"), slots).collect()
    parts = lambda k: [(r["type"], r["content"], r["slot"]) for r in sorted(got, key=lambda r: r["pos"]) if r["devid"] == k]
    assert parts(1) == [("text", "a  **One:** ", None), ("image_url", "u1", "image1"), ("text", " b ", None), ("text", "`x` **Two:** ", None), ("text", "`image2`", None)]
    assert parts(2) == [("text", " ", None), ("image_url", "u3", "image1"), ("text", " tail", None)]
    assert parts(3) == [] and parts(4) == [("text", texts[3][1], None)]


def parts_of(spark, rows):
    return spark.createDataFrame(rows, "devid bigint, pos bigint, type string, content string, slot string")


def test_answers_keep_errors_in_rows(spark):
    def client():
        def ask(system, message):
            if message[0][1] == "a":
                raise OSError("no network")
            if message[0][1] == "b":
                raise ValueError("bad")
            return "fine"

        return ask

    parts = parts_of(spark, [(1, 0, "text", "a", None), (2, 0, "text", "b", None), (3, 0, "text", "c", None)]).drop("slot")
    got = {r["devid"]: (r["response"], r["error_kind"]) for r in models.answers(parts, "s", client, wait=0.01).collect()}
    assert got == {1: (None, "api"), 2: (None, "general"), 3: ("fine", None)}


def test_calls_of_a_partition_overlap(spark):
    def slow():
        def ask(system, message):
            time.sleep(0.25)
            return message[0][1]

        return ask

    parts = parts_of(spark, [(k, 0, "text", f"q{k}", None) for k in range(24)]).coalesce(1)
    took = {}
    for pool in (1, 12):
        frame = models.answers(parts, "s", slow, pool=pool).coalesce(1)
        frame.count()
        began = time.time()
        got = frame.collect()
        took[pool] = time.time() - began
        assert sorted((r["devid"], r["response"]) for r in got) == [(k, f"q{k}") for k in range(24)]
    assert took[12] < took[1] - 3  # 24 calls take 6 s one by one


def test_failed_calls_are_tried_again_a_few_times():
    calls = []

    def ask(system, message):
        calls.append(message)
        if len(calls) % 3:
            raise ConnectionError("again")
        return "at last"

    caller = models.Caller("s", lambda: ask, 1, 3, 0.0, None)
    assert caller.answer(1, [{"type": "text", "content": "x", "slot": None}]) == (1, "at last", None, None) and len(calls) == 3
    calls.clear()
    short = models.Caller("s", lambda: ask, 1, 2, 0.0, None)
    assert short.answer(1, [{"type": "text", "content": "x", "slot": None}]) == (1, None, "api", "again") and len(calls) == 2


def test_pictures_are_read_by_the_calling_task(spark, tmp_path):
    raw = {f"p{k}.png": bytes([137, k]) * 50 for k in range(3)}
    for name, content in raw.items():
        (tmp_path / name).write_bytes(content)
    uri = lambda name: (tmp_path / name).as_uri()
    rows = [(1, 0, "text", "see ", None), (1, 1, "image_url", uri("p0.png"), "image1"), (1, 2, "image_url", uri("gone.png"), "image2"), (2, 0, "image_url", uri("p1.png"), None), (2, 1, "image_url", str(tmp_path / "no.png"), None)]
    echo = lambda: lambda system, message: "|".join(f"{k}={c}" for k, c in message)
    got = {r["devid"]: r["response"] for r in models.answers(parts_of(spark, rows), "s", echo, read=models.read_file).collect()}
    data = {k: "data:image/png;base64," + base64.b64encode(v).decode() for k, v in raw.items()}
    assert got == {1: f"text=see |image_url={data['p0.png']}|text=`image2`", 2: f"image_url={data['p1.png']}"}


def test_pictures_are_kept_up_to_a_size():
    reads = []

    def read(path):
        reads.append(path)
        return bytes(300)

    kept = models.Pictures(read, 1000)
    for path in "aabcab":
        assert len(kept.uri(path)) == 422
    assert reads == ["a", "b", "c", "a", "b"] and kept.held <= 1000  # two fit


def test_single_points(frame):
    points = frame(walk(1))
    assert steps.steps(points).count() == 0 and steps.last_direction(points).count() == 0
    k = stats.kinematics(points.withColumn("seg", F.lit(0))).first()
    assert k["start_t"] is None and k["total_distance"] == 0 and k["minutes"] == 0
    assert trajectories.tail(points, 20).count() == 1


def test_trajectories_from_files(spark, tmp_path):
    nested = [("x", [(104.0, 30.0), (104.1, 30.1)], [5.0, 6.0], [7, 8])]
    spark.createDataFrame(nested, "devid string, o_geo array<struct<lon: double, lat: double>>, tms array<double>, opath array<bigint>").write.parquet(str(tmp_path / "t"))
    got = trajectories.scan(spark, str(tmp_path / "t")).orderBy("seq").collect()
    assert [(r["lon"], r["t"], r["road_id"]) for r in got] == [(104.0, 5.0, 7), (104.1, 6.0, 8)]
