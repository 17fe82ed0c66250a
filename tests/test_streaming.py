import random
import time
from functools import reduce

from pyspark.sql import functions as F

from wayline.streaming import trips


def test_streams(spark, tmp_path):
    rows = [(d, 1_479_946_800 + 60 * k + (7200 if k >= 5 else 0), k // 3) for d in (1, 2) for k in range(10)] + [(1, 1_480_946_800, 9), (2, 1_480_946_800, 9)]
    spark.createDataFrame(rows, "devid bigint, t bigint, road_id bigint").withColumn("ts", F.timestamp_seconds("t")).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("devid bigint, t bigint, road_id bigint, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("trips", trips.trips(source()), "append"), ("busy", trips.activity(source()), "append"), ("runs", trips.road_runs(source()), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
        q.processAllAvailable()
        q.stop()
    got = spark.sql("SELECT devid, n FROM trips ORDER BY devid, start").collect()
    assert [(r["devid"], r["n"]) for r in got] == [(1, 5), (1, 5), (2, 5), (2, 5)]
    assert spark.sql("SELECT sum(n) AS n FROM busy").first()["n"] == 20
    runs = spark.sql("SELECT road_id, n FROM runs WHERE devid = 1 ORDER BY start_ts").collect()
    assert [(r["road_id"], r["n"]) for r in runs[:4]] == [(0, 3), (1, 3), (2, 3), (3, 1)]


def stream_of(spark, folder):
    return spark.readStream.schema("devid bigint, ts timestamp, road_id bigint").option("maxFilesPerTrigger", 1).parquet(str(folder))


def play(df, folder, name):
    q = df.writeStream.format("parquet").outputMode("append").option("path", str(folder / f"{name}-out")).option("checkpointLocation", str(folder / f"{name}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def put(spark, folder, rows):
    """One file, so one batch; files are taken in the order of their time."""
    time.sleep(1.1)
    frame = spark.createDataFrame([(d, k, r) for d, k, r in rows], "devid bigint, t bigint, road_id bigint").select("devid", F.timestamp_seconds("t").alias("ts"), "road_id")
    frame.coalesce(1).write.mode("append").parquet(str(folder))
    return frame


def seen(frame):
    return sorted((r["devid"], r["road_id"], r["start_ts"], r["end_ts"], r["n"]) for r in frame.collect())


def test_runs_of_a_shuffled_stream_are_those_of_the_table(spark, tmp_path):
    rng, t0 = random.Random(3), 1_480_000_000
    rows = [(d, t0 + 20 * k + (40_000 if k > 60 and d == 2 else 0), (k // rng.choice([3, 4, 5])) % 3) for d in (1, 2, 3) for k in range(90)]
    rows = sorted(set(rows), key=lambda r: r[1] + rng.uniform(0, 400))  # up to 400 s out of order, less than the watermark waits
    end = [(9, t0 + 500_000, 1), (9, t0 + 600_000, 2)]
    source, cut = tmp_path / "in", len(rows) // 2
    frames = [put(spark, source, rows[a : a + 45]) for a in range(0, cut, 45)]
    idle = 3_600_000
    play(trips.road_runs(stream_of(spark, source), idle_ms=idle), tmp_path, "runs")
    frames += [put(spark, source, rows[a : a + 45]) for a in range(max(range(0, cut, 45)) + 45, len(rows), 45)]  # after a restart from the checkpoint
    frames += [put(spark, source, [r]) for r in end] + [put(spark, source, [(2, t0 + 100, 77)])]  # the last one is far too late
    play(trips.road_runs(stream_of(spark, source), idle_ms=idle), tmp_path, "runs")
    whole = reduce(lambda a, b: a.unionByName(b), frames[:-1])
    wanted = [r for r in seen(trips.batch_road_runs(whole, idle)) if r[0] != 9]
    assert [r for r in seen(spark.read.parquet(str(tmp_path / "runs-out"))) if r[0] != 9] == wanted
    assert len(wanted) > 40


def test_runs_that_were_open_before_the_stream(spark, tmp_path):
    t0 = 1_480_000_000
    put(spark, tmp_path / "in", [(1, t0 + 60, 5), (1, t0 + 120, 6), (2, t0 + 60, 7)])
    put(spark, tmp_path / "in", [(9, t0 + 900_000, 1)])
    put(spark, tmp_path / "in", [(9, t0 + 900_001, 1)])
    begun = spark.createDataFrame([(1, 5, t0, t0 + 10, 4), (3, 8, t0, t0 + 10, 2)], "devid bigint, road_id bigint, a bigint, b bigint, n bigint")
    begun = begun.select("devid", "road_id", F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts"), "n")
    play(trips.road_runs(stream_of(spark, tmp_path / "in"), begun=begun), tmp_path, "begun")
    got = [(d, r, n, int(b.timestamp()) - int(a.timestamp())) for d, r, a, b, n in seen(spark.read.parquet(str(tmp_path / "begun-out")))]
    assert got == [(1, 5, 5, 60), (1, 6, 1, 0), (2, 7, 1, 0), (3, 8, 2, 10)]
