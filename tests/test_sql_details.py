"""Details in which results once differed from their SQL on tables larger than those of test_oracle."""

import math
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators import prompts, stats
from wayline.plans import segments  # noqa: F401  registers
from wayline.registry import ORACLE, QUERIES


def test_haversine_of_short_steps(spark):
    """As the SQL has it, to the last bits: the difference of radians, not the radians of a difference."""
    rows = [(30.65 + k * 1e-6, 104.06 + k * 3e-6, 30.65 + k * 2e-6 + 1e-6, 104.06 + k * 5e-6) for k in range(200)]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double").select("*", geo.haversine("a", "b", "c", "d").alias("dist")).collect()
    for a, b, c, d, dist in got:
        p, q, x, y = map(math.radians, (a, c, b, d))
        s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2
        assert dist == pytest.approx(2 * 6371000.0 * math.atan2(math.sqrt(s), math.sqrt(1 - s)), rel=1e-14, abs=0)


@pytest.mark.parametrize("name", ["adaptive_avg_speed", "adaptive_avg_speed_all"])
def test_like_questions(spark, tmp_path, name):
    """Two points of a trajectory in one second on one road are one question, which counts each observation twice."""
    start, events = datetime(2024, 1, 1), []
    for k in range(24):
        at = start + timedelta(hours=5 * (k // 2), milliseconds=400 * (k % 2) * (k % 3 > 0)) + timedelta(minutes=k % 2 * (k % 3 == 0))
        events.append((k, at, 1, "view", 5.0 + k % 2 * 0.01, f'{{"k": {49 + k % 2 if k else 60}}}'))
    db = duckdb.connect()
    db.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    db.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", events)
    db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = db.execute(ORACLE[name]).fetchall()
    assert len(want) < len(events)
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sums_keep_their_digits(spark):
    """Differences of prefix sums of small speeds are good to far more than the SQL's six digits."""
    small = [1 / 7 * 1e-3, 1 / 3 * 1e-3, 1 / 11 * 1e-3]
    seconds = spark.createDataFrame([(1, t, 1, small[t % 3]) for t in range(3000)], "road_id long, t long, n long, s double")
    edges = spark.createDataFrame([(1, 10.0, False), (1, 12.0, True)], "road_id long, x double, high boolean")
    low, high = [r["s"] for r in stats.sums_until(seconds, edges, 100).orderBy("x").collect()]
    assert float(high - low) == pytest.approx(math.fsum(small), rel=1e-15, abs=0)


def test_large_numbers_in_texts(spark):
    rows = spark.createDataFrame([(12345678.5,), (0.0004,), (0.0,), (100.0,), (7.12345,), (None,)], "x double")
    assert [r[0] for r in rows.select(prompts.plain(F.col("x"), 4)).collect()] == ["12345678.5", "0.0004", "0.0", "100.0", "7.1235", None]
