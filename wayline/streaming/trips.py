"""Trajectory operators on streams of points: trips by gaps in time, steps and road runs as they happen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def trips(points: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """devid, start, end, n: sessions of (devid, ts) that a silence of ``gap`` ends; points later than ``late`` are dropped by the watermark."""
    session = F.session_window("ts", gap)
    return points.withWatermark("ts", late).groupBy("devid", session.alias("trip")).agg(F.count("*").alias("n")).select("devid", F.col("trip.start").alias("start"), F.col("trip.end").alias("end"), "n")


def activity(points: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, road_id, n: points per road in tumbling or sliding windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return points.withWatermark("ts", late).groupBy(window.alias("w"), "road_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "road_id", "n")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = ["devid", "road_id", "start_ts", "end_ts", "n"]
RUN = "road_id bigint, first bigint, last bigint, n bigint"  # times in microseconds


class RoadRuns(StatefulProcessor):
    """Runs of one road in the order of event time. Points wait in the state until the watermark has passed them, so that those
    that come late, but not too late, find their place; a timer then takes them out. One open run is held for each trajectory."""

    def __init__(self, idle: int):
        self.idle = idle  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)
        self.waiting = handle.getListState("waiting", "at bigint, road_id bigint")

    def wake(self, micros: int) -> None:
        """When the watermark has passed this point in time."""
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            at = some["ts"].astype("datetime64[us]").astype("int64")
            new = [(int(t), None if pd.isna(r) else int(r)) for t, r in zip(at, some["road_id"])]
            self.waiting.appendList(new)
            self.wake(min(t for t, _ in new))
        yield pd.DataFrame(columns=NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(((int(t), r) for t, r in self.waiting.get()), key=lambda x: (x[0], x[1] is not None, x[1] or 0)) if self.waiting.exists() else []
        due = [x for x in held if x[0] <= now]
        run = tuple(self.run.get()) if self.run.exists() else None
        done: list[tuple] = []
        for at, road in due:
            if run and road == run[0] and at - run[2] <= self.idle:
                run = (run[0], run[1], at, run[3] + 1)
            else:
                if run:
                    done.append((key[0], *run))
                run = (road, at, at, 1)
        if run and run[2] + self.idle < now:
            done.append((key[0], *run))
            run = None
        if run:
            self.run.update(run)
            self.wake(run[2] + self.idle + 1000)
        elif self.run.exists():
            self.run.clear()
        if due:
            left = held[len(due) :]
            self.waiting.clear()
            if left:
                self.waiting.put(left)
                self.wake(left[0][0])
        out = pd.DataFrame(done, columns=NAMES)
        for c in ("start_ts", "end_ts"):
            out[c] = pd.to_datetime(out[c].astype("int64"), unit="us")
        yield out

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        row = initialState.iloc[-1]
        first, last = (int(pd.Timestamp(row[c]).value // 1000) for c in ("start_ts", "end_ts"))
        self.run.update((int(row["road_id"]), first, last, int(row["n"])))
        self.wake(last + self.idle + 1000)

    def close(self) -> None:
        pass


def road_runs(points: DataFrame, key: str = "bigint", late: str = "10 minutes", idle_ms: int = 86_400_000, begun: DataFrame | None = None) -> DataFrame:
    """devid, road_id, start_ts, end_ts, n of a stream (devid, ts, road_id): the runs that ``batch_road_runs`` finds in all its points.

    A run ends when the road changes in the order of event time, or by a silence of over ``idle_ms``; it is given out once the watermark
    has passed that. Points that are more than ``late`` behind are dropped. ``begun`` (the same columns) has a run that is open for some
    trajectories when the stream starts. The state store must be RocksDB's; it is chosen for the session.
    """
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = f"devid {key}, road_id bigint, start_ts timestamp, end_ts timestamp, n bigint"
    kept = points.select("devid", "ts", "road_id").withWatermark("ts", late).groupBy("devid")
    return kept.transformWithStateInPandas(RoadRuns(idle_ms * 1000), schema, "Append", "EventTime", begun.groupBy("devid") if begun is not None else None)


def batch_road_runs(points: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """devid, road_id, start_ts, end_ts, n of a table (devid, ts, road_id): runs of one road without a silence of over ``idle_ms``."""
    order = W.partitionBy("devid").orderBy("ts", F.col("road_id").asc_nulls_first())
    silent = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > idle_ms * 1000
    new = ~F.col("road_id").eqNullSafe(F.lag("road_id").over(order)) | F.coalesce(silent, F.lit(True))
    runs = points.select("devid", "ts", "road_id", F.sum(new.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("run"))
    return runs.groupBy("devid", "run").agg(F.min("road_id").alias("road_id"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")).drop("run")
