"""Segmentation that goes from run to run or from point to point.

A segmented trajectory is ``(devid, seg, pos, seq, ...)``: a row per point of a segment, pos its place there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

# fixed values: weights and upper ends of the cost's factors
WEIGHTS = {"speed": 1.0, "road": 1.0, "length": 0.1, "angle": 0.5}
UPPER = {"speed": 50.0, "road": 20.0, "length": 1.0, "angle": 1000.0}


def angle_between(ax: float, ay: float, bx: float, by: float) -> float:
    lengths = np.hypot(ax, ay) * np.hypot(bx, by)
    return 180.0 if lengths == 0 else float(np.degrees(np.arccos(np.clip((ax * bx + ay * by) / lengths, -1, 1))))


def road_starts(lon: np.ndarray, lat: np.ndarray, road: np.ndarray, angle: float = 30.0, reach: int = 5) -> list[int]:
    """First points of segments: where the road changes, unless the way goes on nearly straight.

    Straight is judged by the vectors over ``reach`` points before and after; both must exist.
    """
    starts = [0] if len(lon) else []
    for i in np.flatnonzero(road[1:] != road[:-1]) + 1:
        if i - starts[-1] >= reach and i + reach < len(lon):
            back = max(starts[-1], i - 1 - reach)
            if angle_between(lon[i - 1] - lon[back], lat[i - 1] - lat[back], lon[i + reach] - lon[i], lat[i + reach] - lat[i]) < angle:
                continue
        starts.append(int(i))
    return starts


def absorb(segments: list, least: int, first: bool, size: Callable[[list], int]) -> list:
    """One pass from the left: a small segment takes the one after it. In the first pass a large one also joins a
    result before it that is still small, if the segment just before was small."""
    small = [size(s) < least for s in segments]
    out: list[list] = []
    at = 0
    while at < len(segments):
        if small[at]:
            out.append(segments[at] + (segments[at + 1] if at + 1 < len(segments) else []))
            at += 2
            continue
        if first and at and small[at - 1] and out and size(out[-1]) < least:
            out[-1] = out[-1] + segments[at]
        else:
            out.append(segments[at])
        at += 1
    return out


def merge_small(segments: list, least: int = 30, size: Callable[[list], int] = len) -> list:
    """Segments (lists of point numbers, or of anything that ``size`` counts) of at least ``least`` points, as far as merging goes.

    A single segment stays as it is. Small ones that are left after five passes wait for the next large one
    and are put behind its points, the last ones behind the last. If none is large nothing remains.
    """
    if len(segments) < 2:
        return segments
    segments = absorb(segments, least, True, size)
    for _ in range(4):
        if len(segments) < 2:
            break
        segments = absorb(segments, least, False, size)
        if all(size(s) >= least for s in segments):
            break
    out, waiting = [], []
    for s in segments:
        if size(s) >= least:
            out.append(s + waiting)
            waiting = []
        else:
            waiting = waiting + s
            if size(waiting) >= least:
                out.append(waiting)
                waiting = []
    if out and waiting:
        out[-1] = out[-1] + waiting
    return out


def straight(back: int, reach: int, limit: float) -> Column:
    """Whether the way from ``back`` points behind to the point just behind goes on within ``limit`` degrees over the next ``reach``."""
    order = W.partitionBy("devid").orderBy("seq")
    at = lambda c, k: F.lag(c, -k).over(order)
    ax, ay = (at(c, -1) - at(c, -back) for c in ("lon", "lat"))
    bx, by = (at(c, reach) - F.col(c) for c in ("lon", "lat"))
    lengths = F.hypot(ax, ay) * F.hypot(bx, by)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ax * bx + ay * by) / lengths))
    return F.coalesce((lengths > 0) & (F.degrees(F.acos(cosine)) < limit), F.lit(False))


def road_run_points(points: DataFrame, angle: float = 30.0, reach: int = 5) -> DataFrame:
    """The points with idx (0, 1, ...), run (idx of the first point of their run of one road), and what is known where a run begins:
    far and near say whether the way goes on straight, seen from reach + 1 and from reach points behind. last marks the last point."""
    order = W.partitionBy("devid").orderBy("seq")
    begins = (F.row_number().over(order) == 1) | ~F.col("road_id").eqNullSafe(F.lag("road_id").over(order))
    rows = points.select("devid", "seq", "lon", "lat", "t", "road_id").withColumns({
        "idx": F.row_number().over(order).cast("bigint") - 1, "begins": begins, "last": F.lead("seq").over(order).isNull(),
        "far": straight(reach + 1, reach, angle), "near": straight(reach, reach, angle),
    })
    return rows.withColumn("run", F.max(F.when(F.col("begins"), F.col("idx"))).over(order))


def run_segments(idx: list[int], far: list[bool], near: list[bool], n: int, reach: int, least: int | None) -> list[list[tuple[int, int]]]:
    """Segments as lists of runs (first point, size), from one trajectory's runs: where each begins and whether it goes on straight."""
    starts: list[list[tuple[int, int]]] = []
    for at, end, seen_far, seen_near in zip(idx, [*idx[1:], n], far, near):
        first = starts[-1][0][0] if starts else None
        if first is not None and (seen_far if first < at - reach else seen_near and first == at - reach):
            starts[-1].append((at, end - at))
        else:
            starts.append([(at, end - at)])
    return starts if least is None else merge_small(starts, least, lambda s: sum(n for _, n in s))


def trajectories_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one devid at a time, from batches that are sorted by it (the first column)."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def by_road(points: DataFrame, angle: float = 30.0, reach: int = 5, least: int | None = 30) -> DataFrame:
    """Segments by road, small ones merged (not at all with ``least`` None), before continuity().

    A new segment begins where the road changes, unless the way goes on within ``angle`` degrees, judged by the vectors
    over ``reach`` points before and after; both must exist. Windows find the runs of one road and the angles; only a row per
    run reaches the sequential part, whose answers are joined to the points by devid and run.
    """
    rows = road_run_points(points, angle, reach)
    kind = points.schema["devid"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for trip in trajectories_in(batches):
            n = trip[-1][1] + 1
            idx, far, near = zip(*[r[1:4] for r in trip if r[4]])
            for seg, runs in enumerate(run_segments(idx, far, near, n, reach, least)):
                pos = 0
                for run, size in runs:
                    out.append((trip[0][0], run, seg, pos))
                    pos += size
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays(columns(out), names=names)
                out = []
        yield pa.RecordBatch.from_arrays(columns(out), names=names)

    names = ["devid", "run", "seg", "first"]
    key = to_arrow_type(points.schema["devid"].dataType)
    columns = lambda out: [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, [key, pa.int64(), pa.int64(), pa.int64()])]
    runs = rows.where(F.col("begins") | F.col("last")).select("devid", "idx", "far", "near", "begins").repartition("devid").sortWithinPartitions("devid", "idx")
    placed = runs.mapInArrow(place, f"devid {kind}, run bigint, seg bigint, first bigint").alias("p")
    met = rows.alias("r").join(placed, F.col("r.devid").eqNullSafe(F.col("p.devid")) & (F.col("r.run") == F.col("p.run")))
    return met.select("r.devid", "seg", (F.col("first") + F.col("idx") - F.col("r.run")).alias("pos"), "seq", "lon", "lat", "t", "road_id")


def continuity(segmented: DataFrame) -> DataFrame:
    """Each segment begins with the last point of the one before, unless it already does. Added rows have pos -1."""
    place = F.struct("pos", "seq", "lon", "lat", "t", "road_id")
    ends = segmented.groupBy("devid", "seg").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(W.partitionBy("devid").orderBy("seg")))
    apart = (F.col("before.lon") != F.col("first.lon")) | (F.col("before.lat") != F.col("first.lat"))
    added = ends.where(apart).select("devid", "seg", F.lit(-1).cast("bigint").alias("pos"), *[F.col(f"before.{c}").alias(c) for c in ("seq", "lon", "lat", "t", "road_id")])
    return segmented.select(added.columns).unionByName(added)


class Costs:
    """Cost of any part [a, b) of one trajectory in constant time, from prefix sums.

    The step into the next part counts. Speeds are taken around their mean, so that squares lose no digits.
    """

    def __init__(self, lon: np.ndarray, lat: np.ndarray, t: np.ndarray, road: np.ndarray, weights: dict[str, float], upper: dict[str, float]):
        self.n, self.weights, self.upper = len(lon), weights, upper
        phi, lam = np.radians(lat), np.radians(lon)
        h = np.sin(np.diff(phi) / 2) ** 2 + np.cos(phi[1:]) * np.cos(phi[:-1]) * np.sin(np.diff(lam) / 2) ** 2
        dist, dt = 2 * 6371000.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)), np.diff(t).astype(float)
        valid = dt > 0
        v = np.divide(dist, dt, out=np.zeros(len(dt)), where=valid)
        v = np.where(valid, v - (v[valid].mean() if valid.any() else 0.0), 0.0)
        dx, dy = np.diff(lon), np.diff(lat)
        dot, size = dx[:-1] * dx[1:] + dy[:-1] * dy[1:], np.hypot(dx, dy)
        lengths = size[:-1] * size[1:]
        cosine = np.divide(dot, lengths, out=np.ones(len(dot)), where=lengths > 0)
        turn = np.degrees(np.arccos(np.clip(cosine, -1, 1)))
        total = lambda x: np.r_[0.0, np.cumsum(x)]
        self.count, self.v, self.v2 = total(valid), total(v), total(v * v)
        self.changes, self.turns = total(road[1:] != road[:-1]), total(np.abs(180 - turn))

    def factors(self, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        size, steps, triples = b - a, np.minimum(b, self.n - 1), np.maximum(a, np.minimum(b - 1, self.n - 2))
        steps = np.maximum(a, steps)
        n = self.count[steps] - self.count[a]
        safe = np.maximum(n, 1)
        var = np.maximum(0.0, (self.v2[steps] - self.v2[a]) / safe - ((self.v[steps] - self.v[a]) / safe) ** 2)
        return {
            "speed": np.where((size >= 2) & (n >= 2), var, 0.0),
            "road": np.where(size >= 2, self.changes[steps] - self.changes[a], 0.0),
            "length": 1.0 / (size + 1),
            "angle": np.where((size >= 3) & (triples > a), self.turns[np.minimum(triples, len(self.turns) - 1)] - self.turns[np.minimum(a, len(self.turns) - 1)], 0.0),
        }

    def cost(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(self.weights[k] * np.clip(f / self.upper[k], 0, 1) for k, f in self.factors(a, b).items())


def factors(parts: DataFrame) -> DataFrame:
    """devid, seg, speed, road, length, angle: the cost's factors, not yet weighted, of parts (seg) that follow one another."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        costs = Costs(*(rows[c].to_numpy() for c in ("lon", "lat", "t", "road_id")), WEIGHTS, UPPER)
        seg = rows["seg"].to_numpy()
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        found = costs.factors(first, np.r_[first[1:], len(rows)])
        return pd.DataFrame({"devid": rows["devid"].iloc[0], "seg": seg[first], **found})

    kind = parts.schema["devid"].dataType.simpleString()
    return parts.select("devid", "seg", "seq", "lon", "lat", "t", "road_id").groupBy("devid").applyInPandas(run, f"devid {kind}, seg bigint, speed double, road double, length double, angle double")


class Starts:
    """Known starts of parts in blocks, with what no part that starts in a block can fall below.

    Road changes and turns only grow with a part's end, so a block whose least total with these alone is above
    what one part from the first point costs at most is dropped for good. Speed's bound is by sums of squares: that of a longer part is no less
    than that of a part inside it. A block is looked into for an end only if its bound there isn't above the best total found.
    """

    SIZE = 64
    MARGIN = 1e-9

    def __init__(self, costs: Costs, best: np.ndarray):
        self.costs, self.best = costs, best
        self.blocks, self.least = np.empty(0, int), np.empty(0)
        self.closed = 0
        self.bounded = all(w >= 0 for w in costs.weights.values()) and all(u > 0 for u in costs.upper.values())
        self.most = sum(costs.weights[k] for k in ("speed", "road", "angle"))

    def close(self, until: int) -> None:
        """Whole blocks of starts below ``until`` are bounded from now on."""
        while self.closed + self.SIZE <= until:
            self.blocks = np.r_[self.blocks, self.closed]
            self.least = np.r_[self.least, self.best[self.closed : self.closed + self.SIZE].min()]
            self.closed += self.SIZE

    def clipped(self, name: str, factor: np.ndarray) -> np.ndarray:
        return self.costs.weights[name] * np.clip(factor / self.costs.upper[name], 0, 1)

    def bounds(self, ends: np.ndarray) -> np.ndarray:
        """By block and end; drops blocks for good."""
        c, first, last = self.costs, self.blocks[:, None], self.blocks[:, None] + self.SIZE - 1
        steps, triples = np.minimum(ends, c.n - 1), np.minimum(ends - 1, c.n - 2)
        growing = self.clipped("road", c.changes[steps] - c.changes[last]) + self.clipped("angle", c.turns[triples] - c.turns[last])
        n, wide = np.maximum(1, c.count[steps] - c.count[last]), np.maximum(1, c.count[steps] - c.count[first])
        squares = np.maximum(0.0, c.v2[steps] - c.v2[last] - (c.v[steps] - c.v[last]) ** 2 / n)
        found = self.least[:, None] + growing + self.clipped("speed", squares / wide) + self.clipped("length", 1.0 / (ends - first + 1))
        one_part = self.most + float(self.clipped("length", np.array(1.0 / (ends[0] + 1))))
        keep = self.least + growing[:, 0] <= one_part + self.MARGIN
        self.blocks, self.least = self.blocks[keep], self.least[keep]
        return found[keep]


def best_cuts(costs: Costs, least: int = 10) -> list[int]:
    """First points of the parts of least total cost; every part has ``least`` points or more. Ties go to the longer last part.

    ``least`` ends are worked on together, as they need the totals of earlier ones alone. Starts near the ends are all tried, those further back by
    their bounds (``Starts``).
    """
    n = costs.n
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = 0.0
    known = Starts(costs, best)
    for at in range(least, n + 1, least):
        ends = np.arange(at, min(at + least, n + 1))
        if known.bounded:
            known.close(at - least + 1)
        near = np.arange(known.closed, ends[-1] - least + 1)
        if len(near):
            d, h = np.broadcast_arrays(near[:, None], ends[None])
            totals = best[d] + costs.cost(d, np.maximum(h, d))
            totals[d > h - least] = np.inf
            back[ends] = near[totals.argmin(axis=0)]
            best[ends] = totals.min(axis=0)
        if len(known.blocks):
            bounds = known.bounds(ends)
            for first in (True, False):  # the most promising block of every end, then what may still be better or as good
                some = bounds <= best[ends] + known.MARGIN
                if first and len(bounds):
                    only = np.zeros_like(some)
                    only[bounds.argmin(axis=0), np.arange(len(ends))] = True
                    some &= only
                block, end = np.nonzero(some)
                if not len(block):
                    continue
                bounds[some] = np.inf
                d = known.blocks[block][:, None] + np.arange(known.SIZE)
                totals = best[d] + costs.cost(d, np.broadcast_to(ends[end][:, None], d.shape))
                low = totals.argmin(axis=1)
                for k, start, total in zip(ends[end].tolist(), d[np.arange(len(d)), low].tolist(), totals[np.arange(len(d)), low].tolist()):
                    if total < best[k] or total == best[k] and start < back[k]:
                        best[k], back[k] = total, start
    starts, at = [], n
    while at > 0:
        at = int(back[at]) if n >= least else 0
        starts.append(at)
    return starts[::-1]


def by_cost(points: DataFrame, least: int = 10, weights: dict[str, float] = WEIGHTS, upper: dict[str, float] = UPPER) -> DataFrame:
    """Segments of least cost by dynamic programming with bounds. One point alone has no segment.

    A trajectory's points meet in one task; only first points of its parts leave the sequential part.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable").reset_index(drop=True)
        if len(rows) < 2:
            return rows.assign(seg=0, pos=0)[names].iloc[:0]
        starts = np.array(best_cuts(Costs(*(rows[c].to_numpy() for c in ("lon", "lat", "t", "road_id")), weights, upper), least))
        seg = np.searchsorted(starts, np.arange(len(rows)), "right") - 1
        return rows.assign(seg=seg, pos=np.arange(len(rows)) - starts[seg])[names]

    names = ["devid", "seg", "pos", "seq", "lon", "lat", "t", "road_id"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select("devid", "seq", "lon", "lat", "t", "road_id").schema)
    return points.select("devid", "seq", "lon", "lat", "t", "road_id").groupBy("devid").applyInPandas(run, schema.replace("seq ", "seg bigint, pos bigint, seq ", 1))
