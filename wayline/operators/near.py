"""What lies near trajectories: edges, nodes and lights, by an equi-join on grid cells and an exact test.

A box (a piece of road or a spot, widened by the reach) is registered in every cell it touches; the other side's points have one
cell each. Points are counted by fine cells first. A cell with more than LEAF_MOST points is split into quarters, these again,
as far as that is needed; at the deepest level what is still too many is dealt to several shares. Both sides are then dealt by the
same list of leaves, so no join key has more than LEAF_MOST points. A pair is found if it is near, whatever the leaf. Nothing is
broadcast by force, so neither side's size matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.sources.trajectories import bounds_over

from .steps import from_end

DEGREE = 111000.0  # metres a degree, as the thresholds have it
CELL = 0.002  # degrees
DEPTH = 6  # quarterings of a cell
LEAF_MOST = 50_000  # points of a leaf


def widened(rows: DataFrame, low_lon: Column, high_lon: Column, low_lat: Column, high_lat: Column, reach: float) -> DataFrame:
    """``rows`` with their box widened by ``reach`` metres as x1, x2, y1, y2. Longitude is widened by latitude."""
    up = F.lit(reach / 110000.0)
    side = up / F.greatest(F.lit(0.01), F.cos(F.radians(F.greatest(F.abs(low_lat), F.abs(high_lat)) + up)))
    return rows.withColumns({"x1": low_lon - side, "x2": high_lon + side, "y1": low_lat - up, "y2": high_lat + up})


def leaves(points: DataFrame, lon: str, lat: str, cell: float, most: int, depth: int) -> DataFrame:
    """fx, fy, cx, cy, level, shares: the leaf of every fine cell of those cells that are split or shared out, from counts by fine cell.

    All fine cells of a cell meet for that, 4 ** depth rows at most, however many points there are.
    """
    fine = cell / 2**depth
    counts = points.groupBy(F.floor(F.col(lon) / fine).alias("fx"), F.floor(F.col(lat) / fine).alias("fy")).agg(F.count("*").alias("n"))
    counts = counts.withColumns({"cx": F.shiftright("fx", depth), "cy": F.shiftright("fy", depth)})
    held = lambda k: F.sum("n").over(W.partitionBy("cx", "cy", F.shiftright("fx", depth - k), F.shiftright("fy", depth - k)))
    heavy = counts.withColumn("level", F.when(F.sum("n").over(W.partitionBy("cx", "cy")) <= most, 0)).where("level is null")
    level = F.coalesce(*[F.when(held(k) <= most, k) for k in range(1, depth + 1)], F.lit(depth))
    return heavy.select("fx", "fy", "cx", "cy", level.alias("level"), F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int").alias("most_shares")).select(
        "fx", "fy", "cx", "cy", "level", F.when(F.col("level") == depth, F.col("most_shares")).otherwise(1).alias("shares")
    )


def met_in_leaves(points: DataFrame, boxes: DataFrame, lon: str = "lon", lat: str = "lat", cell: float = CELL, most: int = LEAF_MOST, depth: int = DEPTH) -> DataFrame:
    """``points`` joined with the ``boxes`` (x1, x2, y1, y2 among their columns) that they lie in. Column names must differ between the two."""
    fine, names = cell / 2**depth, [*points.columns, *boxes.columns]
    leaf = leaves(points, lon, lat, cell, most, depth)
    spots = points.withColumns({"fx": F.floor(F.col(lon) / fine), "fy": F.floor(F.col(lat) / fine)}).join(leaf.select("fx", "fy", "level", "shares"), ["fx", "fy"], "left")
    spots = spots.withColumns({"level": F.coalesce("level", F.lit(0)), "share": F.when(F.col("shares") > 1, F.pmod(F.xxhash64(*points.columns), F.col("shares")).cast("int")).otherwise(0)})
    spots = spots.withColumns({c: F.expr(f"shiftright(f{c[1]}, {depth} - level)") for c in ("lx", "ly")}).drop("fx", "fy", "shares")
    around = boxes.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x1") / cell), F.floor(F.col("x2") / cell))))
    around = around.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y1") / cell), F.floor(F.col("y2") / cell))))
    parts = leaf.select("cx", "cy", "level", "shares", *[F.expr(f"shiftright(f{c[1]}, {depth} - level)").alias(c) for c in ("lx", "ly")]).groupBy("cx", "cy", "level", "lx", "ly").agg(F.max("shares").alias("shares"))
    around = around.join(parts, ["cx", "cy"], "left")
    edge = lambda c: F.expr(f"shiftright(floor({c} / {fine!r}D), {depth} - level)")
    touched = F.col("lx").between(edge("x1"), edge("x2")) & F.col("ly").between(edge("y1"), edge("y2"))
    around = around.where(F.col("level").isNull() | touched).withColumns({"lx": F.coalesce("lx", "cx"), "ly": F.coalesce("ly", "cy"), "level": F.coalesce("level", F.lit(0))})
    around = around.withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("cx", "cy", "shares")
    inside = F.col(lon).between(F.col("x1"), F.col("x2")) & F.col(lat).between(F.col("y1"), F.col("y2"))
    return spots.join(around, ["level", "lx", "ly", "share"]).where(inside).select(*names)


def pieces(edges: DataFrame) -> DataFrame:
    """fid, piece, lon1, lat1, lon2, lat2: the straight pieces of every line."""
    each = edges.select("fid", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("geometry") - 1), lambda i: F.struct(F.get("geometry", i - 1).alias("a"), F.get("geometry", i).alias("b")))).alias("piece", "p"))
    return each.select("fid", "piece", F.col("p.a.lon").alias("lon1"), F.col("p.a.lat").alias("lat1"), F.col("p.b.lon").alias("lon2"), F.col("p.b.lat").alias("lat2"))


def in_bounds(geometry: str) -> Column:
    """Whether any vertex of a line is inside a trajectory's bounds; a line that only crosses them isn't found."""
    inside = lambda p: p["lon"].between(F.col("min_lon"), F.col("max_lon")) & p["lat"].between(F.col("min_lat"), F.col("max_lat"))
    return F.exists(geometry, inside)


def edges_near(points: DataFrame, edges: DataFrame, threshold: float = 0.001, last: int | None = 5, gap: float | None = 120.0, cell: float = CELL, most: int = LEAF_MOST) -> DataFrame:
    """devid, fid, dist: edges with a piece nearer than ``threshold`` degrees to one of the ``last`` points (all: None).

    A vertex must lie in the trajectory's bounds. With ``gap``, a piece whose bearing is further than that from
    the bearing of those points is passed over. Metres are to the nearest piece that counts. All that is asked of a trajectory is
    found in windows over one shuffle of its points; pieces carry their line's vertices, so lines aren't joined again.
    """
    reach, own = threshold * DEGREE, W.partitionBy("devid")
    rows = points.select("devid", "seq", "lon", "lat", *[c.alias(k) for k, c in bounds_over(own).items()])
    used = rows if last is None else from_end(rows, last).drop("back")
    if gap is not None:
        ends = {f"{c}_{k}": f(c, "seq").over(own) for c in ("lon", "lat") for k, f in (("a", F.min_by), ("b", F.max_by))}
        used = used.withColumns({"n": F.count("*").over(own), **ends})
        used = used.withColumn("way", F.when(F.col("n") >= 2, geo.bearing("lat_a", "lon_a", "lat_b", "lon_b"))).drop("n", *ends)
    long_ = edges.where(F.size("geometry") >= 2).select("fid", "geometry")
    lines = long_.select("fid", "geometry", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("geometry") - 1), lambda i: F.struct(F.get("geometry", i - 1).alias("a"), F.get("geometry", i).alias("b")))).alias("piece", "p"))
    lines = lines.select("fid", "geometry", F.col("p.a.lon").alias("lon1"), F.col("p.a.lat").alias("lat1"), F.col("p.b.lon").alias("lon2"), F.col("p.b.lat").alias("lat2"))
    lines = widened(lines, F.least("lon1", "lon2"), F.greatest("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lat1", "lat2"), reach)
    met = met_in_leaves(used, lines, cell=cell, most=most).where(in_bounds("geometry"))
    met = met.withColumn("dist", geo.point_segment_distance("lat", "lon", "lat1", "lon1", "lat2", "lon2")).where(F.col("dist") < reach)
    if gap is not None:
        met = met.where(F.coalesce(geo.bearing_gap("way", geo.bearing("lat1", "lon1", "lat2", "lon2")) <= gap, F.lit(True)))
    return met.groupBy("devid", "fid").agg(F.min("dist").alias("dist"))


def nodes_near(points: DataFrame, nodes: DataFrame, threshold: float = 0.001, cell: float = CELL, most: int = LEAF_MOST) -> DataFrame:
    """devid, osmid, dist: nodes in a trajectory's bounds and nearer than ``threshold`` degrees to its line."""
    reach = threshold * DEGREE
    order = W.partitionBy("devid").orderBy("seq")
    lines = points.select("devid", "lon", "lat", F.lead("lon").over(order).alias("lon2"), F.lead("lat").over(order).alias("lat2"), F.lead("seq").over(order).alias("next")).where("next is not null").drop("next")
    lines = widened(lines, F.least("lon", "lon2"), F.greatest("lon", "lon2"), F.least("lat", "lat2"), F.greatest("lat", "lat2"), reach)
    spots = nodes.select("osmid", F.col("lon").alias("x"), F.col("lat").alias("y"))
    met = met_in_leaves(spots, lines, "x", "y", cell, most).withColumn("dist", geo.point_segment_distance("y", "x", "lat", "lon", "lat2", "lon2"))
    return met.where(F.col("dist") < reach).groupBy("devid", "osmid").agg(F.min("dist").alias("dist"))  # the bounds' buffer is wider than the reach


def spots_near(points: DataFrame, spots: DataFrame, metres: float, cell: float = CELL, most: int = LEAF_MOST) -> DataFrame:
    """devid, id, dist: spots (id, lon, lat) within ``metres``, that distance included, of a point of the trajectory."""
    around = widened(spots.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), F.col("x"), F.col("x"), F.col("y"), F.col("y"), metres)
    met = met_in_leaves(points.select("devid", "lon", "lat"), around, cell=cell, most=most).withColumn("dist", geo.haversine("y", "x", "lat", "lon"))
    return met.where(F.col("dist") <= metres).groupBy("devid", "id").agg(F.min("dist").alias("dist"))


def too_close(spots: DataFrame, points: DataFrame, metres: float = 30.0, most: int = LEAF_MOST) -> DataFrame:
    """``spots`` (id, lon, lat) with close: whether a point of any trajectory is nearer than ``metres``, so that a label there would hide it."""
    near = spots_near(points, spots, metres, most=most).where(F.col("dist") < metres).select("id").distinct().withColumn("close", F.lit(True))
    return spots.join(near, "id", "left").withColumn("close", F.coalesce("close", F.lit(False)))


def spots_in_view(view: DataFrame, spots: DataFrame, cell: float = 0.02, most: int = LEAF_MOST) -> DataFrame:
    """devid, id: spots inside each view (devid, min_lon, max_lon, min_lat, max_lat), edges included."""
    return met_in_leaves(spots.select("id", "lon", "lat"), box_of(view), cell=cell, most=most).select("devid", "id")


def lines_in_view(view: DataFrame, lines: DataFrame, cell: float = 0.02, most: int = LEAF_MOST) -> DataFrame:
    """devid, id: lines (id, geometry) with a vertex inside each view. A line is found at its first vertex inside and at no other, so
    pairs, which may be many more than points, are made once and never shuffled."""
    corners = lines.select("id", "geometry", F.posexplode("geometry").alias("k", "p"))
    corners = corners.select("id", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), F.slice("geometry", F.lit(1), F.col("k")).alias("before"))
    inside = lambda p: F.coalesce(p["lon"].between(F.col("x1"), F.col("x2")) & p["lat"].between(F.col("y1"), F.col("y2")), F.lit(False))
    return met_in_leaves(corners, box_of(view), cell=cell, most=most).where(~F.exists("before", inside)).select("devid", "id")


def box_of(view: DataFrame) -> DataFrame:
    return view.select("devid", F.col("min_lon").alias("x1"), F.col("max_lon").alias("x2"), F.col("min_lat").alias("y1"), F.col("max_lat").alias("y2"))


def connected(edges: DataFrame, strict: bool = True) -> DataFrame:
    """fid, next_fid, angle, turn: every edge with those that start where it ends."""
    a = edges.select("fid", F.col("v").alias("at"), F.col("geometry").alias("g1"))
    b = edges.select(F.col("fid").alias("next_fid"), F.col("u").alias("at"), F.col("geometry").alias("g2"))
    met = a.join(b, "at").withColumn("angle", geo.edge_turn_angle("g1", "g2"))
    return met.select("fid", "next_fid", "angle", geo.turn_type("angle", strict).alias("turn"), "g2")


def turn_plan(edges: DataFrame, strict: bool = True, length: float = 256.0, size: float = 40.0) -> DataFrame:
    """What a map of turns draws: per connected pair a line from the next edge's start, and an arrow head at its end."""
    rows = connected(edges, strict)
    start, toward = F.element_at("g2", 1), F.element_at("g2", 2)
    end_lon, end_lat = geo.extend_line(start["lon"], start["lat"], toward["lon"], toward["lat"], length)
    rows = rows.withColumns({"start_lon": start["lon"], "start_lat": start["lat"], "end_lon": end_lon, "end_lat": end_lat})
    rows = rows.withColumn("bearing", geo.bearing("start_lat", "start_lon", "end_lat", "end_lon"))
    return rows.withColumn("arrow", geo.arrow_points("end_lat", "end_lon", "bearing", size)).drop("g2")


def arrow_plan(edges: DataFrame, least: float = 30.0) -> DataFrame:
    """fid, piece, lon, lat, rotation: arrows along edges, on pieces of at least ``least`` metres, every other piece of longer lines."""
    rows = pieces(edges).join(edges.select("fid", F.size("geometry").alias("n")), "fid")
    fit = (geo.haversine("lat1", "lon1", "lat2", "lon2") >= least) & ((F.col("piece") % 2 == 0) | (F.col("n") <= 3))
    lon, lat = geo.midpoint("lon1", "lat1", "lon2", "lat2")
    return rows.where(fit).select("fid", "piece", lon.alias("lon"), lat.alias("lat"), ((geo.bearing("lat1", "lon1", "lat2", "lon2") + 270) % 360).alias("rotation"))
