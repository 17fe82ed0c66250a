"""Road networks: nodes, edges, attributes and traffic lights as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .features import read_features, read_lights  # noqa: F401  the files of a network

CELL = 1000000.0 / 1000  # grid cells a degree of the event trajectories' road ids


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last by ``order``, by a pre-aggregated maximum and no window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def load_network(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from Parquet; of repeated (u, v) the edge with the largest fid counts, a missing length is 0."""
    e = spark.read.parquet(edges).withColumn("length", F.coalesce("length", F.lit(0.0)))
    return spark.read.parquet(nodes), latest(e, ["u", "v"], "fid")


def attributes(lines: DataFrame) -> DataFrame:
    """geo_id, value from the first and last field of text rows; rows that aren't numbers are left out. Of repeated ids the last line counts."""
    good = lines.select("line", F.try_element_at("fields", F.lit(1)).try_cast("bigint").alias("geo_id"), F.try_element_at("fields", F.lit(-1)).try_cast("int").alias("value"))
    return latest(good.where("geo_id is not null and value is not null"), ["geo_id"], "line").select("geo_id", "value")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """attributes() of a CSV-like file with a header row, order kept by position in the file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return attributes(text.select("line", F.split("value", ",").alias("fields")))


def numbered(rows: DataFrame, name: str, bucket: str, *order: str) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of (bucket, order): counts per bucket are summed first, so no task has all rows."""
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    base = counts.select(bucket, (F.sum("n").over(W.orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("base"))
    within = F.row_number().over(W.partitionBy(bucket).orderBy(*order)) - 1
    return rows.withColumn("within", within).join(base, bucket).withColumn(name, F.col("base") + F.col("within")).drop("base", "within")


def cell_centre(cell: F.Column) -> F.Column:
    """(lon, lat) of the centre of a grid cell that serves as a road id."""
    lon, lat = F.floor(cell / 100000).cast("double"), (cell % 100000).cast("double")
    return F.struct(((lon + 0.5) / CELL).alias("lon"), ((lat + 0.5) / CELL).alias("lat"))


def edges_of(points: DataFrame) -> DataFrame:
    """edges(fid, u, v, geometry) from the cell changes of trajectories; fid counts in the order of (u, v)."""
    order = W.partitionBy("devid").orderBy("seq")
    pairs = points.select(F.col("road_id").alias("u"), F.lead("road_id").over(order).alias("v")).where("u <> v").distinct()
    named = numbered(pairs.withColumn("column", F.floor(F.col("u") / 100000)), "fid", "column", "u", "v")
    return named.select("fid", "u", "v", F.array(cell_centre(F.col("u")), cell_centre(F.col("v"))).alias("geometry"))


def nodes_of(points: DataFrame) -> DataFrame:
    """nodes(osmid, lon, lat): the visited cells' centres."""
    return points.select(F.col("road_id").alias("osmid")).distinct().select("osmid", cell_centre(F.col("osmid")).alias("c")).select("osmid", "c.lon", "c.lat")


def lights_of(points: DataFrame, every: int = 17) -> DataFrame:
    """lights(id, lon, lat): the centres of the cells whose id is divisible by ``every``."""
    return nodes_of(points).where(F.col("osmid") % every == 0).withColumnRenamed("osmid", "id")
