"""Files and folders as DataFrames, and the sinks of segments, prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, folder, filename, bytes of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("filename"), F.col("length").alias("bytes"))


def texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """folder, filename, text: whole text files below a folder."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True, recursiveFileLookup=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("filename"), F.col("value").alias("text"))


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path, filename, content of pictures."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def write_segments(segments: DataFrame, path: str) -> None:
    """Nested segments as JSON lines, in a folder per first two digits of the id's hash."""
    shaped = segments.select(F.concat_ws("_", "devid", F.lit("segment"), "seg").alias("id"), "*", F.pmod(F.xxhash64("devid"), F.lit(256)).alias("bucket"))
    shaped.write.mode("overwrite").partitionBy("bucket").json(path)


def in_sources(files: DataFrame, root: str) -> DataFrame:
    """``files`` (with path) below ``root``/dataset/source path/folder, with dataset and source_path, as the catalog takes them."""
    inner = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    middle = F.array_join(F.slice(inner, 2, F.greatest(F.size(inner) - 3, F.lit(0))), "/")
    return files.where(F.size(inner) >= 3).withColumns({"dataset": inner[0], "source_path": middle})


def write_truth(rows: DataFrame, path: str) -> None:
    """Ground truth (devid, arrival) as Parquet, the arrival as text in the form of the answers."""
    rows.select("devid", F.date_format("arrival", "yyyy-MM-dd HH:mm:ss").alias("arrival")).write.mode("overwrite").parquet(path)


def write_texts(rows: DataFrame, path: str) -> None:
    """Prompts or answers (devid, task, text) as Parquet by task."""
    rows.write.mode("overwrite").partitionBy("task").parquet(path)
