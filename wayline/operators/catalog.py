"""The catalog of results: which trajectories, tasks, pictures, prompts and outputs there are."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import parse

ROAD_TASKS, ANOMALY = ["TTE", "Anomaly Detection", "Mobility Prediction"], ["Anomaly Detection"]
ANOMALY_PATH, ARRIVAL_PATH = "Anomaly Detection/consolidated_data", "TTE/consolidated_data"
# fixed values: (dataset, source path, folder prefix, priority, tasks)
SOURCES = [
    ("Chengdu", ARRIVAL_PATH, "consolidated_", 1, ROAD_TASKS), ("Chengdu", ANOMALY_PATH, "consolidated_anomaly_", 2, ANOMALY),
    ("Porto", ARRIVAL_PATH, "consolidated_", 1, ROAD_TASKS), ("Porto", ANOMALY_PATH, "consolidated_anomaly_", 2, ANOMALY),
    ("Xian", ARRIVAL_PATH, "consolidated_", 1, ROAD_TASKS), ("Xian", ANOMALY_PATH, "consolidated_anomaly_", 2, ANOMALY),
    ("Beijing", "", "", 1, ["TMI"]),
]
# fixed values: (task, user prompt file, output file)
TASKS = [
    ("TTE", "dynamically_generated_stats_prompt.txt", "o4-mini.txt"), ("Anomaly Detection", None, "ad-o4-mini.txt"),
    ("Mobility Prediction", "dynamically_generated_stats_prompt_MP.txt", "mp-o4-mini.txt"), ("TMI", None, "o4-mini-v1.txt"),
]


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "dataset string, source_path string, prefix string, priority int, tasks array<string>")


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, "task string, prompt_file string, output_file string")


def datasets(spark: SparkSession) -> DataFrame:
    """Names in the order of the configuration."""
    names = list(dict.fromkeys(s[0] for s in SOURCES))
    return spark.createDataFrame(list(enumerate(names)), "place int, dataset string")


def trajectories(folders: DataFrame, spark: SparkSession) -> DataFrame:
    """dataset, id, full_name, source_path, tasks, priority of result folders (dataset, source_path, folder) that their source's prefix names."""
    rows = folders.join(F.broadcast(sources(spark)), ["dataset", "source_path"])
    named = rows.where(F.col("folder").startswith(F.col("prefix")) & ~F.col("folder").startswith("."))
    return named.select("dataset", F.substring("folder", F.length("prefix") + 1, F.lit(1 << 20)).alias("id"), F.col("folder").alias("full_name"), "source_path", "tasks", "priority")


def lookup(listed: DataFrame, asked: DataFrame, with_task: bool) -> DataFrame:
    """The source of each asked (dataset, id[, task]): the first by priority that has the folder and, if asked, supports the task."""
    met = asked.join(listed, ["dataset", "id"])
    if with_task:
        met = met.where(F.array_contains("tasks", F.col("task")))
    keys = ["dataset", "id"] + ["task"] * with_task
    return met.groupBy(*keys).agg(F.min_by(F.struct("full_name", "source_path", "tasks"), "priority").alias("s")).select(*keys, "s.*")


def images(files: DataFrame) -> DataFrame:
    """dataset, id, filename, context, role, number, label of the picture files (dataset, id, filename) of a trajectory.

    Pictures of an unknown name are left out. Beijing's names carry no id, and it has no end views.
    """
    own = F.when(F.col("dataset") == "Beijing", "").otherwise(F.concat(F.lit("_"), "id"))
    stem = F.regexp_extract("filename", r"^(.*)\.png$", 1)
    kind = F.when(F.endswith(stem, F.lit("poi")), "poi").when(F.endswith(stem, F.lit("road_structure")), "road_structure")
    segment = F.when(stem == F.concat(F.regexp_extract(stem, r"^(\d+)_segment", 1), F.lit("_segment"), own, F.lit("_"), kind), F.regexp_extract(stem, r"^(\d+)_segment", 1).try_cast("int"))
    last = F.when((F.col("dataset") != "Beijing") & F.startswith(stem, F.concat(F.lit("last_trajectory"), own, F.lit("_"))), F.regexp_extract(stem, r"_(\d+)$", 1).try_cast("int"))
    whole = F.when(stem == F.concat(F.lit("poi"), own), "poi").when(stem == F.concat(F.lit("road_structure"), own), "road_structure")
    role = F.when(segment.isNotNull(), "segment").when(last.isNotNull(), "last_trajectory").when(whole.isNotNull(), "global")
    size = F.when(last <= 17, "small").when(last <= 18, "medium").otherwise("large")
    label = F.when(role == "segment", F.concat(F.lit("segment "), segment)).when(role == "last_trajectory", F.concat(F.lit("last trajectory "), size))
    context = F.when(F.coalesce(F.when(role == "segment", kind), whole) == "poi", "POI").otherwise("Road network")
    return files.select("dataset", "id", "filename", context.alias("context"), role.alias("role"), F.coalesce(segment, last).alias("number"), label.alias("label")).where("role is not null")


def outputs(found: DataFrame, texts: DataFrame, spark: SparkSession) -> DataFrame:
    """dataset, id, task, output: the text of each found trajectory's output file, or a notice that it isn't there."""
    wanted = found.join(F.broadcast(tasks(spark)), "task").select("dataset", "id", "task", "full_name", F.col("output_file").alias("filename"))
    named = wanted.join(texts.select("dataset", F.col("folder").alias("full_name"), "filename", "text"), ["dataset", "full_name", "filename"], "left")
    return named.select("dataset", "id", "task", F.coalesce("text", F.lit("Output file not found")).alias("output"))


def prompts(found: DataFrame, texts: DataFrame, system: DataFrame, spark: SparkSession) -> DataFrame:
    """dataset, id, task, system_prompt, user_prompt; NULL where a task or dataset has none."""
    wanted = found.join(F.broadcast(tasks(spark)), "task").select("dataset", "id", "task", "full_name", F.col("prompt_file").alias("filename"))
    user = texts.select("dataset", F.col("folder").alias("full_name"), "filename", F.col("text").alias("user_prompt"))
    return wanted.join(user, ["dataset", "full_name", "filename"], "left").join(F.broadcast(system), ["dataset", "task"], "left").select("dataset", "id", "task", "system_prompt", "user_prompt")


def read_system_prompts(path: str | None = None) -> list[dict]:
    """The versions of the system prompts: task, datasets, version, text, placeholders (picture slots that the task's messages have), answer (an example)."""
    with open(path or os.path.join(os.path.dirname(__file__), "system_prompts.json"), encoding="utf-8") as f:
        return json.load(f)


def system_prompts(spark: SparkSession, version: int | None = None, given: list[dict] | None = None) -> DataFrame:
    """dataset, task, version, system_prompt: the latest text of each, or the latest up to ``version``."""
    rows = [(d, p["task"], p["version"], p["text"]) for p in given or read_system_prompts() for d in p["datasets"] if version is None or p["version"] <= version]
    all_ = spark.createDataFrame(rows, "dataset string, task string, version int, system_prompt string")
    return all_.groupBy("dataset", "task").agg(F.max_by(F.struct("version", "system_prompt"), "version").alias("p")).select("dataset", "task", "p.*")


def artifact_type(name: Column) -> Column:
    """The first kind that a file name contains."""
    return F.when(name.contains("poi"), "poi").when(name.contains("road_structure"), "road_structure").when(name.contains("last_trajectory"), "last_trajectory").otherwise("other")


def renamed(files: DataFrame) -> DataFrame:
    """devid, target: the consolidated name of rendered files (kind, filename); others and hidden ones are left out.

    {id}_segment_{n}.png becomes {n}_segment_{id}_{kind}.png, {id}.png becomes {kind}_{id}.png and
    trajectory_{id}_{n}.png of the end views becomes last_trajectory_{id}_{n}.png.
    """
    part = lambda pattern, g: parse.found("filename", pattern, g)
    segment, last, single = r"^(.+)_segment_(\d+)\.png$", r"^trajectory_(.+)_(\d+)\.png$", r"^([^_].*)\.png$"
    is_last = F.col("kind") == "last_trajectory"
    devid = F.when(is_last, part(last, 1)).otherwise(F.coalesce(part(segment, 1), part(single, 1)))
    target = F.when(is_last, F.concat(F.lit("last_trajectory_"), devid, F.lit("_"), part(last, 2), F.lit(".png"))).when(part(segment, 1).isNotNull(), F.concat(part(segment, 2), F.lit("_segment_"), devid, F.lit("_"), "kind", F.lit(".png"))).otherwise(F.concat("kind", F.lit("_"), devid, F.lit(".png")))
    return files.where(~F.col("filename").startswith(".")).select(devid.alias("devid"), target.alias("target")).where("target is not null")


def manifest(files: DataFrame) -> DataFrame:
    """devid, files: consolidated names in text order, so that 10_ comes before 1_."""
    return renamed(files).groupBy("devid").agg(F.array_sort(F.collect_set("target")).alias("files"))


def zoom_variants(pages: DataFrame, zooms: tuple[int, ...] = (17, 18, 20)) -> DataFrame:
    """filename, zoom, html: a copy of each map page (devid, html) per zoom level; pages without a level are left out."""
    rows = pages.where(F.col("html").contains('"zoom":')).withColumn("zoom", F.explode(F.array(*map(F.lit, zooms))))
    html = F.regexp_replace("html", F.lit(r'"zoom"\s*:\s*[^,]+,'), F.format_string('"zoom": %d,', "zoom"))
    return rows.select("devid", F.format_string("trajectory_%s_%d.html", F.col("devid").cast("string"), F.col("zoom")).alias("filename"), "zoom", html.alias("html"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def clip_rectangle(left: Column, top: Column, right: Column, bottom: Column, padding: int = 200, most: int = 2000) -> Column:
    """Part of a rendered page to take: x, y, width, height in pixels."""
    size = lambda a, b: F.least(F.lit(most), b - a + 2 * padding)
    return F.struct(F.greatest(F.lit(0), left - padding).alias("x"), F.greatest(F.lit(0), top - padding).alias("y"), size(left, right).alias("width"), size(top, bottom).alias("height"))
