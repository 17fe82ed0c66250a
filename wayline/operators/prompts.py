"""Texts and messages for a multimodal model: prompts per task, picture slots, interleaved messages, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayline.functions import parse

from .stats import kinematics, segment_distance
from .steps import TREND_LABELS, kth_last_road, last_direction, speed_trend

# fixed values: the wording that the model's system prompts refer to
OPENING = "**The trajectory is segmented based on approximate uniformity in traffic semantics. **\n"
COUNTED = "** Below are details for the %d segments of this trajectory, each with statistical information and corresponding visual data: **\n\n"
SEGMENT_HEAD = (
    "**Segment %d:**\n*   **Visuals:**\n    *   `image%d` (Shows segment path, POIs, signalized intersections)\n"
    "    *   `image%d` (Illustrates road class, lanes, network structure)\n*   **Segment Stats:**\n"
)
END_POINT = (
    "\n**Trajectory End-Point Information:**\n* **Visuals:**\n    * `last_trajectory_view` (A zoomed-in image of the last few points, marked with red dots, with the green line representing the trajectory)\n"
    "* **Stats:**\n    * Overall direction of the last five points: %s (Azimuth: %.2f°)\n    * Movement trend of the last ten points: %s\n    "
)
OVERALL = (
    "\n{0}---\n\n{1}**Overall Trajectory Visuals:**\n{1}* **Visuals:**\n{1}    * `poi_full_image` (Comprehensive view of the entire trajectory with POIs and signalized intersections)\n"
    "{1}    * `road_structure_full_image` (Detailed illustration of the full trajectory's road class, lanes, and network structure)\n{2}"
)
NEXT_ROAD = "Relevant trajectory information:\n- Last 5 points direction: %s (bearing: %.2f°)\n- Last 10 points speed trend: %s\n\n- Road segment ID for the last points: %d\n"


def stat(label: str, value: Column, unit: str = "") -> Column:
    """One line of a segment's statistics; nothing where the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"    *   **{label}: "), value.cast("string"), F.lit(f"{unit} **\n")), F.lit(""))


def plain(value: Column, digits: int) -> Column:
    """A number rounded to ``digits`` as text, never with an exponent: 12345678.5 and not 1.23456785E7."""
    return F.regexp_replace(F.round(value, digits).cast(f"decimal(38,{digits})").cast("string"), r"(\.\d+?)0+$", "$1")


def segment_texts(stats: DataFrame, *lines: Column) -> DataFrame:
    """devid, text: per trajectory the numbered segments with their statistics, in order."""
    n = (F.col("seg") + 1).cast("int")
    one = F.concat(F.format_string(SEGMENT_HEAD, n, 2 * n - 1, 2 * n), *lines, F.lit("\n"))
    each = stats.select("devid", "seg", one.alias("part")).groupBy("devid").agg(F.array_sort(F.collect_list(F.struct("seg", "part"))).alias("parts"))
    return each.select("devid", F.concat(F.lit(OPENING), F.format_string(COUNTED, F.size("parts")), F.array_join("parts.part", "")).alias("text"))


def segment_prompt(segmented: DataFrame) -> DataFrame:
    """The segments' distances, and the start time in the first."""
    starts = segmented.groupBy("devid", "seg").agg(F.min_by("t", "seq").alias("t"))
    stats = segment_distance(segmented).join(starts, ["devid", "seg"])
    start = F.when(F.col("seg") == 0, parse.stamp("t"))
    return segment_texts(stats, stat("Start Time", start), stat("Distance (meters)", plain(F.col("distance"), 4), " meters"))


def arrival_prompt(segmented: DataFrame) -> DataFrame:
    """Travel-time estimation: segments, end point, overall views. Trajectories with fewer than five points are left out."""
    points = segmented.drop("seg")
    ends = last_direction(points).join(speed_trend(points, labels=TREND_LABELS["tte"]), "devid")
    end = F.format_string(END_POINT, "direction", F.round("bearing", 2), "trend")
    return segment_prompt(segmented).join(ends, "devid").select("devid", F.concat("text", end, F.lit(OVERALL.format("    ", "", "    "))).alias("text"))


def mode_prompt(segmented: DataFrame, digits: int | None = None) -> DataFrame:
    """Transport mode: all kinematics of each segment, in full precision unless ``digits`` says otherwise."""
    shown = lambda c: F.col(c) if digits is None else plain(F.col(c), digits)
    lines = [("Start Time", parse.stamp("start_t")), ("End Time", parse.stamp("end_t")), ("Duration (minutes)", F.col("minutes")), ("Total Distance (meters)", shown("total_distance"))]
    lines += [("Average Speed (m/s)", shown("avg_speed")), ("Maximum Speed (m/s)", shown("max_speed")), ("Minimum Speed (m/s)", shown("min_speed")), ("Maximum Acceleration (m/s²)", shown("max_acceleration"))]
    made = segment_texts(kinematics(segmented), *[stat(label, value) for label, value in lines])
    return made.select("devid", F.concat("text", F.lit(OVERALL.format(" " * 12, " " * 8, " " * 8))).alias("text"))


def next_road_prompt(points: DataFrame, holdout: int = 0) -> DataFrame:
    """Next road: direction, trend and the fifth last road. The label's own points are among the last five unless ``holdout`` drops that many."""
    if holdout:
        from pyspark.sql import Window as W

        back = F.row_number().over(W.partitionBy("devid").orderBy(F.desc("seq")))
        points = points.withColumn("back", back).where(F.col("back") > holdout).drop("back")
    rows = last_direction(points).join(speed_trend(points), "devid").join(kth_last_road(points), "devid")
    return rows.select("devid", F.format_string(NEXT_ROAD, "direction", F.round("bearing", 2), "trend", "road_k").alias("text"))


def image_slots(files: DataFrame) -> DataFrame:
    """devid, slot, filename, description: what each placeholder of a prompt stands for.

    The first ten files by name fill image1 to image10, odd ones as maps of places, even ones of roads. The first file of
    each kind by name fills its own slot.
    """
    names = files.groupBy("devid").agg(F.array_sort(F.collect_set("filename")).alias("names"))
    numbered = names.select("devid", F.posexplode(F.slice("names", 1, 10)).alias("k", "filename"))
    kind = F.when(F.col("k") % 2 == 0, "POI & Route Detail Map").otherwise("Road Network Map")
    numbered = numbered.select("devid", F.format_string("image%d", F.col("k") + 1).alias("slot"), "filename", F.format_string("**Segment %d %s:**", F.floor(F.col("k") / 2).cast("int") + 1, kind).alias("description"))
    special = (("last_trajectory", "last_trajectory_view", "End-Point Trajectory View"), ("poi_", "poi_full_image", "Global POI & Route Detail Map"), ("road_structure_", "road_structure_full_image", "Global Road Network Map"))

    def first_named(prefix: str) -> Column:
        return F.try_element_at(F.filter("names", lambda n: n.startswith(prefix)), F.lit(1))

    firsts = F.array(*[F.struct(F.lit(slot).alias("slot"), first_named(prefix).alias("filename"), F.lit(f"**{text}:**").alias("description")) for prefix, slot, text in special])
    one = names.select("devid", F.explode(firsts).alias("s")).select("devid", "s.*").where("filename is not null")
    return numbered.unionByName(one)


PARTS = "array<struct<type:string,content:string,slot:string>>"


def part(kind: str, content: Column, slot: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), content.alias("content"), (F.lit(None).cast("string") if slot is None else slot).alias("slot"))


def interleaved(text: Column, slots: Column) -> Column:
    """The parts (type, content, slot) of a message: text runs joined, each placeholder in ``slots`` (a map to description and
    picture) replaced by its description and picture. Unknown ones stay, as parts of their own."""
    pairs = F.arrays_zip(F.split(text, "`[^`]+`").alias("words"), F.regexp_extract_all(text, F.lit("`[^`]+`"), F.lit(0)).alias("mark"))
    given = F.flatten(F.transform(pairs, lambda z: F.array(F.struct(F.lit(False).alias("mark"), z["words"].alias("s")), F.struct(F.lit(True).alias("mark"), z["mark"].alias("s")))))

    def add(parts: Column, piece: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-1))
        after_text = F.coalesce(last["type"] == "text", F.lit(False))
        push = lambda *more: F.concat(parts, F.array(*more))
        joined = lambda words, *more: F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(part("text", F.concat(last["content"], words)), *more))
        name = F.substring(piece["s"], F.lit(2), F.length(piece["s"]) - 2)
        known = F.try_element_at(slots, name)
        picture = F.when(known["picture"].isNotNull(), part("image_url", known["picture"], name)).otherwise(part("text", piece["s"]))
        words = F.when(~piece["s"].rlike(r"[^\s]"), parts).when(after_text, joined(piece["s"])).otherwise(push(part("text", piece["s"])))
        said = known["description"]
        mark = F.when(known.isNull(), push(part("text", piece["s"]))).when(after_text, joined(F.concat(F.lit(" "), said, F.lit(" ")), picture)).otherwise(push(part("text", F.concat(said, F.lit(" "))), picture))
        return F.when(piece["mark"], mark).otherwise(words)

    return F.aggregate(F.filter(given, lambda z: z["s"].isNotNull()), F.array().cast(PARTS), add)


def messages(prompts: DataFrame, slots: DataFrame) -> DataFrame:
    """devid, pos, type, content, slot: the message of each prompt (devid, text), with pictures (devid, slot, description, picture) in
    their places. Of a slot that is given more than once, the greatest picture counts; slot is null in text parts."""
    one = slots.groupBy("devid", "slot").agg(F.max(F.struct("picture", "description")).alias("s"))
    each = one.groupBy("devid").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(F.coalesce("s.description", F.lit("")).alias("description"), F.col("s.picture").alias("picture"))))).alias("slots"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<description:string,picture:string>>"))
    rows = prompts.select("devid", "text").join(each, "devid", "left")
    made = rows.select("devid", F.posexplode(interleaved(F.coalesce("text", F.lit("")), F.coalesce("slots", none))).alias("pos", "p"))
    return made.select("devid", F.col("pos").cast("bigint").alias("pos"), "p.type", "p.content", "p.slot")


END_VIEW = "last_trajectory_"


def gallery(prompts: DataFrame, pictures: DataFrame, end_views: bool) -> DataFrame:
    """devid, pos, type, content: the text of each prompt (devid, text), then its pictures (devid, filename, picture) by name.

    With ``end_views`` only the views of the end point go with it (next road), else all but those (anomalies).
    """
    wanted = F.col("filename").startswith(END_VIEW)
    chosen = pictures.where(wanted if end_views else ~wanted).join(prompts.select("devid").distinct(), "devid", "left_semi")
    place = F.row_number().over(W.partitionBy("devid").orderBy("filename", "picture")).cast("bigint")
    text = prompts.select("devid", F.lit(0).cast("bigint").alias("pos"), F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("content"))
    return text.unionByName(chosen.select("devid", place.alias("pos"), F.lit("image_url").alias("type"), F.col("picture").alias("content")))
