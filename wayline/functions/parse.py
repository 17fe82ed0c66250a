"""Text of model answers, file names and raw trajectory fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import Value, col

# fixed values: how timestamps are written
STAMP = "yyyy-MM-dd HH:mm:ss"
STAMP_PATTERN = r"[\d-]+ [\d:]+"


def found(text: Value, pattern: str, group: int = 1) -> Column:
    """The first match's group, NULL where there is none."""
    text = col(text)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def eta(text: Value) -> Column:
    """Arrival timestamp: the last in triple angle brackets; only where no triple one is written, the last in double ones. NULL if that isn't a date."""
    every = lambda pattern: F.regexp_extract_all(col(text), F.lit(pattern), F.lit(1))
    triple, double = every(rf"<<<({STAMP_PATTERN})>>>"), every(rf"<<({STAMP_PATTERN})>>")
    last = F.when(F.size(triple) > 0, F.try_element_at(triple, F.lit(-1))).otherwise(F.try_element_at(double, F.lit(-1)))
    return F.try_to_timestamp(last, F.lit("y-M-d H:m:s"))


# fixed values: how answers write what they predict
def top1(text: Value) -> Column:
    """Predicted road id as text."""
    return F.coalesce(F.trim(found(text, r"<<<([^>]+?)>>>")), found(text, r"Top-1 prediction:\s*(\d+)"))


def top5(text: Value) -> Column:
    """Predicted road ids as an array of text, NULL where none are given."""
    inner = F.coalesce(found(text, r"\[\[\[([^\]]+)\]\]\]"), found(text, r"Top-5 candidates:\s*\[+([^\]]*)\]"))
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")


def judgment(text: Value) -> Column:
    """normal or abnormal, as first judged."""
    return F.lower(found(text, r"(?i)(?:\*\*)?Final\s+Judgment:(?:\*\*)?\s*(Normal|Abnormal)"))


def mode(text: Value) -> Column:
    """The transport mode as written between the first triple brackets, blanks kept."""
    return found(text, r"<<<(.+?)>>>")


def folder_label(folder: Value) -> Column:
    return F.when(col(folder).contains("consolidated_normal"), "normal").when(col(folder).contains("consolidated_anomaly"), "abnormal")


def folder_mode(folder: Value) -> Column:
    return F.try_element_at(F.split(col(folder), "_"), F.lit(2))


def folder_id(folder: Value, prefix: str = "consolidated_") -> Column:
    return F.when(col(folder).startswith(prefix), F.substring(col(folder), len(prefix) + 1, 1 << 20)).otherwise(col(folder))


def segment_file_id(name: Value) -> Column:
    """Trajectory id of a segment picture's file name; NULL for other and for hidden files."""
    return found(name, r"^([^._][^/\\:*?\"<>|]*)_segment_\d+\.png$")


def id_list(text: Value) -> Column:
    return F.transform(F.split(col(text), ","), lambda x: F.trim(x).try_cast("bigint"))


def float_list(text: Value) -> Column:
    return F.transform(F.split(col(text), ","), lambda x: F.trim(x).try_cast("double"))


def nested_id_list(text: Value) -> Column:
    return F.transform(F.split(col(text), "\\|"), lambda part: F.transform(F.split(part, ","), lambda x: F.trim(x).try_cast("bigint")))


def wkt_linestring(text: Value) -> Column:
    """Array of (lon, lat) of a LINESTRING; NULL for other text."""
    pair = lambda p: F.split(F.trim(p), r"\s+")
    point = lambda p: F.struct(F.get(pair(p), F.lit(0)).try_cast("double").alias("lon"), F.get(pair(p), F.lit(1)).try_cast("double").alias("lat"))
    return F.transform(F.split(found(text, r"(?i)^\s*LINESTRING\s*\(([^)]*)\)"), ","), point)


def local_time(epoch: Value, zone: str = "Asia/Shanghai") -> Column:
    """Epoch seconds as a timestamp of local clock time (the session's zone is UTC)."""
    return F.from_utc_timestamp(F.timestamp_seconds(col(epoch)), zone)


def stamp(epoch: Value, zone: str = "Asia/Shanghai") -> Column:
    return F.date_format(local_time(epoch, zone), STAMP)


def clock(epoch: Value, with_date: bool = False, zone: str = "Asia/Shanghai") -> Column:
    """HH:MM:SS, or with year, month, day and weekday in front."""
    return F.date_format(local_time(epoch, zone), "yyyy-MM-dd EEEE HH:mm:ss" if with_date else "HH:mm:ss")


def duration(seconds: Value) -> Column:
    """1h2m3s, 2m3s or 3s; fractions are cut off."""
    whole = col(seconds).cast("bigint")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    text = lambda n, unit: F.concat(n.cast("bigint").cast("string"), F.lit(unit))
    return F.when(h > 0, F.concat(text(h, "h"), text(m, "m"), text(s, "s"))).when(m > 0, F.concat(text(m, "m"), text(s, "s"))).otherwise(text(s, "s"))


def seconds_between(a: Value, b: Value) -> Column:
    """Absolute difference of two timestamps."""
    return F.abs(F.unix_timestamp(col(a)) - F.unix_timestamp(col(b))).cast("bigint")


def data_uri(content: Value) -> Column:
    """PNG bytes as a data URI; the encoder's line breaks are taken out."""
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(col(content)), "[\\r\\n]", ""))
