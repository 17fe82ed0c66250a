"""One large JSON file of many records (map features, map elements) read by several tasks: a Python data source.

A file is cut into byte ranges. A task looks for the first record that begins in its range and goes on from record to record
until one begins behind it; the last may end there. A record is an object of an array, so a comma or bracket stands before it, and it has the
keys asked for. Inside a text no such begin can be seen: its quotes are escaped; what looks like one at a text's end doesn't make an
object with those keys. Records hold no records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

PART_BYTES = 32 << 20
CHUNK = 1 << 20
BEGIN = re.compile(rb'[\[,]\s*(\{)\s*["}]')
MARKS = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}]', re.S)
AFTER = re.compile(rb"\s*([,\]])")
BOX = ("min_lon", "max_lon", "min_lat", "max_lat")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


def opened(path: str) -> tuple:
    """The file system and its own path of a plain path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path, re.I) else (fs.LocalFileSystem(), path)


def files_at(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder."""
    from pyarrow import fs

    system, own = opened(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info] if info.is_file else [i for i in system.get_file_info(fs.FileSelector(own)) if i.is_file and i.base_name[0] not in "._"]
    head = path[: len(path) - len(own)] if path.endswith(own) else ""
    return sorted((head + i.path, i.size) for i in infos)


def object_end(data: bytes, start: int) -> int | None:
    """Where the object that begins there ends, or None if the data end before."""
    depth = 0
    for m in MARKS.finditer(data, start):
        mark = m[0]
        if mark == b"{":
            depth += 1
        elif mark == b"}":
            depth -= 1
            if not depth:
                return m.end()
    return None


def box_of(found: dict) -> tuple[float, float, float, float] | None:
    """Least and greatest longitude and latitude of a feature's coordinates or of an element's own."""
    if "lon" in found and "lat" in found:
        return found["lon"], found["lon"], found["lat"], found["lat"]
    low, high, left = [float("inf")] * 2, [float("-inf")] * 2, [found.get("geometry") or {}]
    while left:
        x = left.pop()
        if isinstance(x, dict):
            left += [x.get("coordinates") or []] + (x.get("geometries") or [])
        elif x and isinstance(x[0], list | dict):
            left += x
        elif len(x) > 1:
            low, high = [min(low[k], x[k]) for k in (0, 1)], [max(high[k], x[k]) for k in (0, 1)]
    return (low[0], high[0], low[1], high[1]) if low[0] <= high[0] else None


def records(path: str, start: int, stop: int, keys: set[str]) -> Iterator[tuple[int, bytes, dict]]:
    """(offset, bytes, object) of the records whose comma or bracket before them lies in [start, stop)."""
    system, own = opened(path)
    with system.open_input_file(own) as f:
        f.seek(start)
        data, base, more = b"", start, True

        def grow() -> None:
            nonlocal data, more
            got = f.read(max(CHUNK, len(data)))
            more = len(got) > 0
            data += got

        at, in_array = 0, False
        while True:
            m = (re.compile(rb'[\[,]\s*(\{)').match if in_array else BEGIN.search)(data, at)
            if m is None or m.end() + 1 >= len(data) and more:
                if in_array and m is None and re.match(rb"[\[,]\s*\S", data[at : at + 4096]):
                    in_array = False  # something else than an object stands here
                    continue
                if not more or not in_array and base + len(data) > stop + CHUNK:
                    return
                if not in_array and m is None:
                    at = max(at, len(data) - (1 << 16))
                grow()
                continue
            if base + m.start() >= stop:
                return
            end = object_end(data, m.start(1))
            follows = AFTER.match(data, end) if end is not None else None
            if follows is None and more:
                grow()
                continue
            found = None
            if end is not None and follows is not None:
                try:
                    found = json.loads(data[m.start(1) : end])
                except ValueError:
                    found = None
            if found is not None and keys <= found.keys():
                yield base + m.start(1), data[m.start(1) : end], found
                if follows[1] == b"]":
                    at, in_array = follows.end(), False
                else:
                    at, in_array = follows.start(1), True
            else:
                at, in_array = m.start(1), False
            if at > CHUNK:
                data, base, at = data[at:], base + at, 0


class Records(DataSource):
    """Format ``json_records``: path, start, json, min_lon, max_lon, min_lat, max_lat of every record of the files at ``path``.

    Options: ``keys`` (comma-separated, what makes a record), ``part_bytes``. Comparisons of the box columns with numbers are taken over, so
    that other records aren't sent to Spark at all (spark.sql.python.filterPushdown.enabled).
    """

    @classmethod
    def name(cls) -> str:
        return "json_records"

    def schema(self) -> str:
        return "path string, start bigint, json string, " + ", ".join(f"{c} double" for c in BOX)

    def reader(self, schema: object) -> DataSourceReader:
        return RecordsReader(self.options)


class RecordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("part_bytes", PART_BYTES))
        self.keys = set(options.get("keys", "type,geometry").split(","))
        self.tests: list[tuple[int, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1 and f.attribute[0] in BOX:
                self.tests.append((BOX.index(f.attribute[0]), kinds[type(f)], float(f.value)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [Range(path, at, min(at + self.size, size)) for path, size in files_at(self.path) for at in range(0, size, self.size)]

    def passes(self, box: tuple | None) -> bool:
        tests = {"gt": float.__gt__, "ge": float.__ge__, "lt": float.__lt__, "le": float.__le__}
        return box is not None and all(tests[how](float(box[k]), value) for k, how, value in self.tests)

    def read(self, part: Range) -> Iterator[tuple]:
        for start, raw, found in records(part.path, part.start, part.stop, self.keys):
            box = box_of(found)
            if not self.tests or self.passes(box):
                yield (part.path, start, raw.decode(), *map(float, box)) if box else (part.path, start, raw.decode(), None, None, None, None)


def read_records(spark: SparkSession, path: str, keys: str, part_bytes: int = PART_BYTES) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Records)
    return spark.read.format("json_records").option("keys", keys).option("part_bytes", part_bytes).load(path)


def read_features(spark: SparkSession, path: str, part_bytes: int = PART_BYTES, boxes: bool = False) -> DataFrame:
    """properties, type, coordinates of GeoJSON features, with ``boxes`` also their box; properties as a map to text, coordinates as JSON text.
    Several tasks read one file."""
    kind = "properties map<string, string>, geometry struct<type: string, coordinates: string>"
    raw = read_records(spark, path, "geometry", part_bytes)  # not every writer gives a feature its type
    return raw.select(F.from_json("json", kind).alias("f"), *BOX).select("f.properties", "f.geometry.type", "f.geometry.coordinates", *(BOX if boxes else ()))


def read_lights(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """lights(id, lon, lat) from the elements of a map query's answer, each an object with lat and lon. Several tasks read one file."""
    raw = read_records(spark, path, "lat,lon", part_bytes)
    return raw.select(F.from_json("json", "id bigint, lat double, lon double").alias("e")).select("e.id", "e.lon", "e.lat")
