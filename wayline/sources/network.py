"""The sink of a numbered road network: ids in a declared order, no nested columns, all files or none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, MapType, StructType

from .features import opened
from .roads import numbered


def wkt(line: Column) -> Column:
    """LINESTRING text of an array of (lon, lat); a single point is a POINT, none NULL."""
    pairs = F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")
    return F.when(F.size(line) > 1, F.concat(F.lit("LINESTRING ("), pairs, F.lit(")"))).when(F.size(line) == 1, F.concat(F.lit("POINT ("), pairs, F.lit(")")))


def flat(rows: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Lines as WKT; other arrays, maps and structs as JSON text."""
    nested = [f.name for f in rows.schema if isinstance(f.dataType, ArrayType | MapType | StructType)]
    return rows.withColumns({c: wkt(F.col(c)) if c == geometry else F.to_json(c) for c in nested})


@dataclass
class Written(WriterCommitMessage):
    file: str


class NetworkFiles(DataSource):
    """Format ``whole_files``: Parquet files that appear together when all tasks have written theirs, or not at all."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NetworkWriter(self.options["path"], overwrite)


class NetworkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path.rstrip("/"), overwrite, f"{path.rstrip('/')}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = opened(self.staging)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        file = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.parquet"
        writer = None
        for batch in iterator:
            if writer is None:
                writer = pq.ParquetWriter(f"{folder}/{file}", batch.schema, filesystem=system)
            writer.write_batch(batch)
        if writer is None:
            return Written("")
        writer.close()
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = opened(self.staging)
        target = opened(self.path)[1]
        kept = {m.file for m in messages if m is not None and m.file}
        system.create_dir(folder, recursive=True)
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.base_name not in kept:  # of attempts that didn't count
                system.delete_file(info.path)
        if system.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                system.delete_dir(folder)
                raise FileExistsError(self.path)
            system.delete_dir(target)
        system.move(folder, target)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = opened(self.staging)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


def write_network(edges: DataFrame, path: str, bucket: Column, *order: str, name: str = "fid", overwrite: bool = True) -> None:
    """``edges`` with ``name`` = 0, 1, 2, ... in the order of (bucket, order), lines as WKT and other nested columns as JSON text.

    ``bucket`` must grow with ``order``; ids are given in two levels (``numbered``), so no task has all rows. Columns in ``order`` must tell
    rows apart for a rerun to number alike. A write that fails leaves nothing, and what was there before.
    """
    edges.sparkSession.dataSource.register(NetworkFiles)
    rows = numbered(edges.withColumn("\x00bucket", bucket), name, "\x00bucket", *order).drop("\x00bucket")
    flat(rows).write.format("whole_files").mode("overwrite" if overwrite else "append").option("path", path).save()
