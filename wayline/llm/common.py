"""Shared pieces of the text operators: shared-folder tables, the word class, bounded label samples."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MOST_CHARS = 1 << 27  # of a sample, on the driver
LEAST_EACH, LEAST_CHARS = 20, 200  # rows of a label and characters of a row that a sample has at least
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one of ours where it is unset (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="wayline-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: ends the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as it is; at a task's end its Python worker, which lives on, gives memory that is free back to the system."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return ran


def id_bucket(column: str, modulus: int) -> F.Column:
    """crc32 of the id's decimal text modulo ``modulus``; the folds of the held-out rows use it."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def label_sample(docs: DataFrame, label: str, per_label: int, max_chars: int = 20_000, labels: DataFrame | None = None) -> list:
    """A bounded sample of labelled rows for fitting: ``per_label`` rows (text, label) of each label value, or all it has.

    The label is a column of ``docs``, or of ``labels`` with one row per doc_id. Rows are chosen by a hash alone, in its
    order, so a rerun takes the same ones; only the texts of the chosen ones move. Of a text of over ``max_chars``
    characters a window of that many, at a place by hash, is taken. Every label is sampled by itself, however many
    there are. At most MOST_CHARS characters reach the driver: with very many labels each has fewer rows,
    LEAST_EACH at least, of shorter windows; over MOST_CHARS / (LEAST_EACH * LEAST_CHARS) labels are an error.
    """
    place = F.xxhash64("doc_id", "text")
    texts = docs.where(F.col("text").isNotNull())
    if labels is None:
        usable = texts.select("doc_id", place.alias("place"), F.col(label).alias("label"))
    else:
        usable = texts.select("doc_id", place.alias("place")).join(labels.select("doc_id", F.col(label).alias("label")), "doc_id")
    usable = usable.where(F.col("label").isNotNull())
    most = MOST_CHARS // (LEAST_EACH * LEAST_CHARS)
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} different values of {label}")
    if not counts:
        return []
    each = min(per_label, max(LEAST_EACH, MOST_CHARS // (len(counts) * max_chars)))
    chars = min(max_chars, MOST_CHARS // (len(counts) * each))
    wide = 1 << 30
    # a label's threshold lets twice the rows through and some more: enough but for a chance that is nil
    shares = docs.sparkSession.createDataFrame([(k, int(min(1.0, (2 * each + 20) / n) * wide)) for k, n in counts.items()], usable.select("label", F.lit(0).alias("share")).schema)
    picked = usable.join(F.broadcast(shares), "label").where(F.col("share") > F.pmod("place", F.lit(wide)))
    order = [F.pmod("place", F.lit(wide)), F.col("place"), F.col("doc_id")]
    chosen = picked.withColumn("turn", F.row_number().over(W.partitionBy("label").orderBy(*order))).where(F.col("turn") <= each)
    chosen = cut(chosen.groupBy("doc_id", "place", "label").agg(F.count("*").alias("times")), "chosen")  # at most each * labels rows
    start = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int") + 1
    met = texts.select("doc_id", "text", place.alias("place")).join(F.broadcast(chosen.select(F.col("doc_id").alias("id"), F.col("place").alias("at"), "label", "times")), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("place") == F.col("at")))
    rows = met.select("doc_id", "place", "label", "times", F.substr("text", start, F.lit(chars)).alias("text")).distinct().collect()
    rows.sort(key=lambda r: (r["place"] % wide, r["place"], r["doc_id"] or 0, r["text"]))
    return [(r["text"], r["label"]) for r in rows for _ in range(r["times"])]
