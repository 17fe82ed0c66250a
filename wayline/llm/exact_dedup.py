"""Exact dedup with a two-pass Bloom filter, in DataFrame functions only.

Pass 1 counts, per Bloom slot, how many rows fall there; slots with two or more are packed into bitmaps.
Pass 2 tests every row against the bitmaps: a text that occurs twice finds all its slots set, so a row with
a clear slot is unique and passes straight through. Only the rest is shuffled, by its full SHA-256.

The filter has 16 bits a row whatever the number of rows: the digests are written in ranges of their hash, of
``RANGE_ROWS`` rows or so, and each range has a filter of its own, so none that is broadcast is over 4 * RANGE_ROWS bytes.
What pass 1 moves are slot numbers (two a row, 8 bytes each, counted map-side first), no rows. Bitmaps built map-side would be
more: a partition's rows are spread over all of a filter, so each partition would send all of its pages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

BITMAP_BITS = 8 * 4096  # of Spark's bitmap_construct_agg
RANGE_ROWS = 1 << 25  # 64 MB of bitmaps
BITS_EACH = 16
HASHES = 2
HOT_PARTS = 4096  # a text with over 1 / HOT_PARTS of all rows is hot; there are fewer than HOT_PARTS of these


def sha256() -> F.Column:
    """Lowercase hex of the text; null counts as the empty text."""
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def digits(sha: str, first: int, n: int) -> F.Column:
    return F.conv(F.substring(sha, first, n), 16, 10).cast("long")


def slot(k: int, slots: int, sha: str = "text_sha256") -> F.Column:
    """The k-th Bloom slot of a row, from hex digits of its SHA-256 that the range isn't taken from."""
    return digits(sha, 9 + 15 * k, 15) % slots


def bitmaps(rows: DataFrame, slots: int) -> DataFrame:
    """bucket, bits: bitmaps of the slots that two or more rows fall into. Counts are combined map-side."""
    each = rows.select(F.explode(F.array(*[slot(k, slots) for k in range(HASHES)])).alias("slot"))
    twice = each.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.floor(F.col("slot") / BITMAP_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bits"))


def bit_is_set(bits: str, place: F.Column) -> F.Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def tested(rows: DataFrame, filled: DataFrame, slots: int, sha: str = "text_sha256", maybe: str = "maybe") -> DataFrame:
    """``rows`` with the column ``maybe``: true for every repeated text, and for few others."""
    names, found = rows.columns, F.lit(True)
    for k in range(HASHES):
        place = slot(k, slots, sha)
        own = filled.select(F.col("bucket").alias(f"\x00bucket{k}"), F.col("bits").alias(f"\x00bits{k}"))
        rows = rows.join(F.broadcast(own), F.floor(place / BITMAP_BITS) == F.col(f"\x00bucket{k}"), "left")
        found = found & F.coalesce(bit_is_set(f"\x00bits{k}", place % BITMAP_BITS), F.lit(False))
    return rows.select(*[F.col(f"`{c}`") for c in names], found.alias(maybe))


def possible(rows: DataFrame, hash_: F.Column, hashes: DataFrame, n: int) -> DataFrame:
    """``rows`` with the column \\x00maybe: true if their hash is among the ``n`` hashes (one long column), and for one in 16 or fewer others.

    The filter is 64 MB at most: of over 33 million hashes it lets more other rows through, never fewer of those asked for.
    """
    slots = min(sized(n), 1 << 29)
    place = F.pmod(hash_, F.lit(slots))
    each = hashes.select(F.pmod(hashes.columns[0], F.lit(slots)).alias("slot")).groupBy(F.floor(F.col("slot") / BITMAP_BITS).alias("\x00bucket"))
    filled = cut(each.agg(F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("\x00bits")), "filter")
    met = rows.join(F.broadcast(filled), F.floor(place / BITMAP_BITS) == F.col("\x00bucket"), "left")
    return met.withColumn("\x00maybe", F.coalesce(bit_is_set("\x00bits", place % BITMAP_BITS), F.lit(False))).drop("\x00bucket", "\x00bits")


def sized(rows: int) -> int:
    """Slots for so many rows: a power of two, BITS_EACH a row or up to twice that."""
    return 1 << max(16, (BITS_EACH * max(1, rows) - 1).bit_length())


def exact_groups(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Of equal texts the row with the largest doc_id stays. A null text equals the empty text. A null doc_id
    is below every other. Rows repeated with the same doc_id and text are one document: all have the same
    kept, each counts in group_size. An empty table gives no rows. Texts are hashed whole, however long. Other columns of
    ``docs`` aren't read. A text with a third of all rows is no task's alone: hot groups are found after the map-side
    combined count, are fewer than HOT_PARTS and are met by a broadcast.
    """
    spark = docs.sparkSession
    n = docs.count()
    ranges = max(1, -(-n // range_rows))
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/exact-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", sha256().alias("text_sha256"))
    rows.withColumn("range", (digits("text_sha256", 1, 8) % ranges).cast("int")).write.partitionBy("range").parquet(f"{folder}/digests")
    digests = spark.read.schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_sha256 string, range int").parquet(f"{folder}/digests")
    slots = sized(-(-n // ranges))
    for k in range(ranges):  # one after the other, so that one filter at a time is broadcast
        own = digests.where(F.col("range") == k).drop("range")
        tested(own, cut(bitmaps(own, slots), "bloom"), slots).write.mode("append").parquet(f"{folder}/tested")
    seen = spark.read.schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_sha256 string, maybe boolean").parquet(f"{folder}/tested")
    suspects = seen.where("maybe").select("doc_id", "text_sha256")
    groups = cut(suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    hot, cold = F.broadcast(groups.where(F.col("group_size") > n / HOT_PARTS)), groups.where(F.col("group_size") <= n / HOT_PARTS)
    shuffled = suspects.join(hot, "text_sha256", "left_anti").join(cold, "text_sha256", "left")
    alone = seen.where("not maybe").select("doc_id", "text_sha256", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    out = suspects.join(hot, "text_sha256").unionByName(shuffled).unionByName(alone)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` without exact copies: per text the row with the largest doc_id, and of repeated rows one.

    Null texts count as empty, null ids are below others, an empty table stays empty, all columns are kept whatever
    their names; rows repeated with the same doc_id and text but other values elsewhere leave any one of them.
    Whole rows move only where their text is possibly repeated, as far as one filter holds all rows (``range_rows``).
    """
    found = cut(exact_groups(docs, range_rows), "exact")
    copies = found.where("group_size > 1")
    again = cut(copies.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_sha256"), "again")
    gone = cut(copies.where("not kept").select("doc_id", "text_sha256").unionByName(again).distinct(), "gone")
    n = found.count()
    rows = docs.withColumn("\x00sha", sha256())
    if n <= range_rows:
        slots = sized(n)
        rows = tested(rows, cut(bitmaps(found.select("text_sha256"), slots), "bloom"), slots, "\x00sha", "\x00maybe")
        unique, rows = rows.where("not `\x00maybe`").drop("\x00maybe"), rows.where("`\x00maybe`").drop("\x00maybe")
    same = lambda b: rows["doc_id"].eqNullSafe(b["doc_id"]) & (rows["\x00sha"] == b["text_sha256"])
    once = rows.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        once = once.unionByName(rows.join(again, same(again), "left_semi").withColumn("\x00key", F.struct("doc_id", "\x00sha")).dropDuplicates(["\x00key"]).drop("\x00key"))
    return (once.unionByName(unique) if n <= range_rows else once).drop("\x00sha")
