"""Mixing sources to target weights by a low-discrepancy schedule.

Words, not documents, are dealt. Every source's documents stand in a shuffled line that is cut into
blocks of equally many words. Slot j of the mix lies at the golden-ratio point frac(j * 0.618...); the
cumulative shares of the targets map that point to a source, and the k-th slot of a source takes the
k-th block of its line (modulo the line's length, so that a further epoch starts over).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, cut

UNIT = 1 << 31  # points are integers in [0, UNIT)
GOLDEN = 1327217885  # odd, and next to UNIT * 0.6180339887
SHUFFLE_PRIME, SHUFFLE_FACTOR = 2147483647, 1103515245
CELL_BITS = 21
MAX_BROADCAST_SOURCES = 2_000
SLOT_CHUNK = 1024


def sizes(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text_hash, source, size: a narrow table, so that no text is moved later. Null texts have size 0."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("text_hash"), "source", size.alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """sidx, source, source_size, target, lo, hi: one row per source.

    Sources in code-point order, null last, take the weights in turn. A target is weight * level, at most
    ``epochs`` times the source's size; the level is such that all targets add up to all words. Sorted by
    size / weight the sources that stop at their limit come first, so the level needs prefix sums only.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", "sidx")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("sidx") % len(weights) + 1).cast("int"))
    table = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("sidx", F.row_number().over(by_name) - 1)
        .withColumn("weight", pick.cast("double"))
        .withColumn("all_words", F.sum("source_size").over(W.partitionBy()))
        .withColumn("limit", (F.col("source_size") * epochs).cast("double"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("below", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("all_words") - F.col("below")) / F.col("rest"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sidx", "level"))).over(W.partitionBy())["level"])
        .withColumn("target", F.least("limit", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")))
    )
    upto = F.sum("target").over(W.orderBy("sidx").rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = F.when(F.col("all_words") > 0, F.floor(F.col("upto") / F.col("whole") * UNIT)).otherwise(0)
    return (
        table.withColumn("upto", upto)
        .withColumn("whole", F.sum("target").over(W.partitionBy()))
        .withColumn("hi", F.when(F.col("upto") >= F.col("whole"), UNIT).otherwise(edge).cast("long"))
        .withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("sidx")), F.lit(0)).cast("long"))
        .select("sidx", "source", "source_size", "target", "lo", "hi")
    )


def schedule(source_table: DataFrame, slots: int) -> DataFrame:
    """slot, sidx, nth: the source of every slot and the slot's rank within that source (from 0).

    Cells of the unit interval turn the search for the source into an equi-join; ranks are counted per
    chunk of slots first, so that a source with most of the slots isn't one task's work.
    """
    spark = source_table.sparkSession
    cells = source_table.where("hi > lo").select("sidx", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % UNIT) * GOLDEN % UNIT).alias("point"))
    points = points.withColumn("cell", F.shiftright("point", CELL_BITS)).withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK))
    placed = points.join(cells, "cell").where("point >= lo and point < hi").select("slot", "chunk", "sidx")
    before = placed.groupBy("sidx", "chunk").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy("sidx").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)))
    ranked = placed.withColumn("within", F.row_number().over(W.partitionBy("sidx", "chunk").orderBy("slot")) - 1)
    return ranked.join(before, ["sidx", "chunk"]).select("slot", "sidx", (F.col("upto") - F.col("n") + F.col("within")).alias("nth"))


def lines(sized: DataFrame, buckets: int) -> DataFrame:
    """Adds start, stop: the words that a document takes in its source's shuffled line.

    The prefix sum has two levels: over ranges of the shuffle order, then within one range.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-1))
    mixed = sized.withColumn("at", F.pmod(F.pmod(key, F.lit(SHUFFLE_PRIME)) * SHUFFLE_FACTOR + 12345, F.lit(SHUFFLE_PRIME)))
    mixed = mixed.withColumn("bucket", F.floor(F.col("at") * buckets / SHUFFLE_PRIME))
    sums = mixed.groupBy("sidx", "bucket").agg(F.sum("size").alias("total"))
    base = sums.withColumn("base", F.sum("total").over(W.partitionBy("sidx").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("total"))
    own = F.sum("size").over(W.partitionBy("sidx", "bucket").orderBy("at", "doc_id", "rid").rowsBetween(W.unboundedPreceding, W.currentRow))
    return mixed.withColumn("own", own).join(base, ["sidx", "bucket"]).withColumn("stop", F.col("base") + F.col("own")).withColumn("start", F.col("stop") - F.col("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, slots_aimed: int = 1 << 18, block_most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): per document its share of the mix, and the mix itself as (slot, rid, words).

    documents: rid, doc_id, text_hash, size, source, source_size, target, taken. A piece is the part of a document in
    one slot's block, so the pieces in slot order are the mixed stream. A source's taken words differ from
    its target by a few blocks; a block is 1/``slots_aimed`` of all words, at most ``block_most`` words.

    Null doc_id, source or text: kept; a null source is a source of its own, a null or blank text has size
    0 and is never taken. Repeated rows are dealt like different documents. Ties in the shuffle order fall
    by doc_id, then row. An empty table, or one without words, gives target 0 and taken 0. A very long text is counted
    whole and lies in many blocks. Only doc_id, text and source of ``docs`` are read.
    """
    sized = cut(sizes(docs), "mix-sizes")
    table = cut(targets(sized, weights, epochs), "mix-targets")
    facts = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.count("*").alias("sources")).first()
    block = max(1, min(block_most, -(-facts["words"] // slots_aimed)))
    slots = -(-facts["words"] // block)
    buckets = max(64, min(1 << 20, sized.count() // 256))
    small = F.broadcast(table) if facts["sources"] <= MAX_BROADCAST_SOURCES else table
    known = sized.join(small, sized["source"].eqNullSafe(table["source"])).select("rid", "doc_id", "text_hash", "size", sized["source"], "sidx", "source_size", "target")
    placed = lines(known.select("rid", "doc_id", "size", "sidx").where("size > 0"), buckets)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)
    parts = placed.select("rid", "sidx", "start", "stop", F.explode(F.sequence(first, last)).alias("block"))
    parts = parts.select("rid", "sidx", "block", (F.least(F.col("stop"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)).alias("words"))
    lengths = table.where("source_size > 0").select("sidx", F.ceil(F.col("source_size") / block).alias("blocks"))
    turns = schedule(table, slots).join(F.broadcast(lengths) if facts["sources"] <= MAX_BROADCAST_SOURCES else lengths, "sidx")
    turns = turns.where(F.col("nth") < F.col("blocks") * epochs).select("slot", "sidx", (F.col("nth") % F.col("blocks")).alias("block"))
    pieces = turns.join(parts, ["sidx", "block"]).select("slot", "rid", "words")
    taken = pieces.groupBy("rid").agg(F.sum("words").alias("taken"))
    out = known.join(taken, "rid", "left").select("rid", "doc_id", "text_hash", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out, pieces


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: every document as often as its words are taken, to the nearest whole time.

    A line is taken from its start, so all but a document or two of a source are taken whole times. Documents
    that the mix doesn't take go, those without words and with a null text among them. Rows repeated with the same doc_id
    and text share what they have. An empty table stays empty; all columns are kept, whatever their names.
    """
    mixed, _ = mix(docs, **options)
    taken = mixed.where("taken > 0").groupBy("doc_id", "text_hash")
    times = taken.agg(F.round(F.sum(F.col("taken") / F.col("size")) / F.count("*")).cast("int").alias("\x00times"))
    times = cut(times.where(F.col("\x00times") > 0).select(F.col("doc_id").alias("\x00id"), F.col("text_hash").alias("\x00hash"), "\x00times"), "times")
    met = docs.join(times, docs["doc_id"].eqNullSafe(times["\x00id"]) & (F.xxhash64(docs["text"]) == times["\x00hash"]))
    return met.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col("\x00times"))).alias("\x00turn")).drop("\x00turn")
