"""How filters of documents act on one another: the trie of all their orders, run on survivors.

Every document's verdicts are worked out once. Then the trie of orders is walked depth first. Orders that begin with the
same filters, whatever their turn, leave the same survivors, so a state is a set of filters; it is met once, holds its
survivors persisted while its branches are walked, and counts there what each next filter removes. Rows of all orders
are put together from those counts.
"""

from __future__ import annotations

import uuid
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

SPACE = r"[\x20\x09-\x0D]+"
HOT_PARTS = 4096  # a text with over 1 / HOT_PARTS of all rows is hot; there are fewer than HOT_PARTS of these
FLAGS = ("good", "toxic")


def text_filters(text: F.Column) -> dict[str, F.Column]:
    """Failure conditions on a text alone, by name: too few words, too many repeated ones, shouting, signs of markup."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def verdicts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, good, toxic, A, B, C, D, E: a row per row of ``docs``; a letter is true where its filter fails the document.

    E: the text is that of a row with a smaller doc_id. A null doc_id is below all others, so it never fails and the others of its text do;
    repeated rows don't fail for each other. A null text counts as empty, a null ``part`` as the empty string. A document
    is good (toxic) if any row of ``labels`` with its doc_id has quality = 1 (toxic = 1).
    """
    text = F.coalesce("text", F.lit(""))
    fails = text_filters(F.col("\x00text"))
    own = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("\x00text"))
    rows = cut(own.select("doc_id", "part", F.unhex(F.sha2(F.col("\x00text").cast("binary"), 256)).alias("sha"), *[c.alias(k) for k, c in fails.items()]), "verdicts")
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id")).alias("least")
    groups = cut(rows.groupBy("sha").agg(least, F.count("*").alias("n")).where("n > 1"), "copies")
    many = rows.count() / HOT_PARTS
    hot, cold = F.broadcast(groups.where(F.col("n") > many)), groups.where(F.col("n") <= many)
    copy = (F.col("least").isNotNull() & F.col("doc_id").isNotNull() & (~F.col("least.has_id") | (F.col("least.doc_id") < F.col("doc_id")))).alias("E")
    hot_rows = rows.join(hot, "sha").select("doc_id", "part", *fails, copy)
    cold_rows = rows.join(hot, "sha", "left_anti").join(cold, "sha", "left").select("doc_id", "part", *fails, copy)
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    seen = hot_rows.unionByName(cold_rows)
    known = seen.where("doc_id is not null").join(marked, "doc_id", "left").unionByName(seen.where("doc_id is null"), allowMissingColumns=True)
    return known.select("part", *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS], *[F.coalesce(f, F.lit(False)).alias(f) for f in [*fails, "E"]])


def edge_counts(seen: DataFrame, filters: list[str]) -> DataFrame:
    """part, state, filter, kept, removed, good_lost, toxic_lost: for every state (a bitmap of filters applied before) and next filter.

    States are walked depth first and met once. The survivors of the states on the way are persisted, and made anew from the
    verdicts where an executor with a part of them is lost. A part that is empty in a state has no row there.
    """
    spark = seen.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/edges-{uuid.uuid4().hex}"
    schema = "part string, state int, filter int, n long, removed long, good_lost long, toxic_lost long"
    met: set[int] = set()

    def visit(survivors: DataFrame, state: int) -> None:
        met.add(state)
        after = [k for k in range(len(filters)) if not state >> k & 1]
        lost = [c for k in after for c in (F.count_if(filters[k]).alias(f"r{k}"), *[F.count_if(F.col(filters[k]) & F.col(f)).alias(f"{f}{k}") for f in FLAGS])]
        counts = survivors.groupBy("part").agg(F.count("*").alias("n"), *lost)
        edges = F.explode(F.array(*[F.struct(F.lit(k).alias("filter"), F.col(f"r{k}").alias("removed"), *[F.col(f"{f}{k}").alias(f"{f}_lost") for f in FLAGS]) for k in after])).alias("e")
        counts.select("part", F.lit(state).alias("state"), "n", edges).select("part", "state", "e.filter", "n", "e.removed", "e.good_lost", "e.toxic_lost").coalesce(1).write.mode("append").parquet(folder)
        for k in after:
            below = state | 1 << k
            if below not in met and below + 1 < 1 << len(filters):
                rest = survivors.where(~F.col(filters[k])).persist(StorageLevel.MEMORY_AND_DISK)
                visit(rest, below)
                rest.unpersist()

    start = seen.persist(StorageLevel.MEMORY_AND_DISK)
    visit(start, 0)
    start.unpersist()
    edges = spark.read.schema(schema).parquet(folder)
    return edges.withColumn("kept", F.col("n") - F.col("removed")).drop("n")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for every part, order
    of the filters and step, zeros included.

    kept and removed are counts after and at the step; redundant counts the documents that fail the step's filter but were removed earlier,
    unique_fails those that fail no other, shapley what the filter removes, summed over all orders. An empty table gives no rows. How
    nulls, repeated rows and labels count is said at ``verdicts``; columns but doc_id, text and ``part`` aren't read.
    """
    filters = ["A", "B", "C", "D", "E"]
    seen = cut(verdicts(docs, labels, part), "seen")
    edges = cut(edge_counts(seen, filters), "edges")
    n, places = len(filters), range(len(filters))
    alone = [F.count_if(F.col(f) & ~F.greatest(*[F.col(g) for g in filters if g != f])).alias(f) for f in filters]
    fails = [F.count_if(f).alias(f"{f}_all") for f in filters]
    totals = seen.groupBy("part").agg(*fails, *alone)
    each = totals.select("part", F.explode(F.array(*[F.struct(F.lit(k).alias("filter"), F.col(f"{f}_all").alias("fails"), F.col(f).alias("unique_fails")) for k, f in enumerate(filters)])).alias("e")).select("part", "e.*")
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in places]), F.bit_count("state") + 1)
    shares = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    steps = []
    for order in permutations(places):
        state = 0
        for at, k in enumerate(order):
            steps.append(("".join(filters[x] for x in order), at + 1, state, k))
            state |= 1 << k
    trie = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    rows = each.join(shares, ["part", "filter"], "left").join(F.broadcast(trie), "filter").join(edges, ["part", "state", "filter"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "part", "filter_order", "step", zero("kept"), zero("removed"), (F.col("fails") - F.coalesce("removed", F.lit(0))).alias("redundant"), "unique_fails", zero("good_lost"), zero("toxic_lost"), zero("shapley")
    )
