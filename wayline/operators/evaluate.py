"""Scores of the four tasks. Inputs are one row per trajectory; outputs are single rows or small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import parse

from .stats import ratio


def whole(name: str, test: Column) -> Column:
    return F.count_if(test).cast("bigint").alias(name)


def first_per(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the first by ``order``, else by all columns, so that a repeated key doesn't multiply what it meets."""
    rest = [c for c in rows.columns if c != key]
    row = F.struct(*([order] if order else []), *rest)
    return rows.groupBy(key).agg(F.min(row).alias("first")).select(key, *[F.col(f"first.{c}").alias(c) for c in rest])


ID_FIELDS = ("id", "traj_id", "trajectory_id", "devid", "device_id")  # fixed values


def first_match(asked: DataFrame, rows: DataFrame, order: str, fields: tuple[str, ...] = ID_FIELDS) -> DataFrame:
    """``asked`` (key) with the columns of the row that is the first by ``order`` to have the key, as text, in any of the id ``fields`` it has.

    Keys without a row are left out. Rows are reduced to one per id before they meet the keys. ``order`` tells rows apart: a line
    number, or struct(_metadata.file_path, _metadata.row_index) of rows that were read from Parquet files.
    """
    present = [F.col(c).cast("string") for c in fields if c in rows.columns]
    whole = F.struct(*[F.col(c) for c in rows.columns])
    each = rows.select(F.explode(F.array_distinct(F.array(*present))).alias("\x00id"), F.col(order).alias("\x00order"), whole.alias("\x00row")).where("`\x00id` is not null")
    first = each.groupBy("\x00id").agg(F.min_by("\x00row", "\x00order").alias("\x00row"))
    met = asked.join(first, asked["key"].cast("string") == first["\x00id"])
    return met.select(*[asked[c] for c in asked.columns], *[F.col(f"`\x00row`.`{c}`") for c in rows.columns if c not in asked.columns])


def arrival_errors(answers: DataFrame, trips: DataFrame) -> DataFrame:
    """Per answer (devid, text) of trips (devid, start_ts, end_ts): eta, error_s, duration_s; NULLs where an answer or its trip is missing. Of a repeated trip the first counts."""
    rows = answers.withColumn("eta", parse.eta("text")).join(first_per(trips, "devid"), "devid", "left")
    return rows.select("devid", "eta", parse.seconds_between("eta", "end_ts").alias("error_s"), parse.seconds_between("start_ts", "end_ts").alias("duration_s"))


def arrival_metrics(errors: DataFrame) -> DataFrame:
    """n_ok, n_failed, mean_duration, mae, rmse, mape. Trips without duration don't count in mape."""
    e = F.col("error_s")
    both = e.isNotNull() & F.col("duration_s").isNotNull()
    ok = F.when(both, e)
    return errors.agg(
        whole("n_ok", both), whole("n_failed", ~both), F.avg(F.when(both, F.col("duration_s"))).alias("mean_duration"), F.avg(ok).alias("mae"), F.sqrt(F.avg(ok * ok)).alias("rmse"),
        F.avg(F.try_divide(ok, F.col("duration_s")) * 100).alias("mape"),
    )


def next_road_hits(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Per answer with a truth (devid, label) and something to read: top1, top5, hit1, hit5. Ids are compared as text; of a repeated truth the first counts."""
    rows = answers.select("devid", parse.top1("text").alias("top1"), parse.top5("text").alias("top5")).join(first_per(truth, "devid"), "devid")
    rows = rows.where(F.col("label").isNotNull() & (F.col("top1").isNotNull() | (F.coalesce(F.size("top5"), F.lit(0)) > 0)))
    label = F.col("label").cast("string")
    return rows.select("devid", "top1", "top5", "label", F.coalesce(F.col("top1") == label, F.lit(False)).alias("hit1"), F.coalesce(F.array_contains("top5", label), F.lit(False)).alias("hit5"))


def next_road_metrics(hits: DataFrame) -> DataFrame:
    share = lambda c: F.coalesce(F.avg(F.when(F.col(c), 100.0).otherwise(0.0)), F.lit(0.0))
    return hits.agg(F.count("*").alias("n"), share("hit1").alias("acc1"), share("hit5").alias("acc5"), share("hit5").alias("recall5"))


def confusion(results: DataFrame) -> DataFrame:
    """tp, fp, tn, fn, n of (truth, prediction) in normal / abnormal; rows without a prediction are skipped."""
    is_ = lambda t, p: (F.col("truth") == t) & (F.col("prediction") == p)
    known = results.where("truth is not null and prediction is not null")
    return known.agg(whole("tp", is_("abnormal", "abnormal")), whole("fp", is_("normal", "abnormal")), whole("tn", is_("normal", "normal")), whole("fn", is_("abnormal", "normal")), F.count("*").alias("n"))


def binary_metrics(table: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy of a confusion row; undefined ones are 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rows = table.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp + tn, F.col("n")).alias("accuracy"))
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_ratio(folders: DataFrame) -> DataFrame:
    """n_normal, n_abnormal and their ratio over all labelled folders, answered or not."""
    counts = folders.agg(whole("n_normal", F.col("truth") == "normal"), whole("n_abnormal", F.col("truth") == "abnormal"))
    return counts.withColumn("ratio", F.col("n_normal") / F.greatest(F.lit(1), F.col("n_abnormal")))


def pr_auc(table: DataFrame) -> DataFrame:
    """Area under the precision-recall curve and average precision where scores are 0 or 1, in closed form; NULL without positives.

    The curve has three points: all rows called positive, those predicted so, and none.
    """
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    share = F.try_divide(tp + fn, n)
    called = tp + fp > 0
    p, r = F.when(called, F.try_divide(tp, tp + fp)).otherwise(share), F.when(called, F.try_divide(tp, tp + fn)).otherwise(1.0)
    rows = table.where("n > 0").select(p.alias("p"), r.alias("r"), share.alias("share"))
    p, r, share = F.col("p"), F.col("r"), F.col("share")
    some = lambda x: F.when(share > 0, x)
    return rows.select(some((1 - r) * (share + p) / 2 + r * (p + 1) / 2).alias("pr_auc"), some(r * p + (1 - r) * share).alias("average_precision"))


def wrong(results: DataFrame) -> DataFrame:
    """The false positives and false negatives."""
    kind = F.when((F.col("truth") == "normal") & (F.col("prediction") == "abnormal"), "FP").when((F.col("truth") == "abnormal") & (F.col("prediction") == "normal"), "FN")
    return results.withColumn("kind", kind).where("kind is not null")


def misclassified(results: DataFrame) -> DataFrame:
    """The answers that can be read and are wrong, with all columns of (truth, prediction, ...)."""
    return results.where("prediction is not null and truth <> prediction")


def mode_metrics(results: DataFrame) -> DataFrame:
    """n, correct, accuracy, macro_f1, weighted_f1 in percent of (truth, prediction).

    Accuracy's denominator counts answers that can't be read, the F1s are over the rest, NULL unless two
    classes are true. Counts per pair of classes are made first, so all further work is on a small table.
    """
    pairs = results.groupBy("truth", "prediction").agg(F.count("*").alias("k"))
    read = pairs.where("prediction is not null")
    side = lambda c: read.groupBy(F.col(c).alias("label")).agg(F.sum("k").alias(f"n_{c}"))
    hit = read.where("truth = prediction").select(F.col("truth").alias("label"), F.col("k").alias("tp"))
    labels = side("truth").join(side("prediction"), "label", "full").join(hit, "label", "left").na.fill(0)
    f1 = labels.withColumn("f1", ratio(2.0 * F.col("tp"), F.col("n_truth") + F.col("n_prediction")))
    scores = f1.agg(F.count_if(F.col("n_truth") > 0).alias("classes"), (F.avg("f1") * 100).alias("macro"), (F.try_divide(F.sum(F.col("f1") * F.col("n_truth")), F.sum("n_truth")) * 100).alias("weighted"))
    counts = pairs.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("k"))), F.lit(0)).alias("correct"))
    both = lambda c: F.when(F.col("classes") > 1, F.col(c))
    return counts.crossJoin(scores).select("n", "correct", (ratio(F.col("correct"), F.col("n")) * 100).alias("accuracy"), both("macro").alias("macro_f1"), both("weighted").alias("weighted_f1"))


def class_distribution(results: DataFrame) -> DataFrame:
    """Per true class of the answers that can be read: n and n_wrong."""
    return results.where("prediction is not null").groupBy("truth").agg(F.count("*").alias("n"), whole("n_wrong", F.col("truth") != F.col("prediction")))
