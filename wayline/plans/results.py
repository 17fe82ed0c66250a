"""Queries on texts: parsing, scores, prompts, messages, the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import parse
from wayline.operators import catalog, evaluate, models, prompts
from wayline.registry import query, table
from wayline.sources import files as files_source
from wayline.sources import trajectories

from .movement import points_of, r
from .segments import parts_of
from .sql import bearing, direction, stamp, with_

ORDER = "o_orderkey"
TIME = "%Y-%m-%d %H:%M:%S"


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def day(ts: str, zone: int = 0) -> Column:
    return F.date_format(F.col(ts).cast("timestamp") + F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {zone})"), parse.STAMP)


def eta_answers(orders: DataFrame) -> DataFrame:
    """Answers in the shapes that models give: triple brackets, repeated, double only, a bad month, none."""
    t = day("o_orderdate", 90)
    shape = F.col(ORDER) % 5
    said = F.when(shape == 0, text("It arrives <<<", t, ">>>.")).when(shape == 1, text("First <<<2001-01-01 00:00:00>>>, no: <<<", t, ">>>")).when(shape == 2, text("About <<", t, ">>"))
    return orders.select(F.col(ORDER).alias("devid"), said.when(shape == 3, text("<<<2001-13-01 00:00:00>>> or <<", t, ">>")).otherwise("I don't know.").alias("text"))


_ETA = "CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 SECOND END"


@query(f"SELECT o_orderkey AS devid, strftime({_ETA}, '{TIME}') AS eta FROM orders")
def parse_eta(spark: SparkSession, d: str) -> DataFrame:
    return eta_answers(table(spark, d, "orders")).select("devid", F.date_format(parse.eta("text"), parse.STAMP).alias("eta"))


@query(f"SELECT o_orderkey AS devid, CASE WHEN o_orderkey % 5 < 3 THEN CAST(90 AS BIGINT) END AS error_s FROM orders")
def eta_error_seconds(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    truth = orders.select(F.col(ORDER).alias("devid"), F.col("o_orderdate").cast("timestamp").alias("end_ts"))
    return eta_answers(orders).join(truth, "devid").select("devid", parse.seconds_between(parse.eta("text"), "end_ts").alias("error_s"))


def trips_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(answers, trips) of the event trajectories; every seventh trip is unknown."""
    ends = points_of(spark, d).groupBy("devid").agg(F.min_by("t", "seq").alias("t1"), F.max_by("t", "seq").alias("t2"))
    said = parse.stamp(F.col("t2") + F.col("devid") % 100 - 50)
    shape = F.col("devid") % 4
    answers = ends.select("devid", F.when(shape == 0, text("<<", said, ">>")).when(shape == 1, "none").otherwise(text("<<<", said, ">>>")).alias("text"))
    trips = ends.where("devid % 7 <> 0").select("devid", parse.local_time("t1").alias("start_ts"), parse.local_time("t2").alias("end_ts"))
    return answers, trips


_TRIPS = "SELECT devid, CASE WHEN devid % 7 <> 0 AND devid % 4 <> 1 THEN abs(devid % 100 - 50) END AS error_s, CASE WHEN devid % 7 <> 0 THEN max_by(t, seq) - min_by(t, seq) END AS duration_s FROM points GROUP BY devid"


@query(with_("points", trips=_TRIPS, body="SELECT devid, CAST(error_s AS BIGINT) AS error_s, CAST(duration_s AS BIGINT) AS duration_s FROM trips"))
def tte_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.arrival_errors(*trips_of(spark, d)).select("devid", "error_s", "duration_s")


@query(with_("points", trips=_TRIPS, body="""SELECT count(error_s) AS n_ok, count(*) - count(error_s) AS n_failed, round(avg(duration_s) FILTER (error_s IS NOT NULL), 4) AS mean_duration, round(avg(error_s), 6) AS mae,
    round(sqrt(avg(error_s * error_s)), 6) AS rmse, round(avg(error_s * 100.0 / nullif(duration_s, 0)), 6) AS mape FROM trips"""))
def tte_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.arrival_metrics(evaluate.arrival_errors(*trips_of(spark, d)))
    return m.select("n_ok", "n_failed", r("mean_duration", 4), r("mae", 6), r("rmse", 6), r("mape", 6))


def road_answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(answers, truth): next-road answers of the orders, in both formats, with gaps."""
    rows = table(spark, d, "orders").select(F.col(ORDER).alias("devid"), F.col("o_custkey").alias("road"))
    s = lambda k: (F.col("road") + k).cast("string")
    shape = F.col("devid") % 5
    said = F.when(shape == 0, text("<<< ", s(0), " >>> and [[[", s(1), ", ", s(2), "]]]")).when(shape == 1, text("Top-1 prediction: ", s(1), "\nTop-5 candidates: [[", s(0), ", ", s(1), "]]")).when(shape == 2, text("[[[", s(0), ",,", s(3), "]]]"))
    return rows.select("devid", said.when(shape == 3, text("<<<", s(2), ">>>")).otherwise("no idea").alias("text")), rows.select("devid", F.col("road").alias("label"))


_ROAD = "SELECT o_orderkey AS devid, o_custkey AS road, o_orderkey % 5 AS shape FROM orders"


@query(f"SELECT devid, CASE shape WHEN 0 THEN CAST(road AS VARCHAR) WHEN 1 THEN CAST(road + 1 AS VARCHAR) WHEN 3 THEN CAST(road + 2 AS VARCHAR) END AS top1 FROM ({_ROAD})")
def parse_top1(spark: SparkSession, d: str) -> DataFrame:
    return road_answers(spark, d)[0].select("devid", parse.top1("text").alias("top1"))


@query(f"SELECT devid, CASE shape WHEN 0 THEN concat(road + 1, '|', road + 2) WHEN 1 THEN concat(road, '|', road + 1) WHEN 2 THEN concat(road, '|', road + 3) END AS top5 FROM ({_ROAD})")
def parse_top5(spark: SparkSession, d: str) -> DataFrame:
    return road_answers(spark, d)[0].select("devid", F.array_join(parse.top5("text"), "|").alias("top5"))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey + 1 END AS devid, o_custkey % 50 AS label FROM orders),
    k AS (SELECT o_orderkey, unnest([id, devid]) AS key, label FROM r) SELECT c_custkey AS key, min(o_orderkey) AS o_orderkey, min_by(label, o_orderkey) AS label FROM customer JOIN k ON c_custkey = key GROUP BY c_custkey""")
def mp_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first row, in the order of a file, that has a customer's key in one of its id fields."""
    key, owner = F.col(ORDER), F.col("o_custkey")
    rows = table(spark, d, "orders").select(ORDER, F.when(key % 3 == 0, owner).alias("id"), F.when(key % 3 != 0, owner + 1).alias("devid"), (owner % 50).alias("label"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return evaluate.first_match(asked, rows, ORDER).select("key", ORDER, "label")


@query(f"SELECT devid, shape = 0 AS hit1, shape IN (1, 2) AS hit5 FROM ({_ROAD}) WHERE shape < 4")
def mp_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.next_road_hits(*road_answers(spark, d)).select("devid", "hit1", "hit5")


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN shape = 0 THEN 100.0 ELSE 0.0 END), 6) AS acc1, round(avg(CASE WHEN shape IN (1, 2) THEN 100.0 ELSE 0.0 END), 6) AS acc5, round(avg(CASE WHEN shape IN (1, 2) THEN 100.0 ELSE 0.0 END), 6) AS recall5 FROM ({_ROAD}) WHERE shape < 4")
def mp_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.next_road_metrics(evaluate.next_road_hits(*road_answers(spark, d)))
    return m.select("n", r("acc1", 6), r("acc5", 6), r("recall5", 6))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """folder, text: answers about the labelled documents; truth by quality, answer by toxic, every ninth unreadable."""
    key = F.col("doc_id").cast("string")
    word = F.when(F.col("toxic") == 1, "Abnormal").otherwise("NORMAL")
    said = F.when(F.col("doc_id") % 9 == 0, "no judgment").when(F.col("doc_id") % 2 == 0, text("... **Final Judgment:** ", word)).otherwise(text("final  judgment:", word, " (sure)"))
    return table(spark, d, "labels").select("doc_id", text(F.when(F.col("quality") == 0, "consolidated_anomaly_").otherwise("consolidated_normal_"), key).alias("folder"), said.alias("text"))


def judged_results(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("doc_id", parse.folder_label("folder").alias("truth"), parse.judgment("text").alias("prediction"))


_JUDGED = "SELECT doc_id, CASE WHEN quality = 0 THEN 'abnormal' ELSE 'normal' END AS truth, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN toxic = 1 THEN 'abnormal' ELSE 'normal' END AS prediction FROM labels"
_COUNTS = f"SELECT count(*) FILTER (truth = 'abnormal' AND prediction = 'abnormal') AS tp, count(*) FILTER (truth = 'normal' AND prediction = 'abnormal') AS fp, count(*) FILTER (truth = 'normal' AND prediction = 'normal') AS tn, count(*) FILTER (truth = 'abnormal' AND prediction = 'normal') AS fn, count(*) AS n FROM ({_JUDGED}) WHERE prediction IS NOT NULL"


@query(f"SELECT doc_id, prediction AS judgment FROM ({_JUDGED})")
def parse_judgment(spark: SparkSession, d: str) -> DataFrame:
    return judged_results(spark, d).select("doc_id", F.col("prediction").alias("judgment"))


@query(f"SELECT doc_id, truth, CAST(doc_id AS VARCHAR) AS mode FROM ({_JUDGED})")
def label_from_folder(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d).withColumn("ride", F.concat(F.lit("010_"), F.col("doc_id").cast("string"), F.lit("_2008")))
    return rows.select("doc_id", parse.folder_label("folder").alias("truth"), parse.folder_mode("ride").alias("mode"))


@query(_COUNTS)
def ad_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(judged_results(spark, d))


@query(f"SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, round(a, 6) AS accuracy FROM (SELECT coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r, coalesce((tp + tn) / nullif(n, 0), 0.0) AS a FROM ({_COUNTS}))")
def ad_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.binary_metrics(evaluate.confusion(judged_results(spark, d))).select(r("precision", 6), r("recall", 6), r("f1", 6), r("accuracy", 6))


@query(f"SELECT n_normal, n_abnormal, round(n_normal / greatest(1, n_abnormal), 6) AS ratio FROM (SELECT count(*) FILTER (truth = 'normal') AS n_normal, count(*) FILTER (truth = 'abnormal') AS n_abnormal FROM ({_JUDGED}))")
def ad_class_ratio(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.class_ratio(judged_results(spark, d)).select("n_normal", "n_abnormal", r("ratio", 6))


@query(f"""SELECT CASE WHEN s > 0 THEN round((1 - r) * (s + p) / 2 + r * (p + 1) / 2, 6) END AS pr_auc, CASE WHEN s > 0 THEN round(r * p + (1 - r) * s, 6) END AS average_precision FROM (
    SELECT (tp + fn) / n AS s, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE (tp + fn) / n END AS p, CASE WHEN tp + fp > 0 THEN tp / nullif(tp + fn, 0) ELSE 1.0 END AS r FROM ({_COUNTS}))""")
def ad_pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pr_auc(evaluate.confusion(judged_results(spark, d))).select(r("pr_auc", 6), r("average_precision", 6))


@query(f"SELECT doc_id, CASE WHEN truth = 'normal' THEN 'FP' ELSE 'FN' END AS kind FROM ({_JUDGED}) WHERE prediction <> truth")
def ad_errors(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.wrong(judged_results(spark, d)).select("doc_id", "kind")


def rides(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, truth, prediction: modes of the labelled vectors; every eleventh answer can't be read."""
    said = F.when(F.col("vec_id") % 11 == 0, "unknown").otherwise(text("I say <<<m", (F.col("vec_id") % 10 % 7).cast("string"), ">>> or <<<x>>>"))
    rows = table(spark, d, "embeddings").select("vec_id", text("010_m", (F.col("label") % 7).cast("string"), "_2008").alias("folder"), said.alias("text"))
    return rows.select("vec_id", parse.folder_mode("folder").alias("truth"), parse.mode("text").alias("prediction"))


_RIDES = "SELECT vec_id, concat('m', label % 7) AS truth, CASE WHEN vec_id % 11 <> 0 THEN concat('m', vec_id % 10 % 7) END AS prediction FROM embeddings"


@query(f"SELECT vec_id, prediction AS mode FROM ({_RIDES})")
def parse_mode(spark: SparkSession, d: str) -> DataFrame:
    return rides(spark, d).select("vec_id", F.col("prediction").alias("mode"))


@query(f"""WITH r AS ({_RIDES}), ok AS (SELECT * FROM r WHERE prediction IS NOT NULL), names AS (SELECT truth AS label FROM ok UNION SELECT prediction FROM ok),
    f AS (SELECT label, (SELECT count(*) FROM ok WHERE truth = label) AS nt, (SELECT count(*) FROM ok WHERE prediction = label) AS np, (SELECT count(*) FROM ok WHERE prediction = label AND truth = label) AS tp FROM names)
    SELECT (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM ok WHERE truth = prediction) AS correct, round(100.0 * (SELECT count(*) FROM ok WHERE truth = prediction) / (SELECT count(*) FROM r), 6) AS accuracy,
    round(100 * avg(2.0 * tp / (nt + np)), 6) AS macro_f1, round(100 * sum(nt * 2.0 * tp / (nt + np)) / sum(nt), 6) AS weighted_f1 FROM f""")
def tmi_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mode_metrics(rides(spark, d)).select("n", "correct", r("accuracy", 6), r("macro_f1", 6), r("weighted_f1", 6))


@query(f"SELECT truth, count(*) AS n, count(*) FILTER (truth <> prediction) AS n_wrong FROM ({_RIDES}) WHERE prediction IS NOT NULL GROUP BY truth")
def tmi_class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.class_distribution(rides(spark, d))


@query(f"SELECT vec_id, truth, prediction FROM ({_RIDES}) WHERE prediction IS NOT NULL AND truth <> prediction")
def tmi_misclassified(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.misclassified(rides(spark, d))


@query("SELECT o_orderkey, [o_orderkey, o_custkey] AS ids FROM orders")
def parse_id_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", parse.id_list(F.concat_ws(",", "o_orderkey", "o_custkey")).alias("ids"))


@query("SELECT l_orderkey, l_linenumber, [l_quantity, l_discount] AS xs FROM lineitem")
def parse_float_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parse.float_list(F.concat_ws(", ", "l_quantity", "l_discount")).alias("xs"))


@query("SELECT o_orderkey, o_orderkey AS first, o_custkey AS last, 2 AS n FROM orders")
def parse_nested_id_list(spark: SparkSession, d: str) -> DataFrame:
    ids = parse.nested_id_list(F.concat_ws("", "o_orderkey", F.lit(",7|8,"), "o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", ids[0][0].alias("first"), ids[1][1].alias("last"), F.size(ids).alias("n"))


@query("SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS lon1, CAST(s_nationkey AS DOUBLE) AS lat2, 2 AS n FROM supplier")
def parse_wkt_linestring(spark: SparkSession, d: str) -> DataFrame:
    line = parse.wkt_linestring(F.concat_ws("", F.lit("LINESTRING ("), "s_suppkey", F.lit(" 1.5, 2.5 "), "s_nationkey", F.lit(")")))
    return table(spark, d, "supplier").select("s_suppkey", line[0]["lon"].alias("lon1"), line[1]["lat"].alias("lat2"), F.size(line).alias("n"))


@query("SELECT page_id, concat('data:image/png;base64,', base64(encode(html))) AS uri FROM pages")
def image_data_uri(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", parse.data_uri(F.encode("html", "UTF-8")).alias("uri"))


_LOCAL = f"CAST({stamp('t')} AS TIMESTAMP)"


@query(with_("points", body=f"SELECT devid, seq, strftime({_LOCAL}, '%H:%M:%S') AS clock, strftime({_LOCAL}, '%Y-%m-%d %A %H:%M:%S') AS full FROM points"))
def format_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return points_of(spark, d).select("devid", "seq", parse.clock("t").alias("clock"), parse.clock("t", True).alias("full"))


@query("SELECT o_orderkey, CASE WHEN s >= 3600 THEN concat(s // 3600, 'h', s // 60 % 60, 'm', s % 60, 's') WHEN s >= 60 THEN concat(s // 60, 'm', s % 60, 's') ELSE concat(s, 's') END AS length FROM (SELECT o_orderkey, CAST(o_orderkey * 7 % 9000 AS BIGINT) AS s FROM orders)")
def format_duration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", parse.duration((F.col(ORDER) * 7 % 9000).cast("double") + 0.7).alias("length"))


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """kind, filename: pictures that rendering leaves: four segments and the whole per kind, three end views, hidden and other files."""
    ids = points_of(spark, d).select("devid").distinct()
    i = F.col("devid").cast("string")
    each = [F.struct(F.lit(kind).alias("kind"), F.concat(i, F.lit(tail)).alias("filename")) for kind in ("poi", "road_structure") for tail in ("_segment_0.png", "_segment_1.png", "_segment_10.png", "_segment_2.png", ".png", ".txt")]
    each += [F.struct(F.lit("last_trajectory").alias("kind"), F.concat(F.lit("trajectory_"), i, F.lit(f"_{z}.png")).alias("filename")) for z in (17, 18, 20)]
    each.append(F.struct(F.lit("poi").alias("kind"), F.concat(F.lit("._"), i, F.lit("_segment_0.png")).alias("filename")))
    return ids.select(F.explode(F.array(*each)).alias("f")).select("f.*")


_IDS = "SELECT DISTINCT devid FROM points"
_NAMES = """SELECT devid, unnest([concat('0_segment_', devid, '_poi.png'), concat('1_segment_', devid, '_poi.png'), concat('10_segment_', devid, '_poi.png'), concat('2_segment_', devid, '_poi.png'), concat('poi_', devid, '.png'),
    concat('0_segment_', devid, '_road_structure.png'), concat('1_segment_', devid, '_road_structure.png'), concat('10_segment_', devid, '_road_structure.png'), concat('2_segment_', devid, '_road_structure.png'), concat('road_structure_', devid, '.png'),
    concat('last_trajectory_', devid, '_17.png'), concat('last_trajectory_', devid, '_18.png'), concat('last_trajectory_', devid, '_20.png')]) AS filename FROM ids"""


@query(with_("points", ids=_IDS, body="SELECT CAST(devid AS VARCHAR) AS devid FROM ids"))
def traj_ids_from_artifacts(spark: SparkSession, d: str) -> DataFrame:
    names = rendered(spark, d).select(parse.segment_file_id("filename").alias("devid"))
    return names.where("devid is not null").distinct()


@query(with_("points", ids=_IDS, names=_NAMES, body="SELECT CAST(devid AS VARCHAR) AS devid, list(filename ORDER BY filename) AS files FROM names GROUP BY devid"))
def artifact_manifest(spark: SparkSession, d: str) -> DataFrame:
    return catalog.manifest(rendered(spark, d))


def consolidated(spark: SparkSession, d: str) -> DataFrame:
    return catalog.renamed(rendered(spark, d)).distinct().withColumnRenamed("target", "filename")


@query(with_("points", ids=_IDS, names=_NAMES, body="SELECT CASE WHEN contains(filename, 'poi') THEN 'poi' WHEN contains(filename, 'road_structure') THEN 'road_structure' ELSE 'last_trajectory' END AS kind, count(*) AS n FROM names GROUP BY 1"))
def artifact_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return consolidated(spark, d).groupBy(catalog.artifact_type(F.col("filename")).alias("kind")).agg(F.count("*").alias("n"))


@query(with_("points", ids=_IDS, names=_NAMES, body="SELECT CAST(devid AS VARCHAR) AS id, filename FROM names"))
def artifact_catalog(spark: SparkSession, d: str) -> DataFrame:
    return consolidated(spark, d).select(F.col("devid").alias("id"), "filename")


_IMAGES = """SELECT CAST(devid AS VARCHAR) AS id, filename, CASE WHEN contains(filename, 'poi') THEN 'POI' ELSE 'Road network' END AS context,
    CASE WHEN contains(filename, '_segment_') THEN 'segment' WHEN starts_with(filename, 'last_') THEN 'last_trajectory' ELSE 'global' END AS role,
    TRY_CAST(CASE WHEN contains(filename, '_segment_') THEN split_part(filename, '_', 1) WHEN starts_with(filename, 'last_') THEN split_part(split_part(filename, '_', 4), '.', 1) END AS INT) AS number FROM names"""


@query(with_("points", ids=_IDS, names=_NAMES, images=_IMAGES, body="SELECT *, CASE role WHEN 'segment' THEN concat('segment ', number) WHEN 'last_trajectory' THEN concat('last trajectory ', CASE WHEN number <= 17 THEN 'small' WHEN number <= 18 THEN 'medium' ELSE 'large' END) END AS label FROM images"))
def catalog_images(spark: SparkSession, d: str) -> DataFrame:
    files = consolidated(spark, d).select(F.lit("Chengdu").alias("dataset"), F.col("devid").alias("id"), "filename")
    return catalog.images(files).drop("dataset")


_CITY = "['Chengdu', 'Porto', 'Xian', 'Beijing'][1 + CAST(devid % 4 AS INT)]"


@query(with_("points", ids=_IDS, names=_NAMES, images=_IMAGES.replace("SELECT ", f"SELECT {_CITY} AS dataset, ", 1), body="""SELECT dataset, id, CASE WHEN dataset = 'Beijing' THEN replace(filename, concat('_', id), '') ELSE filename END AS filename, context, role, number,
    CASE role WHEN 'segment' THEN concat('segment ', number) WHEN 'last_trajectory' THEN concat('last trajectory ', CASE WHEN number <= 17 THEN 'small' WHEN number <= 18 THEN 'medium' ELSE 'large' END) END AS label FROM images WHERE dataset <> 'Beijing' OR role <> 'last_trajectory'"""))
def catalog_images_cities(spark: SparkSession, d: str) -> DataFrame:
    """The pictures of four cities; one has no ids in its names and no views of the end point."""
    id_ = F.col("devid").try_cast("bigint")
    city = F.element_at(F.array(*map(F.lit, ("Chengdu", "Porto", "Xian", "Beijing"))), (id_ % 4 + 1).cast("int"))
    name = F.when(city == "Beijing", F.replace("filename", F.concat(F.lit("_"), "devid"), F.lit(""))).otherwise(F.col("filename"))
    return catalog.images(consolidated(spark, d).select(city.alias("dataset"), F.col("devid").alias("id"), name.alias("filename")))


@query(with_("points", body="SELECT devid, count(*) AS n FROM points GROUP BY devid HAVING devid % 7 <> 0 AND devid % 5 <> 0"))
def consistent_trajectories(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories whose arrays agree; every seventh has lost a time, every fifth has a road too many."""
    nested = trajectories.nest(points_of(spark, d))
    short = F.when(F.col("devid") % 7 == 0, F.slice("times", 1, F.size("times") - 1)).otherwise(F.col("times"))
    more = F.when(F.col("devid") % 5 == 0, F.concat("road_ids", F.array(F.lit(-1).cast("bigint")))).otherwise(F.col("road_ids"))
    return trajectories.consistent(nested.withColumns({"times": short, "road_ids": more})).select("devid", F.size("points").cast("bigint").alias("n"))


@query(with_("points", ids=_IDS, names=_NAMES, places="SELECT *, row_number() OVER (PARTITION BY devid ORDER BY filename) AS k FROM names", body="""SELECT devid, concat('image', k) AS slot, filename FROM (SELECT CAST(devid AS VARCHAR) AS devid, k, filename FROM places) WHERE k <= 10
    UNION ALL SELECT CAST(devid AS VARCHAR), 'last_trajectory_view', concat('last_trajectory_', devid, '_17.png') FROM ids UNION ALL SELECT CAST(devid AS VARCHAR), 'poi_full_image', concat('poi_', devid, '.png') FROM ids
    UNION ALL SELECT CAST(devid AS VARCHAR), 'road_structure_full_image', concat('road_structure_', devid, '.png') FROM ids"""))
def image_slots(spark: SparkSession, d: str) -> DataFrame:
    return prompts.image_slots(consolidated(spark, d)).select("devid", "slot", "filename")


@query(with_("points", ids=_IDS, body="SELECT devid, concat('trajectory_', devid, '_', z, '.html') AS filename, z AS zoom, concat('{\"zoom\": ', z, ', \"id\": ', devid, '}') AS html FROM ids, (SELECT unnest([17, 18, 20]) AS z)"))
def zoom_variants(spark: SparkSession, d: str) -> DataFrame:
    pages = points_of(spark, d).select("devid").distinct().withColumn("html", F.concat(F.lit('{"zoom": 15, "id": '), F.col("devid").cast("string"), F.lit("}")))
    return catalog.zoom_variants(pages)


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'exists' WHEN 'O' THEN 'created' ELSE 'error' END"


@query(f"SELECT {_STATUS} AS status, count(*) AS n FROM orders GROUP BY 1")
def pipeline_status_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "exists").when(F.col("o_orderstatus") == "O", "created").otherwise("error")
    return catalog.status_counts(table(spark, d, "orders").select(status.alias("status")))


@query(f"SELECT o_orderkey AS id, concat('trajectory_', o_orderkey, '.html') AS html, concat('trajectory_', o_orderkey, '.png') AS png FROM orders WHERE {_STATUS} <> 'error'")
def snapshot_manifest(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return done.select(F.col(ORDER).alias("id"), *[text("trajectory_", F.col(ORDER).cast("string"), f".{kind}").alias(kind) for kind in ("html", "png")])


_START = stamp("min_by(t, seq)")
_PART_TEXT = """SELECT p.devid, p.seg, coalesce(sum(m.dist), 0.0) AS distance, min_by(p.t, p.seq) AS t FROM parts p LEFT JOIN part_moves m USING (devid, seg, seq) GROUP BY p.devid, p.seg"""
_HEAD = "concat('**Segment ', seg + 1, ':**\n*   **Visuals:**\n    *   `image', 2 * seg + 1, '` (Shows segment path, POIs, signalized intersections)\n    *   `image', 2 * seg + 2, '` (Illustrates road class, lanes, network structure)\n*   **Segment Stats:**\n')"
_SEGMENT = f"SELECT devid, seg, concat({_HEAD}, CASE WHEN seg = 0 THEN concat('    *   **Start Time: ', {stamp('t')}, ' **\n') ELSE '' END, '    *   **Distance (meters): ', round(distance, 4), ' meters **\n', '\n') AS part FROM dists"
_OPEN = "concat('**The trajectory is segmented based on approximate uniformity in traffic semantics. **\n', '** Below are details for the ', count(*), ' segments of this trajectory, each with statistical information and corresponding visual data: **\n\n', string_agg(part, '' ORDER BY seg))"
_PROMPT = {"dists": _PART_TEXT, "segs": _SEGMENT, "prompts": f"SELECT devid, {_OPEN} AS text FROM segs GROUP BY devid"}


@query(with_("part_moves", **_PROMPT, body="SELECT devid, text FROM prompts"))
def prompt_segments(spark: SparkSession, d: str) -> DataFrame:
    return prompts.segment_prompt(parts_of(spark, d))


_ENDS = "SELECT devid, max(CASE WHEN back = 5 THEN lon END) AS lon, max(CASE WHEN back = 5 THEN lat END) AS lat, max(CASE WHEN back = 1 THEN lon END) AS lon2, max(CASE WHEN back = 1 THEN lat END) AS lat2, max(CASE WHEN back = 5 THEN road_id END) AS road_k FROM backs WHERE n >= 5 GROUP BY devid"
_WAY = f"SELECT devid, road_k, {bearing('lat', 'lon', 'lat2', 'lon2')} AS b FROM ends"
_TREND = "SELECT devid, max(CASE WHEN back = 2 THEN speed END) - max(CASE WHEN back = 5 THEN speed END) AS change FROM (SELECT s.*, b.back FROM steps s JOIN backs b USING (devid, seq) WHERE b.n >= 5) GROUP BY devid"
_END = {"ends": _ENDS, "way": _WAY, "trend": _TREND}
_VIEWS = "'    * `poi_full_image` (Comprehensive view of the entire trajectory with POIs and signalized intersections)\n'", "'    * `road_structure_full_image` (Detailed illustration of the full trajectory''s road class, lanes, and network structure)\n'"


def _overall(a: str, b: str, c: str) -> str:
    return f"'\n{a}---\n\n{b}**Overall Trajectory Visuals:**\n{b}* **Visuals:**\n{b}' || {_VIEWS[0]} || '{b}' || {_VIEWS[1]} || '{c}'"


_TTE = f"""SELECT devid, text || '\n**Trajectory End-Point Information:**\n* **Visuals:**\n    * `last_trajectory_view` (A zoomed-in image of the last few points, marked with red dots, with the green line representing the trajectory)\n* **Stats:**\n    * Overall direction of the last five points: '
    || {direction('b')} || ' (Azimuth: ' || printf('%.2f', round(b, 2)) || '°)\n    * Movement trend of the last ten points: ' || CASE WHEN change > 0.1 THEN 'Speed up' WHEN change < -0.1 THEN 'Slow down' ELSE 'Steady speed' END || '\n    ' || {_overall('    ', '', '    ')} AS text FROM prompts JOIN way USING (devid) JOIN trend USING (devid)"""


@query(with_("part_moves", "steps", "backs", **_PROMPT, **_END, body=_TTE))
def prompt_tte(spark: SparkSession, d: str) -> DataFrame:
    return prompts.arrival_prompt(parts_of(spark, d))


_SIZES = "SELECT devid, seg, min_by(t, seq) AS t1, max_by(t, seq) AS t2 FROM parts GROUP BY devid, seg HAVING count(*) >= 2"
_MOVING = "SELECT devid, seg, sum(dist) AS total_distance, sum(dist) / sum(dt) AS avg_speed, max(speed) AS max_speed, min(speed) AS min_speed, max(accel) AS max_acceleration FROM part_valid GROUP BY devid, seg"
_STATS = " || ".join(f"'    *   **{label}: ' || CAST(round(coalesce({c}, 0.0), 2) AS VARCHAR) || ' **\n'" for label, c in (("Total Distance (meters)", "total_distance"), ("Average Speed (m/s)", "avg_speed"), ("Maximum Speed (m/s)", "max_speed"), ("Minimum Speed (m/s)", "min_speed"), ("Maximum Acceleration (m/s²)", "max_acceleration")))
_TMI = f"SELECT devid, seg, {_HEAD} || '    *   **Start Time: ' || {stamp('t1')} || ' **\n    *   **End Time: ' || {stamp('t2')} || ' **\n    *   **Duration (minutes): ' || CAST(round((t2 - t1) / 60.0, 2) AS VARCHAR) || ' **\n' || {_STATS} || '\n' AS part FROM sizes LEFT JOIN moving USING (devid, seg)"


@query(with_("part_valid", sizes=_SIZES, moving=_MOVING, segs=_TMI, body=f"SELECT devid, {_OPEN} || {_overall(' ' * 12, ' ' * 8, ' ' * 8)} AS text FROM segs GROUP BY devid"))
def prompt_tmi(spark: SparkSession, d: str) -> DataFrame:
    """Two digits, so that engines print the same; the operator's default is full precision."""
    return prompts.mode_prompt(parts_of(spark, d), 2)


_NEXT_ROAD = f"""SELECT devid, 'Relevant trajectory information:\n- Last 5 points direction: ' || {direction('b')} || ' (bearing: ' || printf('%.2f', round(b, 2)) || '°)\n- Last 10 points speed trend: ' || CASE WHEN change > 0.1 THEN 'accelerating' WHEN change < -0.1 THEN 'decelerating' ELSE 'stable speed' END
    || '\n\n- Road segment ID for the last points: ' || road_k || '\n' AS text FROM way JOIN trend USING (devid)"""


@query(with_("steps", "backs", **_END, body=_NEXT_ROAD))
def prompt_mp(spark: SparkSession, d: str) -> DataFrame:
    return prompts.next_road_prompt(points_of(spark, d))


def messages_of(spark: SparkSession, d: str) -> DataFrame:
    slots = prompts.image_slots(consolidated(spark, d)).select(F.col("devid").cast("bigint").alias("devid"), "slot", "description", F.concat(F.lit("file:"), "filename").alias("picture"))
    return prompts.messages(prompts.arrival_prompt(parts_of(spark, d)), slots)


_SLOTTED = """SELECT devid, concat('image', k) AS slot, concat('file:', filename) AS picture, concat('**Segment ', (k + 1) // 2, CASE WHEN k % 2 = 1 THEN ' POI & Route Detail Map:**' ELSE ' Road Network Map:**' END) AS said FROM places WHERE k <= 10
    UNION ALL SELECT devid, 'last_trajectory_view', concat('file:last_trajectory_', devid, '_17.png'), '**End-Point Trajectory View:**' FROM ids
    UNION ALL SELECT devid, 'poi_full_image', concat('file:poi_', devid, '.png'), '**Global POI & Route Detail Map:**' FROM ids
    UNION ALL SELECT devid, 'road_structure_full_image', concat('file:road_structure_', devid, '.png'), '**Global Road Network Map:**' FROM ids"""
_PIECES = "SELECT devid, string_split(regexp_replace(text, '(`[^`]+`)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS pieces, held FROM tte JOIN (SELECT devid, list({'slot': slot, 'picture': picture, 'said': said}) AS held FROM slotted GROUP BY devid) USING (devid)"
# a message is put together piece by piece: `before` says that its last part is text
_JOINED = """SELECT devid, pieces, held, 1 AS i, CAST([] AS STRUCT(type VARCHAR, content VARCHAR)[]) AS said FROM cut_up UNION ALL
    SELECT devid, pieces, held, i + 1, CASE
        WHEN known IS NOT NULL THEN list_append(CASE WHEN before THEN list_append(said[1:len(said) - 1], {'type': 'text', 'content': concat(said[len(said)].content, ' ', known.said, ' ')})
          ELSE list_append(said, {'type': 'text', 'content': concat(known.said, ' ')}) END, {'type': 'image_url', 'content': known.picture})
        WHEN marked THEN list_append(said, {'type': 'text', 'content': piece}) WHEN trim(piece, chr(10) || ' ') = '' THEN said
        WHEN before THEN list_append(said[1:len(said) - 1], {'type': 'text', 'content': concat(said[len(said)].content, piece)}) ELSE list_append(said, {'type': 'text', 'content': piece}) END
    FROM (SELECT *, pieces[i] AS piece, regexp_full_match(pieces[i], '`[^`]+`') AS marked, len(said) > 0 AND said[len(said)].type = 'text' AS before, list_filter(held, lambda h: concat('`', h.slot, '`') = pieces[i])[1] AS known FROM joined WHERE i <= len(pieces))"""
_MESSAGES = {
    **_PROMPT, **_END, "tte": _TTE, "ids": _IDS, "names": _NAMES, "places": "SELECT *, row_number() OVER (PARTITION BY devid ORDER BY filename) AS k FROM names", "slotted": _SLOTTED, "cut_up": _PIECES, "joined": _JOINED,
    "parts_said": "SELECT devid, unnest(range(0, len(said))) AS pos, unnest(said) AS p FROM joined WHERE i > len(pieces)",
}


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query(recursive(with_("part_moves", "steps", "backs", **_MESSAGES, body="SELECT devid, CAST(pos AS BIGINT) AS pos, p.type AS type, p.content AS content FROM parts_said")))
def message_assembly(spark: SparkSession, d: str) -> DataFrame:
    return messages_of(spark, d).drop("slot")


_TOLD = "SELECT devid, concat(count(*), ' parts, ', sum(CASE WHEN p.type = 'text' THEN length(p.content) ELSE 0 END), ' characters, ', count(*) FILTER (p.type <> 'text'), ' pictures') AS response, CAST(NULL AS VARCHAR) AS error_kind, CAST(NULL AS VARCHAR) AS error FROM parts_said GROUP BY devid"


@query(recursive(with_("part_moves", "steps", "backs", **_MESSAGES, body=_TOLD)))
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every message answered by the offline stand-in."""
    return models.answers(messages_of(spark, d), "You estimate arrival times.")


def pictures_of(spark: SparkSession, d: str) -> DataFrame:
    files = consolidated(spark, d).where(catalog.artifact_type(F.col("filename")).isNotNull())
    return files.select(F.col("devid").try_cast("bigint").alias("devid"), "filename", F.concat(F.lit("file:"), "filename").alias("picture"))


_SHOWN = "SELECT devid, CAST(row_number() OVER (PARTITION BY devid ORDER BY filename) AS BIGINT) AS pos, 'image_url' AS type, concat('file:', filename) AS content FROM names WHERE"


@query(with_("points", ids=_IDS, names=_NAMES, body=f"SELECT devid, CAST(0 AS BIGINT) AS pos, 'text' AS type, concat('These are all images for trajectory ', devid, ':') AS content FROM ids UNION ALL {_SHOWN} NOT starts_with(filename, 'last_trajectory_')"))
def anomaly_messages(spark: SparkSession, d: str) -> DataFrame:
    """What the model is asked to find anomalies in: one line, then all pictures but those of end points."""
    asked = points_of(spark, d).select("devid").distinct().select("devid", F.concat(F.lit("These are all images for trajectory "), F.col("devid").cast("string"), F.lit(":")).alias("text"))
    return prompts.gallery(asked, pictures_of(spark, d), False)


@query(with_("steps", "backs", **_END, ids=_IDS, names=_NAMES, body=f"SELECT devid, CAST(0 AS BIGINT) AS pos, 'text' AS type, text AS content FROM ({_NEXT_ROAD}) UNION ALL {_SHOWN} starts_with(filename, 'last_trajectory_') AND devid IN (SELECT devid FROM ({_NEXT_ROAD}))"))
def next_road_messages(spark: SparkSession, d: str) -> DataFrame:
    """What the model is asked for the next road: the prompt, then the views of the end point."""
    return prompts.gallery(prompts.next_road_prompt(points_of(spark, d)), pictures_of(spark, d), True)


def folders(spark: SparkSession, d: str) -> DataFrame:
    """dataset, source_path, folder: result folders of the customers, some anomalous, some of one city, some not named as they should be."""
    key = F.col("c_custkey")
    city = F.element_at(F.array(*map(F.lit, ("Chengdu", "Porto", "Xian", "Beijing"))), (key % 4 + 1).cast("int"))
    odd = key % 5 == 0
    path = F.when(city == "Beijing", "").when(odd, catalog.ANOMALY_PATH).otherwise(catalog.ARRIVAL_PATH)
    folder = F.when(city == "Beijing", text("010_train_", key.cast("string"))).when(key % 11 == 0, text("other_", key.cast("string"))).otherwise(F.when(odd, text("consolidated_anomaly_", key.cast("string"))).otherwise(text("consolidated_", key.cast("string"))))
    return table(spark, d, "customer").select(key.alias("key"), city.alias("dataset"), path.alias("source_path"), folder.alias("folder"))


_FOLDERS = """SELECT c_custkey AS key, ['Chengdu', 'Porto', 'Xian', 'Beijing'][1 + c_custkey % 4] AS dataset, CASE WHEN c_custkey % 4 = 3 THEN '' WHEN c_custkey % 5 = 0 THEN 'Anomaly Detection/consolidated_data' ELSE 'TTE/consolidated_data' END AS source_path,
    CASE WHEN c_custkey % 4 = 3 THEN concat('010_train_', c_custkey) ELSE CAST(c_custkey AS VARCHAR) END AS id, CASE WHEN c_custkey % 4 = 3 THEN 'TMI' WHEN c_custkey % 5 = 0 THEN 'Anomaly Detection' ELSE 'TTE|Anomaly Detection|Mobility Prediction' END AS tasks FROM customer WHERE c_custkey % 4 = 3 OR c_custkey % 11 <> 0"""


@query("SELECT * FROM (VALUES (0, 'Chengdu'), (1, 'Porto'), (2, 'Xian'), (3, 'Beijing')) AS x(place, dataset)")
def catalog_datasets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.datasets(spark)


@query(f"SELECT dataset, id, source_path, tasks FROM ({_FOLDERS})")
def catalog_trajectories(spark: SparkSession, d: str) -> DataFrame:
    return catalog.trajectories(folders(spark, d), spark).select("dataset", "id", "source_path", F.array_join("tasks", "|").alias("tasks"))


@query(f"SELECT dataset, id, tasks FROM ({_FOLDERS})")
def catalog_tasks(spark: SparkSession, d: str) -> DataFrame:
    listed = catalog.trajectories(folders(spark, d), spark)
    return catalog.lookup(listed, listed.select("dataset", "id").distinct(), False).select("dataset", "id", F.array_join("tasks", "|").alias("tasks"))


@query(f"SELECT dataset, folder, id, source_path FROM (SELECT *, CASE WHEN dataset = 'Beijing' THEN concat('010_train_', key) WHEN source_path LIKE 'Anomaly%' THEN concat('consolidated_anomaly_', key) ELSE concat('consolidated_', key) END AS folder FROM ({_FOLDERS}))")
def catalog_folders(spark: SparkSession, d: str) -> DataFrame:
    """The catalog from paths of files, as a listing of the result folders gives them."""
    root = "hdfs://store/results"
    files = folders(spark, d).select(F.concat_ws("/", F.lit(root), "dataset", F.when(F.col("source_path") != "", F.col("source_path")), "folder", F.lit("image_order.json")).alias("path"), "folder")
    listed = catalog.trajectories(files_source.in_sources(files, root).select("dataset", "source_path", "folder").distinct(), spark)
    return listed.select("dataset", F.col("full_name").alias("folder"), "id", "source_path")


def looked_up(spark: SparkSession, d: str) -> DataFrame:
    listed = catalog.trajectories(folders(spark, d), spark)
    asked = listed.select("dataset", "id").distinct().join(F.broadcast(catalog.tasks(spark).select("task")))
    return catalog.lookup(listed, asked, True)


_LOOKED = f"SELECT f.dataset, f.id, f.key, t.task, f.source_path FROM ({_FOLDERS}) f JOIN (VALUES ('TTE'), ('Anomaly Detection'), ('Mobility Prediction'), ('TMI')) AS t(task) ON list_contains(string_split(f.tasks, '|'), t.task)"


@query(f"SELECT dataset, id, task, source_path FROM ({_LOOKED})")
def catalog_lookup(spark: SparkSession, d: str) -> DataFrame:
    return looked_up(spark, d).select("dataset", "id", "task", "source_path")


def result_texts(spark: SparkSession, d: str) -> DataFrame:
    """dataset, folder, filename, text: outputs and prompts of two thirds of the folders."""
    names = [n for t in catalog.TASKS for n in t[1:] if n]
    rows = folders(spark, d).where("key % 3 <> 0").select("dataset", "folder", "key", F.explode(F.array(*map(F.lit, names))).alias("filename"))
    return rows.select("dataset", "folder", "filename", text("text of ", F.col("filename"), " ", F.col("key").cast("string")).alias("text"))


_FILE = "CASE task WHEN 'TTE' THEN 'o4-mini.txt' WHEN 'Anomaly Detection' THEN 'ad-o4-mini.txt' WHEN 'Mobility Prediction' THEN 'mp-o4-mini.txt' ELSE 'o4-mini-v1.txt' END"


@query(f"SELECT dataset, id, task, CASE WHEN key % 3 = 0 THEN 'Output file not found' ELSE concat('text of ', {_FILE}, ' ', key) END AS output FROM ({_LOOKED})")
def catalog_outputs(spark: SparkSession, d: str) -> DataFrame:
    return catalog.outputs(looked_up(spark, d), result_texts(spark, d), spark)


_USER = "CASE task WHEN 'TTE' THEN 'dynamically_generated_stats_prompt.txt' WHEN 'Mobility Prediction' THEN 'dynamically_generated_stats_prompt_MP.txt' END"


_SYSTEM = ", ".join("('{}', '{}', '{}')".format(d, p["task"], p["text"].replace("'", "''")) for p in catalog.read_system_prompts() for d in p["datasets"])


@query(f"SELECT dataset, id, task, system_prompt, CASE WHEN key % 3 <> 0 AND {_USER} IS NOT NULL THEN 'text of ' || {_USER} || ' ' || key END AS user_prompt FROM ({_LOOKED}) LEFT JOIN (VALUES {_SYSTEM}) AS s(dataset, task, system_prompt) USING (dataset, task)")
def catalog_prompts(spark: SparkSession, d: str) -> DataFrame:
    system = catalog.system_prompts(spark).drop("version")
    return catalog.prompts(looked_up(spark, d), result_texts(spark, d), system, spark)
