"""Metrics, splits, folds and scaling on labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.operators import metrics as mt
from courtside.operators import ranking as rk
from courtside.plans.inputs import TR, table, tracks

r6 = lambda c, n: F.round(c, 6).alias(n)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, label, score, prediction: quality against the text's length."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("score"))
    return docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", F.col("quality").alias("label"), "score", (F.col("score") > 1500).cast("int").alias("prediction"))


LABELLED = "lb AS (SELECT doc_id, lang, quality AS label, n_chars AS score, (n_chars > 1500)::INTEGER AS prediction FROM documents JOIN labels USING (doc_id))"
METRICS = """round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return mt.binary_metrics(labelled(spark, d), ["lang"], "label", "prediction")


def auc(spark: SparkSession, d: str) -> DataFrame:
    return mt.roc_auc(labelled(spark, d), "label", "score", F.floor(F.col("score") / 256))


def mean_iou(spark: SparkSession, d: str) -> DataFrame:
    return mt.mean_iou(tracks(spark, d).withColumns({"label": (F.col("y") % 4).cast("int"), "prediction": (F.col("event_id") % 5 % 4).cast("int")}), "label", "prediction")


def value_presence(spark: SparkSession, d: str) -> DataFrame:
    """How often each event type occurs, as a class number from a small map, 0 for types that it lacks."""
    classes = F.create_map(*(F.lit(v) for pair in (("view", 1), ("click", 2), ("purchase", 3)) for v in pair))
    t = tracks(spark, d).withColumn("cls", F.coalesce(F.try_element_at(classes, F.col("event_type")), F.lit(0)))
    return t.groupBy("cls", "event_type").agg(F.count("*").alias("n"))


def most_common(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value of each event type, the smallest of those that tie."""
    return rk.most_common(tracks(spark, d), ["event_type"], "y")


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return rk.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1}).select("doc_id", "split", "rank")


def capped_split(spark: SparkSession, d: str) -> DataFrame:
    return rk.hash_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", {"train": 0.8, "val": 0.2}, seed=7, cap=3000).select("o_orderkey", "split")


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    s = hash_split(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return s.groupBy("split").agg(F.count("*").alias("docs"), F.count("quality").alias("labels"))


def time_split(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return rk.time_split(o, F.year("o_orderdate") * 12 + F.month("o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


def group_fold(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return rk.group_folds(o, "o_custkey", "label", bucket=F.floor(F.col("o_custkey") / 4096))


FOLDS = """WITH g AS (SELECT o_custkey, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_positive FROM orders GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY n_positive DESC, n_rows DESC, o_custkey) - 1 AS k FROM g)
SELECT o_custkey, n_rows, n_positive, (CASE WHEN k % 6 < 3 THEN k % 6 ELSE 5 - k % 6 END)::INTEGER AS fold FROM r"""


def stratified_fold(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return rk.stratified_folds(o, "o_custkey", "label")


def _stratified_sql() -> str:
    """Groups one after the other, a and b being the negatives and positives that the folds hold; then each kind's quotas in order of hash."""
    cost = lambda i: f"{{'cost': a[{i + 1}] * (k.n_rows - k.n_positive)::HUGEINT * hv + b[{i + 1}] * k.n_positive::HUGEINT * lt, 'rows': a[{i + 1}] + b[{i + 1}], 'fold': {i}}}"
    at = f"list_sort([{', '.join(cost(i) for i in range(3))}])[1].fold"
    add = lambda c, v: f"[{', '.join(f'{c}[{i + 1}] + CASE WHEN pick = {i} THEN {v} ELSE 0 END' for i in range(3))}]"
    return f"""WITH RECURSIVE g AS MATERIALIZED (SELECT o_custkey, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_positive FROM orders GROUP BY o_custkey),
 t AS MATERIALIZED (SELECT greatest(1, sum(n_positive))::HUGEINT * greatest(1, sum(n_positive)) AS hv, greatest(1, sum(n_rows - n_positive))::HUGEINT * greatest(1, sum(n_rows - n_positive)) AS lt FROM g),
 k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY abs(2 * n_positive - n_rows) DESC, n_rows DESC, n_positive DESC, o_custkey) AS i FROM g),
 s AS (SELECT 0::BIGINT AS i, 0::BIGINT AS n_rows, 0::BIGINT AS n_positive, -1 AS pick, [0, 0, 0]::HUGEINT[] AS a, [0, 0, 0]::HUGEINT[] AS b
  UNION ALL
  SELECT i, n_rows, n_positive, pick, {add("a", "n_rows - n_positive")}, {add("b", "n_positive")} FROM (SELECT k.i, k.n_rows, k.n_positive, a, b, {at} AS pick FROM s JOIN k ON k.i = s.i + 1 CROSS JOIN t)),
 f AS (SELECT n_rows, n_positive, pick AS fold, row_number() OVER (PARTITION BY n_rows, n_positive ORDER BY pick) AS place FROM s WHERE i > 0),
 h AS (SELECT *, row_number() OVER (PARTITION BY n_rows, n_positive ORDER BY md5('0|' || o_custkey), o_custkey) AS place FROM g)
SELECT o_custkey, h.n_rows, h.n_positive, f.fold::INTEGER AS fold FROM h JOIN f ON f.n_rows = h.n_rows AND f.n_positive = h.n_positive AND f.place = h.place"""


def standardise(spark: SparkSession, d: str) -> DataFrame:
    return mt.standardised(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars"], population=True).select("doc_id", r6(F.col("n_chars_std"), "n_chars_std"))


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return mt.latency(table(spark, d, "events"), ["event_type"], "value", rate=30.0)


def fusion_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights in proportion to two predictors' accuracies, to four places."""
    lb = labelled(spark, d)
    acc = lambda p: F.avg((F.col("label") == p).cast("double"))
    both = lb.agg(acc(F.col("prediction")).alias("one"), acc((F.col("score") > 800).cast("int")).alias("two"))
    return both.select(r6(F.col("one"), "accuracy_one"), r6(F.col("two"), "accuracy_two"), F.round(F.col("one") / (F.col("one") + F.col("two")), 4).alias("weight_one"), F.round(F.col("two") / (F.col("one") + F.col("two")), 4).alias("weight_two"))


def fold_means(spark: SparkSession, d: str) -> DataFrame:
    """Each language as a fold: the metrics' means over the folds that have both classes."""
    folds = mt.binary_metrics(labelled(spark, d), ["lang"], "label", "prediction").filter("tp + fn > 0 and fp + tn > 0")
    return folds.agg(F.count("*").alias("folds"), *(r6(F.avg(m), f"mean_{m}") for m in ("accuracy", "precision", "recall", "f1")))


CONFUSION = f"WITH {LABELLED}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM lb GROUP BY lang), k AS (SELECT lang, n, tp, fp, fn, tn, {METRICS} FROM c)"

QUERIES = {f.__name__: f for f in (confusion, auc, mean_iou, value_presence, most_common, hash_split, capped_split, split_counts, time_split, group_fold, stratified_fold, standardise, latency_stats, fusion_weights, fold_means)}
ORACLES = {
    "confusion": f"{CONFUSION} SELECT * FROM k",
    "auc": f"WITH {LABELLED} SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, round((SELECT sum(CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5::DOUBLE ELSE 0 END) FROM lb p, lb q WHERE p.label = 1 AND q.label = 0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM lb",
    "mean_iou": f"WITH {TR}, p AS (SELECT y % 4 AS a, event_id % 5 % 4 AS b FROM tr), c AS (SELECT v, count(*) FILTER (a = v AND b = v) AS i, count(*) FILTER (a = v OR b = v) AS u FROM p, (VALUES (0), (1), (2), (3)) t(v) GROUP BY v) SELECT round(avg(i / u), 6) AS mean_iou, count(*) AS classes FROM c WHERE u > 0",
    "value_presence": "SELECT CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS cls, event_type, count(*) AS n FROM events GROUP BY ALL",
    "hash_split": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS rank, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rank <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rank <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split, rank FROM r",
    "capped_split": "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) AS rank, least(count(*) OVER (), 3000) AS n FROM orders) SELECT o_orderkey, CASE WHEN rank <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r WHERE rank <= 3000",
    "split_counts": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS rank, count(*) OVER () AS n FROM documents) SELECT CASE WHEN rank <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rank <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split, count(*) AS docs, count(quality) AS labels FROM r LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "time_split": "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rank, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN rank <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r",
    "group_fold": FOLDS,
    "most_common": f"WITH {TR}, c AS (SELECT event_type, y, count(*) AS n FROM tr GROUP BY ALL) SELECT event_type, min(y) AS y, n FROM c WHERE (event_type, n) IN (SELECT (event_type, max(n)) FROM c GROUP BY event_type) GROUP BY event_type, n",
    "stratified_fold": _stratified_sql(),
    "standardise": "SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER (), 6) AS n_chars_std FROM documents",
    "latency_stats": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(count(*) * 1000 / sum(value), 6) AS per_second, round(count(*) * 1000 / sum(value) / 30, 6) AS real_time_ratio FROM events GROUP BY event_type",
    "fusion_weights": f"WITH {LABELLED}, a AS (SELECT avg((label = prediction)::INTEGER) AS one, avg((label = (score > 800)::INTEGER)::INTEGER) AS two FROM lb) SELECT round(one, 6) AS accuracy_one, round(two, 6) AS accuracy_two, round(one / (one + two), 4) AS weight_one, round(two / (one + two), 4) AS weight_two FROM a",
    "fold_means": f"""{CONFUSION} SELECT count(*) AS folds, round(avg(accuracy), 6) AS mean_accuracy, round(avg("precision"), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1 FROM k WHERE tp + fn > 0 AND fp + tn > 0""",
}
