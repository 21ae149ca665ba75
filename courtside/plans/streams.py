"""Streaming queries: TR as a stream, run until its data are used up, with the same result as in batch."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.operators import features as ft
from courtside.operators import recurrence as rc
from courtside.plans import learned
from courtside.plans import sequences as sq
from courtside.plans.inputs import BY_FRAME, TR, tracks
from courtside.shipping import ship
from courtside.streaming import tracks as live
from courtside.streaming import win_model as wm

r6 = lambda c, n: F.round(c, 6).alias(n)


def _folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir, or a local one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(spark: SparkSession, rows: DataFrame, query) -> DataFrame:
    """Write the rows as files in frame order, read them as a stream, apply ``query``, and wait until all is done."""
    ship(spark)
    folder = _folder(spark)
    rows.repartition("match_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    run = query(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_speed_px(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("match_id", "frame", "x", F.col("y").cast("double").alias("y"), F.lit(30.0).alias("rate"))
    out = drained(spark, t, lambda s: live.stateful(s, "match_id", ["frame"], ["x", "y", "rate"], [None, None, []], live.speed_step, "speed double, smooth_speed double", ["frame"]))
    return out.select("match_id", "frame", r6(F.col("speed"), "speed"), r6(F.col("smooth_speed"), "smooth_speed"))


def stream_change_log(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("match_id", "frame", (F.col("y") % 3).cast("int").alias("read"), "event_type")
    out = drained(spark, t, lambda s: live.stateful(s, "match_id", ["frame"], ["read", "event_type"], [False, []], live.change_step, "changed boolean", ["frame", "read", "event_type"]).filter("changed"))
    return out.select("match_id", "frame", "read", "event_type")


def stream_stable_run(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("match_id", "frame", (F.col("y") % 3).cast("int").alias("read"), (F.col("event_type") != "error").alias("ok"))
    out = drained(spark, t, lambda s: live.stateful(s, "match_id", ["frame"], ["read", "ok"], [[], None, 0, None], live.stable_step, "vote int, stable int", ["frame"]))
    return out.select("match_id", "frame", "stable")


def stream_gate(spark: SparkSession, d: str) -> DataFrame:
    t = sq.scored(spark, d).select("match_id", "frame", "rally_id", "in_play")
    step = lambda state, row: live.gate_step(state, row, seen=2, missing=3)
    out = drained(spark, t, lambda s: live.stateful(s, "match_id", ["frame"], ["rally_id", "in_play"], [-1, None, 0, False], step, "is_active boolean, collects boolean", ["frame", "rally_id"]))
    return out.select("match_id", "rally_id", "frame", "is_active", "collects")


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and day, by event time; each micro-batch writes the counts so far over those before."""
    t = tracks(spark, d).select("match_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "x")
    folder = _folder(spark)
    t.write.parquet(f"{folder}/in")
    counts = spark.readStream.schema(t.schema).parquet(f"{folder}/in").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.max("x").alias("max_x"))
    day = counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "max_x")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")
    run = day.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(day.schema).parquet(f"{folder}/out")


def stream_clamped_sum(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    t = tracks(spark, d).select("match_id", "frame", delta.alias("delta"), (F.col("event_type") == "signup").alias("reset"))
    return drained(spark, t, lambda s: live.stateful(s, "match_id", ["frame"], ["delta", "reset"], [0], live.clamp_step, "score long", ["frame"])).select("match_id", "frame", "score")


def stream_scene_gate(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("match_id", "frame", "x", "conf")
    out = drained(spark, t, lambda s: live.stateful(s, "match_id", ["frame"], ["x", "conf"], ["gameplay", 0], rc.scene_step, "scene string, is_cut boolean, process boolean", ["frame"]))
    return out.select("match_id", "frame", "scene", "is_cut", "process")


def stream_ema(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("match_id", "frame", "x", F.col("y").cast("double").alias("y"), (F.col("event_type") != "error").alias("valid"))
    out = drained(spark, t, lambda s: live.stateful(s, "match_id", ["frame"], ["x", "y", "valid"], [None, None, 0], rc.ema_step, "smooth_x double, smooth_y double, since_valid int", ["frame"]))
    return out.select("match_id", "frame", r6(F.col("smooth_x"), "smooth_x"), r6(F.col("smooth_y"), "smooth_y"), "since_valid")


def stream_corner_tracker(spark: SparkSession, d: str) -> DataFrame:
    step = lambda state, row: tuple(map(list, rc.corner_step(tuple(state), row)))
    out = drained(spark, learned.corner_rows(spark, d), lambda s: live.stateful(s, "match_id", ["frame"], [*rc.CORNERS, "found", "marked"], list(rc.TRACKER), step, rc.CORNER_OUTPUTS, ["frame"]))
    return learned._corners_out(out)


def _live_steps(spark: SparkSession, rows: DataFrame, columns: list[str], start: list, step, outputs: str, keep: list[str]) -> DataFrame:
    return drained(spark, rows, lambda s: live.stateful(s, "match_id", ["frame"], columns, start, step, outputs, keep))


def stream_speed_m(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("match_id", "frame", "x", F.col("y").cast("double").alias("y"), (F.col("event_type") != "error").alias("valid"))
    out = _live_steps(spark, t, ["frame", "x", "y", "valid"], [None, None, None, [], None], live.metric_step, "metric_x double, metric_y double, metric_speed double", ["frame"])
    return out.select("match_id", "frame", r6(F.col("metric_x"), "metric_x"), r6(F.col("metric_y"), "metric_y"), r6(F.col("metric_speed"), "metric_speed"))


def stream_trail(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("match_id", "frame", "x", F.col("y").cast("double").alias("y"))
    out = _live_steps(spark, t, ["x", "y"], [], live.trail_step, "xs array<double>, ys array<double>", ["frame"])
    return out.select("match_id", "frame", F.size("xs").alias("points"), F.get("xs", F.lit(0)).alias("oldest_x"), r6(F.aggregate("xs", F.lit(0.0), lambda s, x: s + x), "sum_x"))


def stream_points(spark: SparkSession, d: str) -> DataFrame:
    """Points as they begin and end: the number of each row's, whether it starts there, and who won the one before."""
    out = _live_steps(spark, sq.scored(spark, d).select("match_id", "frame", "p1", "p2"), ["p1", "p2"], [None, None, 0], live.point_step, "rally_id long, is_start boolean, won_before string", ["frame"])
    return out.select("match_id", "frame", "rally_id", "is_start", "won_before")


def stream_set_debounce(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("match_id", "frame", F.when(F.col("y") % 8 != 0, F.col("y") % 7).alias("sets"), (F.col("event_type") != "error").alias("ok"))
    return _live_steps(spark, t, ["sets", "ok"], [None, 0, None], lambda s, row: live.sets_step(s, row, runs=2), "stable_sets int", ["frame"]).select("match_id", "frame", "stable_sets")


def stream_obscured(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("match_id", "frame", F.col("event_type").isin("view", "error").alias("read"), (F.col("event_type") != "error").alias("ok"))
    return _live_steps(spark, t, ["read", "ok"], [False], live.obscured_step, "obscured boolean", ["frame"]).select("match_id", "frame", "obscured")


def stream_toggle_gate(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("match_id", "frame", (F.col("event_type") == "signup").alias("toggle"))
    return _live_steps(spark, t, ["toggle"], [False], live.toggle_step, "gate_open boolean", ["frame"]).select("match_id", "frame", "gate_open")


def stream_manual_score(spark: SparkSession, d: str) -> DataFrame:
    step = lambda s, row: (list((r := rc.score_step(tuple(s), row))[0]), r[1])
    out = _live_steps(spark, learned.manual_events(spark, d), ["player", "kind", "delta"], [0, 0, 0, 0], step, "p1_score int, p2_score int, p1_sets int, p2_sets int", ["frame"])
    return out.select("match_id", "frame", "p1_score", "p2_score", "p1_sets", "p2_sets")


def stream_rally_stats(spark: SparkSession, d: str) -> DataFrame:
    t = sq.point_samples(spark, d).select("match_id", "frame", "rally_id", "speed", "zone")
    outputs = ", ".join(["live_mean_speed double, live_max_speed double", *(f"live_zone_{z} long" for z in range(9))])
    return sq._stats_out(_live_steps(spark, t, ["rally_id", "speed", "zone"], live.LIVE_STATS, live.stats_step, outputs, ["frame", "rally_id"]))


def stream_speed_reset(spark: SparkSession, d: str) -> DataFrame:
    """Speeds whose track history starts anew at each signup, as it does at a scene's cut."""
    t = tracks(spark, d).select("match_id", "frame", "x", F.col("y").cast("double").alias("y"), F.lit(30.0).alias("rate"), (F.col("event_type") == "signup").alias("cut"))
    step = live.reset_at(live.speed_step, [None, None, []])
    out = drained(spark, t, lambda s: live.stateful(s, "match_id", ["frame"], ["x", "y", "rate", "cut"], [None, None, []], step, "speed double, smooth_speed double", ["frame"]))
    return out.select("match_id", "frame", r6(F.col("speed"), "speed"), r6(F.col("smooth_speed"), "smooth_speed"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """Events as poses of two players and as the ball's rows, and an end row per match, through the live predictor."""
    s = sq.scored(spark, d)
    rows = s.select(
        "match_id", "rally_id", "frame", (F.col("player") + 1).alias("player_id"), F.col("x").alias("hand"), F.col("conf").alias("com"), (F.col("y") - 50).alias("torso"), (F.col("x") * 2).alias("elbow"),
        F.col("conf").alias("visible"), (F.col("event_type") != "error").alias("flies"), F.col("x").alias("speed"),
    )
    rows = rows.unionByName(rows.groupBy("match_id").agg((F.max("frame") + 1).alias("frame")), allowMissingColumns=True)
    step = lambda state, row: live.predict_step(state, row, lambda v: 1 / (1 + math.exp(-v[0] / 100)))
    columns = ["rally_id", "frame", "player_id", "hand", "com", "torso", "elbow", "visible", "flies", "speed"]
    outputs = ", ".join(["ended long", *(f"{c} double" for c in ft.RALLY_FEATURES), "probability double"])
    return drained(spark, rows, lambda s: live.stateful(s, "match_id", ["frame"], columns, live.PREDICTOR, step, outputs, ["frame", "rally_id"]))


def stream_rally_features(spark: SparkSession, d: str) -> DataFrame:
    """The eight features of each rally as it ends; the last one of a match is flushed by the end row."""
    out = _predicted(spark, d).filter("ended is not null")
    return out.select("match_id", F.col("ended").alias("rally_id"), *(r6(F.col(c), c) for c in ft.RALLY_FEATURES[:-1]), F.col("rally_duration_frames").cast("long").alias("rally_duration_frames"))


def stream_chances(spark: SparkSession, d: str) -> DataFrame:
    """The chance in force at each frame: that of the last rally that ended, even before the first."""
    return _predicted(spark, d).filter("rally_id is not null").select("match_id", "frame", r6(F.col("probability"), "probability"))


#: A model of a few of the nineteen values, which SQL can say too.
_LIVE = wm.Linear([0.0] * 19, [1.0] * 19, [0.01] + [0.0] * 7 + [0.005] + [0.0] * 7 + [0.05, 0.0, -0.001], 0.1)


def _live_model(spark: SparkSession, d: str) -> DataFrame:
    """Events through the live win model: odd frames come first, even ones in a later micro-batch, end rows with the latter."""
    ship(spark)
    s = sq.pose_events(spark, d).withColumn("reset", F.lit(False))
    ends = s.groupBy("match_id").agg((F.max("frame") + 1).alias("frame"))
    # a row of no match far ahead moves the watermark over all others
    ahead = spark.range(1).select(F.lit(-1).cast("long").alias("match_id"), F.lit(400_000_000).cast("int").alias("frame"))
    rows = s.unionByName(ends, allowMissingColumns=True).unionByName(ahead, allowMissingColumns=True).withColumn("ts", F.timestamp_seconds(F.col("frame")))
    folder, files = _folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in (1, 0):
        rows.filter((F.col("frame") % 2 == part) | (F.lit(part == 0) & F.col("rally_id").isNull())).repartition(files, "match_id").write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    run = wm.predicted(stream, _LIVE, keep=["frame", "rally_id"], delay="3650 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_win_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The nineteen values of every point, as it ends."""
    out = _live_model(spark, d).filter("ended is not null")
    return out.select("match_id", F.col("ended").alias("rally_id"), *(F.round(F.get("vector", F.lit(i)), 9).alias(c) for i, c in enumerate(ft.MODEL_FEATURES)))


def stream_win_chances(spark: SparkSession, d: str) -> DataFrame:
    """The model's answer in force at each frame."""
    out = _live_model(spark, d).filter("rally_id is not null")
    return out.select("match_id", "frame", *(F.round(c, 9).alias(c) for c in ("player1_win_prob", "player2_win_prob", "confidence")), "model_ready")


QUERIES = {f.__name__: f for f in (
    stream_win_vectors, stream_win_chances, stream_corner_tracker, stream_speed_m, stream_trail, stream_points, stream_set_debounce, stream_obscured, stream_toggle_gate, stream_manual_score, stream_rally_stats, stream_speed_px, stream_change_log, stream_stable_run, stream_gate, stream_window_counts, stream_clamped_sum, stream_scene_gate, stream_ema, stream_speed_reset, stream_rally_features, stream_chances,
)}
ORACLES = {
    "stream_win_vectors": f"{sq.VECTORS} SELECT * FROM vectors",
    "stream_win_chances": f"""{sq.VECTORS}, c AS (SELECT match_id, rally_id, lag(1 / (1 + exp(-(0.1::DOUBLE + 0.01::DOUBLE * hand_speed_diff + 0.005::DOUBLE * hand_speed_diff_last3 + 0.05::DOUBLE * score_diff - 0.001::DOUBLE * rally_number)))) OVER (PARTITION BY match_id ORDER BY rally_id) AS p FROM vectors)
SELECT match_id, frame, round(coalesce(p, 0.5), 9) AS player1_win_prob, round(1 - coalesce(p, 0.5), 9) AS player2_win_prob, round(abs(coalesce(p, 0.5) - 0.5) * 2, 9) AS confidence, p IS NOT NULL AS model_ready FROM scored JOIN c USING (match_id, rally_id)""",
    "stream_speed_px": sq.SPEED_PX,
    "stream_change_log": sq.ORACLES["change_log"],
    "stream_stable_run": sq.STABLE,
    "stream_gate": sq.GATE,
    "stream_window_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, max(value) AS max_x FROM events GROUP BY ALL",
    "stream_clamped_sum": sq.ORACLES["clamped_sum"],
    "stream_scene_gate": learned.SCENE,
    "stream_ema": learned.EMA,
    "stream_speed_m": sq.SPEED_M,
    "stream_trail": sq.ORACLES["trail"],
    "stream_points": f"""WITH {sq.SCORED}, b AS (SELECT *, lag(p1) OVER w AS b1, lag(p2) OVER w AS b2 FROM scored WINDOW w AS ({BY_FRAME}))
SELECT match_id, frame, rally_id, is_start, CASE WHEN is_start THEN CASE WHEN p1 <> b1 AND p2 IS NOT DISTINCT FROM b2 THEN 'p1' WHEN p1 = b1 AND p2 IS DISTINCT FROM b2 THEN 'p2' ELSE 'unknown' END END AS won_before FROM b""",
    "stream_set_debounce": sq.SETS,
    "stream_obscured": sq.ORACLES["obscured_flags"],
    "stream_toggle_gate": sq.ORACLES["toggle_gate"],
    "stream_manual_score": learned.MANUAL,
    "stream_rally_stats": sq.ORACLES["live_rally_stats"],
    "stream_corner_tracker": learned.TRACKER_SQL,
    "stream_speed_reset": f"""WITH {TR}, e AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER ({BY_FRAME}) AS part FROM tr), s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) * 30 AS speed FROM e WINDOW w AS (PARTITION BY match_id, part ORDER BY frame))
SELECT match_id, frame, round(speed, 6) AS speed, round(coalesce(avg(speed) OVER (PARTITION BY match_id, part ORDER BY frame ROWS 4 PRECEDING), 0), 6) AS smooth_speed FROM s""",
    "stream_rally_features": sq.MODEL_FEATURES,
    "stream_chances": f"""{sq.MODEL_SIDES}, c AS (SELECT match_id, rally_id, lag(1 / (1 + exp(-hand / 100))) OVER (PARTITION BY match_id ORDER BY rally_id) AS p FROM side)
SELECT match_id, frame, round(coalesce(p, 0.5), 6) AS probability FROM scored JOIN c USING (match_id, rally_id)""",
}
