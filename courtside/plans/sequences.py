"""Window and sequence queries on TR."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from courtside.functions import fusion as fz
from courtside.operators import features as ft
from courtside.operators import joins as jn
from courtside.operators import rallies as ra
from courtside.operators import windows as win
from courtside.plans.inputs import BY_FRAME, TR, table, tracks

KEYS, ORDER = ["match_id"], ["frame"]
r6 = lambda c, n: F.round(c, 6).alias(n)


def _ok():
    return F.col("event_type") != "error"


def speed_px(spark: SparkSession, d: str) -> DataFrame:
    out = win.pixel_speed(tracks(spark, d), KEYS, ORDER, "frame", "x", "y", 30.0)
    return out.select("match_id", "frame", r6(F.col("speed"), "speed"), r6(F.col("smooth_speed"), "smooth_speed"))


SPEED_PX = f"""WITH {TR}, s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) * 30 AS speed FROM tr WINDOW w AS ({BY_FRAME}))
SELECT match_id, frame, round(speed, 6) AS speed, round(coalesce(avg(speed) OVER ({BY_FRAME} ROWS 4 PRECEDING), 0), 6) AS smooth_speed FROM s"""


def speed_m(spark: SparkSession, d: str) -> DataFrame:
    out = win.metric_speed(tracks(spark, d), KEYS, ORDER, "frame", "x", "y", _ok(), 1.0, limit=40.0)
    return out.select("match_id", "frame", r6(F.col("metric_x"), "metric_x"), r6(F.col("metric_y"), "metric_y"), r6(F.col("metric_speed"), "metric_speed"))


SPEED_M = f"""WITH {TR}, v AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) / (frame - lag(frame) OVER w) AS step FROM tr WHERE event_type <> 'error' WINDOW w AS ({BY_FRAME})),
 g AS (SELECT match_id, frame, quantile_cont(step, 0.5) OVER ({BY_FRAME} ROWS 4 PRECEDING) AS speed FROM v WHERE step <= 40),
 j AS (SELECT tr.*, g.speed, tr.event_type <> 'error' AS ok FROM tr LEFT JOIN g USING (match_id, frame))
SELECT match_id, frame, round(last_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER w, 6) AS metric_x, round(last_value(CASE WHEN ok THEN y::DOUBLE END IGNORE NULLS) OVER w, 6) AS metric_y, round(last_value(speed IGNORE NULLS) OVER w, 6) AS metric_speed
FROM j WINDOW w AS ({BY_FRAME} ROWS UNBOUNDED PRECEDING)"""


def trail(spark: SparkSession, d: str) -> DataFrame:
    out = win.trail(tracks(spark, d), KEYS, ORDER, ["x", "y"], 30)
    sums = F.aggregate("trail", F.lit(0.0), lambda s, p: s + p["x"])
    return out.select("match_id", "frame", F.size("trail").alias("points"), F.col("trail")[0]["x"].alias("oldest_x"), r6(sums, "sum_x"))


def rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    return win.rolling_rate(tracks(spark, d), KEYS, ORDER, "x").select("match_id", "frame", r6(F.col("rolling_mean"), "rolling_mean"), r6(F.col("rolling_rate"), "rolling_rate"))


def running_max(spark: SparkSession, d: str) -> DataFrame:
    return win.running_max(tracks(spark, d), KEYS, ORDER, "x").select("match_id", "frame", "running_max")


def pose_velocity(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).withColumn("px", F.when(_ok(), F.col("x")))
    return win.velocity(t, ["match_id", "player"], ORDER, "frame", "px", "y", 30.0).select("match_id", "player", "frame", r6(F.col("velocity"), "velocity"))


def epoch(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).withColumn("epoch", win.epoch(F.col("event_type") == "signup", KEYS, ORDER))
    out = win.pixel_speed(t, ["match_id", "epoch"], ORDER, "frame", "x", "y", 30.0)
    return out.select("match_id", "frame", F.col("epoch").cast("long").alias("epoch"), r6(F.col("speed"), "speed"))


EPOCH = f"""WITH {TR}, e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({BY_FRAME}) AS epoch FROM tr)
SELECT match_id, frame, epoch::BIGINT AS epoch, round(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) * 30, 6) AS speed FROM e WINDOW w AS (PARTITION BY match_id, epoch ORDER BY frame)"""


def freeze_after(spark: SparkSession, d: str) -> DataFrame:
    return win.freeze_after(tracks(spark, d), KEYS, ORDER, "frame", F.col("event_type") == "signup", 8).select("match_id", "frame", "event_type")


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).withColumn("read", (F.col("y") % 3).cast("int"))


def vote(spark: SparkSession, d: str) -> DataFrame:
    return win.vote(_reads(spark, d), KEYS, ORDER, "read", _ok()).select("match_id", "frame", "vote")


VOTES = f"""{TR}, o AS (SELECT *, y % 3 AS rd, event_type <> 'error' AS ok FROM tr),
 l AS (SELECT match_id, frame, list(rd) OVER ({BY_FRAME} ROWS 4 PRECEDING) AS rs FROM o WHERE ok),
 c AS (SELECT match_id, frame, list_max(list_transform(list_distinct(rs), lambda v: {{'n': len(list_filter(rs, lambda q: q = v)), 'place': -list_position(rs, v), 'v': v}})) AS best, len(rs) AS n FROM l),
 votes AS (SELECT o.*, CASE WHEN n >= 3 AND best.n >= 2 THEN best.v END AS vote FROM o LEFT JOIN c USING (match_id, frame))"""


def stable_run(spark: SparkSession, d: str) -> DataFrame:
    voted = win.vote(_reads(spark, d), KEYS, ORDER, "read", _ok())
    return win.stable_run(voted, KEYS, ORDER, "vote", _ok(), runs=4).select("match_id", "frame", "stable")


STABLE = f"""WITH {VOTES}, b AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER ({BY_FRAME}) AS breaks FROM votes),
 k AS (SELECT *, last_value(vote IGNORE NULLS) OVER (PARTITION BY match_id, breaks ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b),
 i AS (SELECT *, sum(CASE WHEN vote IS NOT NULL AND vote IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, breaks ORDER BY frame) AS island FROM k),
 n AS (SELECT *, count(vote) OVER (PARTITION BY match_id, breaks, island ORDER BY frame) AS run FROM i)
SELECT match_id, frame, last_value(CASE WHEN vote IS NOT NULL AND run >= 4 THEN vote END IGNORE NULLS) OVER ({BY_FRAME} ROWS UNBOUNDED PRECEDING) AS stable FROM n"""


def tumbling_vote(spark: SparkSession, d: str) -> DataFrame:
    blocks = win.tumbling_vote(_reads(spark, d), KEYS, ORDER, "read", 3).filter("vote is not null")
    return win.change_log(blocks, KEYS, ["block"], ["vote"]).select("match_id", F.col("block").cast("long").alias("block"), "vote")


TUMBLING = f"""WITH {TR}, b AS (SELECT match_id, (frame - 1) // 3 AS block, list(y % 3 ORDER BY frame) AS r FROM tr GROUP BY ALL),
 v AS (SELECT match_id, block, CASE WHEN r[1] = r[2] OR r[1] = r[3] THEN r[1] WHEN r[2] = r[3] THEN r[2] END AS vote FROM b WHERE len(r) = 3),
 c AS (SELECT *, lag(vote) OVER (PARTITION BY match_id ORDER BY block) AS prev FROM v WHERE vote IS NOT NULL)
SELECT match_id, block::BIGINT AS block, vote FROM c WHERE vote IS DISTINCT FROM prev"""


def change_log(spark: SparkSession, d: str) -> DataFrame:
    return win.change_log(_reads(spark, d), KEYS, ORDER, ["read", "event_type"]).select("match_id", "frame", "read", "event_type")


def toggle_gate(spark: SparkSession, d: str) -> DataFrame:
    return win.toggle_gate(tracks(spark, d), KEYS, ORDER, F.col("event_type") == "signup").select("match_id", "frame", "gate_open")


def clamped_sum(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    out = win.clamped_sum(tracks(spark, d).withColumn("delta", delta), KEYS, ORDER, "delta", F.col("event_type") == "signup")
    return out.select("match_id", "frame", F.col("score").cast("long").alias("score"))


CLAMPED = f"""WITH {TR}, e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS delta, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({BY_FRAME}) AS epoch FROM tr),
 s AS (SELECT *, sum(delta) OVER w AS total FROM e WINDOW w AS (PARTITION BY match_id, epoch ORDER BY frame))
SELECT match_id, frame, (total - least(0, min(total) OVER (PARTITION BY match_id, epoch ORDER BY frame)))::BIGINT AS score FROM s"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """TR with a stable pair (running counts of purchases and signups, known from the first of each), its points and the gate's input."""
    t = tracks(spark, d)
    count = lambda kind: F.sum(F.when(F.col("event_type") == kind, 1)).over(win.along(KEYS, ORDER).rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    t = t.withColumns({"p1": count("purchase"), "p2": count("signup"), "in_play": F.col("event_type").isin("view", "click", "purchase")})
    return ra.point_rows(t, KEYS, ORDER, "p1", "p2").withColumn("rally_id", F.col("rally_id").cast("long"))


SCORED = f"""{TR}, p AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 END) OVER ({BY_FRAME})::BIGINT AS p1, sum(CASE WHEN event_type = 'signup' THEN 1 END) OVER ({BY_FRAME})::BIGINT AS p2,
  event_type IN ('view', 'click', 'purchase') AS in_play FROM tr),
 q AS (SELECT *, coalesce(lag(p1) OVER w IS NOT NULL AND p1 IS NOT NULL AND (p1 IS DISTINCT FROM lag(p1) OVER w OR p2 IS DISTINCT FROM lag(p2) OVER w), false) AS is_start FROM p WINDOW w AS ({BY_FRAME})),
 scored AS (SELECT *, sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER ({BY_FRAME})::BIGINT AS rally_id FROM q)"""


def rallies(spark: SparkSession, d: str) -> DataFrame:
    """match_id, rally_id, start_frame, end_frame, winner, and the start scores p1, p2 of each point; the last one is open."""
    return ra.point_spans(scored(spark, d), KEYS, "frame", ["p1", "p2"]).withColumnRenamed("first_frame", "start_frame").drop("last_frame")


RALLIES = f"""{SCORED}, b AS (SELECT *, lag(p1) OVER w AS b1, lag(p2) OVER w AS b2 FROM scored WINDOW w AS ({BY_FRAME})),
 f AS (SELECT match_id, rally_id, min(frame) AS start_frame, arg_max({{'a': p1, 'b': p2}}, frame) FILTER (is_start OR (b1 IS NULL AND p1 IS NOT NULL AND p2 IS NOT NULL)) AS s,
  max(CASE WHEN is_start THEN CASE WHEN p1 <> b1 AND p2 IS NOT DISTINCT FROM b2 THEN 'p1' WHEN p1 = b1 AND p2 IS DISTINCT FROM b2 THEN 'p2' ELSE 'unknown' END END) AS won FROM b GROUP BY ALL),
 rallies AS (SELECT match_id, rally_id, start_frame, lead(start_frame) OVER w AS end_frame, coalesce(lead(won) OVER w, 'unknown') AS winner, s.a AS p1, s.b AS p2 FROM f WINDOW w AS (PARTITION BY match_id ORDER BY rally_id))"""


def _ball(spark: SparkSession, d: str) -> DataFrame:
    """Up to two positions of a frame, in metres: on the table, beside it, or unknown; errors have no speed."""
    t = tracks(spark, d).select("match_id", "frame", "x", "y", "conf", "player", "event_type")
    one = t.select("match_id", "frame", F.when(F.col("event_type") != "signup", F.col("conf") * 3 - 0.15).alias("x_m"), (F.col("y") % 16 / 10.0 - 0.05).alias("y_m"), F.when(_ok(), F.col("x") / 7).alias("speed_mps"))
    two = t.filter("player = 1").select("match_id", "frame", (F.col("y") % 40 / 10.0 - 0.6).alias("x_m"), (F.col("conf") * 1.5).alias("y_m"), (F.col("x") / 11).alias("speed_mps"))
    return one.unionByName(two)


def rally_records(spark: SparkSession, d: str) -> DataFrame:
    """The rally log of TR: sets are counts of clicks, errors skip the running point in some frames and take it back in others."""
    event = F.when((F.col("event_type") == "error") & (F.col("frame") % 3 == 0), ra.SKIP).when((F.col("event_type") == "error") & (F.col("frame") % 3 == 1), ra.UNDO)
    clicks = F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).over(win.along(KEYS, ORDER))
    frames = scored(spark, d).select("match_id", "frame", (F.col("frame") / 30.0).alias("timestamp_sec"), "p1", "p2", clicks.alias("s1"), F.col("player").alias("s2"), (F.col("frame") % 50 != 7).alias("ok"), event.alias("event"))
    return ra.rally_records(frames, _ball(spark, d), KEYS, scores=("p1", "p2"), sets=("s1", "s2"), calibrated="ok", event="event", seen=2, missing=3)


_ON = "x_m BETWEEN -0.1 AND 2.84 AND y_m BETWEEN -0.1 AND 1.625"
RECORDS = f"""WITH {RALLIES}, ball AS (SELECT match_id, frame, CASE WHEN event_type <> 'signup' THEN conf * 3 - 0.15::DOUBLE END AS x_m, y % 16 / 10.0::DOUBLE - 0.05::DOUBLE AS y_m, CASE WHEN event_type <> 'error' THEN x / 7 END AS speed FROM tr
  UNION ALL SELECT match_id, frame, y % 40 / 10.0::DOUBLE - 0.6::DOUBLE, conf * 1.5::DOUBLE, x / 11 FROM tr WHERE player = 1),
 play AS (SELECT match_id, frame, bool_or(CASE WHEN frame % 50 <> 7 THEN coalesce({_ON}, false) ELSE x_m IS NOT NULL END) AS playing FROM ball GROUP BY ALL),
 r AS (SELECT s.*, playing, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame) AS s1, player AS s2, lag(p1) OVER (PARTITION BY match_id ORDER BY frame) AS b1,
  CASE WHEN event_type = 'error' AND frame % 3 = 0 THEN 'skip' WHEN event_type = 'error' AND frame % 3 = 1 THEN 'undo' END AS said FROM scored s JOIN play USING (match_id, frame)),
 t AS (SELECT *, CASE WHEN playing IS NOT DISTINCT FROM lag(playing) OVER w THEN 0 ELSE 1 END AS turn FROM r WINDOW w AS (PARTITION BY match_id, rally_id ORDER BY frame)),
 i AS (SELECT *, sum(turn) OVER (PARTITION BY match_id, rally_id ORDER BY frame) AS island FROM t),
 l AS (SELECT *, row_number() OVER (PARTITION BY match_id, rally_id, island ORDER BY frame) AS n FROM i),
 a AS (SELECT *, coalesce(last_value(CASE WHEN playing AND n >= 2 THEN true WHEN NOT playing AND n >= 3 THEN false END IGNORE NULLS) OVER (PARTITION BY match_id, rally_id ORDER BY frame ROWS UNBOUNDED PRECEDING), false) AS open FROM l),
 c AS (SELECT *, playing AND coalesce(lag(open) OVER (PARTITION BY match_id, rally_id ORDER BY frame), false) AS takes, max(CASE WHEN said = 'skip' THEN frame END) OVER (PARTITION BY match_id, rally_id) AS cut,
  coalesce(arg_max(said, frame) FILTER (said IS NOT NULL) OVER (PARTITION BY match_id, rally_id) = 'skip', false) AS skipped FROM a),
 k AS (SELECT c.match_id, c.rally_id, CASE WHEN speed > 0 THEN speed END AS up, CASE WHEN {_ON} THEN least(2, floor(greatest(0, least(1.525::DOUBLE, y_m)) / (1.525::DOUBLE / 3))) * 3 + least(2, floor(greatest(0, least(2.74::DOUBLE, x_m)) / (2.74::DOUBLE / 3))) END AS zone
  FROM c JOIN ball b ON b.match_id = c.match_id AND b.frame = c.frame WHERE takes AND c.frame % 50 <> 7 AND NOT skipped AND (cut IS NULL OR c.frame > cut) AND x_m IS NOT NULL),
 z AS (SELECT match_id, rally_id, avg(up) AS m, max(up) AS h, CASE WHEN count(up) > 1 THEN stddev_pop(up) END AS s, {", ".join(f"count(*) FILTER (zone = {n}) AS z{n}" for n in range(9))} FROM k GROUP BY ALL),
 e AS (SELECT match_id, rally_id, max(frame) AS last, max(skipped) AS skipped, arg_max(coalesce(p1, -1), frame) >= 0 AS known, arg_max({{'a': s1, 'b': s2}}, frame) FILTER (is_start OR (b1 IS NULL AND p1 IS NOT NULL AND p2 IS NOT NULL)) AS s FROM c GROUP BY ALL)
SELECT match_id, rally_id::INTEGER AS rally_id, CASE WHEN rally_id = 0 THEN 0 ELSE start_frame END::BIGINT AS rally_start_frame, coalesce(end_frame, last)::BIGINT AS rally_end_frame, CASE WHEN rally_id = 0 THEN 0 ELSE start_frame / 30.0::DOUBLE END AS rally_start_time,
 coalesce(end_frame, last) / 30.0::DOUBLE AS rally_end_time, p1::INTEGER AS p1_score_start, p2::INTEGER AS p2_score_start, e.s.a::INTEGER AS p1_sets_start, e.s.b::INTEGER AS p2_sets_start, round(m, 4) AS mean_speed_mps, round(h, 4) AS max_speed_mps, round(z.s, 4) AS speed_std_mps,
 {", ".join(f"coalesce(z{n}, 0)::INTEGER AS landing_zone_{n}" for n in range(9))}, winner AS point_winner, e.skipped::INTEGER AS skipped
FROM rallies JOIN e USING (match_id, rally_id) LEFT JOIN z USING (match_id, rally_id) WHERE end_frame IS NOT NULL OR known"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    return rallies(spark, d)


def gate(spark: SparkSession, d: str) -> DataFrame:
    out = win.gate(scored(spark, d), ["match_id", "rally_id"], ORDER, F.col("in_play"), seen=2, missing=3)
    return out.select("match_id", "rally_id", "frame", "is_active", "collects")


GATE = f"""WITH {SCORED}, t AS (SELECT *, CASE WHEN in_play IS NOT DISTINCT FROM lag(in_play) OVER w THEN 0 ELSE 1 END AS turn FROM scored WINDOW w AS (PARTITION BY match_id, rally_id ORDER BY frame)),
 i AS (SELECT *, sum(turn) OVER (PARTITION BY match_id, rally_id ORDER BY frame) AS island FROM t),
 l AS (SELECT *, row_number() OVER (PARTITION BY match_id, rally_id, island ORDER BY frame) AS n FROM i),
 a AS (SELECT *, coalesce(last_value(CASE WHEN in_play AND n >= 2 THEN true WHEN NOT in_play AND n >= 3 THEN false END IGNORE NULLS) OVER (PARTITION BY match_id, rally_id ORDER BY frame ROWS UNBOUNDED PRECEDING), false) AS is_active FROM l)
SELECT match_id, rally_id, frame, is_active, in_play AND coalesce(lag(is_active) OVER (PARTITION BY match_id, rally_id ORDER BY frame), false) AS collects FROM a"""


def in_play(spark: SparkSession, d: str) -> DataFrame:
    """Per hour of a match: any position on the table, and the fastest one."""
    t = tracks(spark, d).withColumn("slot", F.floor(F.col("frame") / 5))
    return t.groupBy("match_id", "slot").agg(F.bool_or(F.col("event_type").isin("view", "click", "purchase")).alias("in_play"), F.max("x").alias("max_x")).withColumn("slot", F.col("slot").cast("long"))


def rally_stats(spark: SparkSession, d: str) -> DataFrame:
    """Speeds above 0 of each rally: mean, max, and population deviation, null for a single one."""
    s = win.pixel_speed(scored(spark, d), KEYS, ORDER, "frame", "x", "y", 1.0)
    up = F.when(F.col("speed") > 0, F.col("speed"))
    return s.groupBy("match_id", "rally_id").agg(F.count(up).alias("n"), r6(F.avg(up), "mean_speed"), r6(F.max(up), "max_speed"), r6(F.when(F.count(up) > 1, F.stddev_pop(up)), "speed_std"))


RALLY_STATS = f"""WITH {SCORED}, s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS speed FROM scored WINDOW w AS ({BY_FRAME})), u AS (SELECT match_id, rally_id, CASE WHEN speed > 0 THEN speed END AS u FROM s)
SELECT match_id, rally_id, count(u) AS n, round(avg(u), 6) AS mean_speed, round(max(u), 6) AS max_speed, round(CASE WHEN count(u) > 1 THEN stddev_pop(u) END, 6) AS speed_std FROM u GROUP BY ALL"""


def zone_pivot(spark: SparkSession, d: str) -> DataFrame:
    """How often each of nine zones was hit in a rally, 0 for none."""
    zone = F.col("y") % 9
    return scored(spark, d).groupBy("match_id", "rally_id").agg(*(F.count_if(zone == z).alias(f"landing_zone_{z}") for z in range(9)))


def digit_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Digits of a slot, read from left to right: the first two make a number of at most 30; confidence over all of them."""
    t = tracks(spark, d).withColumns({"slot": F.floor(F.col("frame") / 3).cast("long"), "digit": F.col("y") % 12}).filter("digit <= 9")
    read = t.groupBy("match_id", "slot").agg(F.array_sort(F.collect_list(F.struct("x", "frame", "digit"))).alias("all"), F.count("*").alias("n"), r6(F.avg("conf"), "mean_conf"), F.min("conf").alias("min_conf"))
    number = F.array_join(F.transform(F.slice("all", 1, 2), lambda s: s["digit"].cast("string")), "").try_cast("int")
    return read.select("match_id", "slot", F.when(number <= 30, number).alias("number"), "n", "mean_conf", "min_conf")


DIGITS = f"""WITH {TR}, g AS (SELECT match_id, (frame // 3)::BIGINT AS slot, list((y % 12)::VARCHAR ORDER BY x, frame) AS ds, count(*) AS n, round(avg(conf), 6) AS mean_conf, min(conf) AS min_conf FROM tr WHERE y % 12 <= 9 GROUP BY ALL),
 h AS (SELECT *, CASE WHEN len(ds) > 1 THEN ds[1] || ds[2] ELSE ds[1] END::INTEGER AS number FROM g) SELECT match_id, slot, CASE WHEN number <= 30 THEN number END AS number, n, mean_conf, min_conf FROM h"""


def two_sided_read(spark: SparkSession, d: str) -> DataFrame:
    """A scoreboard's two numbers, left and right of its centre; both must be there, each at most 30."""
    t = tracks(spark, d).withColumns({"slot": F.floor(F.col("frame") / 6).cast("long"), "digit": F.col("y") % 10, "side": F.when(F.col("player") == 0, "left").otherwise("right")})
    two = lambda side: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("x", "frame", "digit")))), 1, 2), lambda s: s["digit"].cast("string")), "").try_cast("int").alias(f"{side}_score")
    return t.groupBy("match_id", "slot").agg(two("left"), two("right")).filter("left_score <= 30 and right_score <= 30")


TWO_SIDED = f"""WITH {TR}, g AS (SELECT match_id, (frame // 6)::BIGINT AS slot, list((y % 10)::VARCHAR ORDER BY x, frame) FILTER (player = 0) AS l, list((y % 10)::VARCHAR ORDER BY x, frame) FILTER (player = 1) AS r FROM tr GROUP BY ALL),
 h AS (SELECT match_id, slot, (l[1] || coalesce(l[2], ''))::INTEGER AS left_score, (r[1] || coalesce(r[2], ''))::INTEGER AS right_score FROM g WHERE l IS NOT NULL AND r IS NOT NULL) SELECT * FROM h WHERE left_score <= 30 AND right_score <= 30"""


def match_winner(spark: SparkSession, d: str) -> DataFrame:
    last = scored(spark, d).groupBy("match_id").agg(F.max_by(F.struct("p1", "p2"), "frame").alias("s"))
    return last.select("match_id", F.when(F.col("s.p1") > F.col("s.p2"), 1).otherwise(0).alias("label"))


def range_join(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each rally, both ends included, so that a boundary frame belongs to two rallies."""
    found = jn.range_join(tracks(spark, d).select("match_id", "frame", "x"), rallies(spark, d).withColumn("end_frame", F.coalesce("end_frame", F.lit(2**31 - 1))).filter("end_frame < 2147483647"), KEYS, "frame", "start_frame", "end_frame", 16)
    return found.groupBy("match_id", "rally_id").agg(F.count("*").alias("frames"), r6(F.sum("x"), "sum_x"))


def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase's value at each click, else 0."""
    t = tracks(spark, d)
    bought = t.filter("event_type = 'purchase'").select("match_id", "frame", F.col("x").alias("price"), F.col("y").alias("units"))
    return jn.asof_join(t.filter("event_type = 'click'").select("match_id", "frame", "x"), bought, KEYS, "frame", ["price", "units"], {"price": 0.0, "units": 0})


ASOF = f"""WITH {TR} SELECT c.match_id, c.frame, c.x, coalesce(b.x, 0) AS price, coalesce(b.y, 0) AS units FROM (SELECT * FROM tr WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM tr WHERE event_type = 'purchase') b ON c.match_id = b.match_id AND c.frame >= b.frame"""


def locf(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).withColumn("pose", F.when(F.col("event_type") == "view", F.col("x")))
    return jn.locf(t, KEYS, ORDER, {"pose": "last_pose"}).select("match_id", "frame", "last_pose")


def best_box(spark: SparkSession, d: str) -> DataFrame:
    """The most confident box of each slot, held until the next one that is confident enough."""
    t = tracks(spark, d).withColumn("slot", F.floor(F.col("frame") / 3).cast("long"))
    best = t.groupBy("match_id", "slot").agg(F.max(F.struct("conf", "frame", "x")).alias("b"))
    best = best.select("match_id", "slot", F.when(F.col("b.conf") >= 0.6, F.col("b.x")).alias("box_x"))
    return jn.locf(best, KEYS, ["slot"], {"box_x": "held_x"}).select("match_id", "slot", "held_x")


def rally_features(spark: SparkSession, d: str) -> DataFrame:
    """Player differences of each rally from two sides that are summed on their own, then joined."""
    s = scored(spark, d)
    pose = s.groupBy("match_id", "rally_id").agg(*(r6(F.coalesce(F.avg(F.when(F.col("player") == 0, F.col(c))), F.lit(0.0)) - F.coalesce(F.avg(F.when(F.col("player") == 1, F.col(c))), F.lit(0.0)), f"{c}_diff") for c in ("x", "y")))
    ball = s.filter(_ok()).groupBy("match_id", "rally_id").agg(r6(F.avg("conf"), "conf_mean"), F.max("conf").alias("conf_max"), (F.max("frame") - F.min("frame")).alias("duration"))
    return jn.left_default(pose, ball, ["match_id", "rally_id"], {"conf_mean": 0.0, "conf_max": 0.0, "duration": 0})


FEATURES = f"""{SCORED}, pose AS (SELECT match_id, rally_id, round(coalesce(avg(x) FILTER (player = 0), 0) - coalesce(avg(x) FILTER (player = 1), 0), 6) AS x_diff, round(coalesce(avg(y) FILTER (player = 0), 0) - coalesce(avg(y) FILTER (player = 1), 0), 6) AS y_diff FROM scored GROUP BY ALL),
 ball AS (SELECT match_id, rally_id, round(avg(conf), 6) AS conf_mean, max(conf) AS conf_max, max(frame) - min(frame) AS duration FROM scored WHERE event_type <> 'error' GROUP BY ALL),
 features AS (SELECT match_id, rally_id, x_diff, y_diff, coalesce(conf_mean, 0) AS conf_mean, coalesce(conf_max, 0) AS conf_max, coalesce(duration, 0) AS duration FROM pose LEFT JOIN ball USING (match_id, rally_id))"""


def expanding(spark: SparkSession, d: str) -> DataFrame:
    out = win.expanding(rally_features(spark, d), KEYS, ["rally_id"], ["x_diff", "conf_mean"])
    return out.select("match_id", "rally_id", *(F.round(c, 9).alias(c) for c in ("x_diff_mean", "conf_mean_mean", "x_diff_last3", "conf_mean_last3")), F.col("row_in_key").alias("rally_number"))


EXPANDING = f"""WITH {FEATURES} SELECT match_id, rally_id, round(avg(x_diff) OVER a, 9) AS x_diff_mean, round(avg(conf_mean) OVER a, 9) AS conf_mean_mean, round(avg(x_diff) OVER b, 9) AS x_diff_last3, round(avg(conf_mean) OVER b, 9) AS conf_mean_last3, (row_number() OVER a)::INTEGER AS rally_number
FROM features WINDOW a AS (PARTITION BY match_id ORDER BY rally_id ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY match_id ORDER BY rally_id ROWS 2 PRECEDING)"""

def rally_model_features(spark: SparkSession, d: str) -> DataFrame:
    """The eight features of each rally: events as poses of two players, those without errors as the ball's rows."""
    s = scored(spark, d)
    pose = s.select("match_id", "rally_id", (F.col("player") + 1).alias("player_id"), F.col("x").alias("v_hand_speed"), F.col("conf").alias("com_height"), (F.col("y") - 50).alias("v_torso_x"), (F.col("x") * 2).alias("angle_elbow_dom"), F.col("conf").alias("visibility_mean"))
    out = ft.rally_features(pose, s.filter(_ok()).withColumnRenamed("x", "speed_mps"), KEYS + ["rally_id"])
    return out.select("match_id", "rally_id", *(r6(F.col(c), c) for c in ft.RALLY_FEATURES[:-1]), "rally_duration_frames")


_SIDES = lambda agg, v: f"coalesce({agg}({v}) FILTER (player = 0), 0) - coalesce({agg}({v}) FILTER (player = 1), 0)"
MODEL_SIDES = f"""WITH {SCORED}, side AS (SELECT match_id, rally_id, {_SIDES("avg", "x")} AS hand, {_SIDES("stddev_samp", "conf")} AS com, {_SIDES("avg", "abs(y - 50)")} AS move, {_SIDES("avg", "x * 2")} AS elbow,
  (coalesce(avg(conf) FILTER (player = 0), 0) + coalesce(avg(conf) FILTER (player = 1), 0)) / 2 AS vis FROM scored GROUP BY ALL),
 flight AS (SELECT match_id, rally_id, avg(x) AS mean, max(x) AS most, max(frame) - min(frame) AS frames FROM scored WHERE event_type <> 'error' GROUP BY ALL)"""
MODEL_FEATURES = f"""{MODEL_SIDES}
SELECT match_id, rally_id, round(hand, 6) AS hand_speed_diff, round(com, 6) AS com_std_diff, round(move, 6) AS movement_diff, round(elbow, 6) AS elbow_diff, round(vis, 6) AS visibility_avg,
 round(coalesce(mean, 0), 6) AS ball_speed_mean, round(coalesce(most, 0), 6) AS ball_speed_max, coalesce(frames, 0)::BIGINT AS rally_duration_frames FROM side LEFT JOIN flight USING (match_id, rally_id)"""


def pose_events(spark: SparkSession, d: str) -> DataFrame:
    """TR's events as poses of two players with the score at each."""
    return scored(spark, d).select(
        "match_id", "rally_id", "frame", (F.col("player") + 1).alias("player_id"), F.col("x").alias("hand"), F.col("conf").alias("com"), (F.col("y") - 50).alias("torso"), (F.col("x") * 2).alias("elbow"), F.col("conf").alias("visible"),
        _ok().alias("flies"), F.col("x").alias("speed"), F.col("p1").cast("int").alias("p1_score"), F.col("p2").cast("int").alias("p2_score"), F.col("player").alias("p1_sets"), (F.col("y") % 3).alias("p2_sets"),
    )


def win_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The nineteen values of every point: the score is that of the row that ends it, or of the match's last row."""
    s = pose_events(spark, d)
    pose = s.select("match_id", "rally_id", "player_id", F.col("hand").alias("v_hand_speed"), F.col("com").alias("com_height"), F.col("torso").alias("v_torso_x"), F.col("elbow").alias("angle_elbow_dom"), F.col("visible").alias("visibility_mean"))
    eight = ft.rally_features(pose, s.filter("flies").withColumnRenamed("speed", "speed_mps"), [*KEYS, "rally_id"])
    score = F.struct("p1_score", "p2_score", "p1_sets", "p2_sets")
    ends = s.groupBy("match_id", "rally_id").agg(F.min_by(score, "frame").alias("first"), F.max_by(score, "frame").alias("last"))
    ends = ends.withColumn("end", F.coalesce(F.lead("first").over(win.along(KEYS, ["rally_id"])), "last")).select("match_id", "rally_id", "end.*")
    out = ft.model_features(eight.join(ends, ["match_id", "rally_id"]), KEYS, "rally_id", ("p1_score", "p2_score"), ("p1_sets", "p2_sets"))
    return out.select("match_id", "rally_id", *(F.round(c, 9).alias(c) for c in ft.MODEL_FEATURES))


def _vectors_sql() -> str:
    eight = dict(zip(ft.RALLY_FEATURES, ("hand", "com", "move", "elbow", "vis", "coalesce(mean, 0)", "coalesce(most, 0)", "coalesce(frames, 0)"), strict=True))
    means = ", ".join(f"round(avg({c}) OVER a, 9) AS {c}, round(avg({c}) OVER b, 9) AS {c}_last3" for c in eight)
    return f"""{MODEL_SIDES}, eight AS (SELECT match_id, rally_id, {", ".join(f"({v})::DOUBLE AS {c}" for c, v in eight.items())} FROM side LEFT JOIN flight USING (match_id, rally_id)),
 edges AS (SELECT match_id, rally_id, arg_min({{'p1': p1, 'p2': p2, 's1': player, 's2': y % 3}}, frame) AS head, arg_max({{'p1': p1, 'p2': p2, 's1': player, 's2': y % 3}}, frame) AS tail FROM scored GROUP BY ALL),
 ends AS (SELECT match_id, rally_id, coalesce(lead(head) OVER (PARTITION BY match_id ORDER BY rally_id), tail) AS e FROM edges),
 vectors AS (SELECT match_id, rally_id, {means}, (coalesce(e.p1, 0) - coalesce(e.p2, 0) + 11 * (e.s1 - e.s2))::DOUBLE AS score_diff, (coalesce(e.p1, 0) + coalesce(e.p2, 0) + 11 * (e.s1 + e.s2))::DOUBLE AS total_points,
  (row_number() OVER a)::DOUBLE AS rally_number FROM eight JOIN ends USING (match_id, rally_id) WINDOW a AS (PARTITION BY match_id ORDER BY rally_id ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY match_id ORDER BY rally_id ROWS 2 PRECEDING))"""


VECTORS = _vectors_sql()


def pose_velocities(spark: SparkSession, d: str) -> DataFrame:
    """A player's hand, torso and centre of mass against the pose before; errors lack the hand, signups the torso."""
    t = tracks(spark, d).withColumns({"hx": F.when(_ok(), F.col("x")), "hy": F.col("y").cast("double"), "torso": F.when(F.col("event_type") != "signup", F.col("x") - 50), "com": F.col("conf")})
    out = win.pose_velocities(t, ["match_id", "player"], ORDER, "frame", 30.0, {"v_hand_speed": ("hx", "hy")}, {"v_torso_x": "torso", "v_com_y": "com"})
    return out.select("match_id", "player", "frame", *(r6(F.col(c), c) for c in ("v_hand_speed", "v_torso_x", "v_com_y")))


VELOCITIES = f"""WITH {TR}, p AS (SELECT *, CASE WHEN event_type <> 'error' THEN x END AS hx, CASE WHEN event_type <> 'signup' THEN x - 50 END AS torso FROM tr),
 v AS (SELECT *, (frame - lag(frame) OVER w) / 30.0::DOUBLE AS dt, hx - lag(hx) OVER w AS dx, y - lag(y) OVER w AS dy, torso - lag(torso) OVER w AS dt_x, conf - lag(conf) OVER w AS dc FROM p WINDOW w AS (PARTITION BY match_id, player ORDER BY frame))
SELECT match_id, player, frame, round(sqrt(dx * dx + dy * dy) / dt, 6) AS v_hand_speed, round(dt_x / dt, 6) AS v_torso_x, round(dc / dt, 6) AS v_com_y FROM v"""


def point_samples(spark: SparkSession, d: str) -> DataFrame:
    """TR by points; the gate's collected rows are samples with a speed and a zone."""
    g = win.gate(scored(spark, d), ["match_id", "rally_id"], ORDER, F.col("in_play"), seen=2, missing=3)
    return g.withColumns({"speed": F.when(F.col("collects"), F.col("x")), "zone": F.when(F.col("collects"), (F.col("y") % 9).cast("int"))})


def _stats_out(out: DataFrame) -> DataFrame:
    return out.select("match_id", "rally_id", "frame", F.round("live_mean_speed", 9).alias("live_mean_speed"), "live_max_speed", *(F.col(f"live_zone_{z}").cast("long").alias(f"live_zone_{z}") for z in range(9)))


def live_rally_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats_out(ra.live_stats(point_samples(spark, d), ["match_id", "rally_id"], ORDER, F.col("speed"), F.col("zone")))


LIVE = f"""{GATE.replace("SELECT match_id, rally_id, frame, is_active, in_play AND", ", g AS (SELECT *, in_play AND", 1)}),
 u AS (SELECT *, CASE WHEN collects AND x > 0 THEN x END AS up, CASE WHEN collects THEN y % 9 END AS zone FROM g),
 live AS (SELECT match_id, rally_id, frame, is_active, event_type, x, y, conf, p1, p2, player, round(avg(up) OVER w, 9) AS live_mean_speed, max(up) OVER w AS live_max_speed, {", ".join(f"count(*) FILTER (zone = {z}) OVER w AS live_zone_{z}" for z in range(9))} FROM u WINDOW w AS (PARTITION BY match_id, rally_id ORDER BY frame))"""


def packets(spark: SparkSession, d: str) -> DataFrame:
    """Live packets, flattened again: their ball, score, running rally and one player's pose."""
    s = win.trail(win.pixel_speed(ra.live_stats(point_samples(spark, d), ["match_id", "rally_id"], ORDER, F.col("speed"), F.col("zone")), KEYS, ORDER, "frame", "x", "y", 30.0), KEYS, ORDER, ["x", "y"], 5)
    began = F.min("frame").over(Window.partitionBy("match_id", "rally_id"))
    s = s.withColumns({"timestamp_sec": F.col("frame") / 30.0, "lasted": F.when(F.col("is_active"), (F.col("frame") - began) / 30.0)})
    ball = {"detected": _ok(), "position_px": F.struct("x", "y"), "speed_pps": F.col("smooth_speed"), "trajectory_px": F.col("trail")}
    score = {"player1_score": F.col("p1"), "player2_score": F.col("p2"), "score_reliable": F.when(F.col("event_type") == "error", False)}
    rally = {"is_active": F.col("is_active"), "rally_id": F.col("rally_id"), "rally_duration_sec": F.col("lasted"), "mean_speed_mps": F.col("live_mean_speed"), "max_speed_mps": F.col("live_max_speed"), "landing_zones": F.array(*(f"live_zone_{z}" for z in range(9)))}
    pose = F.struct(F.col("conf").alias("visibility_mean"), F.col("x").alias("debug_landmarks"))
    p = ft.packets(s, KEYS, ball, score, rally, tuple(F.when(F.col("player") == i, pose) for i in (0, 1)))
    return p.select(
        "match_id", "packet.frame_idx", r6(F.col("packet.timestamp_sec"), "timestamp_sec"), "packet.ball.detected", "packet.ball.position_px.x", r6(F.col("packet.ball.speed_pps"), "speed_pps"), F.size("packet.ball.trajectory_px").alias("points"),
        "packet.score.player1_score", "packet.score.player2_sets", "packet.score.sets_to_win", "packet.score.score_reliable", "packet.rally.is_active", r6(F.col("packet.rally.rally_duration_sec"), "rally_duration_sec"), "packet.rally.max_speed_mps",
        F.col("packet.rally.landing_zones")[4].alias("zone_4"), F.col("packet.pose.player1.visibility_mean").alias("visibility_1"), F.col("packet.pose.player2.visibility_mean").alias("visibility_2"), F.size(F.map_keys(F.from_json(F.to_json("packet.pose.player1"), "map<string,string>"))).alias("pose_fields"),
    )


PACKETS = f"""{LIVE}, s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) * 30 AS speed, min(frame) OVER (PARTITION BY match_id, rally_id) AS began FROM live WINDOW w AS ({BY_FRAME}))
SELECT match_id, frame AS frame_idx, round(frame / 30.0::DOUBLE, 6) AS timestamp_sec, event_type <> 'error' AS detected, CASE WHEN event_type <> 'error' THEN x END AS x, CASE WHEN event_type <> 'error' THEN round(coalesce(avg(speed) OVER ({BY_FRAME} ROWS 4 PRECEDING), 0), 6) END AS speed_pps,
 CASE WHEN event_type <> 'error' THEN least(frame, 5) END::INTEGER AS points, p1 AS player1_score, 0 AS player2_sets, 3 AS sets_to_win, event_type <> 'error' AS score_reliable, is_active, CASE WHEN is_active THEN round((frame - began) / 30.0::DOUBLE, 6) ELSE 0 END AS rally_duration_sec,
 live_max_speed AS max_speed_mps, live_zone_4 AS zone_4, CASE WHEN player = 0 THEN conf END AS visibility_1, CASE WHEN player = 1 THEN conf END AS visibility_2, CASE WHEN player = 0 THEN 1 END AS pose_fields FROM s"""


def set_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Set counts of which every eighth is missing and some are impossible, held for two reads."""
    t = tracks(spark, d).withColumn("sets", F.when(F.col("y") % 8 != 0, F.col("y") % 7))
    return win.stable_sets(t, KEYS, ORDER, "sets", _ok(), runs=2).select("match_id", "frame", "stable_sets")


SETS = f"""WITH {TR}, t AS (SELECT match_id, frame, CASE WHEN event_type <> 'error' AND y % 8 <> 0 AND y % 7 <= 5 THEN y % 7 END AS v FROM tr),
 u AS (SELECT *, CASE WHEN v = lag(v) OVER ({BY_FRAME}) THEN v END AS held FROM t)
SELECT match_id, frame, last_value(held IGNORE NULLS) OVER ({BY_FRAME} ROWS UNBOUNDED PRECEDING) AS stable_sets FROM u"""


def obscured_flags(spark: SparkSession, d: str) -> DataFrame:
    """Views and errors are reads, errors obscured ones."""
    out = win.obscured(tracks(spark, d), KEYS, ORDER, F.col("event_type").isin("view", "error"), _ok())
    return out.select("match_id", "frame", "obscured")


def calibration_in_force(spark: SparkSession, d: str) -> DataFrame:
    """Signups mark the table anew, those with a small y wrongly; each click has the last mark that is valid."""
    t = tracks(spark, d)
    marks = t.filter("event_type = 'signup'").select("match_id", "frame", F.col("x").alias("left"), F.col("y").alias("top"))
    return ft.calibration_at(t.filter("event_type = 'click'").select("match_id", "frame"), marks, KEYS, "frame", ["left", "top"], F.col("top") >= 20)


def profile_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The last live value of each match beside its player's balance, for the two thirds of the matches that have one."""
    live = tracks(spark, d).groupBy("match_id").agg(F.max_by("conf", "frame").alias("live"))
    career = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("match_id"), (F.col("c_acctbal") / 10000).alias("p"))
    out = ft.with_profile(live, career, KEYS, "p")
    fused = fz.fused(F.col("live"), F.col("profile_probability"), F.lit(0.5))["probability"]
    return out.select("match_id", "live", r6(F.col("profile_probability"), "profile_probability"), "has_profile", r6(fused, "probability"))


QUERIES = {f.__name__: f for f in (
    rally_model_features, win_vectors, pose_velocities, live_rally_stats, packets, set_debounce, obscured_flags, calibration_in_force, profile_fusion, speed_px, speed_m, trail, rolling_rate, running_max, pose_velocity, epoch, freeze_after, vote, stable_run, tumbling_vote, change_log, toggle_gate, clamped_sum, segments, rally_records, gate, in_play, rally_stats,
    zone_pivot, digit_assembly, two_sided_read, match_winner, range_join, asof_join, locf, best_box, rally_features, expanding,
)}
ORACLES = {
    "rally_model_features": MODEL_FEATURES,
    "win_vectors": f"{VECTORS} SELECT * FROM vectors",
    "pose_velocities": VELOCITIES,
    "live_rally_stats": f"{LIVE} SELECT * EXCLUDE (is_active, event_type, x, y, conf, p1, p2, player) FROM live",
    "packets": PACKETS,
    "set_debounce": SETS,
    "obscured_flags": f"WITH {TR} SELECT match_id, frame, coalesce(last_value(CASE event_type WHEN 'view' THEN false WHEN 'error' THEN true END IGNORE NULLS) OVER ({BY_FRAME} ROWS UNBOUNDED PRECEDING), false) AS obscured FROM tr",
    "calibration_in_force": f'WITH {TR} SELECT c.match_id, c.frame, m.x AS "left", m.y AS top FROM (SELECT * FROM tr WHERE event_type = \'click\') c ASOF LEFT JOIN (SELECT * FROM tr WHERE event_type = \'signup\' AND y >= 20) m ON c.match_id = m.match_id AND c.frame >= m.frame',
    "profile_fusion": f"WITH {TR}, l AS (SELECT match_id, arg_max(conf, frame) AS live FROM tr GROUP BY ALL), p AS (SELECT match_id, live, CASE WHEN match_id % 3 <> 0 THEN c_acctbal / 10000 END AS q FROM l LEFT JOIN customer ON c_custkey = match_id) SELECT match_id, live, round(q, 6) AS profile_probability, q IS NOT NULL AS has_profile, round(coalesce(0.6::DOUBLE * live + 0.4::DOUBLE * q, live), 6) AS probability FROM p",
    "speed_px": SPEED_PX,
    "speed_m": SPEED_M,
    "trail": f"WITH {TR} SELECT match_id, frame, count(*) OVER w AS points, first_value(x) OVER w AS oldest_x, round(sum(x) OVER w, 6) AS sum_x FROM tr WINDOW w AS ({BY_FRAME} ROWS 29 PRECEDING)",
    "rolling_rate": f"WITH {TR}, m AS (SELECT match_id, frame, avg(x) OVER ({BY_FRAME} ROWS 29 PRECEDING) AS m FROM tr) SELECT match_id, frame, round(m, 6) AS rolling_mean, round(CASE WHEN m <> 0 THEN 1 / m END, 6) AS rolling_rate FROM m",
    "running_max": f"WITH {TR} SELECT match_id, frame, max(x) OVER ({BY_FRAME}) AS running_max FROM tr",
    "pose_velocity": f"WITH {TR}, p AS (SELECT *, CASE WHEN event_type <> 'error' THEN x END AS px FROM tr) SELECT match_id, player, frame, round(sqrt((px - lag(px) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) / ((frame - lag(frame) OVER w) / 30.0::DOUBLE), 6) AS velocity FROM p WINDOW w AS (PARTITION BY match_id, player ORDER BY frame)",
    "epoch": EPOCH,
    "freeze_after": f"WITH {TR}, s AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN frame END IGNORE NULLS) OVER ({BY_FRAME} ROWS UNBOUNDED PRECEDING) AS swap FROM tr) SELECT match_id, frame, event_type FROM s WHERE swap IS NULL OR frame >= swap + 8",
    "vote": f"WITH {VOTES} SELECT match_id, frame, vote FROM votes",
    "stable_run": STABLE,
    "tumbling_vote": TUMBLING,
    "change_log": f"WITH {TR}, c AS (SELECT *, y % 3 AS rd FROM tr), k AS (SELECT *, lag(rd) OVER w AS r0, lag(event_type) OVER w AS e0 FROM c WINDOW w AS ({BY_FRAME})) SELECT match_id, frame, rd AS read, event_type FROM k WHERE frame = 1 OR rd IS DISTINCT FROM r0 OR event_type IS DISTINCT FROM e0",
    "toggle_gate": f"WITH {TR} SELECT match_id, frame, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({BY_FRAME}) % 2 = 1 AS gate_open FROM tr",
    "clamped_sum": CLAMPED,
    "segments": f"WITH {RALLIES} SELECT * FROM rallies",
    "rally_records": RECORDS,
    "gate": GATE,
    "in_play": f"WITH {TR} SELECT match_id, (frame // 5)::BIGINT AS slot, bool_or(event_type IN ('view', 'click', 'purchase')) AS in_play, max(x) AS max_x FROM tr GROUP BY ALL",
    "rally_stats": RALLY_STATS,
    "zone_pivot": f"WITH {SCORED} SELECT match_id, rally_id, " + ", ".join(f"count(*) FILTER (y % 9 = {z}) AS landing_zone_{z}" for z in range(9)) + " FROM scored GROUP BY ALL",
    "digit_assembly": DIGITS,
    "two_sided_read": TWO_SIDED,
    "match_winner": f"WITH {SCORED}, l AS (SELECT match_id, arg_max({{'a': p1, 'b': p2}}, frame) AS s FROM scored GROUP BY ALL) SELECT match_id, CASE WHEN s.a > s.b THEN 1 ELSE 0 END AS label FROM l",
    "range_join": f"WITH {RALLIES} SELECT r.match_id, r.rally_id, count(*) AS frames, round(sum(t.x), 6) AS sum_x FROM rallies r JOIN tr t ON t.match_id = r.match_id AND t.frame BETWEEN r.start_frame AND r.end_frame GROUP BY ALL",
    "asof_join": ASOF,
    "locf": f"WITH {TR} SELECT match_id, frame, last_value(CASE WHEN event_type = 'view' THEN x END IGNORE NULLS) OVER ({BY_FRAME} ROWS UNBOUNDED PRECEDING) AS last_pose FROM tr",
    "best_box": f"WITH {TR}, b AS (SELECT match_id, (frame // 3)::BIGINT AS slot, max({{'c': conf, 'f': frame, 'x': x}}) AS b FROM tr GROUP BY ALL) SELECT match_id, slot, last_value(CASE WHEN b.c >= 0.6 THEN b.x END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS held_x FROM b",
    "rally_features": f"WITH {FEATURES} SELECT * FROM features",
    "expanding": EXPANDING,
}
