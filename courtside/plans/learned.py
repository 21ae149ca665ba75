"""Recurrences, ratings and models: queries that SQL can't express, and a scene machine that it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.operators import features as ft
from courtside.operators import fold_fits as ff
from courtside.operators import learning as ml
from courtside.operators import ratings as rt
from courtside.operators import recurrence as rc
from courtside.operators import windows as win
from courtside.plans.inputs import MH, TR, history, table, tracks
from courtside.shared import stored
from courtside.shipping import ship

r6 = lambda c, n: F.round(c, 6).alias(n)


def scene_gate(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    out = rc.scene_gate(tracks(spark, d).select("match_id", "frame", "x", "conf"), ["match_id"], ["frame"], "x", "conf")
    return out.select("match_id", "frame", "scene", "is_cut", "process")


SCENE = f"""WITH RECURSIVE {TR}, s AS (
 SELECT match_id, 0 AS frame, 'gameplay' AS scene, 0 AS waited, false AS is_cut, false AS process FROM (SELECT DISTINCT match_id FROM tr)
 UNION ALL
 SELECT t.match_id, t.frame,
  CASE WHEN s.scene = 'gameplay' THEN CASE WHEN t.x > 30 THEN 'cut' ELSE 'gameplay' END WHEN s.scene = 'cut' OR s.waited + 1 >= 15 THEN CASE WHEN t.conf >= 0.04 THEN 'gameplay' ELSE 'other' END ELSE s.scene END,
  CASE WHEN s.scene = 'gameplay' OR s.scene = 'cut' OR s.waited + 1 >= 15 THEN 0 ELSE s.waited + 1 END,
  CASE WHEN s.scene = 'gameplay' THEN false WHEN s.scene = 'cut' OR s.waited + 1 >= 15 THEN t.conf >= 0.04 ELSE false END,
  CASE WHEN s.scene = 'gameplay' THEN NOT t.x > 30 WHEN s.scene = 'cut' OR s.waited + 1 >= 15 THEN t.conf >= 0.04 ELSE false END
 FROM s JOIN tr t ON t.match_id = s.match_id AND t.frame = s.frame + 1)
SELECT match_id, frame, scene, is_cut, process FROM s WHERE frame > 0"""


def skipped_frames(spark: SparkSession, d: str) -> DataFrame:
    return scene_gate(spark, d).groupBy("match_id").agg(F.count_if(~F.col("process")).alias("skipped"), F.count_if("is_cut").alias("cuts"))


def ema(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    t = tracks(spark, d).select("match_id", "frame", "x", F.col("y").cast("double").alias("y"), (F.col("event_type") != "error").alias("valid"))
    return rc.smoothed(t, ["match_id"], ["frame"], "x", "y", "valid").select("match_id", "frame", r6(F.col("smooth_x"), "smooth_x"), r6(F.col("smooth_y"), "smooth_y"), "since_valid")


_FAR = "NOT t.ok OR (s.x IS NOT NULL AND sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2) > 50)"
EMA = f"""WITH RECURSIVE {TR}, t AS (SELECT match_id, frame, x, y::DOUBLE AS y, event_type <> 'error' AS ok FROM tr), s AS (
 SELECT match_id, 0 AS frame, NULL::DOUBLE AS x, NULL::DOUBLE AS y, 0 AS since FROM (SELECT DISTINCT match_id FROM t)
 UNION ALL
 SELECT t.match_id, t.frame, CASE WHEN {_FAR} THEN s.x WHEN s.x IS NULL THEN t.x ELSE 0.3::DOUBLE * t.x + (1 - 0.3::DOUBLE) * s.x END, CASE WHEN {_FAR} THEN s.y WHEN s.x IS NULL THEN t.y ELSE 0.3::DOUBLE * t.y + (1 - 0.3::DOUBLE) * s.y END, CASE WHEN {_FAR} THEN s.since + 1 ELSE 0 END
 FROM s JOIN t ON t.match_id = s.match_id AND t.frame = s.frame + 1)
SELECT match_id, frame, round(x, 6) AS smooth_x, round(y, 6) AS smooth_y, since AS since_valid FROM s WHERE frame > 0"""


#: TR as a camera's corners: (left, top) + (width, height) by match, each point off by a few pixels of the row's values.
_OFF = {"tl": (0, 0, 0.11, 0.3), "tr": (1, 0, 0.23, -0.2), "br": (1, 1, 0.17, 0.5), "bl": (0, 1, 0.3, -0.4)}


def corner_rows(spark: SparkSession, d: str) -> DataFrame:
    """Corners as a tracker finds them: errors aren't found, signups mark anew at another size, some rows jump or cross over."""
    t = tracks(spark, d)
    width, height = 260 + t.match_id % 7 * 70, 200.0 + F.when(F.col("event_type") == "signup", F.col("y") * 2).otherwise(F.col("y") % 30)
    far = F.when(F.col("y") % 23 == 0, 80.0).otherwise(0.0)
    cross = F.when(F.col("y") % 19 == 0, F.col("x")).otherwise(0.0)
    points = {}
    for corner, (right, low, dx, dy) in _OFF.items():
        points[f"x_{corner}"] = 200 + right * width + dx * F.col("x") + (far if corner == "br" else 0) + (cross if corner == "tl" else 0)
        points[f"y_{corner}"] = 300 + low * height + dy * F.col("y")
    points["x_bl"] = F.when(F.col("y") % 31 != 0, points["x_bl"])
    return t.select("match_id", "frame", *(c.cast("double").alias(n) for n, c in points.items()), (F.col("event_type") != "error").alias("found"), (F.col("event_type") == "signup").alias("marked"))


def _corners_out(out: DataFrame) -> DataFrame:
    return out.select("match_id", "frame", *(r6(F.col(f"smooth_{c}"), f"smooth_{c}") for c in rc.CORNERS), "is_valid", "since_valid")


def corner_tracker(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return _corners_out(rc.tracked_corners(corner_rows(spark, d), ["match_id"], ["frame"], "found", "marked"))


def _corners_sql() -> str:
    """A recursive query: p are the row's points, s the state, n the smoothed ones."""
    points = []
    for corner, (right, low, dx, dy) in _OFF.items():
        more = " + CASE WHEN y % 23 = 0 THEN 80 ELSE 0 END" if corner == "br" else " + CASE WHEN y % 19 = 0 THEN x ELSE 0 END" if corner == "tl" else ""
        x = f"200 + {right} * (260 + match_id % 7 * 70) + {dx}::DOUBLE * x{more}"
        points.append(f"({x if corner != 'bl' else f'CASE WHEN y % 31 <> 0 THEN {x} END'})::DOUBLE AS x_{corner}")
        points.append(f"(300 + {low} * (200 + CASE WHEN event_type = 'signup' THEN y * 2 ELSE y % 30 END) + {dy}::DOUBLE * y)::DOUBLE AS y_{corner}")
    names = ["tl", "tr", "br", "bl"]
    area = lambda t: "abs(" + " + ".join(f"{t}.x_{a} * {t}.y_{b} - {t}.x_{b} * {t}.y_{a}" for a, b in zip(names, names[1:] + names[:1], strict=True)) + ") / 2"
    turn = lambda a, b, c: f"(n.x_{b} - n.x_{a}) * (n.y_{c} - n.y_{b}) - (n.y_{b} - n.y_{a}) * (n.x_{c} - n.x_{b}) > 0"
    turns = [turn(names[i], names[(i + 1) % 4], names[(i + 2) % 4]) for i in range(4)]
    side = lambda a, b: f"sqrt((n.x_{a} - n.x_{b}) ** 2 + (n.y_{a} - n.y_{b}) ** 2)"
    aspect = f"({side('tl', 'tr')} + {side('bl', 'br')}) / ({side('tl', 'bl')} + {side('tr', 'br')})"
    jumps = f"greatest({', '.join(f'sqrt((t.x_{c} - s.x_{c}) ** 2 + (t.y_{c} - s.y_{c}) ** 2)' for c in names)})"
    passes = f"n.known AND t.found AND s.x_tl IS NOT NULL AND {jumps} <= 50 AND ({' AND '.join(f'({t})' for t in turns)} OR NOT ({' OR '.join(f'({t})' for t in turns)})) AND {area('n')} >= 500 AND (s.area = 0 OR {area('n')} / s.area BETWEEN 0.3 AND 3) AND {aspect} BETWEEN 1.2 AND 5"
    smooth = ", ".join(f"0.3::DOUBLE * t.{c} + 0.7::DOUBLE * s.{c} AS {c}" for c in rc.CORNERS)
    sets = "n.known AND (t.marked OR (s.x_tl IS NULL AND t.found))"
    out = ", ".join(f"CASE WHEN {sets} THEN t.{c} WHEN {passes} THEN n.{c} ELSE s.{c} END AS {c}" for c in rc.CORNERS)
    return f"""WITH RECURSIVE {TR}, t AS (SELECT match_id, frame, {", ".join(points)}, event_type <> 'error' AS found, event_type = 'signup' AS marked FROM tr), s AS (
 SELECT match_id, 0 AS frame, {", ".join(f"NULL::DOUBLE AS {c}" for c in rc.CORNERS)}, 0::DOUBLE AS area, false AS is_valid, 0 AS since FROM (SELECT DISTINCT match_id FROM t)
 UNION ALL
 SELECT t.match_id, t.frame, {out}, CASE WHEN {sets} THEN {area("t")} ELSE s.area END, coalesce({sets} OR ({passes}), false), CASE WHEN {sets} OR ({passes}) THEN 0 ELSE s.since + 1 END
 FROM s JOIN t ON t.match_id = s.match_id AND t.frame = s.frame + 1, LATERAL (SELECT {smooth}, {" AND ".join(f"t.{c} IS NOT NULL" for c in rc.CORNERS)} AS known) n)
SELECT match_id, frame, {", ".join(f"round({c}, 6) AS smooth_{c}" for c in rc.CORNERS)}, is_valid, since AS since_valid FROM s WHERE frame > 0"""


TRACKER_SQL = _corners_sql()


def tracked_positions(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as pixels, placed on the table by the tracked corners in force."""
    corners = [f"smooth_{c}" for c in rc.CORNERS]
    clicks = tracks(spark, d).filter("event_type = 'click'").select("match_id", "frame", (200 + F.col("x") * 4).alias("u"), (F.col("y") * 2 + 300.0).alias("v"))
    out = ft.calibrated_positions(clicks, corner_tracker(spark, d), ["match_id"], "frame", corners, "u", "v", F.col("is_valid"))
    return out.select("match_id", "frame", r6(F.col("x_m"), "x_m"), r6(F.col("y_m"), "y_m"))


def _positions_sql() -> str:
    """The map of the unit square onto the corners has a closed form; a click's place is its inverse.

    The terms stand in the same order as in ``geometry``, so that doubles agree to the last bit before they are rounded. A
    calibration counts as there: its corners map to the table's within REPROJECTION, and no side is shorter than SIDE.
    """
    c = {k: f"smooth_{k}" for k in rc.CORNERS}
    near = lambda x, y: f"{x} BETWEEN -3 AND 5.74::DOUBLE AND {y} BETWEEN -3 AND 4.525::DOUBLE"
    place = lambda u, v: tuple(f"((h{i} * {u} + h{i + 1} * {v} + h{i + 2}) / (h6 * {u} + h7 * {v} + h8))" for i in (0, 3))
    names, fits = ["tl", "tr", "br", "bl"], []
    for i, (k, (u, v)) in enumerate(zip(names, (("0", "0"), ("2.74::DOUBLE", "0"), ("2.74::DOUBLE", "1.525::DOUBLE"), ("0", "1.525::DOUBLE")), strict=True)):
        x, y = place(c[f"x_{k}"], c[f"y_{k}"])
        after = names[(i + 1) % 4]
        side = f"sqrt(({c[f'x_{k}']} - {c[f'x_{after}']}) ** 2 + ({c[f'y_{k}']} - {c[f'y_{after}']}) ** 2)"
        fits.append(f"{near(x, y)} AND sqrt(({x} - {u}) ** 2 + ({y} - {v}) ** 2) <= 0.15::DOUBLE AND {side} >= 10")
    x, y = place("u", "v")
    return f"""WITH q AS ({TRACKER_SQL}), {TR},
 e AS (SELECT q.*, {c["x_tr"]} - {c["x_br"]} AS ax, {c["y_tr"]} - {c["y_br"]} AS ay, {c["x_bl"]} - {c["x_br"]} AS bx, {c["y_bl"]} - {c["y_br"]} AS by_, {c["x_tl"]} - {c["x_tr"]} + {c["x_br"]} - {c["x_bl"]} AS sx, {c["y_tl"]} - {c["y_tr"]} + {c["y_br"]} - {c["y_bl"]} AS sy FROM q WHERE is_valid),
 g AS (SELECT *, (sx * by_ - bx * sy) / (ax * by_ - bx * ay) AS g, (ax * sy - sx * ay) / (ax * by_ - bx * ay) AS h FROM e),
 m AS (SELECT g.* EXCLUDE (ax, ay, bx, by_, sx, sy), {c["x_tr"]} - {c["x_tl"]} + g * {c["x_tr"]} AS a, {c["x_bl"]} - {c["x_tl"]} + h * {c["x_bl"]} AS b, {c["x_tl"]} AS c, {c["y_tr"]} - {c["y_tl"]} + g * {c["y_tr"]} AS d, {c["y_bl"]} - {c["y_tl"]} + h * {c["y_bl"]} AS e, {c["y_tl"]} AS f FROM g),
 n AS (SELECT m.*, (e - f * h) * 2.74::DOUBLE AS h0, (c * h - b) * 2.74::DOUBLE AS h1, (b * f - c * e) * 2.74::DOUBLE AS h2, (f * g - d) * 1.525::DOUBLE AS h3, (a - c * g) * 1.525::DOUBLE AS h4, (c * d - a * f) * 1.525::DOUBLE AS h5, d * h - e * g AS h6, b * g - a * h AS h7, a * e - b * d AS h8 FROM m),
 o AS (SELECT match_id, frame, h0, h1, h2, h3, h4, h5, h6, h7, h8 FROM n WHERE {" AND ".join(fits)}),
 k AS (SELECT match_id, frame, 200 + x * 4 AS u, y * 2 + 300.0::DOUBLE AS v FROM tr WHERE event_type = 'click'),
 j AS (SELECT k.match_id, k.frame, u, v, h0, h1, h2, h3, h4, h5, h6, h7, h8 FROM k ASOF LEFT JOIN o ON k.match_id = o.match_id AND k.frame >= o.frame),
 w AS (SELECT match_id, frame, {x} AS x, {y} AS y FROM j)
SELECT match_id, frame, round(CASE WHEN {near("x", "y")} THEN x END, 6) AS x_m, round(CASE WHEN {near("x", "y")} THEN y END, 6) AS y_m FROM w"""


def manual_events(spark: SparkSession, d: str) -> DataFrame:
    """Points and sets from events: purchases score, errors take back, signups win a set, every 40th row swaps sides."""
    kind = F.when(F.col("frame") % 40 == 0, "swap").when(F.col("event_type") == "signup", "set").when(F.col("event_type").isin("purchase", "error"), "point").otherwise("none")
    return tracks(spark, d).select("match_id", "frame", F.when(F.col("player") == 0, "p1").otherwise("p2").alias("player"), kind.alias("kind"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("delta"))


def manual_score(spark: SparkSession, d: str) -> DataFrame:
    return win.manual_score(manual_events(spark, d), ["match_id"], ["frame"], "player", "kind", "delta").select("match_id", "frame", "p1_score", "p2_score", "p1_sets", "p2_sets")


MANUAL = f"""WITH RECURSIVE {TR}, t AS (SELECT match_id, frame, player, CASE WHEN frame % 40 = 0 THEN 'swap' WHEN event_type = 'signup' THEN 'set' WHEN event_type IN ('purchase', 'error') THEN 'point' ELSE 'none' END AS kind, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS delta FROM tr), s AS (
 SELECT match_id, 0 AS frame, 0 AS p1, 0 AS p2, 0 AS s1, 0 AS s2 FROM (SELECT DISTINCT match_id FROM t)
 UNION ALL
 SELECT t.match_id, t.frame,
  CASE kind WHEN 'swap' THEN s.p2 WHEN 'set' THEN 0 WHEN 'point' THEN CASE WHEN player = 0 THEN greatest(0, s.p1 + delta) ELSE s.p1 END ELSE s.p1 END, CASE kind WHEN 'swap' THEN s.p1 WHEN 'set' THEN 0 WHEN 'point' THEN CASE WHEN player = 1 THEN greatest(0, s.p2 + delta) ELSE s.p2 END ELSE s.p2 END,
  CASE kind WHEN 'swap' THEN s.s2 WHEN 'set' THEN CASE WHEN player = 0 THEN s.s1 + 1 ELSE s.s1 END ELSE s.s1 END, CASE kind WHEN 'swap' THEN s.s1 WHEN 'set' THEN CASE WHEN player = 1 THEN s.s2 + 1 ELSE s.s2 END ELSE s.s2 END
 FROM s JOIN t ON t.match_id = s.match_id AND t.frame = s.frame + 1)
SELECT match_id, frame, p1 AS p1_score, p2 AS p2_score, s1 AS p1_sets, s2 AS p2_sets FROM s WHERE frame > 0"""


def pooled_matches(spark: SparkSession, d: str) -> DataFrame:
    """The match history with nations' suppliers against their own numbered guests, who meet nobody else."""
    m = history(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("nation")), "a")
    guest = F.concat_ws(" ", F.lit("guest"), F.col("nation").cast("string"), F.col("b").cast("string"))
    return m.select("l_orderkey", "l_linenumber", "day", F.col("a").cast("string").alias("a"), guest.alias("b"), "a_won")


def elo(spark: SparkSession, d: str) -> DataFrame:
    """Ratings before and after each match, in pools of players that are found from who met whom."""
    ship(spark)
    out = rt.elo(pooled_matches(spark, d), None, "a", "b", "a_won", ["day", "l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *(r6(F.col(c), c) for c in ("elo_a", "elo_b", "elo_a_after", "elo_b_after")))


def career_features(spark: SparkSession, d: str) -> DataFrame:
    """Both sides' careers and ratings in force at each match, apart; ages, events and titles are made of the players' numbers."""
    ship(spark)
    m = pooled_matches(spark, d)
    sums = rt.player_rows(m, "a", "b", "a_won").groupBy("player").agg(F.count("*").alias("matches"), F.sum("won").alias("wins"))
    number = F.regexp_extract("player", r"(\d+)$", 1).cast("int")
    profiles = sums.select("player", "matches", "wins", (18 + number % 20).alias("age"), (number % 90).alias("events"), (number % 11).alias("titles")).filter(number % 9 != 0)
    out = rt.rated_careers(m, profiles, "a", "b", "a_won", ["day", "l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *(F.round(f"{c}_diff", 6).alias(f"{c}_diff") for c in ("elo", "age", "events", "matches", "win_rate", "titles")))


#: Matches one after the other in each nation, whose pools lie within it; r are all its players' ratings, by number.
RATED = f"""WITH RECURSIVE {MH}, pm AS MATERIALIZED (SELECT l_orderkey, l_linenumber, s_nationkey AS nation, day, a::VARCHAR AS a, 'guest ' || s_nationkey || ' ' || b AS b, a_won FROM mh JOIN supplier ON s_suppkey = a),
 pl AS MATERIALIZED (SELECT nation, player, row_number() OVER (PARTITION BY nation ORDER BY player) AS i FROM (SELECT DISTINCT nation, a AS player FROM pm UNION SELECT DISTINCT nation, b FROM pm)),
 ms AS MATERIALIZED (SELECT pm.*, x.i AS ia, y.i AS ib, row_number() OVER (PARTITION BY pm.nation ORDER BY day, l_orderkey, l_linenumber) AS n FROM pm JOIN pl x ON x.nation = pm.nation AND x.player = a JOIN pl y ON y.nation = pm.nation AND y.player = b),
 rs AS (SELECT nation, 0::BIGINT AS n, 0::BIGINT AS l_orderkey, 0 AS l_linenumber, NULL::DOUBLE AS ea, NULL::DOUBLE AS eb, NULL::DOUBLE AS up, list_transform(range(count(*)), lambda i: 1500::DOUBLE) AS r FROM pl GROUP BY nation
  UNION ALL
  SELECT nation, n, l_orderkey, l_linenumber, ea, eb, up, list_transform(r, lambda v, i: v + CASE i WHEN ia THEN up WHEN ib THEN -up ELSE 0 END)
  FROM (SELECT ms.*, r, r[ia] AS ea, r[ib] AS eb, 32 * (a_won - 1 / (1 + 10 ** ((r[ib] - r[ia]) / 400))) AS up FROM rs JOIN ms ON ms.nation = rs.nation AND ms.n = rs.n + 1)),
 rated AS (SELECT l_orderkey, l_linenumber, ea, eb, up FROM rs WHERE n > 0)"""
CAREERS = f"""{RATED}, c AS (SELECT player, count(*) AS matches, sum(won)::BIGINT AS wins, regexp_extract(player, '(\\d+)$', 1)::INTEGER AS k FROM (SELECT a AS player, a_won AS won FROM pm UNION ALL SELECT b, 1 - a_won FROM pm) GROUP BY player)
SELECT l_orderkey, l_linenumber, round(ea - eb, 6) AS elo_diff, x.k % 20 - y.k % 20 AS age_diff, x.k % 90 - y.k % 90 AS events_diff, x.matches - y.matches AS matches_diff,
 round(x.wins / (x.matches + 1e-6::DOUBLE) - y.wins / (y.matches + 1e-6::DOUBLE), 6) AS win_rate_diff, x.k % 11 - y.k % 11 AS titles_diff
FROM pm JOIN rated USING (l_orderkey, l_linenumber) JOIN c x ON x.player = a JOIN c y ON y.player = b WHERE x.k % 9 <> 0 AND y.k % 9 <> 0"""


FEATURES = ["x_diff", "y_diff", "conf_mean", "duration"]


def _points(spark: SparkSession, d: str) -> DataFrame:
    from courtside.plans.sequences import rallies, rally_features

    won = rallies(spark, d).filter("winner <> 'unknown'").select("match_id", "rally_id", (F.col("winner") == "p1").cast("int").alias("label"))
    return rally_features(spark, d).join(won, ["match_id", "rally_id"]).withColumn("duration", F.col("duration").cast("double"))


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression and boosted trees on rally features: trained on four fifths of the matches, tested on the rest."""
    p = stored(_points(spark, d))
    held = F.pmod(F.xxhash64("match_id"), F.lit(5)) == 0
    return ml.compare(p.filter(~held), p.filter(held), {"logistic": ml.logistic(FEATURES), "boosted": ml.boosted(FEATURES)})


def win_probability(spark: SparkSession, d: str) -> DataFrame:
    """Each match scored with its last rally."""
    p = stored(_points(spark, d))
    last = p.groupBy("match_id").agg(F.max_by(F.struct(*FEATURES, "label"), "rally_id").alias("r")).select("match_id", "r.*")
    return ml.scored(ml.logistic(FEATURES).fit(p), last).select("match_id", r6(F.col("probability_of"), "probability"), "predicted")


def default_model(spark: SparkSession, d: str) -> DataFrame:
    return ml.even_chances(tracks(spark, d).select("match_id", "frame"))


def meta_model(spark: SparkSession, d: str) -> DataFrame:
    """The meta model's metrics on each of four folds of matches that have a live and a career probability."""
    t = tracks(spark, d).groupBy("match_id").agg(F.max_by("conf", "frame").alias("live"), F.max_by("player", "frame").alias("label"))
    career = table(spark, d, "customer").select(F.col("c_custkey").alias("match_id"), ((F.col("c_acctbal") + 1000) / 11000).cast("double").alias("career"))
    rows = t.join(career, "match_id").withColumn("fold", F.pmod("match_id", F.lit(4)))
    return ml.folds(rows, "fold", {"meta": ml.meta("live", "career")})


def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Each match's meta probability from a model of all others, beside its label."""
    ship(spark)
    t = tracks(spark, d).groupBy("match_id").agg(F.max_by("conf", "frame").alias("live"), F.max_by("player", "frame").alias("label"))
    career = table(spark, d, "customer").select(F.col("c_custkey").alias("match_id"), ((F.col("c_acctbal") + 1000) / 11000).cast("double").alias("career"))
    out = ff.held_out(t.join(career, "match_id"), "match_id", ["live", "career"], "label")
    return out.select("match_id", "label", r6(F.col("probability"), "probability"), "predicted")


QUERIES = {f.__name__: f for f in (scene_gate, skipped_frames, ema, corner_tracker, tracked_positions, manual_score, elo, career_features, model_comparison, win_probability, default_model, meta_model, leave_one_out)}
ORACLES = {
    "scene_gate": SCENE,
    "skipped_frames": f"WITH q AS ({SCENE}) SELECT match_id, count(*) FILTER (NOT process) AS skipped, count(*) FILTER (is_cut) AS cuts FROM q GROUP BY match_id",
    "ema": EMA,
    "corner_tracker": TRACKER_SQL,
    "tracked_positions": _positions_sql(),
    "manual_score": MANUAL,
    "elo": f"{RATED} SELECT l_orderkey, l_linenumber, round(ea, 6) AS elo_a, round(eb, 6) AS elo_b, round(ea + up, 6) AS elo_a_after, round(eb - up, 6) AS elo_b_after FROM rated",
    "career_features": CAREERS,
    "default_model": f"WITH {TR} SELECT match_id, frame, 0.5::DOUBLE AS p1, 0.5::DOUBLE AS p2, 0.0::DOUBLE AS confidence, false AS reliable FROM tr",
}
