"""Row-wise queries: filters, geometry, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions import fusion as fz
from courtside.functions import geometry as geo
from courtside.functions import text as tx
from courtside.plans.inputs import BY_FRAME, TR, table, tracks

r6 = lambda c, n: F.round(c, 6).alias(n)
#: Corners of a calibration, in pixels.
QUAD = [(200.0, 300.0), (1080.0, 320.0), (1000.0, 500.0), (240.0, 480.0)]


def conf_filter(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).filter("conf >= 0.4").select("match_id", "frame", "x", "y", "conf")


def decimate(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).filter("frame % 5 = 0").select("match_id", "frame", "event_type")


def box_geometry(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y").cast("double")
    box = geo.padded_box(x, y, x + 20, y + 10, 8.0, 640.0, 480.0)
    cx, cy = geo.center(x * 2.0, y * 1.5, (x + 20) * 2.0, (y + 10) * 1.5)
    point = {f"p_{k}": v for k, v in geo.point_box(x, y, 640.0, 480.0, 24.0).items()}
    norm = {f"n_{k}": v for k, v in geo.normalized_box(x, y, x + 20, y + 10, 640.0, 480.0).items()}
    back = geo.pixel_corners(norm["n_cx"], norm["n_cy"], norm["n_w"], norm["n_h"], 1280.0, 960.0)
    return tracks(spark, d).select("match_id", "frame", F.round(cx, 10).alias("cx"), F.round(cy, 10).alias("cy"), *(F.round(v, 10).alias(k) for k, v in {**box, **point, **norm}.items()), *((v + 0).cast("int").alias(k) for k, v in back.items()))


BOX_SQL = f"""WITH {TR}, b AS (SELECT *, greatest(x - 12, 0) AS pl, least(greatest(x - 12, 0), 640) AS l, least(greatest(x + 12, 0), 640) AS r, least(greatest(y - 12.0, 0), 480) AS t, least(greatest(y + 12.0, 0), 480) AS o,
 (x + x + 20) / 2 / 640 AS ncx, (y + y + 10.0) / 2 / 480 AS ncy, (x + 20 - x) / 640 AS nw, 10.0::DOUBLE / 480 AS nh FROM tr)
SELECT match_id, frame, round((x * 2 + (x + 20) * 2) / 2, 10) AS cx, round((y * 1.5::DOUBLE + (y + 10) * 1.5::DOUBLE) / 2, 10) AS cy,
 round(least(greatest(x - 8, 0), 640), 10) AS bx1, round(least(greatest(y - 8.0::DOUBLE, 0), 480), 10) AS by1, round(least(greatest(x + 28, 0), 640), 10) AS bx2, round(least(greatest(y + 18.0::DOUBLE, 0), 480), 10) AS by2,
 round((l + r) / 2 / 640, 10) AS p_cx, round((t + o)::DOUBLE / 2 / 480, 10) AS p_cy, round((r - l) / 640, 10) AS p_w, round((o - t)::DOUBLE / 480, 10) AS p_h,
 round(ncx, 10) AS n_cx, round(ncy::DOUBLE, 10) AS n_cy, round(nw, 10) AS n_w, round(nh, 10) AS n_h,
 trunc((ncx - nw / 2) * 1280)::INTEGER AS px1, trunc((ncy::DOUBLE - nh / 2) * 960)::INTEGER AS py1, trunc((ncx + nw / 2) * 1280)::INTEGER AS px2, trunc((ncy::DOUBLE + nh / 2) * 960)::INTEGER AS py2 FROM b"""


def _meters(df: DataFrame) -> DataFrame:
    h = geo.homography([(F.lit(x), F.lit(y)) for x, y in QUAD])
    x, y = geo.to_meters(list(h.values()), F.col("x") * 4 + 200, F.col("y") * 2.5 + 280)
    return df.withColumns({"x_m": x, "y_m": y})


def _solved() -> list[float]:
    """The homography of QUAD by a linear solve: an independent way for the oracle."""
    import numpy as np

    target = [(0.0, 0.0), (geo.TABLE_LENGTH, 0.0), (geo.TABLE_LENGTH, geo.TABLE_WIDTH), (0.0, geo.TABLE_WIDTH)]
    rows, right = [], []
    for (u, v), (x, y) in zip(QUAD, target, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    return [*np.linalg.solve(np.array(rows), np.array(right)).tolist(), 1.0]


def _meters_sql() -> str:
    h = _solved()
    u, v = "(x * 4 + 200)", "(y * 2.5::DOUBLE + 280)"
    x, y = (f"(({h[i]!r}::DOUBLE * {u} + {h[i + 1]!r}::DOUBLE * {v} + {h[i + 2]!r}::DOUBLE) / ({h[6]!r}::DOUBLE * {u} + {h[7]!r}::DOUBLE * {v} + 1))" for i in (0, 3))
    return f"{TR}, raw AS (SELECT *, {x} AS xm, {y} AS ym FROM tr), m AS (SELECT *, CASE WHEN xm BETWEEN -3 AND 5.74 AND ym BETWEEN -3 AND 4.525 THEN xm END AS x_m, CASE WHEN xm BETWEEN -3 AND 5.74 AND ym BETWEEN -3 AND 4.525 THEN ym END AS y_m FROM raw)"


METERS = _meters_sql()
ZONE = """CASE WHEN x_m BETWEEN -0.1 AND 2.84 AND y_m BETWEEN -0.1 AND 1.625 THEN (least(2, floor(least(greatest(y_m, 0), 1.525) / (1.525 / 3))) * 3 + least(2, floor(least(greatest(x_m, 0), 2.74) / (2.74 / 3))))::INTEGER END"""


def homography(spark: SparkSession, d: str) -> DataFrame:
    return _meters(tracks(spark, d)).select("match_id", "frame", r6(F.col("x_m"), "x_m"), r6(F.col("y_m"), "y_m"))


def landing_zone(spark: SparkSession, d: str) -> DataFrame:
    return _meters(tracks(spark, d)).select("match_id", "frame", geo.landing_zone(F.col("x_m"), F.col("y_m")).alias("zone"))


def side_swap(spark: SparkSession, d: str) -> DataFrame:
    swapped = F.col("player") == 1
    return tracks(spark, d).select("match_id", "frame", F.when(swapped, F.col("y")).otherwise(F.col("x")).alias("p1"), F.when(swapped, F.col("x")).otherwise(F.col("y")).alias("p2"))


def score_context(spark: SparkSession, d: str) -> DataFrame:
    p1, p2, s1, s2 = F.col("y") % 11, F.col("event_id") % 11, F.col("y") % 3, F.col("event_id") % 3
    plain, weighted = fz.score_context(p1, p2, s1, s2), fz.score_context(p1, p2, s1, s2, 11)
    return tracks(spark, d).select("match_id", "frame", *(v.cast("long").alias(k) for k, v in plain.items()), *(v.cast("long").alias(f"{k}_11") for k, v in weighted.items()))


def map_lookup(spark: SparkSession, d: str) -> DataFrame:
    wins = F.create_map(*(F.lit(v) for pair in ((3, 2), (5, 3), (7, 4)) for v in pair))
    best = F.col("y") % 4 * 2 + 1
    return tracks(spark, d).select("match_id", "frame", best.cast("int").alias("best_of"), F.coalesce(F.try_element_at(wins, best.cast("int")), F.lit(3)).alias("sets_to_win"))


def packet(spark: SparkSession, d: str) -> DataFrame:
    """Nested as a live packet, then flattened again: the nesting loses nothing."""
    t = tracks(spark, d)
    ball = F.struct((F.col("event_type") != "error").alias("detected"), F.struct(F.col("x"), F.col("y")).alias("position_px"), F.lit("debug").alias("debug_landmarks"))
    nested = t.select(F.struct(F.col("match_id"), F.col("frame").alias("frame_idx"), F.round(F.col("frame") / 30.0, 6).alias("timestamp_sec"), ball.dropFields("debug_landmarks").alias("ball")).alias("packet"))
    return nested.select("packet.match_id", "packet.frame_idx", "packet.timestamp_sec", "packet.ball.detected", "packet.ball.position_px.x", "packet.ball.position_px.y")


def _corners(spark: SparkSession, d: str, scale: float = 100.0) -> DataFrame:
    e = F.col("embedding")
    points = F.array(*(F.struct((e[2 * i].cast("double") * scale).alias("x"), (e[2 * i + 1].cast("double") * scale).alias("y")) for i in range(4)))
    return table(spark, d, "embeddings").select("vec_id", points.alias("points"))


def quad_quality(spark: SparkSession, d: str) -> DataFrame:
    c = _corners(spark, d).withColumn("o", geo.ordered_corners(F.col("points")))
    quad = [(F.col("o")[i]["x"], F.col("o")[i]["y"]) for i in range(4)]
    return c.select("vec_id", r6(quad_area := geo.quad_area(quad), "area"), geo.is_convex(quad).alias("convex"), r6(geo.quad_aspect(quad), "aspect"), r6(geo.shortest_side(quad), "shortest"), (quad_area >= 500).alias("large"))


_P = "list_transform([0, 1, 2, 3], lambda i: {'x': embedding[2 * i + 1]::DOUBLE * 100, 'y': embedding[2 * i + 2]::DOUBLE * 100})"


def _quad_sql() -> str:
    q = [(f"q[{i}].x", f"q[{i}].y") for i in (1, 2, 3, 4)]
    nxt = [*q[1:], q[0]]
    area = "abs(" + " + ".join(f"({a[0]} * {b[1]} - {b[0]} * {a[1]})" for a, b in zip(q, nxt, strict=True)) + ") / 2"
    side = lambda a, b: f"sqrt(({a[0]} - {b[0]}) ** 2 + ({a[1]} - {b[1]}) ** 2)"
    turns = [f"(({q[(i + 1) % 4][0]} - {q[i][0]}) * ({q[(i + 2) % 4][1]} - {q[(i + 1) % 4][1]}) - ({q[(i + 1) % 4][1]} - {q[i][1]}) * ({q[(i + 2) % 4][0]} - {q[(i + 1) % 4][0]}))" for i in range(4)]
    return f"""WITH p AS (SELECT vec_id, {_P} AS ps FROM embeddings),
 s AS (SELECT vec_id, list_sort(list_transform(ps, lambda v: {{'y': v.y, 'x': v.x}})) AS s FROM p),
 t AS (SELECT vec_id, list_sort([{{'x': s[1].x, 'y': s[1].y}}, {{'x': s[2].x, 'y': s[2].y}}]) AS top, list_sort([{{'x': s[3].x, 'y': s[3].y}}, {{'x': s[4].x, 'y': s[4].y}}]) AS low FROM s),
 o AS (SELECT vec_id, [top[1], top[2], low[2], low[1]] AS q FROM t)
SELECT vec_id, round({area}, 6) AS area, least({", ".join(turns)}) > 0 OR greatest({", ".join(turns)}) < 0 AS convex,
 round(({side(q[0], q[1])} + {side(q[3], q[2])}) / ({side(q[1], q[2])} + {side(q[0], q[3])}), 6) AS aspect, round(least({", ".join(side(a, b) for a, b in zip(q, nxt, strict=True))}), 6) AS shortest, {area} >= 500 AS large FROM o"""


def angles(spark: SparkSession, d: str) -> DataFrame:
    p = [(F.col("points")[i]["x"], F.col("points")[i]["y"]) for i in range(4)]
    return _corners(spark, d).select("vec_id", r6(geo.joint_angle(p[0], p[1], p[2]), "joint"), r6(geo.lean_angle(p[0], p[3]), "lean"))


ANGLES_SQL = f"""WITH p AS (SELECT vec_id, {_P} AS q FROM embeddings), v AS (SELECT vec_id, q[1].x - q[2].x AS ux, q[1].y - q[2].y AS uy, q[3].x - q[2].x AS vx, q[3].y - q[2].y AS vy, q[4].x - q[1].x AS dx, q[4].y - q[1].y AS dy FROM p)
SELECT vec_id, CASE WHEN sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy) >= 1e-9 THEN round(degrees(acos(least(greatest((ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)), -1), 1))), 6) END AS joint, CASE WHEN abs(dx) >= 1e-9 OR abs(dy) >= 1e-9 THEN round(degrees(atan2(dx, dy)), 6) END AS lean FROM v"""


def _landmarks(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks of a crop that is half as wide as the picture, on its left for even ids and on its right for odd ones."""
    e = F.col("embedding")
    at = lambda i: e[i % 64].cast("double")
    points = F.array(*(F.struct(at(i).alias("x"), at(i + 31).alias("y"), (F.abs(at(i + 7)) * 4).alias("visibility")) for i in range(33)))
    return table(spark, d, "embeddings").select("vec_id", geo.full_frame(points, F.lit(640), F.col("vec_id") % 2 * 640, F.lit(1280)).alias("points"))


def pose_row(spark: SparkSession, d: str) -> DataFrame:
    return _landmarks(spark, d).select("vec_id", *(r6(v, k) for k, v in geo.pose_row(F.col("points")).items()))


def _pose_sql() -> str:
    at = lambda i: f"embedding[{i % 64 + 1}]::DOUBLE"
    used = (11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28)
    cols = ", ".join(f"abs({at(i + 7)}) * 4 AS v{i}, ({at(i)} * 640 + (vec_id % 2) * 640) / 1280 AS rx{i}, {at(i + 31)} AS ry{i}" for i in used)
    gated = ", ".join(f"CASE WHEN v{i} >= 0.5 THEN rx{i} END AS x{i}, CASE WHEN v{i} >= 0.5 THEN ry{i} END AS y{i}" for i in used)
    mid = lambda c, a, b: f"CASE WHEN {c}{a} IS NULL THEN {c}{b} WHEN {c}{b} IS NULL THEN {c}{a} ELSE ({c}{a} + {c}{b}) / 2 END"
    ten = [f"v{i}" for i in (11, 12, 23, 24, 25, 26, 27, 28, 15, 16)]

    def angle(a: int, b: int, c: int, r: str = "") -> str:
        dot = f"(({r}x{a} - {r}x{b}) * ({r}x{c} - {r}x{b}) + ({r}y{a} - {r}y{b}) * ({r}y{c} - {r}y{b}))"
        size = f"(sqrt(({r}x{a} - {r}x{b}) ** 2 + ({r}y{a} - {r}y{b}) ** 2) * sqrt(({r}x{c} - {r}x{b}) ** 2 + ({r}y{c} - {r}y{b}) ** 2))"
        return f"(CASE WHEN {size} >= 1e-9 THEN degrees(acos(least(greatest({dot} / {size}, -1), 1))) END)"

    return f"""WITH j AS (SELECT vec_id, {cols} FROM embeddings), g AS (SELECT *, {gated} FROM j),
 k AS (SELECT *, {mid("x", 11, 12)} AS sx, {mid("y", 11, 12)} AS sy, {mid("x", 23, 24)} AS hx, {mid("y", 23, 24)} AS hy, {angle(23, 25, 27)} AS kl, {angle(24, 26, 28)} AS kr,
  (v11 + v13 + v15) / 3 AS al, (v12 + v14 + v16) / 3 AS ar, list_filter([y11, y12, y23, y24, y25, y26], lambda y: y IS NOT NULL) AS body FROM g)
SELECT vec_id, round(({" + ".join(ten)}) / 10, 6) AS visibility_mean, round(least({", ".join(ten)}), 6) AS visibility_min, round(al, 6) AS visibility_left_arm, round(ar, 6) AS visibility_right_arm,
 round(CASE WHEN abs(hx - sx) >= 1e-9 OR abs(hy - sy) >= 1e-9 THEN degrees(atan2(hx - sx, hy - sy)) END, 6) AS angle_trunk_lean,
 round(CASE WHEN al >= ar THEN {angle(11, 13, 15)} ELSE {angle(12, 14, 16)} END, 6) AS angle_elbow_dom, round({angle(11, 13, 15, "r")}, 6) AS angle_elbow_left, round({angle(12, 14, 16, "r")}, 6) AS angle_elbow_right,
 round(CASE WHEN x27 IS NULL OR x28 IS NULL THEN CASE WHEN kl IS NULL OR kl = 0 THEN kr ELSE kl END WHEN x27 <= x28 THEN kl ELSE kr END, 6) AS angle_knee_front,
 round(CASE WHEN x27 IS NULL OR x28 IS NULL THEN NULL WHEN x27 <= x28 THEN kr ELSE kl END, 6) AS angle_knee_back, round(1 - list_sum(body) / len(body), 6) AS com_height,
 round(1 - CASE WHEN al >= ar THEN y15 ELSE y16 END, 6) AS hand_height, round(1 - ry15, 6) AS hand_height_left, round(1 - ry16, 6) AS hand_height_right, round(abs(x27 - x28), 6) AS stance_length FROM k"""


def winner_target(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("a"), F.concat(F.lit("Team "), F.col("c_nationkey").cast("string")).alias("b"))
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("won by "), F.upper("a"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("won by "), F.col("b"))).otherwise("draw")
    return c.select("c_custkey", tx.winner_target(text, F.col("a"), F.col("b")).alias("target")).dropna(subset=["target"])


def score_parse(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a, b = (F.col("o_orderkey") % 12).cast("string"), (F.col("o_custkey") % 12).cast("string")
    score = F.when(F.col("o_orderkey") % 7 == 0, "walkover").otherwise(F.concat(a, F.lit("-"), b))
    share = F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.concat(a, F.lit(":"), b))
    games = F.concat_ws(" ", F.concat(a, F.lit(":"), b), F.concat(b, F.lit(":"), a))
    m = tx.margin(score)
    return o.select("o_orderkey", m.alias("margin"), F.abs(m).alias("margin_abs"), tx.best_of(F.col("o_orderpriority")).alias("best_of"), F.round(tx.win_share(share), 6).alias("share"), F.array_join(tx.padded_games(games), ",").alias("games"))


SCORE_SQL = """WITH s AS (SELECT *, (o_orderkey % 12)::VARCHAR AS a, (o_custkey % 12)::VARCHAR AS b FROM orders),
 t AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE a::INTEGER - b::INTEGER END AS m FROM s)
SELECT o_orderkey, m::INTEGER AS margin, abs(m)::INTEGER AS margin_abs, CASE WHEN contains(o_orderpriority, '3') THEN 3 ELSE 5 END AS best_of,
 round(CASE WHEN o_orderkey % 5 = 0 THEN 0.5 WHEN a::INTEGER + b::INTEGER = 0 THEN 0.5 ELSE a::DOUBLE / (a::DOUBLE + b::DOUBLE) END, 6) AS share, a || '-' || b || ',' || b || '-' || a || ',N/A,N/A,N/A' AS games FROM t"""


def name_parse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    whole = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" (#"), F.col("p_partkey").cast("string"), F.lit(")")))
    name, key = tx.name_and_id(whole)
    file = F.format_string("img_%06d.png", "p_partkey")  # at least six digits; a longer number stays whole
    return p.select("p_partkey", name.alias("name"), key.alias("id"), tx.frame_number(file).alias("frame"), tx.safe_name(F.col("p_name")).alias("safe_name"))


NAME_SQL = """SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END AS id, p_partkey AS frame, regexp_replace(p_name, '[^A-Za-z0-9_-]+', '_', 'g') AS safe_name FROM part"""


def label_format(spark: SparkSession, d: str) -> DataFrame:
    v = lambda n: F.col("y") / n
    return tracks(spark, d).select("match_id", "frame", tx.label_line(F.col("player"), v(1281.3), v(2561.3), v(5121.3), v(10241.3)).alias("line"))


def label_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = label_format(spark, d).withColumn("line", F.when(F.col("frame") % 9 == 0, "0 broken").otherwise(F.col("line")))
    out = lines.select("match_id", "frame", *(c.alias(n) for n, c in tx.label_parts(F.col("line")).items())).filter("cls is not null")
    return out.withColumn("cls", F.lit(0))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    entries = e.select("event_id", F.explode(F.from_json("props", "map<string,double>")).alias("name", "value"))
    return entries.filter(F.col("value").isNotNull()).select("event_id", "name", "value")


def page_fields(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("at", "href"))


def fusion(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    at = fz.progress(F.col("y") % 12, F.col("event_id") % 12, F.col("y") % 3, F.col("event_id") % 3, F.lit(3))
    out = fz.fused(F.col("conf"), F.when(F.col("player") == 1, F.col("y") % 10 / 10.0), at, F.when(F.col("event_type") == "click", 0.25))
    r9 = lambda c, n: F.round(c, 9).alias(n)  # noqa: E731  at 6 digits some values are ties
    return t.select("match_id", "frame", r9(at, "progress"), r9(fz.live_weight(at), "weight"), *(r9(v, k) for k, v in out.items()))


FUSION_SQL = f"""WITH {TR}, p AS (SELECT *, y % 3 AS s1, event_id % 3 AS s2, (((y % 3) + (event_id % 3)) * 11 + (y % 12) + (event_id % 12)) / 55.0::DOUBLE AS done FROM tr),
 q AS (SELECT *, greatest(least(1.0, done), CASE WHEN greatest(s1, s2) <> 2 THEN 0 WHEN greatest(y % 12, event_id % 12) >= 8 THEN 0.85 ELSE 0.6 END)::DOUBLE AS g, CASE WHEN player = 1 THEN (y % 10) / 10.0::DOUBLE END AS career FROM p),
 w AS (SELECT *, 0.35::DOUBLE + (0.85::DOUBLE - 0.35::DOUBLE) * (g * g * (3 - 2 * g)) AS w FROM q),
 m AS (SELECT *, coalesce(w * conf + (1 - w) * career, conf) AS mean FROM w),
 f AS (SELECT *, CASE WHEN career IS NOT NULL AND event_type = 'click' THEN (1 - g) * 0.25 + g * mean ELSE mean END AS prob FROM m)
SELECT match_id, frame, round(g, 9) AS progress, round(w, 9) AS weight, round(prob, 9) AS probability, round(abs(prob - 0.5) * 2, 9) AS confidence FROM f"""

QUERIES = {f.__name__: f for f in (conf_filter, decimate, box_geometry, homography, landing_zone, side_swap, score_context, map_lookup, packet, quad_quality, angles, pose_row, winner_target, score_parse, name_parse, label_format, label_parse, json_extract, page_fields, page_links, fusion)}
ORACLES = {
    "conf_filter": f"WITH {TR} SELECT match_id, frame, x, y, conf FROM tr WHERE conf >= 0.4",
    "decimate": f"WITH {TR} SELECT match_id, frame, event_type FROM tr WHERE frame % 5 = 0",
    "box_geometry": BOX_SQL,
    "homography": f"WITH {METERS} SELECT match_id, frame, round(x_m, 6) AS x_m, round(y_m, 6) AS y_m FROM m",
    "landing_zone": f"WITH {METERS} SELECT match_id, frame, {ZONE} AS zone FROM m",
    "side_swap": f"WITH {TR} SELECT match_id, frame, CASE WHEN player = 1 THEN y ELSE x END AS p1, CASE WHEN player = 1 THEN x ELSE y END AS p2 FROM tr",
    "score_context": f"WITH {TR} SELECT match_id, frame, (y % 11 - event_id % 11)::BIGINT AS score_diff, (y % 11 + event_id % 11)::BIGINT AS total_points, (y % 11 - event_id % 11 + 11 * (y % 3 - event_id % 3))::BIGINT AS score_diff_11, (y % 11 + event_id % 11 + 11 * (y % 3 + event_id % 3))::BIGINT AS total_points_11 FROM tr",
    "map_lookup": f"WITH {TR} SELECT match_id, frame, (y % 4 * 2 + 1)::INTEGER AS best_of, CASE y % 4 * 2 + 1 WHEN 3 THEN 2 WHEN 5 THEN 3 WHEN 7 THEN 4 ELSE 3 END::INTEGER AS sets_to_win FROM tr",
    "packet": f"WITH {TR} SELECT match_id, frame AS frame_idx, round(frame / 30.0::DOUBLE, 6) AS timestamp_sec, event_type <> 'error' AS detected, x, y FROM tr",
    "quad_quality": _quad_sql(),
    "angles": ANGLES_SQL,
    "pose_row": _pose_sql(),
    "winner_target": "SELECT c_custkey, (c_custkey % 3)::INTEGER AS target FROM customer WHERE c_custkey % 3 < 2",
    "score_parse": SCORE_SQL,
    "name_parse": NAME_SQL,
    "label_format": f"WITH {TR} SELECT match_id, frame, printf('%d %.6f %.6f %.6f %.6f', player, y / 1281.3::DOUBLE, y / 2561.3::DOUBLE, y / 5121.3::DOUBLE, y / 10241.3::DOUBLE) AS line FROM tr",
    "label_parse": f"WITH {TR}, p AS (SELECT match_id, frame, string_split(printf('%d %.6f %.6f %.6f %.6f', player, y / 1281.3::DOUBLE, y / 2561.3::DOUBLE, y / 5121.3::DOUBLE, y / 10241.3::DOUBLE), ' ') AS s FROM tr WHERE frame % 9 <> 0) SELECT match_id, frame, 0 AS cls, s[2]::DOUBLE AS cx, s[3]::DOUBLE AS cy, s[4]::DOUBLE AS w, s[5]::DOUBLE AS h FROM p",
    "json_extract": """SELECT event_id, 'k' AS name, regexp_extract(props, '"k": *(\\d+)', 1)::DOUBLE AS value FROM events""",
    "page_fields": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""",
    "page_links": """SELECT page_id, (i - 1)::INTEGER AS at, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))""",
    "fusion": FUSION_SQL,
}
