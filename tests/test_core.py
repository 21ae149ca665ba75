"""Numeric expectations of the geometry, text, sequence and file operators, and batch against plain state machines."""

from __future__ import annotations

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from courtside.functions import fusion as fz
from courtside.functions import geometry as geo
from courtside.functions import text as tx
from courtside.operators import joins as jn
from courtside.operators import ranking as rk
from courtside.operators import ratings as rt
from courtside.operators import recurrence as rc
from courtside.operators import windows as win
from courtside.streaming import tracks as live

QUAD = [(200.0, 300.0), (1080.0, 300.0), (1080.0, 500.0), (200.0, 500.0)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_calibration(spark):
    h = list(geo.homography([(F.lit(x), F.lit(y)) for x, y in QUAD]).values())
    at = lambda u, v: one(spark, *geo.to_meters(h, F.lit(u), F.lit(v)))
    assert at(200.0, 300.0) == pytest.approx((0, 0), abs=1e-9)
    assert at(1080.0, 500.0) == pytest.approx((2.74, 1.525))
    assert at(640.0, 400.0) == pytest.approx((1.37, 0.7625))
    assert tuple(at(-5000.0, -5000.0)) == (None, None)


@pytest.mark.parametrize(("x", "y", "zone"), [(1.37, 0.76, 4), (0.01, 0.01, 0), (2.73, 0.01, 2), (0.01, 1.515, 6), (2.73, 1.515, 8), (-1.0, -1.0, None)])
def test_zones(spark, x, y, zone):
    assert one(spark, geo.landing_zone(F.lit(x), F.lit(y)))[0] == zone


def test_angles(spark):
    point = lambda x, y: (F.lit(x).cast("double"), F.lit(y).cast("double"))
    angle = lambda *p: one(spark, geo.joint_angle(*(point(*q) for q in p)))[0]
    assert angle((0, 0), (1, 0), (2, 0)) == pytest.approx(180)
    assert angle((0, 1), (0, 0), (1, 0)) == pytest.approx(90)
    assert angle((1, 1), (0, 0), (1, 0)) == pytest.approx(45)
    assert angle((0, 0), (0, 0), (1, 0)) is None
    assert angle((None, 0), (0, 0), (1, 0)) is None
    lean = lambda *p: one(spark, geo.lean_angle(*(point(*q) for q in p)))[0]
    assert lean((0, 0), (0, 10)) == 0 and lean((0, 0), (5, 10)) == pytest.approx(26.565, abs=1e-3) and lean((0, 0), (-5, 10)) < 0
    assert abs(lean((0, 5), (10, 5))) == pytest.approx(90) and lean((5, 5), (5, 5)) is None and lean((None, 0), (0, 10)) is None


def test_pose_row(spark):
    """All measures of a pose whose right arm is seen better and whose right ankle is hidden, by hand."""
    at = {i: (0.5, 0.5, 0.9) for i in range(33)}
    at |= {11: (0.4, 0.2, 0.6), 12: (0.6, 0.2, 0.9), 13: (0.4, 0.4, 0.3), 14: (0.6, 0.4, 0.9), 15: (0.6, 0.4, 0.6), 16: (0.8, 0.4, 0.9), 23: (0.5, 0.6, 0.9), 24: (0.7, 0.6, 0.9), 25: (0.5, 0.8, 0.9), 27: (0.5, 1.0, 0.9), 28: (0.7, 1.0, 0.1)}
    points = F.array(*(F.struct(F.lit(at[i][0]).alias("x"), F.lit(at[i][1]).alias("y"), F.lit(at[i][2]).alias("visibility")) for i in range(33)))
    got = dict(zip(geo.pose_row(points), one(spark, *geo.pose_row(points).values()), strict=True))
    assert (got["visibility_min"], got["angle_knee_back"], got["stance_length"]) == (0.1, None, None)
    want = {"visibility_mean": 0.76, "visibility_left_arm": 0.5, "visibility_right_arm": 0.9, "angle_elbow_dom": 90, "angle_elbow_left": 90, "angle_elbow_right": 90, "angle_knee_front": 180, "hand_height": 0.6, "hand_height_left": 0.6, "com_height": 1 - (0.2 + 0.2 + 0.6 + 0.6 + 0.8 + 0.5) / 6}
    assert {k: got[k] for k in want} == pytest.approx(want) and got["angle_trunk_lean"] == pytest.approx(math.degrees(math.atan2(0.1, 0.4)))
    moved = one(spark, geo.full_frame(points, F.lit(640), F.lit(640), F.lit(1280)))[0]
    assert (moved[11]["x"], moved[11]["y"], moved[11]["visibility"]) == (pytest.approx(0.7), 0.2, 0.6)


def test_quads(spark):
    quad = [(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (400, 0), (400, 200), (0, 200))]
    assert tuple(one(spark, geo.quad_area(quad), geo.is_convex(quad), geo.quad_aspect(quad))) == (80_000.0, True, 2.0)
    bow = [quad[0], quad[2], quad[1], quad[3]]
    assert one(spark, geo.is_convex(bow))[0] is False
    shuffled = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((400, 200), (0, 0), (0, 200), (400, 0))))
    assert [tuple(p) for p in one(spark, geo.ordered_corners(shuffled))[0]] == [(0, 0), (400, 0), (400, 200), (0, 200)]


def test_text(spark):
    assert tuple(one(spark, tx.margin(F.lit("3-1")), tx.margin(F.lit("walkover")), tx.best_of(F.lit("Best of 3")), tx.win_share(F.lit("3:1")), tx.win_share(F.lit("2-2")), tx.win_share(F.lit("?")))) == (2, 0, 3, 0.75, 0.5, 0.5)
    assert one(spark, tx.padded_games(F.lit("11:3 9:11")))[0] == ["11-3", "9-11", "N/A", "N/A", "N/A"]
    assert tuple(one(spark, *tx.name_and_id(F.lit("Ann Lee (#42)")), tx.frame_number(F.lit("img_000010.txt")))) == ("Ann Lee", 42, 10)
    line = F.lit("0 0.489063 0.380093 0.022917 0.023148")
    assert tuple(one(spark, *tx.label_parts(line).values())) == (0, 0.489063, 0.380093, 0.022917, 0.023148)
    assert one(spark, tx.label_parts(F.lit("0 0.1"))["cls"])[0] is None


def test_fusion_weights(spark):
    assert tuple(one(spark, *(fz.live_weight(F.lit(g)) for g in (0.0, 0.5, 1.0)))) == pytest.approx((0.35, 0.6, 0.85))
    at = lambda *v: one(spark, fz.progress(*map(F.lit, v)))[0]
    assert [at(5, 5, 0, 0, 3), at(9, 8, 2, 0, 3), at(7, 2, 2, 0, 3), at(3, 2, 2, 2, 3), at(30, 28, 2, 2, 3), at(0, 0, 0, 0, 4)] == pytest.approx([10 / 55, 0.85, 0.6, 49 / 55, 1, 0])


def test_speed_and_winner(spark):
    rows = spark.createDataFrame([(1, i, 30.0 * i, 0.0) for i in range(6)], "k int, f int, x double, y double")
    out = win.pixel_speed(rows, ["k"], ["f"], "f", "x", "y", 30.0).orderBy("f").collect()
    assert out[0].speed is None and out[0].smooth_speed == 0 and out[5].smooth_speed == pytest.approx(900)
    who = lambda *v: one(spark, win.segment_winner(*(F.lit(x) for x in v)))[0]
    assert (who(5, 3, 5, 4), who(5, 3, 6, 3), who(5, 3, 6, 4), who(5, 3, 4, 3)) == ("p2", "p1", "unknown", "p1")


def play(seed, n=400):
    r = random.Random(seed)
    return [(seed, i, r.random() < 0.6, r.randrange(3), r.random() < 0.8, r.choice([-1, 0, 1]), r.random() < 0.05) for i in range(n)]


@pytest.fixture(scope="module")
def games(spark):
    rows = [row for seed in range(4) for row in play(seed)]
    return rows, spark.createDataFrame(rows, "k int, f int, on boolean, v int, ok boolean, d int, reset boolean")


def test_gate_matches_state_machine(games):
    rows, df = games
    got = {(r.k, r.f): (r.is_active, r.collects) for r in win.gate(df, ["k"], ["f"], F.col("on"), 4, 3).collect()}
    for k in range(4):
        state = [0, None, 0, False]
        for _, f, on, *_ in (r for r in rows if r[0] == k):
            state, out = live.gate_step(state, (0, on), 4, 3)
            assert got[k, f] == out


def test_vote_and_stable_match_state_machine(games):
    rows, df = games
    voted = win.vote(df, ["k"], ["f"], "v", F.col("ok"))
    got = {(r.k, r.f): (r.vote, r.stable) for r in win.stable_run(voted, ["k"], ["f"], "vote", F.col("ok"), 3).collect()}
    for k in range(4):
        state = [[], None, 0, None]
        for _, f, _, v, ok, *_ in (r for r in rows if r[0] == k):
            state, out = live.stable_step(state, (v, ok), runs=3)
            assert got[k, f] == out


def test_clamped_sum(games):
    rows, df = games
    got = {(r.k, r.f): r.score for r in win.clamped_sum(df, ["k"], ["f"], "d", F.col("reset")).collect()}
    for k in range(4):
        score = 0
        for _, f, _, _, _, d, reset in (r for r in rows if r[0] == k):
            score = max(0, (0 if reset else score) + d)
            assert got[k, f] == score


def test_metric_speed_matches_state_machine(spark):
    r = random.Random(3)
    rows = [(1, i, r.uniform(0, 30), r.uniform(0, 30), r.random() < 0.7) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, f int, x double, y double, ok boolean")
    got = [x.metric_speed for x in win.metric_speed(df, ["k"], ["f"], "f", "x", "y", F.col("ok"), 1.0, 12.0).orderBy("f").collect()]
    last, kept, value = None, deque(maxlen=5), None
    for i, (_, f, x, y, ok) in enumerate(rows):
        if ok:
            if last:
                speed = math.hypot(x - last[1], y - last[2]) / (f - last[0])
                if speed <= 12:
                    kept.append(speed)
                    s = sorted(kept)
                    value = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
            last = (f, x, y)
        assert got[i] == pytest.approx(value) if value is not None else got[i] is None


def test_asof_and_range(spark):
    left = spark.createDataFrame([(1, 0), (1, 5), (1, 9)], "k int, f int")
    right = spark.createDataFrame([(1, 5, 7, None), (1, 6, None, 3)], "k int, f int, a int, b int")
    out = {r.f: (r.a, r.b) for r in jn.asof_join(left, right, ["k"], "f", ["a", "b"], {"a": 0, "b": 0}).collect()}
    assert out == {0: (0, 0), 5: (7, None), 9: (None, 3)}
    spans = spark.createDataFrame([(1, 10, 0, 5), (1, 11, 5, 200)], "k int, id int, s int, e int")
    hits = jn.range_join(left, spans, ["k"], "f", "s", "e", 4)
    assert sorted((r.f, r.id) for r in hits.collect()) == [(0, 10), (5, 10), (5, 11), (9, 11)]


def test_recurrences(spark):
    rows = [(1, i, d, s) for i, (d, s) in enumerate([(0.0, 0.0), (40.0, 0.0), (0.0, 0.0), *[(0.0, 0.5)] * 15, (0.0, 0.0)])]
    out = rc.scene_gate(spark.createDataFrame(rows, "k int, f int, d double, s double"), ["k"], ["f"], "d", "s").orderBy("f").collect()
    assert [r.scene for r in out][:4] == ["gameplay", "cut", "other", "other"]
    assert out[17].scene == "gameplay" and [i for i, r in enumerate(out) if r.is_cut] == [17]
    assert [i for i, r in enumerate(out) if r.process] == [0, 17, 18]
    state, _ = rc.score_step((0, 0, 0, 0), ("p1", "point", -1))
    assert state == (0, 0, 0, 0)
    state, _ = rc.score_step((4, 2, 0, 1), ("p1", "set", 1))
    assert state == (0, 0, 1, 1)
    assert rc.score_step((3, 1, 2, 0), ("p1", "swap", 0))[0] == (1, 3, 0, 2)


def test_rally_features(spark):
    """By hand: two poses of player 1, one of player 2, a rally with a ball only and one without a ball."""
    from courtside.operators import features as ft

    poses = spark.createDataFrame([(1, 1, 2.0, 0.5, -3.0, 90.0, 0.8), (1, 1, 4.0, 0.7, 1.0, None, 0.6), (1, 2, 1.0, 0.4, 2.0, 60.0, 0.5), (2, 2, 1.0, 0.1, 1.0, 30.0, 0.4), (None, 1, 9.0, 9.0, 9.0, 9.0, 9.0)], "r int, player_id int, v_hand_speed double, com_height double, v_torso_x double, angle_elbow_dom double, visibility_mean double")
    ball = spark.createDataFrame([(1, 10, 3.0), (1, 16, 5.0), (3, 7, None)], "r int, frame int, speed_mps double")
    got = {x.r: tuple(x)[1:] for x in ft.rally_features(poses, ball, ["r"]).collect()}
    assert got[1] == pytest.approx((2.0, math.sqrt(0.02), 0.0, 30.0, 0.6, 4.0, 5.0, 6))
    assert got[2] == pytest.approx((-1.0, 0.0, -1.0, -30.0, 0.2, 0.0, 0.0, 0)) and got[3] == (0,) * 8 and len(got) == 3


def test_stable_sets_and_obscured(spark):
    rows = [(1, i, v, ok) for i, (v, ok) in enumerate([(1, True), (1, True), (None, True), (1, True), (1, True), (7, True), (2, True), (2, True), (2, True), (3, False)])]
    df = spark.createDataFrame(rows, "k int, f int, v int, ok boolean")
    out = win.stable_sets(df, ["k"], ["f"], "v", F.col("ok"), runs=3).orderBy("f").collect()
    assert [x.stable_sets for x in out] == [None] * 8 + [2, 2]
    flags = win.obscured(df, ["k"], ["f"], F.col("f") % 3 == 0, F.col("ok")).orderBy("f").collect()
    assert [x.obscured for x in flags] == [False] * 9 + [True]


def test_calibration_valid(spark):
    quad = lambda *points: [(F.lit(float(x)), F.lit(float(y))) for x, y in points]
    good, point, small, line = quad((200, 300), (1080, 300), (1080, 500), (200, 500)), quad(*[(5, 5)] * 4), quad((0, 0), (5, 0), (5, 3), (0, 3)), quad((0, 0), (100, 0), (200, 0), (300, 0))
    assert [one(spark, geo.calibration_valid(q))[0] for q in (good, point, small, line)] == [True, False, False, False]


def test_elo(spark):
    assert rt.elo_step({}, "a", "b", 1) == (1500, 1500, 1516, 1484)
    df = spark.createDataFrame([(1, 1, "a", "b", 1), (1, 2, "a", "b", 1), (2, 1, "a", "b", 0)], "pool int, t int, a string, b string, w int")
    out = {(r.pool, r.t): r.elo_a for r in rt.elo(df, "pool", "a", "b", "w", ["t"]).collect()}
    assert out == {(1, 1): 1500, (1, 2): 1516, (2, 1): 1500}


def test_splits(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    split = rk.hash_split(df, "k", {"train": 0.8, "val": 0.1, "test": 0.1})
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 800, "val": 100, "test": 100}
    assert sorted(r["rank"] for r in split.collect()) == list(range(1, 1001))


def test_files(spark, tmp_path):
    from courtside.sources import files

    folder = tmp_path / "m1"
    folder.mkdir()
    (folder / "trajectories_1.csv").write_text("frame,track_id,x,y,speed_pps,x_m,y_m,speed_mps\n1,0,1.00,2.00,3.00\n2,0,1.50,2.00,3.00,0.10,0.20,0.30\n")
    (folder / "broadcast_session_1.json").write_text('{"player_names": ["Ann"], "sets_to_win": 4}')
    rows = {r.frame: (r.match_id, r.x_m) for r in files.read_logs(spark, str(tmp_path), "trajectories").collect()}
    assert rows == {1: (1, None), 2: (1, 0.1)}
    assert tuple(files.read_sessions(spark, str(tmp_path)).first()) == ("m1", "Ann", "Player 2", 4, 7)
    (tmp_path / "points.json").write_text('{"5": {"x": 1, "y": 2}, "6": {"x": 1}}')
    assert [tuple(r) for r in files.read_annotations(spark, str(tmp_path / "points.json")).collect()] == [(5, 1.0, 2.0)]
    labels = spark.createDataFrame([("a", 0, 0.5, 0.5, 0.1, 0.1)], "name string, cls int, cx double, cy double, w double, h double")
    files.write_labels(labels, str(tmp_path / "labels"))
    assert files.read_labels(spark, str(tmp_path / "labels/*/*.txt")).select("cx").first()[0] == 0.5


def test_log_kinds_and_lists(spark, tmp_path):
    """Each kind of log, and the small readers and writers, on files by hand."""
    from courtside.sources import files

    folder = tmp_path / "m1"
    folder.mkdir()
    (folder / "scores_1.csv").write_text("frame,timestamp_sec,player1_score,player1_sets\n5,0.5,3,1\n")
    (folder / "rallies_1.csv").write_text("rally_id,rally_start_frame,rally_end_frame\n1,10,40\n2,50,\n")
    (folder / "pose_frames_1.csv").write_text("frame,timestamp_sec,player_id,visibility_mean\n7,0.7,2,0.25\n")
    log = lambda kind: files.read_logs(spark, str(tmp_path), kind)
    assert log("scores").select("frame", "player1_score", "player2_obscured").first()[:] == (5, 3, None)
    assert sorted(tuple(r) for r in log("rallies").select("rally_id", "rally_end_frame").collect()) == [(1, 40), (2, None)]
    assert log("pose_frames").select("player_id", "visibility_mean", "v_com_y").first()[:] == (2, 0.25, None)
    files.write_logs(log("scores"), str(tmp_path / "logs"))
    assert spark.read.parquet(str(tmp_path / "logs")).select("match_id", "frame").first()[:] == (1, 5)

    (tmp_path / "c.json").write_text('{"fps": 30, "rois": {"p1": [1, 2, 3, 4]}, "table_corners": [[0, 1], [2, 3]]}')
    c = files.read_config(spark, str(tmp_path / "c.json")).first()
    assert (c.fps, c.rois["p1"], c.table_corners[1], c.ball_model) == (30.0, [1, 2, 3, 4], [2.0, 3.0], None)
    (tmp_path / "h.csv").write_text('ID_A,Player A,Match  Score\n 7 ,Ann,3-1\n')
    h = files.read_history(spark, str(tmp_path / "h.csv"))
    assert h.columns == ["ID_A", "a", "score"] and h.first()[:] == ("7", "Ann", "3-1")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "train.txt").write_text("a.jpg\n\n b.jpg \n")
    assert sorted(tuple(r) for r in files.read_splits(spark, str(tmp_path / "s")).collect()) == [("train", "a.jpg"), ("train", "b.jpg")]
    images = tmp_path / "x" / "export1" / "valid" / "images"
    images.mkdir(parents=True)
    (images / "f_000001.jpg").write_bytes(b"x")
    assert [tuple(r) for r in files.find_exports(spark, str(tmp_path / "x")).collect()] == [("export1", "val", "f_000001")]

    scores = spark.createDataFrame([(0.5, 15, 3, "x")], "timestamp_sec double, frame int, score int, other string")
    files.write_csv(scores, str(tmp_path / "out"))
    files.write_csv(scores, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    for _ in range(2):
        files.write_score_log(scores, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).columns == ["timestamp_sec", "frame", "score"] and spark.read.csv(str(tmp_path / "log"), header=True).count() == 2
    scores.write.parquet(str(tmp_path / "live"))
    assert files.live_rows(spark, str(tmp_path / "live"), "timestamp_sec double, frame int, score int").isStreaming


def test_manual_score(spark):
    """Batch against the live step on random events, nulls included."""
    rng = random.Random(5)
    rows = [(k, i, rng.choice(["p1", "p2", None]), rng.choice(["point"] * 6 + ["set", "swap", "none", None]), rng.choice([1, 1, 1, -1])) for k in range(4) for i in range(80)]
    got = {(r.k, r.f): r[5:] for r in win.manual_score(spark.createDataFrame(rows, "k int, f int, p string, kind string, d int"), ["k"], ["f"], "p", "kind", "d").collect()}
    for k in range(4):
        state = (0, 0, 0, 0)
        for _, i, *row in rows[k * 80 : k * 80 + 80]:
            state, out = rc.score_step(state, tuple(row))
            assert got[k, i] == out


def test_name_search(spark):
    names = spark.createDataFrame([(1, "Ann Lee"), (2, "LEE"), (3, None), (4, ""), (5, "aaaa")], "i int, n string")
    wanted = spark.createDataFrame([("lee",), ("LEE",), ("nn le",), ("a",), ("aaa",), ("",), (None,), ("%",)], "w string")
    low = {1: "ann lee", 2: "lee", 4: "", 5: "aaaa"}
    assert sorted((r.i, r.w) for r in jn.name_search(names, "n", wanted, "w").collect()) == sorted((i, w) for i, n in low.items() for w in ("lee", "nn le", "a", "aaa", "") if w in n)


def test_rank_slice(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    out = rk.rank_slice(df, F.floor(F.col("k") / 40), ["k"], 75, 100)
    assert sorted((r["rank"], r.k) for r in out.collect()) == [(i + 1, i) for i in range(74, 174)]


def test_predictor():
    """Rallies that end by a next one or by an end row, against plain sums; state stays as small as it starts."""
    rng = random.Random(3)
    rows = [(1 + i // 20, i, rng.choice([1, 2, None]), rng.random(), rng.choice([None, rng.random()]), rng.uniform(-1, 1), rng.random(), rng.random(), rng.random() < 0.5, rng.choice([None, rng.random()])) for i in range(60)]
    state, ended = live.PREDICTOR, []
    for row in [*rows, (None, 60, *[None] * 8)]:
        state, (rally, *values, p) = live.predict_step(state, row, lambda v: v[0])
        if rally is not None:
            ended.append((rally, values))
            assert p == values[0]
    assert [r for r, _ in ended] == [1, 2, 3] and live.PREDICTOR[4] == 0.5 and live.PREDICTOR[1][0][0] == [0, 0.0]
    mean = lambda v: sum(v) / len(v) if v else 0.0
    for rally, values in ended:
        side = lambda p, c: [r[c] for r in rows if r[0] == rally and r[2] == p and r[c] is not None]
        dev = lambda v: math.sqrt(sum((x - mean(v)) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else 0.0
        fly = [r for r in rows if r[0] == rally and r[8]]
        speeds = [r[9] for r in fly if r[9] is not None]
        want = [mean(side(1, 3)) - mean(side(2, 3)), dev(side(1, 4)) - dev(side(2, 4)), mean([abs(x) for x in side(1, 5)]) - mean([abs(x) for x in side(2, 5)]), mean(side(1, 6)) - mean(side(2, 6))]
        want += [(mean(side(1, 7)) + mean(side(2, 7))) / 2, mean(speeds), max(speeds, default=0.0), fly[-1][1] - fly[0][1] if fly else 0]
        assert values == pytest.approx(want)


def test_models_on_disk(spark, tmp_path):
    """A saved model scores as before; the user's model runs over batches."""
    from courtside.operators import learning as ml

    df = spark.createDataFrame([(i / 20, (i * 7 % 20) / 20, int(i > 9)) for i in range(20)], "live double, career double, label int")
    model = ml.meta("live", "career").fit(df)
    ml.save(model, str(tmp_path / "model"))
    assert ml.scored(ml.load(str(tmp_path / "model")), df).collect() == ml.scored(model, df).collect()
    assert ml.apply_model(df, ml.WinModel()).select("p1", "reliable").distinct().collect() == ml.even_chances(df).select("p1", "reliable").distinct().collect()
