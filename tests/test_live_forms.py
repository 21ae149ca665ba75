"""Odd cases of live steps, searches, pairings and files; the usual ones are compared with SQL and with batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import features as ft
from courtside.operators import joins as jn
from courtside.operators import rallies as ra
from courtside.operators import ranking as rk
from courtside.operators import ratings as rt
from courtside.operators import windows as win
from courtside.sources import files
from courtside.streaming import tracks as live


def run(step, start, rows, **more):
    out = []
    for row in rows:
        start, made = step(start, row, **more)
        out.append(made)
    return out


def test_points_live_and_in_batch(spark):
    """Scores that are null, come back and change together."""
    r = random.Random(2)
    rows = [(m, f, r.choice([None, 1, 1, 2]), r.choice([None, 0, 0, 3])) for m in range(3) for f in range(60)]
    df = spark.createDataFrame(rows, "m int, f int, p1 int, p2 int")
    batch = [tuple(x) for x in ra.point_rows(df, ["m"], ["f"], "p1", "p2").orderBy("m", "f").select("rally_id", "is_start", "won_before").collect()]
    assert batch == [x for m in range(3) for x in run(live.point_step, [None, None, 0], [x[2:] for x in rows if x[0] == m])]


def test_metric_speed_live_and_in_batch(spark):
    """Invalid rows, rejected speeds and the median of the last ones."""
    r = random.Random(3)
    rows = [(1, f, r.uniform(0, 3), r.uniform(0, 2), r.random() < 0.7) for f in sorted(r.sample(range(400), 120))]
    df = spark.createDataFrame(rows, "m int, f int, x double, y double, ok boolean")
    out = win.metric_speed(df, ["m"], ["f"], "f", "x", "y", F.col("ok"), 25.0, limit=20.0).orderBy("f").collect()
    for got, want in zip(out, run(live.metric_step, [None, None, None, [], None], [(f, x, y, ok) for _, f, x, y, ok in rows], rate=25.0, limit=20.0), strict=True):
        assert (got.metric_x, got.metric_y, got.metric_speed) == pytest.approx(want)


def test_small_steps():
    assert [x[0] for x in run(live.sets_step, [None, 0, None], [(1, True), (1, True), (2, True), (None, True), (2, True), (9, True), (2, True), (2, True), (2, False), (2, True)], runs=2)] == [None, 1, 1, 1, 1, 1, 1, 2, 2, 2]
    assert [x[0] for x in run(live.obscured_step, [False], [(False, False), (True, False), (False, True), (True, True)])] == [False, True, True, False]
    assert run(live.trail_step, [], [(1, 2), (3, 4), (5, 6)], length=2)[-1] == ([3.0, 5.0], [4.0, 6.0])
    stats = run(live.stats_step, live.LIVE_STATS, [(0, None, None), (0, 4.0, 2), (0, 0.0, 2), (0, 8.0, None), (1, None, 8)])
    assert stats[0][:2] == (None, None) and stats[3] == (6.0, 8.0, 0, 0, 2, 0, 0, 0, 0, 0, 0) and stats[4] == (None, None, *[0] * 8, 1)
    assert live.LIVE_STATS == [None, 0, 0.0, None, [0] * 9]


def test_signed_velocities(spark):
    rows = [(1, 0, 1.0, 0.0, 5.0), (1, 6, 0.4, 0.8, None), (1, 12, None, 0.0, 2.0), (2, 0, 1.0, 1.0, 1.0), (2, 0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "k int, f int, x double, y double, com double")
    out = [tuple(r)[-3:] for r in win.pose_velocities(df, ["k"], ["f", "x"], "f", 30.0, {"v_hand": ("x", "y")}, {"v_x": "x", "v_com": "com"}).orderBy("k", "f", "x").collect()]
    assert out == [(None, None, None), (pytest.approx(5.0), pytest.approx(-3.0), None), (None, None, None), (None, None, None), (None, None, None)]


def test_player_search(spark):
    rows = [(1, "Ann Lee", "Bo Ek", 10, 20), (2, "Bo Ek", "Cy Lee", 11, 21), (3, "Dee Leek", "Ed Lee", 12, 22), (4, None, "Flo", 13, 23)]
    matches = spark.createDataFrame(rows, "no int, name_a string, name_b string, age_a int, age_b int")
    searches = spark.createDataFrame([("LEE",), ("bo ek",), ("nobody",), ("lee",), (None,), ("lo",), ("a.n",)], "wanted string")
    got = sorted(map(tuple, jn.player_search(matches, searches, "wanted", {"a": "name_a", "b": "name_b"}, F.col("no"), ["age"]).collect()))
    assert got == [("bo ek", "a", "Bo Ek", 11), ("lee", "a", "Dee Leek", 12), ("lo", "b", "Flo", 23)]


def test_frame_pairs(spark):
    left = spark.createDataFrame([("g1", "img_000010.jpg"), ("g2", "img_10.jpg"), ("g1", "img_000011.jpg"), ("g1", "none.jpg")], "game string, name string")
    right = spark.createDataFrame([("g1", "v2_mask10.png"), ("g1", "mask.png"), ("g2", "0010"), ("g3", "11")], "game string, name string")
    assert sorted(tuple(r) for r in jn.frame_pairs(left, right, "game", "name").select("game", "frame", "name_right", "pair").collect()) == [("g1", 10, "v2_mask10.png", "g1_10"), ("g2", 10, "0010", "g2_10")]


def test_values_from_data(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "v string")
    out = rt.one_hot(df, "v", None, "is_")
    assert out.columns == ["v", "is_b", "is_c"] and sorted(map(tuple, out.select("is_b", "is_c").collect())) == [(0, 0), (0, 0), (0, 1), (1, 0)]
    with pytest.raises(ValueError):
        rt.one_hot(spark.range(rt.VALUES + 1).select(F.col("id").cast("string").alias("v")), "v", None, "is_")
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "z"), (2, "w"), (3, None)], "k int, v string")
    assert sorted(map(tuple, rk.most_common(pairs, ["k"], "v").collect())) == [(1, "y", 2), (2, "w", 1)]


def test_packet_defaults(spark):
    df = spark.createDataFrame([(1, 5, 0.2, True, 1.0), (1, 6, 0.3, None, 2.0)], "m int, frame int, timestamp_sec double, seen boolean, x double")
    pose = F.when(F.col("frame") == 5, F.struct(F.col("x").alias("com_height"), F.lit("raw").alias("debug_landmarks")))
    first, second = (r.packet.asDict(recursive=True) for r in ft.packets(df, ["m"], {"detected": F.col("seen"), "speed_pps": F.col("x")}, {}, {}, (pose, pose)).orderBy("packet.frame_idx").collect())
    assert first["ball"] == {"detected": True, "position_px": None, "position_m": None, "speed_mps": None, "speed_pps": 1.0, "trajectory_px": None} and first["pose"]["player1"] == {"com_height": 1.0}
    assert not second["ball"]["detected"] and second["ball"]["speed_pps"] is None and second["pose"]["player2"] is None
    assert second["score"] == {"player1_score": None, "player2_score": None, "player1_sets": 0, "player2_sets": 0, "sets_to_win": 3, "score_reliable": True}
    assert second["rally"] == {"is_active": False, "rally_id": 0, "rally_duration_sec": 0.0, "mean_speed_mps": None, "max_speed_mps": None, "landing_zones": [0] * 9}


def test_weights_in_two_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 0.25, 0.4, 0.6, 0.4), (2, 0.1, 0.2, 0.3, 0.6, 0.4)], "match_id long, cv double, profile double, fused double, weight_cv double, weight_profile double")
    files.write_weights(df, f"{tmp_path}/w")
    assert sorted(map(tuple, files.read_weights(spark, f"{tmp_path}/w").select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
