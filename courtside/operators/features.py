"""Features of a rally for the win models, and what is known of a match beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import fusion as fz
from courtside.functions import geometry as geo
from courtside.operators import joins as jn
from courtside.operators import windows as win

#: The eight features, in the order that models read them.
RALLY_FEATURES = ["hand_speed_diff", "com_std_diff", "movement_diff", "elbow_diff", "visibility_avg", "ball_speed_mean", "ball_speed_max", "rally_duration_frames"]

#: What a match's model reads after a point, in this order: means over all its rallies and the last three, the score, the rally's number.
MODEL_FEATURES = [*RALLY_FEATURES, *(f"{c}_last3" for c in RALLY_FEATURES), "score_diff", "total_points", "rally_number"]


def rally_features(
    poses: DataFrame, ball: DataFrame, keys: Sequence[str], *, player: str = "player_id", frame: str = "frame", hand_speed: str = "v_hand_speed", com: str = "com_height", torso: str = "v_torso_x",
    elbow: str = "angle_elbow_dom", visibility: str = "visibility_mean", speed: str = "speed_mps",
) -> DataFrame:
    """One row per rally of ``keys`` that has a pose or a ball row, with RALLY_FEATURES.

    Differences are player 1's mean (sample deviation for ``com``) less player 2's; movement is the mean absolute ``torso``.
    Poses and ball rows are summed on their own sides and then joined, so they never multiply. What a side has no values
    for, or a deviation of one value, counts as 0. Rallies without keys (null) are left out.
    """
    of = lambda agg, value, who: F.coalesce(agg(F.when(F.col(player) == who, value)), F.lit(0.0))
    apart = lambda agg, value: of(agg, value, 1) - of(agg, value, 2)
    known = lambda df: df.dropna(subset=list(keys))
    pose = known(poses).groupBy(*keys).agg(
        apart(F.avg, F.col(hand_speed)).alias("hand_speed_diff"), apart(F.stddev_samp, F.col(com)).alias("com_std_diff"), apart(F.avg, F.abs(F.col(torso))).alias("movement_diff"),
        apart(F.avg, F.col(elbow)).alias("elbow_diff"), ((of(F.avg, F.col(visibility), 1) + of(F.avg, F.col(visibility), 2)) / 2).alias("visibility_avg"),
    )
    balls = known(ball).groupBy(*keys).agg(F.avg(speed).alias("ball_speed_mean"), F.max(speed).cast("double").alias("ball_speed_max"), (F.max(frame) - F.min(frame)).cast("long").alias("rally_duration_frames"))
    return pose.join(balls, list(keys), "full_outer").select(*keys, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in RALLY_FEATURES))


#: The fields of a live packet, by its parts.
BALL = ["detected", "position_px", "position_m", "speed_mps", "speed_pps", "trajectory_px"]
SCORE = ["player1_score", "player2_score", "player1_sets", "player2_sets", "sets_to_win", "score_reliable"]
RALLY = ["is_active", "rally_id", "rally_duration_sec", "mean_speed_mps", "max_speed_mps", "landing_zones"]


def packets(df: DataFrame, keys: Sequence[str], ball: dict[str, Column], score: dict[str, Column], rally: dict[str, Column], poses: tuple[Column, Column], frame: str = "frame", time: str = "timestamp_sec") -> DataFrame:
    """keys and ``packet``: each frame's row as the nested record that a live model sees.

    ``ball``, ``score`` and ``rally`` give the columns of BALL, SCORE and RALLY; what is left out is null, but sets are 0,
    sets_to_win 3, scores reliable, a rally idle with no zone hit. Without a detection the ball has no position, speed or
    trajectory. ``poses`` are a struct per player, or null; its debug_landmarks are dropped.
    """
    defaults = {"detected": F.lit(False), "player1_sets": F.lit(0), "player2_sets": F.lit(0), "sets_to_win": F.lit(3), "score_reliable": F.lit(True), "is_active": F.lit(False), "rally_id": F.lit(0), "rally_duration_sec": F.lit(0.0)}
    defaults |= {"landing_zones": F.array_repeat(F.lit(0).cast("long"), 9)}
    part = lambda names, given: {n: F.coalesce(given[n], defaults[n]) if n in given and n in defaults else given.get(n, defaults.get(n, F.lit(None))) for n in names}
    seen = part(BALL, ball)
    seen |= {n: F.when(seen["detected"], c) for n, c in seen.items() if n != "detected"}
    fields = lambda columns: F.struct(*(c.alias(n) for n, c in columns.items()))
    players = [F.when(p.isNotNull(), p.dropFields("debug_landmarks")).alias(f"player{i}") for i, p in enumerate(poses, 1)]
    whole = F.struct(
        F.col(frame).alias("frame_idx"), F.col(time).alias("timestamp_sec"), fields(seen).alias("ball"), fields(part(SCORE, score)).alias("score"), fields(part(RALLY, rally)).alias("rally"),
        F.struct(*players).alias("pose"), F.col(time).alias("match_elapsed_sec"),
    )
    return df.select(*keys, whole.alias("packet"))


def model_features(rallies: DataFrame, keys: Sequence[str], rally: str, scores: tuple[str, str], sets: tuple[str, str] | None = None, set_points: float = 11) -> DataFrame:
    """keys, rally and MODEL_FEATURES: one row per rally, with what is known of its match once it has ended.

    ``rallies`` has RALLY_FEATURES and the scores at the rally's end; a set counts ``set_points``, without ``sets`` nothing.
    """
    out = win.expanding(rallies, keys, [rally], RALLY_FEATURES, recent=3)
    s1, s2 = (F.col(sets[0]), F.col(sets[1])) if sets else (F.lit(0), F.lit(0))
    score = fz.score_context(F.coalesce(scores[0], F.lit(0)), F.coalesce(scores[1], F.lit(0)), s1, s2, set_points)
    means = [F.col(f"{c}_mean").cast("double").alias(c) for c in RALLY_FEATURES]
    recent = [F.col(f"{c}_last3").cast("double").alias(f"{c}_last3") for c in RALLY_FEATURES]
    return out.select(*keys, rally, *means, *recent, *(c.cast("double").alias(n) for n, c in score.items()), F.col("row_in_key").cast("double").alias("rally_number"))


def calibration_at(frames: DataFrame, calibrations: DataFrame, keys: Sequence[str], frame: str, corners: Sequence[str], valid: Column) -> DataFrame:
    """Adds the corners in force at each frame: the last valid calibration at or before it, null before the first."""
    return jn.asof_join(frames, calibrations.filter(valid), list(keys), frame, list(corners), {})


def calibrated_positions(frames: DataFrame, calibrations: DataFrame, keys: Sequence[str], frame: str, corners: Sequence[str], u: str, v: str, usable: Column | None = None) -> DataFrame:
    """Adds x_m, y_m, the place on the table of pixel (u, v) by the calibration in force: the last one at or before the frame that is valid.

    ``corners`` are the eight coordinate columns of TL, TR, BR, BL, from marks or from a tracker, whose rows that aren't
    ``usable`` (such as its ``is_valid``) count as none. Null before the first calibration and for places far from the table.
    """
    quad = [(F.col(corners[i]), F.col(corners[i + 1])) for i in range(0, 8, 2)]
    valid = geo.calibration_valid(quad) if usable is None else usable & geo.calibration_valid(quad)
    placed = calibration_at(frames, calibrations, keys, frame, corners, valid)
    x, y = geo.to_meters(list(geo.homography(quad).values()), F.col(u), F.col(v))
    return placed.withColumns({"x_m": x, "y_m": y}).drop(*corners)


def with_profile(live: DataFrame, career: DataFrame, keys: Sequence[str], probability: str, name: str = "profile_probability") -> DataFrame:
    """Adds each match's career probability, null if there is none, and ``has_profile``. A match has one career row at most."""
    found = career.select(*keys, F.col(probability).alias(name))
    return live.join(found, list(keys), "left").withColumn("has_profile", F.col(name).isNotNull())
