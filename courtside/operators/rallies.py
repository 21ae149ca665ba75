"""Points of a match as records: where each begins and ends, who won it, and what the ball did in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.functions import geometry as geo
from courtside.operators import windows as win

Names = Sequence[str]
ZONES = 9
#: What the viewer says of the point that runs: throw its samples away, or take that back.
SKIP, UNDO = "skip", "undo"


def point_rows(df: DataFrame, keys: Names, order: Names, first: str, second: str, *, strict: bool = False) -> DataFrame:
    """Adds rally_id, is_start, is_known and won_before along each key's rows.

    A point ends where the pair of scores differs from that of the row before, if the first score is known in both; a null
    second score equals another. That row starts the next point and says who won the last: the side whose score changed,
    if the other's didn't (``strict``: only upwards), else unknown. ``is_known`` marks rows at which the pair becomes known:
    there the point that runs takes its start scores anew.
    """
    w = win.along(keys, order)
    out = win.segments(df, keys, order, first, second)
    before_first, before_second = F.lag(first).over(w), F.lag(second).over(w)
    known = before_first.isNull() & F.col(first).isNotNull() & F.col(second).isNotNull()
    winner = win.segment_winner(before_first, before_second, F.col(first), F.col(second), strict)
    return out.withColumns({"is_known": known, "won_before": F.when(F.col("is_start"), winner)})


def point_spans(rows: DataFrame, keys: Names, frame: str, columns: Names) -> DataFrame:
    """One row per point of ``point_rows``: keys, rally_id, first_frame, last_frame, end_frame, winner, and start values of columns.

    end_frame is the next point's first frame, null for the last. Start values are those of the last row that started the
    point or at which the scores became known, null without one. The last point's winner is unknown.
    """
    begins = F.when(F.col("is_start") | F.col("is_known"), F.col(frame))
    spans = rows.groupBy(*keys, "rally_id").agg(
        F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.max("won_before").alias("won_before"), F.max_by(F.struct(*columns), begins).alias("r_start"),
    )
    w = win.along(keys, ["rally_id"])
    spans = spans.withColumns({"end_frame": F.lead("first_frame").over(w), "winner": F.coalesce(F.lead("won_before").over(w), F.lit("unknown"))})
    return spans.select(*keys, "rally_id", "first_frame", "last_frame", "end_frame", "winner", *(F.col(f"r_start.{c}").alias(c) for c in columns))


def in_play_frames(tracks: DataFrame, keys: Names, frame: str, x: str, y: str, calibrated: Column) -> DataFrame:
    """keys, frame, in_play: whether a position is on the table or just beside it; without a calibration, whether there is one at all."""
    there = F.col(x).isNotNull() & F.col(y).isNotNull()
    return tracks.groupBy(*keys, frame).agg(F.bool_or(F.when(calibrated, there & geo.on_table(F.col(x), F.col(y))).otherwise(there)).alias("in_play"))


def speed_and_zones(speed: Column, zone: Column) -> list[Column]:
    """Mean, max and population deviation (null for a single one) of the speeds above 0, and how often each zone was hit."""
    up = F.when(speed > 0, speed)
    stats = [F.avg(up).alias("mean_speed_mps"), F.max(up).alias("max_speed_mps"), F.when(F.count(up) > 1, F.stddev_pop(up)).alias("speed_std_mps")]
    return [*stats, *(F.count_if(zone == z).alias(f"landing_zone_{z}") for z in range(ZONES))]


def live_stats(df: DataFrame, keys: Names, order: Names, speed: Column, zone: Column) -> DataFrame:
    """Adds live_mean_speed, live_max_speed (of speeds above 0, null before the first) and live_zone_0.. of the rows so far of each key.

    ``keys`` name a point; speeds and zones of rows that aren't samples are null.
    """
    w = win.along(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    up = F.when(speed > 0, speed)
    stats = {"live_mean_speed": F.avg(up).over(w), "live_max_speed": F.max(up).over(w)}
    return df.withColumns(stats | {f"live_zone_{z}": F.count_if(zone == z).over(w) for z in range(ZONES)})


def rally_records(
    frames: DataFrame, tracks: DataFrame, keys: Names, *, frame: str = "frame", time: str = "timestamp_sec", scores: tuple[str, str] = ("player1_score", "player2_score"),
    sets: tuple[str, str] = ("player1_sets", "player2_sets"), x: str = "x_m", y: str = "y_m", speed: str = "speed_mps", calibrated: str | None = None, event: str | None = None,
    seen: int = 4, missing: int = 30, strict: bool = False,
) -> DataFrame:
    """The rally log: one row per point, with the columns of ``files.RALLIES``.

    ``frames`` has a row per frame with the stable scores and sets, ``tracks`` the ball's positions in metres. Within a
    point, samples are the positions of frames in play while the gate is open (``windows.gate``), if the table is calibrated
    (``calibrated``: a boolean column of frames; by default it is). A skip (a text column of frames, ``event``) throws away
    the point's samples up to and including its frame, and all of them unless an undo follows; a new point is not skipped.
    The first point starts at frame 0. The last ends with the last frame, is won by nobody known, and is left out if the
    first score isn't known there. Speeds have four decimals.
    """
    rows = frames.withColumns({"r_calibrated": F.coalesce(F.col(calibrated), F.lit(False)) if calibrated else F.lit(True), "r_event": F.col(event) if event else F.lit(None).cast("string")})
    placed = tracks.join(rows.select(*keys, frame, "r_calibrated"), [*keys, frame]) if calibrated else tracks.withColumn("r_calibrated", F.lit(True))
    playing = in_play_frames(placed, keys, frame, x, y, F.col("r_calibrated"))
    rows = point_rows(rows.join(playing, [*keys, frame], "left"), keys, [frame], *scores, strict=strict)
    point = [*keys, "rally_id"]
    rows = win.gate(rows, point, [frame], F.col("in_play"), seen, missing)
    whole = Window.partitionBy(*point)
    rows = rows.withColumns({
        "r_cut": F.max(F.when(F.col("r_event") == SKIP, F.col(frame))).over(whole), "r_skipped": F.coalesce(F.max_by(F.col("r_event") == SKIP, F.when(F.col("r_event").isin(SKIP, UNDO), F.col(frame))).over(whole), F.lit(False)),
    })
    kept = rows.filter(F.col("collects") & F.col("r_calibrated") & ~F.col("r_skipped") & (F.col("r_cut").isNull() | (F.col(frame) > F.col("r_cut"))))
    samples = tracks.join(kept.select(*point, frame), [*keys, frame]).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    samples = samples.groupBy(*point).agg(*speed_and_zones(F.col(speed), geo.landing_zone(F.col(x), F.col(y))))

    points = point_spans(rows, keys, frame, [*scores, *sets])
    ends = rows.groupBy(*point).agg(F.min_by(time, frame).alias("r_from"), F.max_by(F.struct(F.col(time).alias("at"), F.col(scores[0]).isNotNull().alias("known")), frame).alias("r_last"), F.max("r_skipped").alias("r_skipped"))
    points = points.join(ends, point).withColumn("r_until", F.lead("r_from").over(win.along(keys, ["rally_id"]))).filter("end_frame is not null or r_last.known")
    four = lambda c: F.round(c, 4).alias(c)
    first = F.col("rally_id") == 0
    return points.join(samples, point, "left").select(
        *keys, F.col("rally_id").cast("int").alias("rally_id"), F.when(first, 0).otherwise(F.col("first_frame")).cast("long").alias("rally_start_frame"), F.coalesce("end_frame", "last_frame").cast("long").alias("rally_end_frame"),
        F.when(first, 0.0).otherwise(F.col("r_from")).alias("rally_start_time"), F.coalesce("r_until", "r_last.at").alias("rally_end_time"),
        *(F.col(c).cast("int").alias(n) for c, n in zip((*scores, *sets), ("p1_score_start", "p2_score_start", "p1_sets_start", "p2_sets_start"), strict=True)),
        *(four(c) for c in ("mean_speed_mps", "max_speed_mps", "speed_std_mps")), *(F.coalesce(f"landing_zone_{z}", F.lit(0)).cast("int").alias(f"landing_zone_{z}") for z in range(ZONES)),
        F.col("winner").alias("point_winner"), F.col("r_skipped").cast("int").alias("skipped"),
    )
