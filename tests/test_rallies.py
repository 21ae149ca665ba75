"""Rally records against a plain state machine, and the cases that a viewer or a scoreboard makes."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from courtside.operators import rallies as ra
from courtside.sources import files

FRAMES = "match_id long, frame long, timestamp_sec double, player1_score int, player2_score int, player1_sets int, player2_sets int, ok boolean, said string"
TRACKS = "match_id long, frame long, x_m double, y_m double, speed_mps double"


def on_table(x, y):
    return -0.1 <= x <= 2.84 and -0.1 <= y <= 1.625


def zone(x, y):
    cell = lambda v, size: min(2, int(max(0.0, min(size, v)) / (size / 3)))
    return cell(y, 1.525) * 3 + cell(x, 2.74) if on_table(x, y) else None


def machine(frames, balls, seen, missing):
    """Frame by frame, as a live log is written: what is known of a point, an open or shut gate, samples, and a flag."""
    out, last, start, sets, samples, skipped = [], (None, None), (None, None), (None, None), [], False
    rally, since, began, active, run, gap = 0, 0, 0.0, False, 0, 0

    def write(end, at, winner):
        kept = [] if skipped else samples
        speeds = [s for _, _, s in kept if s > 0]
        zones = [sum(zone(x, y) == z for x, y, _ in kept) for z in range(9)]
        stats = (statistics.fmean(speeds), max(speeds)) if speeds else (None, None)
        out.append((rally, since, end, began, at, *start, *sets, *stats, statistics.pstdev(speeds) if len(speeds) > 1 else None, *zones, winner, int(skipped)))

    for f, t, p1, p2, s1, s2, ok, said in frames:
        now, places = (p1, p2), [b for b in balls.get(f, []) if b[0] is not None and b[1] is not None]
        if last[0] is None and None not in now:
            last, start, sets = now, now, (s1, s2)
        if last[0] is not None and p1 is not None and now != last:
            write(f, t, "p1" if p1 != last[0] and p2 == last[1] else "p2" if p2 != last[1] and p1 == last[0] else "unknown")
            rally, since, began, start, sets, samples, skipped, active, run, gap = rally + 1, f, t, now, (s1, s2), [], False, False, 0, 0
        last = now
        playing = any(on_table(x, y) for x, y, _ in places) if ok else bool(places)
        if not active:
            run = run + 1 if playing else 0
            active, gap = run >= seen, 0
        elif playing:
            gap = 0
            samples += [(x, y, s or 0.0) for x, y, s in places] if ok else []
        else:
            gap += 1
            active, run = gap < missing, 0
        if said == ra.SKIP:
            skipped, samples = True, []
        elif said == ra.UNDO:
            skipped = False
    if last[0] is not None:
        write(frames[-1][0], frames[-1][1], "unknown")
    return out


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert tuple(a) == tuple(pytest.approx(v, abs=1e-4) if isinstance(v, float) else v for v in b)


def test_records_equal_the_state_machine(spark):
    r, frames, balls, want = random.Random(4), [], [], []
    for m in range(12):
        score, sets, own, places = [None, None], [0, 0], [], {}
        playing = False
        for f in range(3, 260):
            if r.random() < 0.06:
                i = r.randrange(2)
                score[i] = r.choice([None, 0, 1]) if score[i] is None or r.random() < 0.1 else score[i] + r.choice([1, 1, -1])
                sets[i] += r.random() < 0.2
            playing ^= r.random() < 0.15
            own.append((f, f / 25, *score, *sets, r.random() < 0.9 if m % 2 else True, r.choice([ra.SKIP, ra.UNDO]) if r.random() < 0.03 else None))
            places[f] = [(r.uniform(-0.3, 3) if r.random() < 0.9 else None, r.uniform(-0.2, 1.7), r.choice([None, 0.0, r.uniform(0, 20)])) for _ in range(r.randrange(1, 3))] if playing or r.random() < 0.1 else []
        want += [(m, *row) for row in machine(own, places, 3, 5)]
        frames += [(m, *row) for row in own]
        balls += [(m, f, *b) for f, bs in places.items() for b in bs]
    out = ra.rally_records(spark.createDataFrame(frames, FRAMES).repartition(5), spark.createDataFrame(balls, TRACKS), ["match_id"], calibrated="ok", event="said", seen=3, missing=5)
    assert out.columns[1:] == [c.split()[0] for c in files.RALLIES.split(", ")]
    close(out.orderBy("match_id", "rally_id").collect(), want)
    assert {w[-2] for w in want} == {"p1", "p2", "unknown"} and {w[-1] for w in want} == {0, 1}


def records(spark, scores, **more):
    rows = [(1, i, i / 30, *s, 1, 0, True, None) for i, s in enumerate(scores)]
    out = ra.rally_records(spark.createDataFrame(rows, FRAMES), spark.createDataFrame([], TRACKS), ["match_id"], **more)
    return [(r.rally_start_frame, r.rally_end_frame, r.p1_score_start, r.p2_score_start, r.p1_sets_start, r.point_winner, r.mean_speed_mps, r.landing_zone_4, r.skipped) for r in out.orderBy("rally_id").collect()]


def test_winners_and_ends(spark):
    assert [x[5] for x in records(spark, [(5, 3), (5, 4)])] == ["p2", "unknown"]
    assert [x[5] for x in records(spark, [(5, 3), (6, 3)])] == ["p1", "unknown"]
    assert [x[5] for x in records(spark, [(5, 3), (6, 4)])] == ["unknown", "unknown"]
    assert [x[5] for x in records(spark, [(5, 3), (4, 3)])] == ["p1", "unknown"] and [x[5] for x in records(spark, [(5, 3), (4, 3)], strict=True)] == ["unknown", "unknown"]
    assert records(spark, [(0, 0), (1, 0), (2, 0), (2, 1)]) == [
        (0, 1, 0, 0, 1, "p1", None, 0, 0), (1, 2, 1, 0, 1, "p1", None, 0, 0), (2, 3, 2, 0, 1, "p2", None, 0, 0), (3, 3, 2, 1, 1, "unknown", None, 0, 0)
    ]
    # no score at all: no row; the start score is the one that becomes known first, and again after a gap
    assert records(spark, [(None, None), (None, 2)]) == []
    assert records(spark, [(None, None), (3, 2), (3, 2), (None, 2), (4, 2), (5, 2)]) == [(0, 5, 4, 2, 1, "p1", None, 0, 0), (5, 5, 5, 2, 1, "unknown", None, 0, 0)]
    # null equals null: only the first score is ever known
    assert [x[5] for x in records(spark, [(1, None), (2, None)])] == ["p1", "unknown"]


def test_no_frames(spark):
    assert ra.rally_records(spark.createDataFrame([], FRAMES), spark.createDataFrame([], TRACKS), ["match_id"], calibrated="ok", event="said").count() == 0


def test_in_play_without_calibration(spark):
    tracks = spark.createDataFrame([(1, 1, 9.0, 9.0, 1.0), (1, 2, None, 1.0, 1.0), (1, 3, 1.0, 1.0, None), (1, 3, 9.0, 9.0, None)], TRACKS)
    for calibrated, want in ((True, [False, False, True]), (False, [True, False, True])):
        got = ra.in_play_frames(tracks, ["match_id"], "frame", "x_m", "y_m", F.lit(calibrated)).orderBy("frame").collect()
        assert [r.in_play for r in got] == want
