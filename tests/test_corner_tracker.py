"""The corner tracker's gates, one by one, its batch form, and the columns that say the same of one quad."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from courtside.functions import geometry as geo
from courtside.operators import features as ft
from courtside.operators import recurrence as rc

FIRST = (200.0, 300.0, 600.0, 300.0, 600.0, 500.0, 200.0, 500.0)


def moved(*by):
    return tuple(p + d for p, d in zip(FIRST, by if len(by) == 8 else by * 8, strict=True))


def after(*rows, state=rc.TRACKER):
    """(corners, is_valid, since) after rows of (points, found, marked)."""
    for points, found, marked in rows:
        state, out = rc.corner_step(state, (*points, found, marked))
    return out[:8], out[8], out[9]


START = (FIRST, True, False)
NONE = (None,) * 8


def test_first_corners():
    assert after((NONE, True, False)) == (NONE, False, 1)
    assert after((FIRST, False, False)) == (NONE, False, 1)
    assert after((FIRST, False, True)) == (FIRST, True, 0)
    assert after((NONE, False, False), START) == (FIRST, True, 0)


def test_smoothing():
    corners, valid, since = after(START, (moved(10.0), True, False))
    assert corners == pytest.approx(moved(3.0)) and valid and since == 0
    corners, _, _ = after(START, *[(moved(10.0), True, False)] * 40)
    assert corners == pytest.approx(moved(10.0), abs=1e-4)


def test_rejected_rows_keep_the_corners():
    lost = (moved(10.0), False, False)
    part = ((*FIRST[:7], None), True, False)
    assert after(START, lost, part, (NONE, True, False)) == (FIRST, False, 3)
    assert after(START, lost, lost, START) == (pytest.approx(FIRST), True, 0)
    # any corner's jump, also of one alone
    assert after(START, (moved(0, 0, 0, 0, 36.0, 36.0, 0, 0), True, False))[1:] == (False, 1)
    assert after(START, (moved(0, 0, 0, 0, 35.0, 35.0, 0, 0), True, False))[1:] == (True, 0)


def test_quality_gates():
    area = rc.area_of(FIRST)
    assert area == 80_000 and rc.quad_passes(FIRST, area) and rc.quad_passes(FIRST, 0)
    assert not rc.quad_passes((200, 300, 600, 300, 200, 500, 600, 500), area)  # crossed
    assert not rc.quad_passes((200, 300, 600, 300, 350, 350, 200, 500), 0)  # dented
    assert not rc.quad_passes((0, 0, 40, 0, 40, 12, 0, 12), 0) and rc.quad_passes((0, 0, 40, 0, 40, 13, 0, 13), 0)  # area of 500
    assert not rc.quad_passes(FIRST, area / 3.01) and rc.quad_passes(FIRST, area / 2.99) and not rc.quad_passes(FIRST, area / 0.29) and rc.quad_passes(FIRST, area / 0.31)
    square = lambda w, h: (0, 0, w, 0, w, h, 0, h)
    assert [rc.quad_passes(square(w, 100), 0) for w in (119, 120, 500, 501)] == [False, True, True, False]


def test_marks_start_anew():
    """A mark sets another size, against which later areas count."""
    small = tuple(p / 4 for p in FIRST)
    out = after(START, (small, False, True))
    assert out == (small, True, 0)
    drift = [(tuple(p * k for p in small), True, False) for k in (1.05, 1.1, 1.15, 1.2)]
    assert after(START, (small, True, True), *drift)[1] and not after(START, (NONE, True, True))[1]


def test_batch_form_and_columns(spark):
    rows = [(1, 1, *FIRST, True, False), (1, 2, *moved(10.0), True, False), (1, 3, *NONE, True, False), (2, 1, *NONE, True, False), (2, 2, *moved(1.0), True, True), (1, 4, *moved(9.0), False, False)]
    df = spark.createDataFrame(rows, "m int, f int, " + ", ".join(f"{c} double" for c in rc.CORNERS) + ", found boolean, marked boolean")
    out = rc.tracked_corners(df, ["m"], ["f"], "found", "marked").orderBy("m", "f").collect()
    assert [(r.m, r.f, r.smooth_x_tl, r.is_valid, r.since_valid) for r in out] == [(1, 1, 200.0, True, 0), (1, 2, 203.0, True, 0), (1, 3, 203.0, False, 1), (1, 4, 203.0, False, 2), (2, 1, None, False, 1), (2, 2, 201.0, True, 0)]

    quads = [FIRST, (200, 300, 600, 300, 200, 500, 600, 500), (0, 0, 40, 0, 40, 12, 0, 12), (0, 0, 119, 0, 119, 100, 0, 100), (0, 0, 501, 0, 501, 100, 0, 100), (0, 0, 120, 0, 121, 100, 0, 100)]
    cases = [(*map(float, q), a) for q in quads for a in (0.0, 300.0, 80_000.0, 1e6)]
    df = spark.createDataFrame(cases, ", ".join(f"{c} double" for c in rc.CORNERS) + ", area double")
    quad = [(F.col(rc.CORNERS[i]), F.col(rc.CORNERS[i + 1])) for i in range(0, 8, 2)]
    got = df.select(*df.columns, geo.quad_passes(quad, F.col("area")).alias("fits"), geo.quad_passes(quad).alias("alone")).collect()
    assert all(r.fits == rc.quad_passes(r[:8], r.area) and r.alone == rc.quad_passes(r[:8], 0) for r in got)


def test_positions_by_the_calibration_in_force(spark):
    """Marks that are no table and rows of a tracker that lost it don't count; the last one that does says where a pixel is."""
    names = ", ".join(f"{c} double" for c in rc.CORNERS)
    marks = [(1, 5, *FIRST, True), (1, 10, *([1.0] * 8), True), (1, 20, *moved(100.0), False), (1, 30, *moved(50.0), True)]
    frames = [(1, f, u, v) for f, u, v in ((1, 200.0, 300.0), (5, 200.0, 300.0), (15, 600.0, 500.0), (25, 400.0, 400.0), (30, 250.0, 350.0), (31, 9e5, 9e5))]
    out = ft.calibrated_positions(
        spark.createDataFrame(frames, "m int, f int, u double, v double"), spark.createDataFrame(marks, f"m int, f int, {names}, ok boolean"), ["m"], "f", rc.CORNERS, "u", "v", F.col("ok")
    ).orderBy("f").collect()
    want = [None, (0, 0), (2.74, 1.525), (1.37, 0.7625), (0, 0), None]
    assert [None if r.x_m is None else (r.x_m, r.y_m) for r in out] == [w and pytest.approx(w, abs=1e-9) for w in want] and out[0].asDict().keys() == {"m", "f", "u", "v", "x_m", "y_m"}
