"""Fusing a live and a career probability into one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The live model's weight at the start and at the end, points of a set; least progress once a side is one
#: set away, and once that set's leading score is late.
LIVE_START, LIVE_END, POINTS = 0.35, 0.85, 11
ONE_SET_AWAY, LATE_SCORE, LATE = 0.6, 8, 0.85


def progress(p1: Column, p2: Column, sets1: Column, sets2: Column, sets_to_win: Column) -> Column:
    """0 to 1: points played, those of decided sets included, of the points of a match that goes the distance.

    Once the leader needs one more set, at least 0.6; with 8 points or more on the leading score as well, 0.85.
    """
    done = F.least(F.lit(1.0), ((sets1 + sets2) * POINTS + p1 + p2) / ((sets_to_win * 2 - 1) * float(POINTS)))
    away = F.greatest(sets1, sets2) == sets_to_win - 1
    floor = F.when(away & (F.greatest(p1, p2) >= LATE_SCORE), LATE).when(away, ONE_SET_AWAY).otherwise(0.0)
    return F.greatest(done, floor)


def live_weight(at: Column) -> Column:
    """A smooth step from LIVE_START to LIVE_END."""
    return LIVE_START + (LIVE_END - LIVE_START) * (at * at * (3 - 2 * at))


def fused(live: Column, career: Column, at: Column, meta: Column | None = None) -> dict[str, Column]:
    """probability and confidence; the live one alone where the career one is null. A meta model counts early on."""
    weight = live_weight(at)
    mean = F.coalesce(weight * live + (1 - weight) * career, live)
    if meta is not None:
        mean = F.when(career.isNotNull() & meta.isNotNull(), (1 - at) * meta + at * mean).otherwise(mean)
    return {"probability": mean, "confidence": F.abs(mean - 0.5) * 2}


def score_context(p1: Column, p2: Column, sets1: Column, sets2: Column, set_weight: int = 0) -> dict[str, Column]:
    return {"score_diff": p1 - p2 + set_weight * (sets1 - sets2), "total_points": p1 + p2 + set_weight * (sets1 + sets2)}
