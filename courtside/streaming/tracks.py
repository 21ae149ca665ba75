"""Live forms of kinematics, votes, change-logs and gates: keyed state over an unbounded stream of frames.

Frames of a key must arrive in order from one micro-batch to the next; within a micro-batch they are sorted. There is no
watermark: a row that comes late is taken as the next one. State is a few numbers per key, and a timer can drop it when a
key falls silent. The update functions are those of the batch tests, one step per row.
"""

from __future__ import annotations

import json
import statistics
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from courtside.streaming.ordered import plain

Step = Callable[[Any, tuple], tuple[Any, tuple]]


def stateful(stream: DataFrame, key: str, order: list[str], columns: list[str], start: Any, step: Step, outputs: str, keep: list[str], silence: int | None = None) -> DataFrame:
    """key, the kept columns and the outputs of ``step`` for each row. State travels as JSON, so it must be plain.

    ``silence`` is the time in ms after which a silent key's state is dropped. A run that ends with its data has none:
    a timer would keep it waiting.
    """
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    shape = ", ".join([f"`{key}` {fields[key]}", *(f"`{c}` {fields[c]}" for c in keep), outputs])
    names = [o.strip().split(" ")[0] for o in outputs.split(",")]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at = json.loads(state.get[0]) if state.exists else start
        found = list(frames)
        rows = pd.concat(found) if len(found) > 1 else found[0]
        if len(order) > 1 or not rows[order[0]].is_monotonic_increasing:
            rows = rows.sort_values(order)
        made = []
        for row in zip(*(plain(rows[c]) for c in columns), strict=True):
            at, out = step(at, row)
            made.append(out)
        state.update((json.dumps(at),))
        if silence:
            state.setTimeoutDuration(silence)
        values = {n: list(v) for n, v in zip(names, zip(*made, strict=True), strict=True)}
        yield pd.DataFrame({key: group[0], **{c: rows[c].to_numpy() for c in keep}, **values}, index=range(len(rows)))

    return stream.groupBy(key).applyInPandasWithState(run, shape, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout if silence else GroupStateTimeout.NoTimeout)


def speed_step(state: list, row: tuple) -> tuple[list, tuple]:
    """[x, y, last speeds], (x, y, rate) to (speed, mean of the last five)."""
    x, y, speeds = state
    new_x, new_y, rate = row
    speed = None if x is None else float(((new_x - x) ** 2 + (new_y - y) ** 2) ** 0.5 * rate)
    speeds = (speeds + [speed] if speed is not None else speeds)[-4:] if speed is None else (speeds + [speed])[-5:]
    recent = speeds if speed is not None else speeds[-4:]
    return [float(new_x), float(new_y), speeds], (speed, sum(recent) / len(recent) if recent else 0.0)


def change_step(state: list, row: tuple) -> tuple[list, tuple]:
    """[seen before, last values], values to whether they changed."""
    return [True, list(row)], (not state[0] or list(row) != state[1],)


def majority(values: list, least: int = 2):
    """The most frequent value, the first seen of those that tie; None below ``least``."""
    best = max(values, key=lambda v: (values.count(v), -values.index(v)), default=None)
    return best if best is not None and values.count(best) >= least else None


def stable_step(state: list, row: tuple, length: int = 5, reads: int = 3, runs: int = 4) -> tuple[list, tuple]:
    """[recent reads, vote, run, stable], (value, reliable) to (vote, stable)."""
    recent, last, run, stable = state
    value, reliable = row
    if not reliable:
        return [recent, None, 0, stable], (None, stable)
    recent = [*recent, int(value)][-length:]
    vote = majority(recent) if len(recent) >= reads else None
    if vote is not None:
        run = run + 1 if vote == last else 1
        last = vote
        stable = vote if run >= runs else stable
    return [recent, last, run, stable], (vote, stable)


def gate_step(state: list, row: tuple, seen: int = 4, missing: int = 30) -> tuple[list, tuple]:
    """[segment, in play before, run, active], (segment, in play) to (active, collects)."""
    segment, before, run, active = state
    new_segment, playing = row
    playing = bool(playing)
    if new_segment != segment:
        before, run, active = None, 0, False
    run = run + 1 if before == playing else 1
    was = active
    if playing and run >= seen:
        active = True
    elif not playing and run >= missing:
        active = False
    return [int(new_segment), playing, run, active], (active, playing and was)


def clamp_step(state: list, row: tuple) -> tuple[list, tuple]:
    """[sum], (delta, reset) to (sum that never goes below 0)."""
    delta, reset = row
    total = max(0, (0 if reset else state[0]) + (delta or 0))
    return [total], (total,)


def metric_step(state: list, row: tuple, rate: float = 1.0, limit: float = 40.0, smooth: int = 5) -> tuple[list, tuple]:
    """[x, y, frame, accepted speeds, median], (frame, x, y, valid) to (x, y, speed) carried over rows that aren't valid.

    A speed counts from the valid point before; one above ``limit`` is rejected, and the median of the last ones holds.
    """
    x, y, at, speeds, speed = state
    frame, new_x, new_y, valid = row
    if valid:
        known = None not in (x, y, new_x, new_y)
        if at is not None and frame > at and known:
            step = ((new_x - x) ** 2 + (new_y - y) ** 2) ** 0.5 / ((frame - at) / rate)
            if step <= limit:
                speeds = [*speeds, step][-smooth:]
                speed = statistics.median(speeds)
        x, y, at = (x if new_x is None else float(new_x)), (y if new_y is None else float(new_y)), frame
    return [x, y, at, speeds, speed], (x, y, speed)


def trail_step(state: list, row: tuple, length: int = 30) -> tuple[list, tuple]:
    """The last points, a point to all of them, oldest first, by coordinate."""
    state = [*state, [float(v) for v in row]][-length:]
    return state, tuple([p[i] for p in state] for i in range(len(row)))


def point_step(state: list, row: tuple) -> tuple[list, tuple]:
    """[first score, second score, point], the row's scores to (point, is_start, who won the point before); see ``rallies.point_rows``."""
    first, second, point = state
    starts = first is not None and row[0] is not None and (first, second) != row
    one, two = row[0] != first, row[1] != second
    winner = ("p1" if one and not two else "p2" if two and not one else "unknown") if starts else None
    point += starts
    return [*row, point], (point, starts, winner)


def sets_step(state: list, row: tuple, runs: int = 4, most: int = 5) -> tuple[list, tuple]:
    """[value, run, stable], (sets, reliable) to the count that last held for ``runs`` reads; a null or impossible one ends a run."""
    value, run, stable = state
    sets, reliable = row
    if not reliable or sets is None or sets > most:
        return [None, 0, stable], (stable,)
    run = run + 1 if sets == value else 1
    return [int(sets), run, int(sets) if run >= runs else stable], (int(sets) if run >= runs else stable,)


def obscured_step(state: list, row: tuple) -> tuple[list, tuple]:
    """[flag], (is a read, reliable) to whether the last read was unreliable."""
    read, reliable = row
    state = [not reliable] if read else state
    return state, (state[0],)


def toggle_step(state: list, row: tuple) -> tuple[list, tuple]:
    """[open], (toggle) to whether an odd number of toggles came so far."""
    state = [state[0] != bool(row[0])]
    return state, (state[0],)


#: Of no point: its number, speeds' number, sum and largest, and hits of nine zones.
LIVE_STATS = [None, 0, 0.0, None, [0] * 9]


def stats_step(state: list, row: tuple) -> tuple[list, tuple]:
    """LIVE_STATS, (point, speed, zone) to (mean, max, nine counts) of the point's samples so far; see ``rallies.live_stats``."""
    point, speed, zone = row
    _, n, total, most, zones = state if state[0] == point else [point, *LIVE_STATS[1:]]
    if speed is not None and speed > 0:
        n, total, most = n + 1, total + speed, speed if most is None else max(most, speed)
    if zone is not None:
        zones = [z + (i == zone) for i, z in enumerate(zones)]
    return [point, n, total, most, zones], (total / n if n else None, most, *zones)


def reset_at(step: Step, start: Any) -> Step:
    """``step`` for rows with one more value at their end: where that is true, as at a cut, the state starts anew before the row."""

    def run(state: Any, row: tuple) -> tuple[Any, tuple]:
        return step(start if row[-1] else state, row[:-1])

    return run


#: State of ``predict_step``: the open rally, per player [[n, sum] of four measures, [n, mean, squares] of one], the ball's
#: [n, sum, max, first frame, last frame], and the last chance.
_SIDE = [[[0, 0.0]] * 4, [0, 0.0, 0.0]]
PREDICTOR = [None, _SIDE, _SIDE, [0, 0.0, None, None, None], 0.5]


def _summed(side: list, values: tuple, com: float | None) -> list:
    sums, (n, mean, squares) = side
    sums = [[k, total] if v is None else [k + 1, total + v] for (k, total), v in zip(sums, values, strict=True)]
    if com is not None:
        n, off = n + 1, com - mean
        mean += off / n
        squares += off * (com - mean)
    return [sums, [n, mean, squares]]


def rally_values(one: list, two: list, ball: list) -> list[float]:
    """The eight features of a rally from its sums, in the order of ``features.RALLY_FEATURES``."""
    mean = lambda side, i: side[0][i][1] / side[0][i][0] if side[0][i][0] else 0.0
    spread = lambda side: (side[1][2] / (side[1][0] - 1)) ** 0.5 if side[1][0] > 1 else 0.0
    apart = lambda i: mean(one, i) - mean(two, i)
    n, total, most, first, last = ball
    return [apart(0), spread(one) - spread(two), apart(1), apart(2), (mean(one, 3) + mean(two, 3)) / 2, total / n if n else 0.0, float(most or 0.0), float(last - first if first is not None else 0)]


def predict_step(state: list, row: tuple, chance: Callable[[list[float]], float]) -> tuple[list, tuple]:
    """PREDICTOR state, (rally, frame, player, hand speed, com, torso speed, elbow, visibility, in flight, ball speed) to
    (the rally that this row ends, its eight features, the chance in force).

    A rally is summed while it lasts. The first row of another one, or an end row without a rally, ends it: its features
    go out with that row, and their chance holds until the next rally ends. Sums are kept, not rows.
    """
    rally, one, two, ball, p = state
    new, frame, player, hand, com, torso, elbow, visible, flies, speed = row
    ended, values = None, [None] * 8
    if rally is not None and new != rally:
        ended, values = int(rally), rally_values(one, two, ball)
        p = chance(values)
    if new != rally:
        one, two, ball = PREDICTOR[1:4]
    if new is not None:
        measures = (hand, None if torso is None else abs(torso), elbow, visible)
        one, two = (_summed(one, measures, com), two) if player == 1 else (one, _summed(two, measures, com)) if player == 2 else (one, two)
        if flies:
            n, total, most, first, last = ball
            known = speed is not None
            ball = [n + known, total + (speed if known else 0.0), max((v for v in (most, speed) if v is not None), default=None), frame if first is None else min(first, frame), frame if last is None else max(last, frame)]
    return [new, one, two, ball, p], (ended, *values, p)
