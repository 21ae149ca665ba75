"""True recurrences: state that depends on its own past in a way no window can express.

Each is a small step function from (state, row) to (state, output). In batch, sorted partitions stream through
mapInPandas, so a key's rows are never gathered; under Structured Streaming the same steps run with keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: Frame difference of a cut, least share of table colour, and frames between two looks.
CUT, TABLE_SHARE, POLL = 30.0, 0.04, 15
#: Weight of a new corner position, and its largest jump.
EMA, JUMP = 0.3, 50.0

Step = Callable[[Any, tuple], tuple[Any, tuple]]


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], start: Any, step: Step, outputs: str) -> DataFrame:
    """Adds the outputs of ``step`` along the rows of each key. ``start`` must be immutable."""
    names = [o.strip().split(" ")[0] for o in outputs.split(",")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), start
        for frame in frames:
            made = []
            for key, row in zip(frame[list(keys)].itertuples(index=False, name=None), frame[list(columns)].itertuples(index=False, name=None), strict=True):
                if key != at:
                    at, state = key, start
                state, out = step(state, row)
                made.append(out)
            yield frame.assign(**{n: [m[i] for m in made] for i, n in enumerate(names)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {outputs}")


def scene_step(state: tuple[str, int], row: tuple[float, float], cut: float = CUT, share: float = TABLE_SHARE, poll: int = POLL) -> tuple[tuple[str, int], tuple[str, bool, bool]]:
    """(scene, frames since the last look), (diff, table share) to (scene, is_cut, process).

    A large difference in gameplay is a cut; the frame after it is looked at, then each ``poll``-th. Seeing the table
    returns to gameplay. ``is_cut`` is true in that frame only, where trackers start anew, not where gameplay ends.
    """
    scene, waited = state
    diff, seen = row
    if scene == "gameplay":
        return (("cut", 0), ("cut", False, False)) if diff is not None and diff > cut else (state, ("gameplay", False, True))
    waited += 1
    if scene == "cut" or waited >= poll:
        if seen is not None and seen >= share:
            return ("gameplay", 0), ("gameplay", True, True)
        return ("other", 0), ("other", False, False)
    return (scene, waited), (scene, False, False)


def ema_step(state: tuple[float | None, float | None, int], row: tuple[float, float, bool], weight: float = EMA, jump: float = JUMP) -> tuple[tuple, tuple]:
    """(x, y, rows since a valid one), (x, y, valid) to (x, y, rows since): invalid rows and jumps keep the old position."""
    x, y, since = state
    new_x, new_y, valid = row
    if not valid or new_x is None or new_y is None:
        return (x, y, since + 1), (x, y, since + 1)
    if x is None:
        return (new_x, new_y, 0), (new_x, new_y, 0)
    if ((new_x - x) ** 2 + (new_y - y) ** 2) ** 0.5 > jump:
        return (x, y, since + 1), (x, y, since + 1)
    x, y = weight * new_x + (1 - weight) * x, weight * new_y + (1 - weight) * y
    return (x, y, 0), (x, y, 0)


#: Least area of a table in pixels, its range against the first one, and the range of width over height.
QUAD_AREA, AREA_RATIO, ASPECT, QUAD_HEIGHT = 500.0, (0.3, 3.0), (1.2, 5.0), 1.0


def area_of(quad: Sequence[float]) -> float:
    """Shoelace area of four points x, y, x, y, ..."""
    return abs(sum(quad[i] * quad[(i + 3) % 8] - quad[(i + 2) % 8] * quad[i + 1] for i in range(0, 8, 2))) / 2


def quad_passes(quad: Sequence[float], first_area: float) -> bool:
    """Whether four corners TL, TR, BR, BL can be a table: convex, large enough, of about the first one's area, wider than high."""
    turns = set()
    for i in range(0, 8, 2):
        (xa, ya), (xb, yb), (xc, yc) = (quad[j % 8 : j % 8 + 2] for j in (i, i + 2, i + 4))
        turns.add((xb - xa) * (yc - yb) - (yb - ya) * (xc - xb) > 0)
    area = area_of(quad)
    if len(turns) > 1 or area < QUAD_AREA or (first_area > 0 and not AREA_RATIO[0] <= area / first_area <= AREA_RATIO[1]):
        return False
    side = lambda a, b: ((quad[2 * a] - quad[2 * b]) ** 2 + (quad[2 * a + 1] - quad[2 * b + 1]) ** 2) ** 0.5
    width, height = (side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2
    return height >= QUAD_HEIGHT and ASPECT[0] <= width / height <= ASPECT[1]


#: No corners yet.
TRACKER = (None, 0.0, 0)


def corner_step(state: tuple, row: tuple, weight: float = EMA, jump: float = JUMP) -> tuple[tuple, tuple]:
    """(corners, area when they were set, rows since they were valid), (eight coordinates, found, marked) to (eight coordinates, is_valid, rows since).

    A row that marks the table (by hand, or after a cut) sets the corners as they are, and so does the first one with all of
    them. Else they move towards the row's by ``weight``, unless a point is missing or not found, one has jumped, or the
    quad would no longer be a table: then the old ones stay, and are not valid until a row passes again.
    """
    corners, area, since = state
    *points, found, marked = row
    known = all(p is not None and p == p for p in points)
    if known and (marked or (corners is None and found)):
        corners = [float(p) for p in points]
        return (corners, area_of(corners), 0), (*corners, True, 0)
    if known and found and corners is not None:
        moved = [((points[i] - corners[i]) ** 2 + (points[i + 1] - corners[i + 1]) ** 2) ** 0.5 for i in range(0, 8, 2)]
        smooth = [weight * p + (1 - weight) * c for p, c in zip(points, corners, strict=True)]
        if max(moved) <= jump and quad_passes(smooth, area):
            return (smooth, area, 0), (*smooth, True, 0)
    return (corners, area, since + 1), (*(corners or [None] * 8), False, since + 1)


def score_step(state: tuple[int, int, int, int], row: tuple[str, str, int]) -> tuple[tuple, tuple]:
    """(points 1, 2, sets 1, 2), (player, kind, delta) to the four: points stop at 0, a set clears both, a swap swaps all.

    The live form; ``windows.manual_score`` gives the same in batch.
    """
    p1, p2, s1, s2 = state
    player, kind, delta = row
    if kind == "swap":
        p1, p2, s1, s2 = p2, p1, s2, s1
    elif kind == "point":
        p1, p2 = (max(0, p1 + delta), p2) if player == "p1" else (p1, max(0, p2 + delta))
    elif kind == "set":
        s1, s2 = (max(0, s1 + delta), s2) if player == "p1" else (s1, max(0, s2 + delta))
        if delta > 0:
            p1, p2 = 0, 0
    return (p1, p2, s1, s2), (p1, p2, s1, s2)


def scene_gate(df: DataFrame, keys: Sequence[str], order: Sequence[str], diff: str, share: str) -> DataFrame:
    return scan(df, keys, order, [diff, share], ("gameplay", 0), scene_step, "scene string, is_cut boolean, process boolean")


def smoothed(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, valid: str) -> DataFrame:
    return scan(df, keys, order, [x, y, valid], (None, None, 0), ema_step, "smooth_x double, smooth_y double, since_valid int")


CORNERS = [f"{axis}_{corner}" for corner in ("tl", "tr", "br", "bl") for axis in "xy"]
CORNER_OUTPUTS = ", ".join([*(f"smooth_{c} double" for c in CORNERS), "is_valid boolean", "since_valid int"])


def tracked_corners(df: DataFrame, keys: Sequence[str], order: Sequence[str], found: str, marked: str, corners: Sequence[str] = CORNERS) -> DataFrame:
    """Adds the table's four smoothed corners, whether they are valid, and for how many rows they haven't been; see ``corner_step``.

    ``corners`` are the eight coordinate columns of TL, TR, BR, BL; ``geometry.ordered_corners`` puts marked points in that order.
    """
    return scan(df, keys, order, [*corners, found, marked], TRACKER, corner_step, CORNER_OUTPUTS)
