"""Geometry as column expressions: boxes, homographies, zones, quads, angles and poses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The table's size in metres, and how far around it a position still counts.
TABLE_LENGTH, TABLE_WIDTH = 2.74, 1.525
POSITION_MARGIN, CONTAINS_MARGIN = 3.0, 0.1
#: A calibration's largest error in metres and its shortest side in pixels.
REPROJECTION, SIDE = 0.15, 10.0
#: Fixed value: lengths below this count as none in angles.
SMALL = 1e-9


def center(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    """Null stays null, which least and greatest alone would pass over."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(value.isNotNull(), F.least(F.greatest(value, as_column(low)), as_column(high)))


def point_box(x: Column, y: Column, width: float, height: float, size: float) -> dict[str, Column]:
    """A square around a point, cut at the picture's edge, as centre and size in shares of the picture."""
    half = size / 2
    left, right = clamp(x - half, 0.0, width), clamp(x + half, 0.0, width)
    top, bottom = clamp(y - half, 0.0, height), clamp(y + half, 0.0, height)
    return {"cx": (left + right) / 2 / width, "cy": (top + bottom) / 2 / height, "w": (right - left) / width, "h": (bottom - top) / height}


def normalized_box(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> dict[str, Column]:
    cx, cy = center(x1, y1, x2, y2)
    return {"cx": cx / width, "cy": cy / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height}


def pixel_corners(cx: Column, cy: Column, w: Column, h: Column, width: float, height: float) -> dict[str, Column]:
    """Corners in whole pixels, cut towards zero."""
    whole = lambda c: c.cast("int")
    return {"px1": whole((cx - w / 2) * width), "py1": whole((cy - h / 2) * height), "px2": whole((cx + w / 2) * width), "py2": whole((cy + h / 2) * height)}


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, pad: float, width: float, height: float) -> dict[str, Column]:
    return {"bx1": clamp(x1 - pad, 0.0, width), "by1": clamp(y1 - pad, 0.0, height), "bx2": clamp(x2 + pad, 0.0, width), "by2": clamp(y2 + pad, 0.0, height)}


Point = tuple[Column, Column]


def homography(quad: Sequence[Point], length: float = TABLE_LENGTH, width: float = TABLE_WIDTH) -> dict[str, Column]:
    """The nine coefficients h0..h8 that map the quad's corners TL, TR, BR, BL to the table's.

    The map of the unit square onto the quad has a closed form; its adjugate is the inverse up to a factor, which a
    projective map doesn't see. Degenerate quads give nulls.
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = quad
    dx1, dy1, dx2, dy2 = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    whole = dx1 * dy2 - dx2 * dy1
    g = F.try_divide(sx * dy2 - dx2 * sy, whole)
    h = F.try_divide(dx1 * sy - sx * dy1, whole)
    a, b, c = x1 - x0 + g * x1, x3 - x0 + h * x3, x0
    d, e, f = y1 - y0 + g * y1, y3 - y0 + h * y3, y0
    rows = [
        [(e - f * h) * length, (c * h - b) * length, (b * f - c * e) * length],
        [(f * g - d) * width, (a - c * g) * width, (c * d - a * f) * width],
        [d * h - e * g, b * g - a * h, a * e - b * d],
    ]
    return {f"h{3 * i + j}": rows[i][j] for i in range(3) for j in range(3)}


def to_meters(h: Sequence[Column], u: Column, v: Column, margin: float = POSITION_MARGIN) -> tuple[Column, Column]:
    """Metres on the table; null where the point maps farther than ``margin`` outside, or to infinity."""
    scale = h[6] * u + h[7] * v + h[8]
    x, y = F.try_divide(h[0] * u + h[1] * v + h[2], scale), F.try_divide(h[3] * u + h[4] * v + h[5], scale)
    near = x.between(-margin, TABLE_LENGTH + margin) & y.between(-margin, TABLE_WIDTH + margin)
    return F.when(near, x), F.when(near, y)


def on_table(x: Column, y: Column, margin: float = CONTAINS_MARGIN) -> Column:
    return x.between(-margin, TABLE_LENGTH + margin) & y.between(-margin, TABLE_WIDTH + margin)


def landing_zone(x: Column, y: Column) -> Column:
    """0 to 8 row by row for positions on the table or just beside it, else null."""
    cell = lambda value, size: F.least(F.lit(2), F.floor(clamp(value, 0.0, size) / (size / 3))).cast("int")
    return F.when(on_table(x, y), cell(y, TABLE_WIDTH) * 3 + cell(x, TABLE_LENGTH))


def ordered_corners(points: Column) -> Column:
    """TL, TR, BR, BL of an array of four structs (x, y): the upper two by y, each two by x."""
    pair = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    by_y = F.transform(F.array_sort(F.transform(points, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))), pair)
    top, low = F.array_sort(F.slice(by_y, 1, 2)), F.array_sort(F.slice(by_y, 3, 2))
    return F.array(top[0], top[1], low[1], low[0])


def quad_area(quad: Sequence[Point]) -> Column:
    total = F.lit(0.0)
    for (xa, ya), (xb, yb) in zip(quad, [*quad[1:], quad[0]], strict=True):
        total = total + xa * yb - xb * ya
    return F.abs(total) / 2


def is_convex(quad: Sequence[Point]) -> Column:
    """All turns go the same way, none is straight."""
    n = len(quad)
    turns = []
    for i in range(n):
        (xa, ya), (xb, yb), (xc, yc) = quad[i], quad[(i + 1) % n], quad[(i + 2) % n]
        turns.append((xb - xa) * (yc - yb) - (yb - ya) * (xc - xb))
    return (F.least(*turns) > 0) | (F.greatest(*turns) < 0)


def quad_aspect(quad: Sequence[Point]) -> Column:
    """Mean length of the long sides over that of the short ones: top and bottom over left and right."""
    side = lambda a, b: F.hypot(a[0] - b[0], a[1] - b[1])
    return F.try_divide(side(quad[0], quad[1]) + side(quad[3], quad[2]), side(quad[1], quad[2]) + side(quad[0], quad[3]))


#: Least area of a table in pixels, its range against a first one, and the range of width over height.
QUAD_AREA, AREA_RATIO, ASPECT = 500.0, (0.3, 3.0), (1.2, 5.0)


def quad_passes(quad: Sequence[Point], first_area: Column | None = None) -> Column:
    """Whether four corners can be a table: convex, large enough, wider than high, and of about the first one's area if it is given and not 0."""
    area, aspect = quad_area(quad), quad_aspect(quad)
    fits = is_convex(quad) & (area >= QUAD_AREA) & aspect.between(*ASPECT)
    if first_area is not None:
        fits = fits & F.coalesce(F.try_divide(area, first_area).between(*AREA_RATIO), F.lit(True))
    return F.coalesce(fits, F.lit(False))


def shortest_side(quad: Sequence[Point]) -> Column:
    return F.least(*(F.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(quad, [*quad[1:], quad[0]], strict=True)))


def calibration_valid(quad: Sequence[Point]) -> Column:
    """Whether the quad's corners map to the table's within REPROJECTION, and no side is shorter than SIDE; never null."""
    h = list(homography(quad).values())
    corners = ((0.0, 0.0), (TABLE_LENGTH, 0.0), (TABLE_LENGTH, TABLE_WIDTH), (0.0, TABLE_WIDTH))
    off = [F.hypot(x - u, y - v) for (x, y), (u, v) in zip((to_meters(h, *p) for p in quad), corners, strict=True)]
    known = off[0].isNotNull() & off[1].isNotNull() & off[2].isNotNull() & off[3].isNotNull()
    return F.coalesce(known & (F.greatest(*off) <= REPROJECTION) & (shortest_side(quad) >= SIDE), F.lit(False))


def joint_angle(a: Point, b: Point, c: Point) -> Column:
    """Degrees at b between a and c; null for null points and where the arms' lengths multiply to less than SMALL."""
    ux, uy, vx, vy = a[0] - b[0], a[1] - b[1], c[0] - b[0], c[1] - b[1]
    size = F.hypot(ux, uy) * F.hypot(vx, vy)
    return F.when(size >= SMALL, F.degrees(F.acos(clamp((ux * vx + uy * vy) / size, -1.0, 1.0))))


def lean_angle(top: Point, bottom: Point) -> Column:
    """Degrees of the line from top to bottom against the downward vertical, positive if the bottom is farther right."""
    dx, dy = bottom[0] - top[0], bottom[1] - top[1]
    return F.when((F.abs(dx) >= SMALL) | (F.abs(dy) >= SMALL), F.degrees(F.atan2(dx, dy)))


def landmark(points: Column, at: int, least: float = 0.5) -> Point:
    """x and y of a landmark that is visible enough, else nulls. Points are structs (x, y, visibility)."""
    seen = F.get(points, F.lit(at))["visibility"] >= least
    return tuple(F.when(seen, F.get(points, F.lit(at))[c]) for c in ("x", "y"))


def midpoint(a: Point, b: Point) -> Point:
    """The middle, or the one point that is known."""
    mid = lambda u, v: F.coalesce((u + v) / 2, u, v)
    return mid(a[0], b[0]), mid(a[1], b[1])


#: Places of the body's joints among the 33 landmarks, left and right.
SHOULDERS, ELBOWS, WRISTS, HIPS, KNEES, ANKLES = (11, 12), (13, 14), (15, 16), (23, 24), (25, 26), (27, 28)


def full_frame(points: Column, crop_width: Column, x_offset: Column, width: Column) -> Column:
    """Landmarks of a crop as landmarks of the whole picture: x in shares of its width; y and visibility stay."""
    return F.transform(points, lambda p: F.struct(((p["x"] * crop_width + x_offset) / width).alias("x"), p["y"].alias("y"), p["visibility"].alias("visibility")))


def pose_row(points: Column) -> dict[str, Column]:
    """The measures of one pose that need no other frame; heights grow upwards, x and y are shares of the picture.

    Both elbows and hands are measured whatever their visibility; everything else needs landmarks that are visible enough.
    The dominant arm is the one that is seen better. The front leg is the one whose ankle is farther left; with one ankle
    hidden it is the known leg, and there is no back leg.
    """
    parts = (("shoulder", SHOULDERS), ("elbow", ELBOWS), ("wrist", WRISTS), ("hip", HIPS), ("knee", KNEES), ("ankle", ANKLES))
    joint = {name: tuple(landmark(points, i) for i in at) for name, at in parts}
    raw = {name: tuple(landmark(points, i, float("-inf")) for i in at) for name, at in parts}
    seen = {name: tuple(F.get(points, F.lit(i))["visibility"] for i in at) for name, at in parts}
    summary = F.array(*(v for name in ("shoulder", "hip", "knee", "ankle", "wrist") for v in seen[name]))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    shoulders, hips = midpoint(*joint["shoulder"]), midpoint(*joint["hip"])
    arm = [(seen["shoulder"][i] + seen["elbow"][i] + seen["wrist"][i]) / 3 for i in (0, 1)]
    left = arm[0] >= arm[1]
    elbow = lambda of, i: joint_angle(of["shoulder"][i], of["elbow"][i], of["wrist"][i])
    knee = [joint_angle(joint["hip"][i], joint["knee"][i], joint["ankle"][i]) for i in (0, 1)]
    ankles = [joint["ankle"][i][0] for i in (0, 1)]
    body = F.filter(F.array(*(joint[name][i][1] for name in ("shoulder", "hip", "knee") for i in (0, 1))), lambda y: y.isNotNull())
    return {
        "visibility_mean": total(summary) / 10, "visibility_min": F.array_min(summary), "visibility_left_arm": arm[0], "visibility_right_arm": arm[1],
        "angle_trunk_lean": lean_angle(shoulders, hips),
        "angle_elbow_dom": F.when(left, elbow(joint, 0)).otherwise(elbow(joint, 1)), "angle_elbow_left": elbow(raw, 0), "angle_elbow_right": elbow(raw, 1),
        "angle_knee_front": F.when(ankles[0] <= ankles[1], knee[0]).when(ankles[0] > ankles[1], knee[1]).otherwise(F.coalesce(F.nullif(knee[0], F.lit(0.0)), knee[1])),
        "angle_knee_back": F.when(ankles[0] <= ankles[1], knee[1]).when(ankles[0] > ankles[1], knee[0]),
        "com_height": F.when(F.size(body) > 0, 1 - total(body) / F.greatest(F.size(body), F.lit(1))),
        "hand_height": 1 - F.when(left, joint["wrist"][0][1]).otherwise(joint["wrist"][1][1]),
        "hand_height_left": 1 - raw["wrist"][0][1], "hand_height_right": 1 - raw["wrist"][1][1], "stance_length": F.abs(ankles[0] - ankles[1]),
    }
