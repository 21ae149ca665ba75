"""Sequence operators on ordered events: kinematics, votes, runs, change-logs, segments and gates.

Every operator takes the columns that partition and order it. Order columns must be unique within a partition; add a
tie-break if they aren't. All windows of one operator partition by the same leading keys, so Spark sorts again but
exchanges once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

Names = Sequence[str]


def along(keys: Names, order: Names) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def latest(value: Column | str, keys: Names, order: Names) -> Column:
    """The last known value up to and including this row."""
    return F.last(value, ignorenulls=True).over(along(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def epoch(flag: Column, keys: Names, order: Names) -> Column:
    """How often the flag has been set so far: a new epoch starts at each flagged row. Null counts as not set."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(along(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def pixel_speed(df: DataFrame, keys: Names, order: Names, frame: str, x: str, y: str, rate: float, smooth: int = 5) -> DataFrame:
    """Adds speed (distance to the previous point times the rate, null at the first) and smooth_speed (mean of the last few, 0 if none).

    The distance counts from the previous point, however many frames ago it was seen.
    """
    w = along(keys, order)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) * rate
    out = df.withColumn("speed", step)
    return out.withColumn("smooth_speed", F.coalesce(F.avg("speed").over(w.rowsBetween(1 - smooth, 0)), F.lit(0.0)))


def metric_speed(df: DataFrame, keys: Names, order: Names, frame: str, x: str, y: str, valid: Column, rate: float, limit: float = 40.0, smooth: int = 5) -> DataFrame:
    """Adds metric_x, metric_y and metric_speed, carried forward over rows that are not valid.

    Speeds are taken between successive valid points; those above ``limit`` are rejected, and the median of the last few
    accepted ones counts. Only the final carry needs all rows; the others look at valid rows by their running number.
    """
    w = along(keys, order)
    group = [*keys, "v_ok"]
    out = df.withColumn("v_ok", F.coalesce(valid, F.lit(False)))
    v = along(group, order)
    moved = F.hypot(F.col(x) - F.lag(x).over(v), F.col(y) - F.lag(y).over(v))
    seconds = (F.col(frame) - F.lag(frame).over(v)) / rate
    out = out.withColumn("v_step", F.when(F.col("v_ok") & (seconds > 0), moved / seconds))
    out = out.withColumn("v_good", F.col("v_ok") & (F.col("v_step") <= limit))
    median = F.expr("percentile(v_step, 0.5)").over(along([*keys, "v_good"], order).rowsBetween(1 - smooth, 0))
    out = out.withColumn("v_speed", F.when(F.col("v_good"), median))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    carried = {f"metric_{n}": F.last(F.when(F.col("v_ok"), F.col(c)), ignorenulls=True).over(back) for n, c in (("x", x), ("y", y))}
    return out.withColumns(carried | {"metric_speed": F.last("v_speed", ignorenulls=True).over(back)}).drop("v_ok", "v_step", "v_good", "v_speed")


def trail(df: DataFrame, keys: Names, order: Names, columns: Names, length: int = 30, name: str = "trail") -> DataFrame:
    """Adds the last ``length`` points, oldest first."""
    return df.withColumn(name, F.collect_list(F.struct(*columns)).over(along(keys, order).rowsBetween(1 - length, 0)))


def majority(values: Column, least: int = 2) -> Column:
    """The most frequent value of an array if it occurs ``least`` times or more; ties go to the one seen first."""
    counted = F.transform(values, lambda v, i: F.struct(F.size(F.filter(values, lambda o: o == v)).alias("n"), (-F.array_position(values, v)).alias("place"), v.alias("value")))
    best = F.array_max(counted)
    return F.when(best["n"] >= least, best["value"])


def vote(df: DataFrame, keys: Names, order: Names, value: str, reliable: Column, length: int = 5, reads: int = 3, least: int = 2, name: str = "vote") -> DataFrame:
    """Adds the majority of the last ``length`` reliable reads, null on unreliable rows and with fewer than ``reads`` of them."""
    out = df.withColumn("v_ok", F.coalesce(reliable, F.lit(False)))
    recent = F.collect_list(value).over(along([*keys, "v_ok"], order).rowsBetween(1 - length, 0))
    out = out.withColumn("v_recent", recent)
    return out.withColumn(name, F.when(F.col("v_ok") & (F.size("v_recent") >= reads), majority(F.col("v_recent"), least))).drop("v_ok", "v_recent")


def stable_run(df: DataFrame, keys: Names, order: Names, value: str, reliable: Column, runs: int = 4, name: str = "stable") -> DataFrame:
    """Adds the value that last held for ``runs`` reliable rows in a row, carried forward.

    Null values neither break nor lengthen a run; an unreliable row ends it.
    """
    w = along(keys, order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("v_ok", F.coalesce(reliable, F.lit(False)))
    out = out.withColumn("v_breaks", F.sum(F.when(~F.col("v_ok"), 1).otherwise(0)).over(back))
    out = out.withColumn("v_value", F.when(F.col("v_ok"), F.col(value)))
    group = along([*keys, "v_breaks"], order)
    before = F.last("v_value", ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("v_before", before)
    out = out.withColumn("v_new", F.when(F.col("v_value").isNotNull() & ~F.col("v_value").eqNullSafe(F.col("v_before")), 1).otherwise(0))
    out = out.withColumn("v_island", F.sum("v_new").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.count("v_value").over(along([*keys, "v_breaks", "v_island"], order).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("v_count", count)
    held = F.when(F.col("v_value").isNotNull() & (F.col("v_count") >= runs), F.col("v_value"))
    return out.withColumn(name, F.last(held, ignorenulls=True).over(back)).drop("v_ok", "v_breaks", "v_value", "v_before", "v_new", "v_island", "v_count")


#: Fixed value: more sets than these can't be won.
MOST_SETS = 5


def stable_sets(df: DataFrame, keys: Names, order: Names, value: str, reliable: Column, runs: int = 4, most: int = MOST_SETS, name: str = "stable_sets") -> DataFrame:
    """Adds the set count that last held for ``runs`` reads in a row. A null or an impossible count ends a run, as an unreliable one does."""
    return stable_run(df, keys, order, value, reliable & F.col(value).isNotNull() & (F.col(value) <= most), runs, name)


def obscured(df: DataFrame, keys: Names, order: Names, read: Column, reliable: Column, name: str = "obscured") -> DataFrame:
    """Adds whether the last read so far was unreliable; false before the first. Rows that aren't reads keep the flag."""
    back = along(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    flag = F.last(F.when(read, ~F.coalesce(reliable, F.lit(False))), ignorenulls=True).over(back)
    return df.withColumn(name, F.coalesce(flag, F.lit(False)))


def tumbling_vote(df: DataFrame, keys: Names, order: Names, value: str, length: int = 3) -> DataFrame:
    """One row per full block of ``length`` rows: keys, block, vote (a value that occurs twice or more, the earliest such)."""
    numbered = df.withColumn("v_at", F.row_number().over(along(keys, order)) - 1).withColumn("block", F.floor(F.col("v_at") / length))
    values = F.transform(F.array_sort(F.collect_list(F.struct("v_at", F.col(value).alias("v")))), lambda s: s["v"])
    blocks = numbered.groupBy(*keys, "block").agg(values.alias("v_all")).filter(F.size("v_all") == length)
    return blocks.select(*keys, "block", majority(F.col("v_all"), 2).alias("vote"))


def change_log(df: DataFrame, keys: Names, order: Names, columns: Names) -> DataFrame:
    """The rows whose columns differ from those of the row before; each partition's first row stays. Null equals null."""
    now = F.struct(*columns)
    marked = df.withColumns({"v_same": F.lag(now).over(along(keys, order)).eqNullSafe(now), "v_at": F.row_number().over(along(keys, order))})
    return marked.filter(~F.col("v_same") | (F.col("v_at") == 1)).drop("v_same", "v_at")


def segments(df: DataFrame, keys: Names, order: Names, first: str, second: str, name: str = "rally_id") -> DataFrame:
    """Adds a segment number that rises where the stable pair changes, and whether this row starts a segment.

    A change counts if the first value is known before and after; the rows before any known value belong to segment 0.
    """
    w = along(keys, order)
    changed = F.lag(first).over(w).isNotNull() & F.col(first).isNotNull() & ~F.struct(first, second).eqNullSafe(F.lag(F.struct(first, second)).over(w))
    out = df.withColumn("is_start", F.coalesce(changed, F.lit(False)))
    return out.withColumn(name, epoch(F.col("is_start"), keys, order))


def segment_winner(first: Column, second: Column, next_first: Column, next_second: Column, strict: bool = False) -> Column:
    """p1 or p2 if exactly one side's score changed (``strict``: rose, from a known one), else unknown. Null equals null."""
    changed = lambda old, new: ~old.eqNullSafe(new)
    one, two = (F.coalesce(b > a, F.lit(False)) if strict else changed(a, b) for a, b in ((first, next_first), (second, next_second)))
    same_one, same_two = ~changed(first, next_first), ~changed(second, next_second)
    return F.when(one & same_two, "p1").when(two & same_one, "p2").otherwise("unknown")


def gate(df: DataFrame, keys: Names, order: Names, active: Column, seen: int = 4, missing: int = 30) -> DataFrame:
    """Adds is_active and collects: a hysteresis that opens after ``seen`` rows in a row and shuts after ``missing`` without.

    A row is collected if it is in play and the gate was already open before it.
    """
    w = along(keys, order)
    out = df.withColumn("v_on", F.coalesce(active, F.lit(False)))
    out = out.withColumn("v_turn", F.when(F.lag("v_on").over(w).eqNullSafe(F.col("v_on")), 0).otherwise(1))
    out = out.withColumn("v_island", F.sum("v_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("v_length", F.row_number().over(along([*keys, "v_island"], order)))
    event = F.when(F.col("v_on") & (F.col("v_length") >= seen), True).when(~F.col("v_on") & (F.col("v_length") >= missing), False)
    out = out.withColumn("v_event", event)
    out = out.withColumn("is_active", F.coalesce(F.last("v_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    return out.withColumn("collects", F.col("v_on") & F.coalesce(F.lag("is_active").over(w), F.lit(False))).drop("v_on", "v_turn", "v_island", "v_length", "v_event")


def toggle_gate(df: DataFrame, keys: Names, order: Names, toggle: Column, name: str = "gate_open") -> DataFrame:
    """Adds whether an odd number of toggles came so far."""
    return df.withColumn(name, epoch(toggle, keys, order) % 2 == 1)


def clamped_sum(df: DataFrame, keys: Names, order: Names, delta: str, reset: Column | None = None, name: str = "score") -> DataFrame:
    """Adds a running sum that never goes below 0 and starts anew after each reset.

    The clamp has a closed form: the plain sum less its lowest value so far, if that is below 0.
    """
    out, group = df, list(keys)
    if reset is not None:
        out, group = out.withColumn("v_epoch", epoch(reset, keys, order)), [*keys, "v_epoch"]
    w = along(group, order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("v_sum", F.sum(F.coalesce(delta, F.lit(0))).over(w))
    out = out.withColumn(name, F.col("v_sum") - F.least(F.lit(0), F.min("v_sum").over(w)))
    return out.drop("v_sum", "v_epoch")


def manual_score(df: DataFrame, keys: Names, order: Names, player: str, kind: str, delta: str) -> DataFrame:
    """Adds p1_score, p2_score, p1_sets, p2_sets of hand-entered events: point, set and swap; other kinds change nothing.

    Events are booked on the person who sits on the named side, which the parity of the swaps so far tells; a person's
    points are a sum clamped at 0 that starts anew with each set won, and at the end persons go back to their sides.
    A player other than p1 counts as p2; a null delta as 0.
    """
    is_a = F.coalesce(F.col(player) == "p1", F.lit(False)) == (F.col("v_swaps") % 2 == 0)
    booked = lambda what, who: F.when((F.col(kind) == what) & who, F.col(delta)).otherwise(0)
    out = df.withColumns({"v_swaps": epoch(F.col(kind) == "swap", keys, order), "v_set": epoch((F.col(kind) == "set") & (F.col(delta) > 0), keys, order)})
    out = out.withColumns({f"v_{what}_{side}": booked(what, who) for what in ("point", "set") for side, who in (("a", is_a), ("b", ~is_a))})
    for side in "ab":
        out = clamped_sum(out, keys, order, f"v_set_{side}", name=f"v_sets_{side}")
    for side in "ab":
        out = clamped_sum(out, [*keys, "v_set"], order, f"v_point_{side}", name=f"v_score_{side}")
    home = F.col("v_swaps") % 2 == 0
    sides = lambda what: (F.when(home, F.col(f"v_{what}_a")).otherwise(F.col(f"v_{what}_b")), F.when(home, F.col(f"v_{what}_b")).otherwise(F.col(f"v_{what}_a")))
    (p1, p2), (s1, s2) = sides("score"), sides("sets")
    return out.select(*df.columns, *(c.cast("int").alias(n) for n, c in (("p1_score", p1), ("p2_score", p2), ("p1_sets", s1), ("p2_sets", s2))))


def running_max(df: DataFrame, keys: Names, order: Names, value: str, name: str = "running_max") -> DataFrame:
    return df.withColumn(name, F.max(value).over(along(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def rolling_rate(df: DataFrame, keys: Names, order: Names, value: str, length: int = 30) -> DataFrame:
    """Adds rolling_mean of the last ``length`` values and rolling_rate, one over it."""
    out = df.withColumn("rolling_mean", F.avg(value).over(along(keys, order).rowsBetween(1 - length, 0)))
    return out.withColumn("rolling_rate", F.try_divide(F.lit(1.0), "rolling_mean"))


def velocity(df: DataFrame, keys: Names, order: Names, frame: str, x: str, y: str, rate: float, name: str = "velocity") -> DataFrame:
    """Adds the speed against the previous row; null if that row lacked the point or no time has passed."""
    w = along(keys, order)
    seconds = (F.col(frame) - F.lag(frame).over(w)) / rate
    return df.withColumn(name, F.when(seconds > 0, F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) / seconds))


def rate_of(df: DataFrame, keys: Names, order: Names, frame: str, value: str, rate: float, name: str) -> DataFrame:
    """Adds how fast a value changes against the previous row, with its sign; null if either row lacks it or no time has passed."""
    w = along(keys, order)
    seconds = (F.col(frame) - F.lag(frame).over(w)) / rate
    return df.withColumn(name, F.when(seconds > 0, (F.col(value) - F.lag(value).over(w)) / seconds))


def pose_velocities(df: DataFrame, keys: Names, order: Names, frame: str, rate: float, points: dict[str, tuple[str, str]], values: dict[str, str]) -> DataFrame:
    """Adds the speeds of ``points`` (name to x, y), which have no sign, and the rates of ``values`` (name to column), which have one.

    Such as the hands' speeds, the torso's rate along x and the centre of mass' rate along y. All look at a player's pose row
    before, and share its sort.
    """
    for name, (x, y) in points.items():
        df = velocity(df, keys, order, frame, x, y, rate, name)
    for name, value in values.items():
        df = rate_of(df, keys, order, frame, value, rate, name)
    return df


def expanding(df: DataFrame, keys: Names, order: Names, columns: Names, recent: int = 3) -> DataFrame:
    """Adds <c>_mean over all rows so far, <c>_last<n> over the last few, and row_in_key."""
    w = along(keys, order)
    means = {f"{c}_mean": F.avg(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}
    lasts = {f"{c}_last{recent}": F.avg(c).over(w.rowsBetween(1 - recent, 0)) for c in columns}
    return df.withColumns(means | lasts | {"row_in_key": F.row_number().over(w)})


def freeze_after(df: DataFrame, keys: Names, order: Names, frame: str, swap: Column, frames: int) -> DataFrame:
    """The rows without a swap in the ``frames`` frames before them; a swap row itself is frozen."""
    last = latest(F.when(swap, F.col(frame)), keys, order)
    return df.withColumn("v_swap", last).filter(F.col("v_swap").isNull() | (F.col(frame) >= F.col("v_swap") + frames)).drop("v_swap")
