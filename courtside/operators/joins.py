"""Joins on time and intervals, expressed so that they scale: equi-joins on buckets and windows over unions, no nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.shared import stored

Names = Sequence[str]


def asof_join(left: DataFrame, right: DataFrame, keys: Names, on: str, columns: Names, defaults: dict[str, object] | None = None) -> DataFrame:
    """Adds to each left row the columns of the last right row of its keys with right.on <= left.on.

    Both sides are laid along one line per key, right rows first where they tie, and the last right row is carried as a
    struct, so that a null in it stays null. Several right rows at one place: the largest by ``columns`` order counts.
    Left rows before any right row get null, or the default.
    """
    carried = F.struct(*columns)
    l_side = left.select(*keys, on, F.lit(1).alias("j_side"), F.struct(*left.columns).alias("j_left"), F.lit(None).cast(right.select(carried).schema[0].dataType).alias("j_right"))
    r_side = right.select(*keys, on, F.lit(0).alias("j_side"), F.lit(None).cast(l_side.schema["j_left"].dataType).alias("j_left"), carried.alias("j_right"))
    w = Window.partitionBy(*keys).orderBy(on, "j_side", "j_right").rowsBetween(Window.unboundedPreceding, 0)
    both = l_side.unionByName(r_side).withColumn("j_last", F.last("j_right", ignorenulls=True).over(w)).filter("j_side = 1")
    found = [F.col("j_last")[c] for c in columns]
    if defaults:
        found = [F.when(F.col("j_last").isNull(), F.lit(defaults.get(c))).otherwise(x) for c, x in zip(columns, found, strict=True)]
    return both.select("j_left.*", *(x.alias(c) for c, x in zip(columns, found, strict=True)))


def locf(df: DataFrame, keys: Names, order: Names, columns: dict[str, str]) -> DataFrame:
    """Adds under new names the last known value of columns, this row's included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({new: F.last(old, ignorenulls=True).over(w) for old, new in columns.items()})


def range_join(points: DataFrame, intervals: DataFrame, keys: Names, at: str, start: str, end: str, bucket: int = 64) -> DataFrame:
    """Each point with every interval of its keys that covers it, both ends included.

    Intervals are dealt to buckets of ``bucket`` units and joined on (keys, bucket), then the bounds are checked. A point
    on a shared boundary belongs to both intervals. Rows with a null bound or place join nothing.
    """
    wide = intervals.filter(F.col(start) <= F.col(end)).withColumn("j_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    placed = points.withColumn("j_bucket", F.floor(F.col(at) / bucket))
    return placed.join(wide, [*keys, "j_bucket"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("j_bucket")


def pair_join(left: DataFrame, right: DataFrame, on: Names) -> DataFrame:
    """Inner pairing on names; AQE broadcasts the smaller side if its measured size allows."""
    return left.join(right, list(on))


def unpaired(left: DataFrame, right: DataFrame, on: Names) -> DataFrame:
    return left.join(right.select(*on), list(on), "left_anti")


def left_default(left: DataFrame, right: DataFrame, on: Names, defaults: dict[str, object]) -> DataFrame:
    """Left join; columns of the right side that find nothing, or null, get their default."""
    out = left.join(right, list(on), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def profile_join(rows: DataFrame, profiles: DataFrame, a: str, b: str, profile_key: str, columns: Names) -> DataFrame:
    """Rows whose two sides both have a profile, with its columns as <c>_a and <c>_b."""
    side = lambda key, tag: profiles.select(F.col(profile_key).alias(key), *(F.col(c).alias(f"{c}_{tag}") for c in columns))
    return rows.join(side(a, "a"), a).join(side(b, "b"), b)


def name_search(rows: DataFrame, name: str, searches: DataFrame, text: str, gram: int = 3) -> DataFrame:
    """Rows whose name holds a searched text, case ignored, literally; the text comes in lower case.

    Each search is keyed by its first ``gram`` characters, each different name by the distinct pieces of that length and less,
    so both sides may be large: they meet on a piece, and what meets is checked. Names with their pieces take far more room
    than the files they are read from say, so they are merged and never broadcast. A null name or search finds nothing.
    """
    wanted = searches.select(F.lower(text).alias(text)).distinct().withColumn("j_piece", F.substring(text, 1, gram))
    named, low = rows.withColumn("j_name", F.col(name)), F.lower("j_name")
    places = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    cut = lambda n: F.transform(places, lambda i: F.substring(low, i, F.lit(n)))
    pieces = [cut(n) for n in range(gram + 1)]
    keyed = named.select("j_name").filter("j_name is not null").distinct().withColumn("j_piece", F.explode(F.array_distinct(F.concat(*pieces))))
    found = keyed.join(wanted.hint("merge"), "j_piece").filter(F.contains(low, F.col(text))).select("j_name", text)
    return named.join(found.hint("merge"), "j_name").drop("j_name")


def player_search(matches: DataFrame, searches: DataFrame, text: str, sides: dict[str, str], order: Column, columns: Names, gram: int = 3) -> DataFrame:
    """For each searched text, the last match with a player whose name holds it (case ignored): side, name, and that side's columns.

    ``sides`` maps a side to its name column; ``columns`` exist as <c>_<side>. If both names hold the text, the first side
    is the player. Searches that find nobody have no row. Of matches at the same place the one with the larger values counts.
    A name's last match is found first, so that names are searched and not matches.
    """
    both = None
    for rank, (side, name) in enumerate(sides.items()):
        own = matches.select(order.alias("j_order"), F.lit(-rank).alias("j_rank"), F.lit(side).alias("side"), F.col(name).alias("name"), *(F.col(f"{c}_{side}").alias(c) for c in columns))
        both = own if both is None else both.unionByName(own)
    last = stored(both.filter("name is not null").groupBy("name").agg(F.max(F.struct("j_order", "j_rank", "name", *columns, "side")).alias("j_last")))
    found = name_search(last, "name", searches, text, gram).groupBy(text).agg(F.max("j_last").alias("r"))
    return found.select(text, "r.side", "r.name", *(f"r.{c}" for c in columns))


def frame_pairs(left: DataFrame, right: DataFrame, game: str, name: str) -> DataFrame:
    """Rows of both sides of one game whose file names have the same frame number, however it is padded: images and masks.

    The right side's name is ``<name>_right``; ``pair`` names both, so that frames of two games don't clash. Names without a
    number pair with nothing.
    """
    number = lambda df: df.withColumn("frame", F.regexp_extract(name, r"(\d+)(?!.*\d)", 1).try_cast("long")).filter("frame is not null")
    other = number(right.select(game, F.col(name))).withColumnRenamed(name, f"{name}_right")
    return number(left).join(other, [game, "frame"]).withColumn("pair", F.concat_ws("_", F.col(game).cast("string"), F.col("frame").cast("string")))


def unordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def pair_enumeration(df: DataFrame, keys: Names, member: str) -> DataFrame:
    """All unordered pairs of members within a key: the one place where pairs are the result itself."""
    left = df.select(*keys, F.col(member).alias(f"{member}_a"))
    right = df.select(*keys, F.col(member).alias(f"{member}_b"))
    return left.join(right, list(keys)).filter(F.col(f"{member}_a") < F.col(f"{member}_b"))


def pairs_with_known(df: DataFrame, keys: Names, member: str, columns: Names, known: DataFrame, low: str, high: str, value: str, default: object, blocks: int = 16) -> DataFrame:
    """All unordered pairs of members within a key, with both sides' columns as <c>_a and <c>_b and what is known of some pairs.

    ``known`` has one row per pair, with ``low`` < ``high``; pairs that it lacks, and null values, get the default. No pair is
    shuffled: each key's members are dealt to ``blocks`` blocks, and a member goes once to each block that it meets, with what is
    known of it and that block. So the shuffles grow with the members and the known pairs, a task holds one block of a key
    at a time, and only the result grows with the pairs. Rows sent to the blocks are more than their files say, so they are
    merged and never broadcast, and few for the pairs they make, so their partitions are as many as the session shuffles to
    and not made fewer by their bytes. ``df`` is read several times.
    """
    a, b = f"{member}_a", f"{member}_b"
    block, all_blocks = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    of = lambda name: df.select(*keys, F.col(member).alias(name)).distinct()
    side = lambda name, tag, own, other: df.select(*keys, F.col(member).alias(name), *(F.col(c).alias(f"{c}_{tag}") for c in columns), block(member).alias(own), all_blocks.alias(other))
    same = known.filter(F.col(value).isNotNull()).select(F.col(low).alias(a), F.col(high).alias(b), value).join(of(b), b).join(of(a), [*keys, a], "left_semi")
    met = same.groupBy(*keys, a, block(b).alias("j_right")).agg(F.map_from_entries(F.collect_list(F.struct(b, value))).alias("j_known"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = side(a, "a", "j_left", "j_right").join(met, [*keys, a, "j_right"], "left").repartition(tasks, *keys, "j_left", "j_right")
    both = left.join(side(b, "b", "j_right", "j_left").hint("merge"), [*keys, "j_left", "j_right"]).filter(F.col(a) < F.col(b))
    return both.withColumn(value, F.coalesce(F.try_element_at("j_known", F.col(b)), F.lit(default))).drop("j_left", "j_right", "j_known")


def union_sources(sources: dict[str, DataFrame], name: str) -> DataFrame:
    """All rows of several sources; names get their source as a prefix, columns that one lacks are null."""
    out = None
    for prefix, df in sources.items():
        own = df.withColumn(name, F.concat(F.lit(f"{prefix}_"), F.col(name).cast("string"))).withColumn("origin", F.lit(prefix))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
