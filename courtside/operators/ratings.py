"""Players from match history: careers, prior win rates, head to head, Elo, and feature tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.operators import joins as jn
from courtside.operators.graph import components

START, K = 1500.0, 32.0
#: What ratings add to a match.
ELO = ("elo_a", "elo_b", "elo_a_after", "elo_b_after")


def player_rows(matches: DataFrame, a: str, b: str, a_won: str | None = None) -> DataFrame:
    """Two rows per match, one for each side: player, side, won, and the match's columns."""
    side = lambda who, name, won: matches.withColumns({"player": F.col(who), "side": F.lit(name)} | ({"won": won} if a_won else {}))
    won = F.col(a_won) if a_won else None
    return side(a, "A", won).unionByName(side(b, "B", 1 - won if a_won else None))


def player_latest(matches: DataFrame, a: str, b: str, order: Column, columns: Sequence[str]) -> DataFrame:
    """side and columns of each player's last match."""
    rows = player_rows(matches.withColumn("m_order", order), a, b)
    return rows.groupBy("player").agg(F.max_by(F.struct("side", *columns), "m_order").alias("r")).select("player", "r.*")


def careers(matches: DataFrame, a: str, b: str, a_won: str, score: str) -> DataFrame:
    return player_rows(matches, a, b, a_won).groupBy("player").agg(F.count("*").alias("matches"), F.sum("won").cast("long").alias("wins"), F.avg(score).alias("mean_score"))


def differences(columns: dict[str, str]) -> list[Column]:
    return [(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"{name}_diff") for c, name in columns.items()]


def prior_win_rates(matches: DataFrame, a: str, b: str, a_won: str, order: Sequence[str], start: float = 0.5, bucket: Column | None = None) -> DataFrame:
    """Adds prior_a and prior_b: each side's share of wins in its earlier matches, ``start`` before the first.

    Sums come in two levels, so that no player's matches meet in one task: a player's totals per ``bucket`` of time (the
    first order column, if not given; it must not fall as the order rises) are summed over the buckets before, and matches
    are counted within their bucket. Both sides of a match go through one scan and are put back together by the order
    columns, which must name it; these travel once, and of the match's other columns only those of ``matches``.
    """
    others = [c for c in matches.columns if c not in order]
    won = F.col(a_won).cast("long")
    sides = F.array(*(F.struct(F.col(p).alias("player"), F.lit(s).alias("side"), w.alias("won")) for p, s, w in ((a, "A", won), (b, "B", 1 - won))))
    bucket = F.col(order[0]) if bucket is None else bucket
    rows = matches.select(F.struct(*others).alias("m_match"), *(F.col(o).alias(f"m_{i}") for i, o in enumerate(order)), bucket.alias("m_bucket"), F.explode(sides).alias("m_side"))
    rows = rows.select(F.when(F.col("m_side.side") == "A", F.col("m_match")).alias("m_match"), *(f"m_{i}" for i in range(len(order))), "m_bucket", "m_side.*")
    sums = lambda by: [F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in ("m_n", "m_won")]
    totals = rows.groupBy("player", "m_bucket").agg(F.count("*").alias("m_n"), F.sum("won").alias("m_won"))
    n, w = sums(Window.partitionBy("player").orderBy("m_bucket"))
    totals = totals.select(F.col("player").alias("t_player"), F.col("m_bucket").alias("t_bucket"), n.alias("t_n"), w.alias("t_won"))
    n, w = sums(Window.partitionBy("player", "m_bucket").orderBy(*(f"m_{i}" for i in range(len(order)))))
    rows = rows.withColumns({"m_n": F.lit(1), "m_won": F.col("won")}).withColumns({"m_before": n, "m_wins": w})
    rows = rows.join(totals, F.col("player").eqNullSafe(F.col("t_player")) & F.col("m_bucket").eqNullSafe(F.col("t_bucket")))
    prior = F.coalesce(F.try_divide(F.col("m_wins") + F.col("t_won"), F.col("m_before") + F.col("t_n")), F.lit(start))
    of = lambda side: F.max(F.when(F.col("side") == side, prior))
    whole = rows.groupBy(*(f"m_{i}" for i in range(len(order)))).agg(F.first("m_match", ignorenulls=True).alias("m_match"), of("A").alias("prior_a"), of("B").alias("prior_b"))
    return whole.select(*((F.col("m_match")[c] if c in others else F.col(f"m_{list(order).index(c)}")).alias(c) for c in matches.columns), "prior_a", "prior_b")


def head_to_head(matches: DataFrame, a: str, b: str, a_won: str, order: Column) -> DataFrame:
    """low, high, matches, low_wins, low_rate, last_winner of each unordered pair; wins count by the winner's id."""
    winner = F.when(F.col(a_won) == 1, F.col(a)).otherwise(F.col(b))
    rows = matches.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), winner.alias("winner"), order.alias("m_order"))
    won = F.count_if(F.col("winner") == F.col("low"))
    return rows.groupBy("low", "high").agg(F.count("*").alias("matches"), won.alias("low_wins"), F.round(won / F.count("*"), 6).alias("low_rate"), F.max_by("winner", "m_order").alias("last_winner"))


#: Different values that one-hot columns are made of at most.
VALUES = 1000


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None, prefix: str) -> DataFrame:
    """0/1 columns for all sorted values but the first; a null has 0 everywhere. Without ``values``, those of the data, up to VALUES."""
    if values is None:
        values = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(VALUES + 1).collect()]
        if len(values) > VALUES:
            raise ValueError(f"{column} has more than {VALUES} values")
    return df.withColumns({f"{prefix}{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(values)[1:]})


def aligned(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Keys, then the features in order as doubles; those missing or null are 0."""
    have = set(df.columns)
    return df.select(*keys, *((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f) for f in features))


def elo_step(ratings: dict, a, b, a_won: int, k: float = K, start: float = START) -> tuple[float, float, float, float]:
    """Ratings of both before and after a match; ``ratings`` is changed."""
    ra, rb = ratings.get(a, start), ratings.get(b, start)
    expected = 1 / (1 + 10 ** ((rb - ra) / 400))
    change = k * (a_won - expected)
    ratings[a], ratings[b] = ra + change, rb - change
    return ra, rb, ra + change, rb - change


def pools(matches: DataFrame, a: str, b: str) -> DataFrame:
    """player, pool: players who met, directly or through others, share a pool, named by the smallest of them."""
    return components(matches.select(a, b), a, b).select(F.col("node").alias("player"), F.col("root").alias("pool"))


def elo(matches: DataFrame, pool: str | None, a: str, b: str, a_won: str, order: Sequence[str], k: float = K, start: float = START) -> DataFrame:
    """Adds elo_a, elo_b (before) and elo_a_after, elo_b_after.

    Ratings depend on all earlier matches of both sides, so matches run in order within a pool: a set of players who
    only meet each other, such as a tour or a league. Pools run side by side; rows of a pool stream through one task,
    which keeps its players' ratings only. Without a ``pool`` column pools are found from who met whom, by the first player.
    """
    if pool is None:
        found = pools(matches, a, b).withColumnRenamed("player", "m_player").withColumnRenamed("pool", "m_pool")
        return elo(matches.join(found, F.col(a) == F.col("m_player")).drop("m_player"), "m_pool", a, b, a_won, order, k, start).drop("m_pool")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ratings = None, {}
        for batch in batches:
            out = before_a, before_b, after_a, after_b = [], [], [], []
            for this, x, y, won in zip(*(batch.column(c).to_pandas().tolist() for c in (pool, a, b, a_won)), strict=True):
                if this != at:
                    at, ratings = this, {}
                ra, rb, up, down = elo_step(ratings, x, y, won, k, start)
                before_a.append(ra)
                before_b.append(rb)
                after_a.append(up)
                after_b.append(down)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.float64(), from_pandas=True) for v in out)], [*batch.schema.names, *ELO])

    rows = matches.repartition(pool).sortWithinPartitions(pool, *order)
    return rows.mapInArrow(run, ", ".join([kinds, *(f"{c} double" for c in ELO)]))


#: Fixed value: what keeps a win rate of no matches from dividing by 0.
NO_MATCHES = 1e-6


def career_differences(a: str = "_a", b: str = "_b") -> list[Column]:
    """elo_diff, age_diff, events_diff, matches_diff, win_rate_diff, titles_diff of rows with both sides' elo, age, events, matches, wins, titles."""
    plain = lambda c: (F.col(f"{c}{a}") - F.col(f"{c}{b}")).alias(f"{c}_diff")
    rate = lambda s: F.col(f"wins{s}") / (F.col(f"matches{s}") + NO_MATCHES)
    return [*map(plain, ("elo", "age", "events", "matches")), (rate(a) - rate(b)).alias("win_rate_diff"), plain("titles")]


def rated_careers(matches: DataFrame, profiles: DataFrame, a: str, b: str, a_won: str, order: Sequence[str], player: str = "player", pool: str | None = None) -> DataFrame:
    """Each match of two players with a profile (age, events, matches, wins, titles): its columns, the ratings in force before it, and ``career_differences``.

    All matches count for the ratings, also those of players without a profile.
    """
    rated = elo(matches, pool, a, b, a_won, order).drop("elo_a_after", "elo_b_after")
    both = jn.profile_join(rated, profiles, a, b, player, ["age", "events", "matches", "wins", "titles"])
    return both.select(*matches.columns, "elo_a", "elo_b", *career_differences())
