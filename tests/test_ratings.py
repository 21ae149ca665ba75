"""Pools, ratings, prior win rates and career differences against plain computations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import graph
from courtside.operators import ratings as rt


def plain_components(edges):
    roots = {}

    def find(x):
        while roots.setdefault(x, x) != x:
            x = roots[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        roots[high] = low
    return {x: find(x) for x in list(roots)}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200)] + [(300, 301 + i) for i in range(50)]
    df = spark.createDataFrame([*edges, (None, 5), (7, None)], "a int, b int")
    assert {x.node: x.root for x in graph.components(df, "a", "b").collect()} == plain_components(edges)
    assert graph.components(df.limit(0), "a", "b").count() == 0


def test_components_pass_over_the_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").mapInPandas(counted, "a long, b long")
    assert graph.components(edges, "a", "b").filter("root = 0").count() == 301 and seen.value == 300


MATCHES = "day int, no int, a string, b string, a_won int, note string"


def matches(r, n=400):
    """Three leagues; one player takes part in half of all matches of the first."""
    out = []
    for i in range(n):
        league = r.randrange(3)
        names = [f"{league}{c}" for c in "abcdefg"]
        a, b = r.sample(names, 2)
        out.append((i // 20, i, "0a" if league == 0 and b != "0a" and r.random() < 0.5 else a, b, r.randrange(2), f"m{i}"))
    return out


def test_prior_rates(spark):
    rows, past, want = matches(random.Random(2)), {}, {}
    for _, i, a, b, won, _ in rows:
        rate = lambda p: sum(past[p]) / len(past[p]) if past.get(p) else 0.5  # noqa: B023, E731
        want[i] = (rate(a), rate(b))
        past.setdefault(a, []).append(won)
        past.setdefault(b, []).append(1 - won)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), MATCHES).repartition(4)
    for bucket in (None, F.lit(1), F.col("no"), (F.col("day") / 3).cast("int")):
        out = rt.prior_win_rates(df, "a", "b", "a_won", ["day", "no"], bucket=bucket)
        assert out.columns == [*df.columns, "prior_a", "prior_b"]
        got = {x.no: (x.prior_a, x.prior_b) for x in out.collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert rt.prior_win_rates(df.limit(0), "a", "b", "a_won", ["day", "no"]).count() == 0


def test_prior_rates_carry_the_order_once(spark):
    df = spark.createDataFrame(matches(random.Random(3), 40), MATCHES)
    out = rt.prior_win_rates(df, "a", "b", "a_won", ["day", "no"])
    carried = [x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "AS m_match" in x and "struct" in x]
    assert carried and not any("struct(day" in x for x in carried)


def plain_elo(rows):
    ratings, out = {}, {}
    for _, i, a, b, won, _ in rows:
        ra, rb = ratings.get(a, 1500.0), ratings.get(b, 1500.0)
        change = 32 * (won - 1 / (1 + 10 ** ((rb - ra) / 400)))
        ratings[a], ratings[b] = ra + change, rb - change
        out[i] = (ra, rb, ra + change, rb - change)
    return out


def test_pools_and_elo(spark):
    rows = matches(random.Random(6))
    df = spark.createDataFrame(rows, MATCHES).repartition(5)
    assert {x.player: x.pool for x in rt.pools(df, "a", "b").collect()} == {f"{k}{c}": f"{k}a" for k in "012" for c in "abcdefg"}
    out = rt.elo(df, None, "a", "b", "a_won", ["day", "no"])
    assert out.columns == [*df.columns, "elo_a", "elo_b", "elo_a_after", "elo_b_after"]
    assert {x.no: pytest.approx(tuple(x)[-4:]) for x in out.collect()} == plain_elo(rows)


def test_rated_careers(spark):
    """Ratings in force, apart, and careers apart; players without a profile have no row but count for the ratings."""
    rows = matches(random.Random(4), 120)
    profiles = {f"{k}{c}": (20 + i, 10 * k + i, 5 * i, i, k) for k in range(3) for i, c in enumerate("abcdef")}
    table = spark.createDataFrame([(p, *v) for p, v in profiles.items()], "player string, age int, events int, matches int, wins int, titles int")
    out = rt.rated_careers(spark.createDataFrame(rows, MATCHES), table, "a", "b", "a_won", ["day", "no"])
    got, elos = {x.no: x for x in out.collect()}, plain_elo(rows)
    assert got.keys() == {i for _, i, a, b, _, _ in rows if a in profiles and b in profiles} and any("g" in a + b for _, _, a, b, _, _ in rows)
    for _, i, a, b, _, note in rows:
        if i in got:
            x, (age, events, played, wins, titles), (age2, events2, played2, wins2, titles2) = got[i], profiles[a], profiles[b]
            want = (elos[i][0] - elos[i][1], age - age2, events - events2, played - played2, wins / (played + 1e-6) - wins2 / (played2 + 1e-6), titles - titles2)
            assert (x.elo_diff, x.age_diff, x.events_diff, x.matches_diff, x.win_rate_diff, x.titles_diff) == pytest.approx(want, abs=1e-9) and x.note == note
