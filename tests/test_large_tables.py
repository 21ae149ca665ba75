"""What only larger tables show: plans that must not broadcast, keys with more digits, work that must not grow with pairs."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.operators import fold_fits as ff
from courtside.operators import joins as jn
from courtside.operators import learning as ml
from courtside.plans import learned, projections, relations
from courtside.shipping import ship
from tests.test_folds_and_logs import one_fit


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_name_parse_takes_keys_of_more_than_six_digits(spark, tmp_path):
    spark.createDataFrame([(7, "hot bolt"), (1_234_567, "hot ring")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.p_partkey: r.frame for r in projections.name_parse(spark, str(tmp_path)).collect()} == {7: 7, 1_234_567: 1_234_567}


def test_name_search_broadcasts_no_exploded_names(spark, tmp_path):
    spark.range(1000).select("id", F.concat(F.lit("name "), "id").alias("n")).write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names")
    found = jn.name_search(names, "n", names.select(F.substring("n", 1, 6).alias("w")), "w")
    assert "BroadcastExchange" not in plan_of(found)
    assert found.count() == sum(f"name {j}" in f"name {i}" for i in range(1000) for j in range(10))


def test_player_search_searches_names_not_matches(spark):
    matches = spark.range(2000).selectExpr("id AS no", "concat('player ', id % 5) AS name_a", "concat('guest ', id % 3) AS name_b", "id AS age_a", "-id AS age_b")
    searches = spark.createDataFrame([("R 2",), ("guest",), ("x",)], "w string")
    found = jn.player_search(matches, searches, "w", {"a": "name_a", "b": "name_b"}, F.col("no"), ["age"])
    assert sorted(map(tuple, found.collect())) == [("guest", "b", "guest 1", -1999), ("r 2", "a", "player 2", 1997)]
    assert "Range (0, 2000" not in plan_of(found)  # a name's last match is found before names are cut up and searched


def test_positions_and_their_sql_leave_out_the_same_calibrations(spark, tmp_path):
    """A mark whose upper side is under SIDE is valid for the tracker, but no calibration."""
    rows = [(1, "signup", 10.0, 5), (2, "click", 20.0, 7), (3, "signup", 290.0, 0), (4, "click", 30.0, 9)]
    events = spark.createDataFrame([(i, i, 7, kind, x, f'{{"k": {k}}}') for i, kind, x, k in rows], "event_id long, t long, user_id long, event_type string, value double, props string")
    events.coalesce(1).select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    said = sorted(con.execute(learned.ORACLES["tracked_positions"]).fetchall())
    assert len(said) == 2 and sorted(map(tuple, learned.tracked_positions(spark, str(tmp_path)).select("match_id", "frame", "x_m", "y_m").collect())) == said


def test_folds_near_the_whole_fit_are_solved_without_rounds_over_the_rows(spark, monkeypatch):
    ship(spark)
    r, n = np.random.default_rng(5), 40_000
    x = r.random((n, 2))
    y = (r.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(int)
    fold = np.where(np.arange(n) < 9_000, -1, np.arange(n))  # one large fold, which goes through the rounds
    df = spark.createDataFrame(list(zip(fold.tolist(), x[:, 0].tolist(), x[:, 1].tolist(), y.tolist(), strict=True)), "fold long, a double, b double, label int")
    held, rounds = [], ff._rounds
    monkeypatch.setattr(ff, "_rounds", lambda rows, folds, ridge: held.append(len(folds)) or rounds(rows, folds, ridge))
    got = {f.fold: [f.intercept, *f.weights] for f in ff.fitted_folds(df, "fold", ["a", "b"], "label").collect()}
    assert len(got) == len(set(fold.tolist())) and held[0] == 1 and sum(held) < 1000
    for k in (-1, 9_000, 23_456, 39_999):
        assert got[k] == pytest.approx(one_fit(x[fold != k], y[fold != k], 1.0), abs=1e-9)


def test_folds_pass_over_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    df = spark.range(400).selectExpr("id % 2 AS fold", "rand(1) AS live", "rand(2) AS career", "int(rand(3) * 2) AS label").mapInPandas(counted, "fold long, live double, career double, label int")
    assert ml.folds(df, "fold", {"meta": ml.meta("live", "career")}).count() == 2 and seen.value == 400


def test_model_comparison_trains_the_whole_boosted_model(spark, monkeypatch):
    """All trees of the default model at their depth, not a smaller one."""
    points = spark.range(40).selectExpr("id AS match_id", "rand(1) AS x_diff", "rand(2) AS y_diff", "rand(3) AS conf_mean", "rand(4) AS duration", "int(id % 2) AS label")
    compared = []
    monkeypatch.setattr(learned, "_points", lambda spark, d: points)
    monkeypatch.setattr(ml, "compare", lambda train, test, pipelines: compared.append(pipelines))
    learned.model_comparison(spark, "")
    assert list(compared[0]) == ["logistic", "boosted"]
    trees = compared[0]["boosted"].getStages()[-1]
    assert (trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize()) == (200, 5, 0.05)
    assert (trees.getSubsamplingRate(), trees.getFeatureSubsetStrategy()) == (0.8, "0.8")


def test_models_are_fitted_with_a_folder_for_checkpoints(spark):
    """Also where the session names none: the lineage of 200 trees overflows the stack."""
    scala, was = spark.sparkContext._jsc.sc(), spark.sparkContext._jsc.sc().getCheckpointDir()
    rows = spark.createDataFrame([(i / 20, (i * 7 % 20) / 20, int(i > 9)) for i in range(20)], "live double, career double, label int")
    getattr(scala, "checkpointDir_$eq")(spark._jvm.scala.Option.empty())
    try:
        assert ml.compare(rows, rows, {"meta": ml.meta("live", "career")}).count() == 1
        assert spark.sparkContext.getCheckpointDir() is not None
    finally:
        getattr(scala, "checkpointDir_$eq")(was)


@pytest.fixture
def unbroadcast(spark):
    """Joins as of tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairing_features_shuffle_no_pairs(spark, tmp_path, unbroadcast):
    """Suppliers listed twice, in two nations or in none, players who met half of their nation, and suppliers without a match."""
    r = np.random.default_rng(8)
    suppliers = [(i, i % 3 if i % 50 else None) for i in range(200)] + [(7, 1), (7, 2), (60, 0)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(i, int(p), int(s), 1, float(i), "ANR"[i % 3]) for i, (p, s) in enumerate(zip(r.integers(0, 12, 1500), r.integers(0, 180, 1500), strict=True))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").selectExpr(
        "*", "0d AS l_extendedprice", "0d AS l_discount", "0d AS l_tax", "'O' AS l_linestatus", "timestamp_seconds(l_orderkey) AS l_shipdate"
    ).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = relations.pairing_features(spark, str(tmp_path))
    said = con.execute(relations.PAIRING).fetchall()
    assert len(said) > 4000 and sorted(map(tuple, got.collect())) == sorted(said)
    plan = plan_of(got)
    assert "Exchange" not in plan[: plan.index("(s_suppkey_a")]  # nothing is shuffled after the step that makes the pairs


@pytest.mark.parametrize("blocks", [1, 5])
def test_pairs_with_known(spark, blocks):
    df = spark.createDataFrame([("x", 1, 10), ("x", 2, 20), ("x", 2, 21), ("x", 3, None), ("y", 1, 11), ("y", 3, 31), (None, 1, 0), (None, 2, 0), ("x", None, 0)], "k string, m long, c long")
    known = spark.createDataFrame([(1, 3, "met"), (2, 3, None), (1, 9, "gone")], "low long, high long, how string")
    out = jn.pairs_with_known(df, ["k"], "m", ["c"], known, "low", "high", "how", "none", blocks)
    assert out.columns == ["k", "m_a", "c_a", "m_b", "c_b", "how"]
    assert sorted(map(tuple, out.collect()), key=str) == [
        ("x", 1, 10, 2, 20, "none"), ("x", 1, 10, 2, 21, "none"), ("x", 1, 10, 3, None, "met"), ("x", 2, 20, 3, None, "none"), ("x", 2, 21, 3, None, "none"), ("y", 1, 11, 3, 31, "met"),
    ]
